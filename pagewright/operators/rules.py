"""Page rules. ``page_rules(s)`` are the seven groups over one snapshot, in their fixed order.

Ids, severities and predicates are the contract; the wording is this module's own. Everything is a Column,
so the same rules run on batches and streams.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import marks as M
from pagewright.operators.findings import FINDING, Rule

#: Pixels a letter takes, and the widths that results show.
TITLE_PX, TITLE_MAX, TITLE_MIN = 9.2, 580, 30
DESC_PX, DESC_MAX, DESC_MIN = 6.6, 960, 70
THIN, SHORT = 150, 300


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def many(n: Column, one: str, more: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {more}"))


def any_of(items: Column, test) -> Column:
    return yes(F.exists(items, test))


def count_of(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def directives(s: Column, x_robots: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(s["robotsMeta"]["content"], F.lit("")), F.coalesce(s["googlebotMeta"]["content"], F.lit("")), F.coalesce(x_robots, F.lit(""))))


def indexability(s: Column, x_robots: Column) -> list[Rule]:
    a, d = "indexability", directives(s, x_robots)
    noindex, header = T.word_in(d, "noindex"), T.word_in(F.lower(x_robots), "noindex")
    own, url = s["canonical"]["href"], s["url"]
    single, href_host = s["canonical"]["count"] == 1, T.host_of(own)
    cross = single & ~T.blank(own) & yes(F.coalesce(href_host, s["host"]) != s["host"])
    other = single & ~cross & ~T.no_fragment(own).eqNullSafe(T.no_fragment(url))
    return [
        Rule(a, "index.noindex", "fail", noindex, "Kept out of search results", F.when(header, "The X-Robots-Tag header says noindex.").otherwise("The robots meta tag says noindex."), "Take noindex away if the page should be found."),
        Rule(a, "index.indexable", "pass", ~noindex & ((s["robotsMeta"]["count"] > 0) | ~T.blank(x_robots)), "May be indexed", d),
        Rule(a, "index.nofollow", "warn", T.word_in(d, "nofollow"), "No link of the page is followed", None, "Drop nofollow for the page; mark single links instead."),
        *(Rule(a, f"index.{x}", "note", d.contains(x), f"Directive {x} is set") for x in ("noarchive", "nosnippet", "noimageindex")),
        Rule(a, "index.max-snippet-zero", "warn", d.rlike(r"max-snippet:\s*0"), "Snippets are switched off", None, "Allow snippets, or results show no text."),
        Rule(a, "canon.missing", "warn", s["canonical"]["count"] == 0, "No canonical address", None, "Name the page's own address as canonical."),
        Rule(a, "canon.multiple", "fail", s["canonical"]["count"] > 1, F.concat(s["canonical"]["count"].cast("string"), F.lit(" canonical addresses")), T.some_of(F.array_compact(s["canonical"]["all"])), "Keep one."),
        Rule(a, "canon.relative", "note", single & ~T.blank(s["canonical"]["raw"]) & ~yes(F.lower(s["canonical"]["raw"]).rlike("^https?:")), "The canonical address is relative", s["canonical"]["raw"], "Write it in full."),
        Rule(a, "canon.cross-domain", "warn", cross, "The canonical address is on another host", own, "Check that the other site should rank instead."),
        Rule(a, "canon.other", "warn", other, "The canonical address is another page", own, "Check that the other page should rank instead."),
        Rule(a, "canon.self", "pass", single & ~cross & ~other, "Canonical to itself"),
        Rule(a, "index.meta-refresh", "warn", ~T.blank(s["metaRefresh"]), "Redirects by meta refresh", s["metaRefresh"], "Redirect on the server."),
        Rule(a, "index.http", "fail", s["protocol"].eqNullSafe("http:"), "Served without encryption", None, "Serve over https and redirect to it."),
    ]


def first_h1(s: Column) -> Column:
    return F.try_element_at(F.filter(s["headings"], lambda h: h["level"] == 1), F.lit(1))["text"]


def width(text: Column, measured: Column, letter: float) -> Column:
    """Measured pixels, or an estimate from the length."""
    return F.coalesce(F.when(measured > 0, measured.cast("double")), F.round(F.length(text) * letter))


def meta(s: Column, title_px: Column, desc_px: Column) -> list[Rule]:
    a, title, desc = "meta", s["title"]["text"], s["description"]["content"]
    has_t, has_d = ~T.blank(title), ~T.blank(desc)
    tw, dw = width(title, title_px, TITLE_PX), width(desc, desc_px, DESC_PX)
    t_long, d_long = has_t & (tw > TITLE_MAX), has_d & (dw > DESC_MAX)
    t_short, d_short = has_t & ~t_long & (F.length(title) < TITLE_MIN), has_d & ~d_long & (F.length(desc) < DESC_MIN)
    h1, og = first_h1(s), ["og:title", "og:description", "og:image"]
    lost = F.filter(F.array(*map(F.lit, og)), lambda k: T.blank(F.try_element_at(s["og"], k)))
    og_url = F.try_element_at(s["og"], F.lit("og:url"))
    return [
        Rule(a, "title.missing", "fail", ~has_t, "No title", None, "Write one that names the page."),
        Rule(a, "title.multiple", "warn", s["title"]["count"] > 1, F.concat(s["title"]["count"].cast("string"), F.lit(" title elements")), T.some_of(s["title"]["all"]), "Keep one."),
        Rule(a, "title.long", "warn", t_long, "The title is cut off in results", F.concat(tw.cast("int").cast("string"), F.lit(" px of "), F.lit(str(TITLE_MAX))), "Shorten it."),
        Rule(a, "title.short", "warn", t_short, "The title is short", title, "Use the room that is left."),
        Rule(a, "title.ok", "pass", has_t & ~t_long & ~t_short, "The title fits", title),
        Rule(a, "title.same-as-h1", "note", has_t & ~T.blank(h1) & (F.trim(h1) == F.trim(title)), "Title and H1 are the same", title),
        Rule(a, "desc.missing", "warn", ~has_d, "No description", None, "Write a sentence or two for results."),
        Rule(a, "desc.multiple", "warn", s["description"]["count"] > 1, F.concat(s["description"]["count"].cast("string"), F.lit(" descriptions")), None, "Keep one."),
        Rule(a, "desc.long", "warn", d_long, "The description is cut off in results", F.concat(dw.cast("int").cast("string"), F.lit(" px of "), F.lit(str(DESC_MAX))), "Shorten it."),
        Rule(a, "desc.short", "warn", d_short, "The description is short", desc, "Use the room that is left."),
        Rule(a, "desc.ok", "pass", has_d & ~d_long & ~d_short, "The description fits"),
        Rule(a, "meta.viewport", "fail", T.blank(s["viewport"]), "No viewport", None, "Set width=device-width."),
        Rule(a, "meta.lang", "warn", T.blank(s["lang"]), "No language on the document", None, "Set lang on the html element."),
        Rule(a, "meta.charset", "note", T.blank(s["charset"]) & T.blank(s["metaCharset"]), "No character set declared", None, "Declare utf-8 first thing in the head."),
        Rule(a, "og.missing", "warn", F.size(lost) == 3, "No Open Graph tags", None, "Set title, description and image for shares."),
        Rule(a, "og.partial", F.when(F.array_contains(lost, "og:image"), "warn").otherwise("note"), F.size(lost).between(1, 2), "Open Graph tags are incomplete", F.array_join(lost, ", "), "Add what is missing."),
        Rule(a, "og.url-mismatch", "warn", ~T.blank(og_url) & ~T.blank(s["canonical"]["href"]) & (T.no_fragment(og_url) != T.no_fragment(s["canonical"]["href"])), "og:url and the canonical address differ", og_url, "Make them the same."),
    ]


def page_words(s: Column) -> Column:
    return F.coalesce(F.nullif(s["content"]["mainWords"], F.lit(0)), s["content"]["bodyWords"], F.lit(0))


def content(s: Column) -> list[Rule]:
    a, h1 = "content", F.filter(s["headings"], lambda h: h["level"] == 1)
    n, words, m = F.size(h1), page_words(s), F.flatten(M.heading_marks(s["headings"]))
    of = lambda id_: F.filter(m, lambda x: x["id"] == id_)
    sole_empty = (n == 1) & yes(F.try_element_at(h1, F.lit(1))["empty"])
    jumps = F.transform(of("head.skipped"), lambda x: x["label"])
    return [
        Rule(a, "h1.missing", "fail", n == 0, "No H1", None, "Give the page one main heading."),
        Rule(a, "h1.multiple", "warn", n > 1, F.concat(n.cast("string"), F.lit(" H1 headings")), T.some_of(F.transform(h1, lambda h: h["text"])), "Keep one, make the others H2."),
        Rule(a, "h1.empty", "fail", sole_empty, "The H1 is empty", None, "Put text into it."),
        Rule(a, "h1.ok", "pass", (n == 1) & ~sole_empty, "One H1", F.try_element_at(h1, F.lit(1))["text"]),
        Rule(a, "head.empty", "note", F.size(of("head.empty")) > 0, many(F.size(of("head.empty")), "heading without text", "headings without text"), None, "Remove or fill them."),
        Rule(a, "head.skipped", "note", F.size(jumps) > 0, F.concat(F.lit("Heading levels are skipped: "), F.array_join(F.slice(jumps, 1, 2), ", ")), None, "Go down one level at a time."),
        Rule(a, "content.thin", "warn", words < THIN, F.concat(F.lit("Little text: "), many(words, "word", "words")), None, "Say more, or merge the page with another."),
        Rule(a, "content.short", "note", (words >= THIN) & (words < SHORT), F.concat(F.lit("Short text: "), many(words, "word", "words"))),
        Rule(a, "content.ok", "pass", words >= SHORT, many(words, "word", "words")),
        Rule(a, "content.no-main", "note", ~yes(s["content"]["hasMain"]), "No main or article element", None, "Wrap the content in main."),
    ]


def links(s: Column) -> list[Rule]:
    a, ls = "links", s["links"]
    real = count_of(ls, M.link_real)
    inside = count_of(ls, lambda x: M.link_real(x) & x["internal"].eqNullSafe(True))
    outside = count_of(ls, lambda x: M.link_real(x) & x["internal"].eqNullSafe(False))
    generic, dead = count_of(ls, M.link_generic), count_of(ls, lambda x: x["kind"] == "no-href")
    scripts = s["specialLinks"]["javascript"]
    return [
        Rule(a, "link.no-text", "warn", any_of(ls, M.link_silent), many(count_of(ls, M.link_silent), "link without text", "links without text"), T.some_of(F.transform(F.filter(ls, M.link_silent), lambda x: F.coalesce(x["href"], F.lit("")))), "Give them text or a label."),
        Rule(a, "link.generic", "note", generic > 2, many(generic, "link says", "links say"), T.some_of(F.array_distinct(F.transform(F.filter(ls, M.link_generic), lambda x: x["text"]))), "Name the target in the link."),
        Rule(a, "link.internal-nofollow", "warn", any_of(ls, M.link_inside_nofollow), many(count_of(ls, M.link_inside_nofollow), "link to an own page is nofollow", "links to own pages are nofollow"), None, "Drop nofollow inside the site."),
        Rule(a, "link.javascript", "warn", yes(scripts > 0), many(scripts, "javascript: link", "javascript: links"), None, "Use addresses."),
        Rule(a, "link.no-href", "note", dead > 2, many(dead, "anchor without target", "anchors without target"), None, "Use buttons, or give them a target."),
        Rule(a, "link.many", "note", real > 300, many(real, "link", "links")),
        Rule(a, "link.no-internal", "warn", (inside == 0) & (real > 0), "No link to an own page", None, "Link to related pages."),
        Rule(a, "link.ok", "pass", inside > 0, F.concat(inside.cast("string"), F.lit(" internal, "), outside.cast("string"), F.lit(" external"))),
    ]


def images(s: Column) -> list[Rule]:
    a, im = "images", s["images"]
    some, n = F.size(im) > 0, lambda t: count_of(im, t)
    srcs = lambda t: T.some_of(F.transform(F.filter(im, t), lambda i: F.coalesce(i["src"], F.lit(""))))
    ratio = F.array_max(F.transform(F.filter(im, M.image_oversized), lambda i: i["naturalWidth"] / i["displayWidth"]))
    return [
        Rule(a, "img.broken", "fail", any_of(im, M.image_broken), many(n(M.image_broken), "image does not load", "images do not load"), srcs(M.image_broken), "Fix the addresses."),
        Rule(a, "img.no-alt", "warn", any_of(im, M.image_no_alt), many(n(M.image_no_alt), "image without alt", "images without alt"), srcs(M.image_no_alt), "Describe them; decoration gets an empty alt."),
        Rule(a, "img.alt-ok", "pass", some & ~any_of(im, M.image_no_alt), "Every image has alt"),
        Rule(a, "img.oversized", "warn", any_of(im, M.image_oversized), many(n(M.image_oversized), "image is sent too large", "images are sent too large"), F.concat(F.lit("up to "), F.format_number(ratio, 1), F.lit(" times")), "Send them at the size they are shown."),
        Rule(a, "img.no-dims", "warn", any_of(im, M.image_no_size), many(n(M.image_no_size), "image without width and height", "images without width and height"), None, "Set both, so the page does not jump."),
        Rule(a, "img.lazy-lcp", "warn", any_of(im, M.image_lazy), many(n(M.image_lazy), "image in view is lazy", "images in view are lazy"), None, "Load at once what is seen first."),
        Rule(a, "img.format", "note", n(M.image_old) > 3, many(n(M.image_old), "image in an old format", "images in old formats"), None, "Serve WebP or AVIF."),
    ]


def ld_nodes(s: Column) -> Column:
    return F.flatten(F.transform(F.filter(s["structuredData"]["jsonLd"], lambda b: b["ok"]), lambda b: b["nodes"]))


def ld_types(s: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(ld_nodes(s), lambda n: n["types"])))


def findings_of(items: Column, make) -> Column:
    """One finding for each item: make(item) gives severity, area, id, title, detail, fix."""
    names = ("severity", "area", "id", "title", "detail", "fix")
    return F.transform(items, lambda x: F.struct(*((v if isinstance(v, Column) else F.lit(v).cast("string")).alias(k) for k, v in zip(names, make(x), strict=True)))).cast(FINDING)


def schema(s: Column) -> list[Rule | Column]:
    a, blocks, nodes = "schema", s["structuredData"]["jsonLd"], ld_nodes(s)
    broken, has = F.filter(blocks, lambda b: ~b["ok"]), F.size(nodes) > 0
    lacking = F.filter(nodes, lambda n: F.size(M.node_missing(n)) > 0)
    product = F.try_element_at(F.filter(nodes, lambda n: F.array_contains(n["types"], "Product")), F.lit(1))
    return [
        Rule(a, "schema.parse", "fail", F.size(broken) > 0, many(F.size(broken), "block cannot be read", "blocks cannot be read"), F.try_element_at(broken, F.lit(1))["error"], "Mend the JSON."),
        Rule(a, "schema.none", "warn", ~has & (F.size(broken) == 0), "No structured data", None, "Describe the page with JSON-LD."),
        Rule(a, "schema.present", "pass", has, F.concat(F.lit("Structured data: "), F.array_join(ld_types(s), ", "))),
        findings_of(lacking, lambda n: ("warn", a, F.concat(F.lit("schema.required."), M.node_type(n)), F.concat(M.node_type(n), F.lit(" is incomplete")), F.array_join(M.node_missing(n), ", "), "Add the properties.")),
        Rule(a, "schema.product-no-offer", "note", product.isNotNull() & ~F.arrays_overlap(product["present"], F.array(F.lit("offers"), F.lit("sku"), F.lit("gtin"))), "Product without offer, sku or gtin"),
        Rule(a, "schema.no-id", "note", has & ~any_of(nodes, lambda n: ~T.blank(n["id"])), "No node has an @id", None, "Give nodes ids, so they can refer to each other."),
    ]


def international(s: Column) -> list[Rule]:
    a, rows = "international", s["hreflang"]
    bad = F.filter(rows, lambda r: ~T.blank(r["hreflang"]) & ~M.lang_valid(r["hreflang"]))
    some, own = F.size(rows) > 0, any_of(rows, lambda r: T.clean_url(r["href"]).eqNullSafe(T.clean_url(s["url"])))
    return [
        Rule(a, "hreflang.invalid", "warn", F.size(bad) > 0, many(F.size(bad), "invalid hreflang code", "invalid hreflang codes"), T.some_of(F.transform(bad, lambda r: r["hreflang"])), "Use language and region codes."),
        Rule(a, "hreflang.no-self", "warn", some & ~own, "No hreflang points to the page itself", None, "Add one."),
        Rule(a, "hreflang.no-xdefault", "note", (F.size(rows) > 1) & ~any_of(rows, lambda r: r["hreflang"].eqNullSafe("x-default")), "No x-default"),
        Rule(a, "hreflang.ok", "pass", some & own & (F.size(bad) == 0), F.concat(F.size(rows).cast("string"), F.lit(" hreflang rows are in order"))),
    ]


def page_rules(s: Column, x_robots: Column | None = None, title_px: Column | None = None, desc_px: Column | None = None) -> list[Rule | Column]:
    none = lambda c, t: c if c is not None else F.lit(None).cast(t)
    return [*indexability(s, none(x_robots, "string")), *meta(s, none(title_px, "double"), none(desc_px, "double")), *content(s), *links(s), *images(s), *schema(s), *international(s)]


def link_status_rules(results: Column) -> list[Rule]:
    """results: array of (url, severity, status)."""
    a = "links"
    of = lambda t: F.filter(results, t)
    fail = of(lambda r: r["severity"] == "fail")
    wall = of(lambda r: (r["severity"] == "warn") & yes(r["status"].isin(M.WALLED)))
    moved = of(lambda r: (r["severity"] == "warn") & ~yes(r["status"].isin(M.WALLED)))
    urls = lambda x: T.some_of(F.transform(x, lambda r: r["url"]))
    return [
        Rule(a, "link.broken", "fail", F.size(fail) > 0, many(F.size(fail), "link is broken", "links are broken"), urls(fail), "Mend or remove them."),
        Rule(a, "link.redirect", "warn", F.size(moved) > 0, many(F.size(moved), "link redirects", "links redirect"), urls(moved), "Link to the final address."),
        Rule(a, "link.blocked", "warn", F.size(wall) > 0, many(F.size(wall), "link refuses robots", "links refuse robots"), urls(wall), "Open them by hand."),
        Rule(a, "link.status-ok", "pass", (F.size(results) > 0) & (F.size(fail) + F.size(wall) + F.size(moved) == 0), many(F.size(results), "link answers", "links answer")),
    ]


def share(raw: Column, rendered: Column) -> Column:
    return F.when(rendered > 0, F.round(raw / F.nullif(rendered, F.lit(0)) * 100)).otherwise(0.0)


def javascript_gap(live: Column, raw: Column) -> list[Rule]:
    """What a page shows only after its scripts ran. raw is null where the HTML was not fetched."""
    a, no = "ai", raw.isNull()
    rendered, sent = page_words(live), page_words(raw)
    part, ld = share(sent, rendered), lambda s: F.size(s["structuredData"]["jsonLd"])
    absent, h1 = lambda s, f: ~T.blank(s[f.split(".")[0]][f.split(".")[1]]), lambda s: any_of(s["headings"], lambda h: (h["level"] == 1) & ~T.blank(h["text"]))
    gone = F.array_compact(F.array(*(F.when(lv & ~rw, name) for name, lv, rw in (
        ("title", absent(live, "title.text"), absent(raw, "title.text")), ("description", absent(live, "description.content"), absent(raw, "description.content")),
        ("canonical", absent(live, "canonical.href"), absent(raw, "canonical.href")), ("H1", h1(live), h1(raw))))))
    inside = lambda s: count_of(s["links"], lambda x: x["internal"].eqNullSafe(True))
    missing, partial = (rendered >= 150) & (part < 10), (rendered >= 150) & (part >= 10) & (part < 60)
    lost = (inside(live) >= 5) & (inside(raw) == 0)
    pct = F.concat(part.cast("int").cast("string"), F.lit(" % of the words are in the HTML as sent"))
    return [
        Rule(a, "js.no-raw", "note", no, "The HTML as sent is not known"),
        Rule(a, "js.logged-in", "note", ~no & yes(raw["page"]["passwordFields"] > 0) & yes(live["page"]["passwordFields"] == 0), "The HTML as sent asks for a password"),
        Rule(a, "js.content-missing", "fail", ~no & missing, "The text is made by scripts", pct, "Render on the server."),
        Rule(a, "js.content-partial", "warn", ~no & partial, "Much of the text is made by scripts", pct, "Render the main text on the server."),
        Rule(a, "js.content-ok", "pass", ~no & ~missing & ~partial & (rendered > 0), "The text is in the HTML as sent", pct),
        Rule(a, "js.head-injected", "fail", ~no & (F.size(gone) > 0), "Made by scripts only", F.array_join(gone, ", "), "Send them in the HTML."),
        Rule(a, "js.schema-injected", "warn", ~no & (ld(live) > ld(raw)), "Structured data is made by scripts", None, "Send it in the HTML."),
        Rule(a, "js.links-missing", "fail", ~no & lost, "Internal links are made by scripts", None, "Send them in the HTML."),
        Rule(a, "js.links-partial", "warn", ~no & ~lost & (inside(live) > 0) & (inside(raw) < inside(live) / 2), "Most internal links are made by scripts", None, "Send them in the HTML."),
    ]


def crawler_access(s: Column, verdict: Column, grid: Column) -> list[Rule]:
    """verdict of robots.txt (read, open, blocked) and grid: array of (id, group, allowed), empty where it is no robots.txt."""
    a, usable = "ai", verdict == "read"
    blocked = F.filter(grid, lambda g: ~g["allowed"])
    ids = lambda t: F.transform(F.filter(blocked, t), lambda g: g["id"])
    search, google = ids(lambda g: g["group"] == "search"), ids(lambda g: g["id"] == "Google-Extended")
    ai = ids(lambda g: (g["group"] == "ai") & (g["id"] != "Google-Extended"))
    asked, d = usable & (F.size(grid) > 0), F.lower(F.coalesce(s["robotsMeta"]["content"], F.lit("")))
    return [
        Rule(a, "robots.availability", F.when(verdict == "blocked", "fail").otherwise("note"), ~usable, F.concat(F.lit("robots.txt: "), verdict)),
        Rule(a, "robots.search-blocked", "fail", asked & (F.size(search) > 0), "Search crawlers are shut out", F.array_join(search, ", "), "Allow them in robots.txt."),
        Rule(a, "robots.google-extended", "warn", asked & (F.size(google) > 0), "Google-Extended is shut out"),
        Rule(a, "robots.ai-blocked", "note", asked & (F.size(ai) > 0), "Answer engines are shut out", F.array_join(ai, ", ")),
        Rule(a, "robots.all-allowed", "pass", asked & (F.size(blocked) == 0), "Every crawler asked about may read the page"),
        Rule(a, "meta.noai", "note", asked & d.rlike("noai|noimageai"), "The robots meta tag says noai"),
    ]


def probe_findings(probes: Column, base_bytes: Column) -> Column:
    """One finding a probe (agent, status, bytes, error) against what a browser got."""
    change = lambda p: F.abs(p["bytes"] - base_bytes) / F.nullif(base_bytes, F.lit(0))
    kind = lambda p: F.when(~T.blank(p["error"]), "error").when(p["status"].isin(401, 403, 429), "blocked").when(yes(base_bytes > 0) & yes(change(p) > 0.3), "different").otherwise("ok")
    level = F.create_map(*(F.lit(x) for x in ("error", "note", "blocked", "fail", "different", "warn", "ok", "pass")))
    return findings_of(probes, lambda p: (F.try_element_at(level, kind(p)), "ai", F.concat(F.lit("probe."), kind(p), F.lit("."), p["agent"]), F.concat(p["agent"], F.lit(": "), kind(p)), F.coalesce(p["error"], F.concat(F.lit("status "), p["status"].cast("string"))), None))


def llms_rules(html: Column, present: Column, h1: Column, summary: Column) -> list[Rule]:
    a, html, present = "ai", yes(html), yes(present)
    return [
        Rule(a, "llms.html", "note", html, "llms.txt answers with a web page"),
        Rule(a, "llms.present", F.when(yes(h1) & yes(summary), "pass").otherwise("note"), ~html & present, "llms.txt is there"),
        Rule(a, "llms.absent", "note", ~html & ~present, "No llms.txt"),
    ]


def citability(s: Column) -> list[Rule]:
    a, shape, types = "ai", lambda f: F.coalesce(s["content"]["shape"][f], F.lit(0)), ld_types(s)
    low = F.transform(types, F.lower)
    publisher = F.arrays_overlap(low, F.array(*map(F.lit, ("organization", "localbusiness", "person"))))
    article = F.arrays_overlap(types, F.array(F.lit("Article"), F.lit("BlogPosting")))
    return [
        Rule(a, "cite.long-lead", "warn", shape("firstParagraphWords") > 90, "The first paragraph is long", None, "Answer in the first two sentences."),
        Rule(a, "cite.long-paras", "note", shape("paragraphsOver120Words") > 0, "Long paragraphs", None, "Split them."),
        Rule(a, "cite.no-questions", "note", (F.coalesce(s["content"]["questionHeadings"], F.lit(0)) == 0) & (F.size(s["headings"]) > 3), "No heading asks a question"),
        Rule(a, "cite.no-structure", "note", (page_words(s) > 600) & (shape("lists") == 0) & (shape("tables") == 0), "Long text without list or table"),
        Rule(a, "cite.no-schema", "warn", F.size(types) == 0, "No structured data to cite by", None, "Add JSON-LD."),
        Rule(a, "cite.no-publisher", "note", (F.size(types) > 0) & ~yes(publisher), "No publisher in the structured data"),
        Rule(a, "cite.no-date", "note", (F.size(s["content"]["shape"]["timeElements"]) == 0) & ~yes(article), "No date"),
        Rule(a, "cite.iframes", "note", shape("contentInIframes") > 0, "Content sits in frames"),
    ]
