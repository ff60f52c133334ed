"""Row marks: what is to be said of one heading, link, image, JSON-LD block or hreflang row.

Each function maps an array column of a snapshot to an array of (severity, id, label) lists, one a row, in
place; the tests are the ones that the rules count with. A null severity is context, not a fault.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import text as T

MARK = "struct<severity:string,id:string,label:string>"
#: Properties that a structured-data type needs.
REQUIRED = {
    "Article": ["headline", "image", "datePublished", "author"],
    "BlogPosting": ["headline", "image", "datePublished", "author"],
    "NewsArticle": ["headline", "image", "datePublished", "author"],
    "Product": ["name", "image", "offers"],
    "LocalBusiness": ["name", "address", "telephone"],
    "Organization": ["name", "url"],
    "FAQPage": ["mainEntity"],
    "BreadcrumbList": ["itemListElement"],
    "Event": ["name", "startDate", "location"],
    "Recipe": ["name", "image", "recipeIngredient"],
    "Service": ["name", "provider"],
    "VideoObject": ["name", "thumbnailUrl", "uploadDate"],
}
#: A language code with optional script and region; answers of walls against robots.
LANG_CODE = r"^([a-z]{2,3})(-[a-zA-Z]{4})?(-([a-zA-Z]{2}|\d{3}))?$"
WALLED = [401, 403, 429, 999]
OLD_FORMATS = ["jpg", "jpeg", "png"]


def mark(when: Column, severity: str | Column | None, id_: str | Column, label: str | Column) -> Column:
    s = severity if isinstance(severity, Column) else F.lit(severity).cast("string")
    return F.when(when, F.struct(s.alias("severity"), (id_ if isinstance(id_, Column) else F.lit(id_)).alias("id"), (label if isinstance(label, Column) else F.lit(label)).alias("label")))


def listed(*marks: Column) -> Column:
    return F.array_compact(F.array(*marks))


# --- tests of one row, used by marks and findings alike
def link_real(a: Column) -> Column:
    return a["kind"] == "link"


def link_silent(a: Column) -> Column:
    return link_real(a) & T.blank(a["text"]) & T.blank(a["ariaLabel"]) & ~F.coalesce(a["hasImage"], F.lit(False))


def link_generic(a: Column) -> Column:
    return link_real(a) & T.generic_anchor(a["text"])


def link_nofollow(a: Column) -> Column:
    return T.has_token(a["rel"], "nofollow")


def link_inside_nofollow(a: Column) -> Column:
    return link_real(a) & a["internal"].eqNullSafe(True) & link_nofollow(a)


def image_broken(i: Column) -> Column:
    return i["broken"].eqNullSafe(True) & ~i["ext"].eqNullSafe("svg")


def image_shown(i: Column) -> Column:
    return ~F.coalesce(i["hidden"], F.lit(False))


def image_no_alt(i: Column) -> Column:
    return ~F.coalesce(i["hasAlt"], F.lit(False)) & image_shown(i)


def image_oversized(i: Column) -> Column:
    return F.coalesce((i["naturalWidth"] > 0) & (i["displayWidth"] > 20) & (i["naturalWidth"] > i["displayWidth"] * 2), F.lit(False))


def image_no_size(i: Column) -> Column:
    return (T.blank(i["widthAttr"]) | T.blank(i["heightAttr"])) & image_shown(i)


def image_lazy(i: Column) -> Column:
    return i["loading"].eqNullSafe("lazy") & i["inViewport"].eqNullSafe(True)


def image_old(i: Column) -> Column:
    return F.coalesce(i["ext"].isin(OLD_FORMATS), F.lit(False))


def lang_valid(code: Column) -> Column:
    return F.coalesce((code == "x-default") | code.rlike(LANG_CODE), F.lit(False))


# --- marks
def heading_marks(headings: Column) -> Column:
    """One fold over the headings in order: how many H1 so far, and the level of the last one seen that is shown and not empty."""
    h1s = F.size(F.filter(headings, lambda h: h["level"] == 1))
    start = F.struct(F.lit(0).alias("ones"), F.lit(0).alias("last"), F.array().cast(f"array<array<{MARK}>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        hidden, empty = F.coalesce(h["hidden"], F.lit(False)), F.coalesce(h["empty"], F.lit(False))
        ones = acc["ones"] + F.when(h["level"] == 1, 1).otherwise(0)
        shown = ~hidden & ~empty
        skipped = shown & (acc["last"] > 0) & (h["level"] > acc["last"] + 1)
        sole = (h["level"] == 1) & (h1s == 1)
        own = listed(
            mark((h["level"] == 1) & (ones > 1), "warn", "h1.multiple", "another H1"),
            mark(hidden, None, "head.hidden", "hidden"),
            mark(~hidden & empty, F.when(sole, "fail").otherwise("note"), F.when(sole, "h1.empty").otherwise("head.empty"), "no text"),
            mark(skipped, "note", "head.skipped", F.concat(F.lit("H"), acc["last"].cast("string"), F.lit(" to H"), h["level"].cast("string"))),
            mark(~h["region"].isin("main", "body"), None, "head.region", h["region"]),
        )
        return F.struct(ones.alias("ones"), F.when(shown, h["level"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.aggregate(headings, start, step, lambda acc: acc["out"])


def link_marks(links: Column) -> Column:
    return F.transform(links, lambda a: listed(
        mark(a["kind"] == "no-href", "note", "link.no-href", "no target"),
        mark(link_silent(a), "warn", "link.no-text", "no text"),
        mark(link_inside_nofollow(a), "warn", "link.internal-nofollow", "own page, nofollow"),
        mark(link_nofollow(a) & ~link_inside_nofollow(a), None, "link.nofollow", "nofollow"),
        mark(T.has_token(a["rel"], "sponsored"), None, "link.sponsored", "sponsored"),
        mark(T.has_token(a["rel"], "ugc"), None, "link.ugc", "user content"),
        mark(link_generic(a), "note", "link.generic", "says nothing"),
    ))


def image_marks(images: Column) -> Column:
    ratio = lambda i: F.concat(F.format_number(i["naturalWidth"] / F.when(i["displayWidth"] > 0, i["displayWidth"]), 1), F.lit("x"))
    return F.transform(images, lambda i: listed(
        mark(image_broken(i), "fail", "img.broken", "does not load"),
        mark(image_no_alt(i), "warn", "img.no-alt", "no alt"),
        mark(~image_no_alt(i) & F.coalesce(i["hasAlt"], F.lit(False)) & T.blank(i["alt"]), None, "img.decorative", "empty alt"),
        mark(image_oversized(i), "warn", "img.oversized", ratio(i)),
        mark(image_no_size(i), "warn", "img.no-dims", "no width or height"),
        mark(image_lazy(i), "warn", "img.lazy-lcp", "lazy in view"),
        mark(F.coalesce(i["hidden"], F.lit(False)), None, "img.hidden", "hidden"),
    ))


def required_map() -> Column:
    return F.create_map(*(x for t, props in REQUIRED.items() for x in (F.lit(t), F.array(*map(F.lit, props)))))


def node_type(n: Column) -> Column:
    """The first type of a node that needs properties; null if none does."""
    return F.try_element_at(F.filter(n["types"], lambda t: t.isin(list(REQUIRED))), F.lit(1))


def node_missing(n: Column) -> Column:
    return F.coalesce(F.array_except(F.try_element_at(required_map(), node_type(n)), n["present"]), F.array().cast("array<string>"))


def schema_marks(blocks: Column) -> Column:
    """For each block: severity, its types, ids, and the properties its nodes miss."""
    def block(b: Column) -> Column:
        missing = F.flatten(F.transform(b["nodes"], node_missing))
        severity = F.when(~b["ok"], "fail").when(F.size(missing) > 0, "warn").otherwise("pass")
        return F.struct(severity.alias("severity"), b["index"].alias("index"), F.flatten(F.transform(b["nodes"], lambda n: n["types"])).alias("types"), F.array_compact(F.transform(b["nodes"], lambda n: n["id"])).alias("ids"), missing.alias("missing"))

    return F.transform(blocks, block)


def hreflang_marks(rows: Column, url: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(r["hreflang"].alias("hreflang"), r["href"].alias("href"), lang_valid(F.trim(F.coalesce(r["hreflang"], F.lit("")))).alias("valid"), T.clean_url(r["href"]).eqNullSafe(T.clean_url(url)).alias("self")))


def link_status_verdict(status: Column, error: Column, redirected: Column) -> tuple[Column, Column]:
    """Severity and label of a link's answer; in this order: no answer, a wall, an error, a redirect, well."""
    none = ~T.blank(error) | (F.coalesce(status, F.lit(0)) == 0)
    walled, moved = status.isin(WALLED), F.coalesce(redirected, F.lit(False))
    severity = F.when(none, "fail").when(walled, "warn").when(status >= 400, "fail").when(moved, "warn").otherwise("pass")
    label = F.when(none, F.when(error == "timed out", "timeout").otherwise("failed")).when(~walled & (status < 400) & moved, F.concat(F.lit("redirect "), status.cast("string"))).otherwise(status.cast("string"))
    return severity, label
