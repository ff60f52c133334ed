"""From snapshots to findings, roll-ups, views and reports."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import findings as FD
from pagewright.operators import marks as M
from pagewright.operators import rules as R
from pagewright.operators import tech

#: The order of areas inside a severity, and the tabs a report has.
AREAS = ["indexability", "meta", "content", "links", "images", "schema", "international", "tech", "ai"]
TABS = ["summary", "headings", "links", "images", "schema", "social", "tech", "ai"]


@cache
def page_findings(application: str, optional: tuple[str, ...]) -> Column:
    """The findings of column s as one expression, built once an application: it is made of thousands of small ones."""
    has = lambda c: F.col(c) if c in optional else None
    return FD.evaluate(R.page_rules(F.col("s"), has("x_robots"), has("title_px"), has("desc_px")))


def unfinished(error: Column) -> Column:
    """The one finding of a page that could not be read."""
    return FD.evaluate([FD.Rule("ai", "run.error", "note", F.lit(True), "The check could not finish", error)])


def audit(snapshots: DataFrame, keep: bool = False) -> DataFrame:
    """snapshots (page_id, s; optional x_robots, title_px, desc_px) -> page_id, findings; with `keep` also s. Row-local: runs on streams as it is."""
    optional = tuple(c for c in ("x_robots", "title_px", "desc_px") if c in snapshots.columns)
    found = page_findings(snapshots.sparkSession.sparkContext.applicationId, optional)
    error = F.col("s.error")
    return snapshots.select("page_id", *(["s"] if keep else []), F.when(error.isNull(), found).otherwise(unfinished(error)).alias("findings"))


def tech_audit(snapshots: DataFrame) -> DataFrame:
    """snapshots (page_id, s; optional headers) -> page_id, trackers, platform, security, summary, findings."""
    headers = F.col("headers") if "headers" in snapshots.columns else F.create_map().cast("map<string,string>")
    s = F.col("s")
    sources = {"html": s["loaded"]["html"], "requests": F.array_join(s["loaded"]["requestedUrls"], "\n"), "scripts": F.array_join(s["loaded"]["scriptUrls"], "\n")}
    rows = snapshots.select("page_id", "s", headers.alias("headers")).withColumn("trackers", tech.trackers(sources))
    rows = rows.withColumn("security", tech.security(F.col("headers"), s["protocol"] == "https:"))
    return rows.select("page_id", "trackers", tech.platform(s["loaded"]["html"], s["page"]["generator"], F.col("headers")).alias("platform"), "security", tech.summary(F.col("trackers"), s["loaded"]["hosts"]).alias("summary"), FD.evaluate(tech.tech_rules(F.col("trackers"), F.col("security"))).alias("findings"))


def site_audit(live: DataFrame, raw: DataFrame, facts: DataFrame) -> DataFrame:
    """Answer-engine findings: live and raw snapshots (page_id, s) and facts (page_id, verdict, grid, probes, base_bytes, llms struct)."""
    j = live.select("page_id", F.col("s").alias("live")).join(raw.select("page_id", F.col("s").alias("raw")), "page_id", "left").join(facts, "page_id", "left")
    grid = F.coalesce("grid", F.array().cast("array<struct<id:string,group:string,allowed:boolean>>"))
    probes = F.coalesce("probes", F.array().cast("array<struct<agent:string,status:int,bytes:bigint,error:string>>"))
    live_s, llms = F.col("live"), F.col("llms")
    found = FD.evaluate([
        *R.javascript_gap(live_s, F.col("raw")), *R.crawler_access(live_s, F.col("verdict"), grid), R.probe_findings(probes, F.col("base_bytes")),
        *R.llms_rules(llms["html"], llms["present"], llms["h1"], llms["summary"]), *R.citability(live_s),
    ])
    error = F.coalesce(F.col("live.error"), F.col("raw.error"))
    return j.select("page_id", F.when(error.isNull(), found).otherwise(unfinished(error)).alias("findings"))


def compute(snapshots: DataFrame) -> DataFrame:
    """All that is said of a page without asking its site: snapshots (page_id, s; optional headers, x_robots, title_px, desc_px, raw_html, containers).

    page_id, checks, tech (trackers, platform, verifications, socials, security, summary, findings), findings (of both), counts, worst.
    The header x-robots-tag is taken from headers where x_robots isn't given.
    """
    cols, s = set(snapshots.columns), F.col("s")
    headers = F.transform_keys("headers", lambda k, v: F.lower(k)) if "headers" in cols else F.create_map().cast("map<string,string>")
    rows = snapshots.withColumn("headers", headers)
    if "x_robots" not in cols:
        rows = rows.withColumn("x_robots", F.try_element_at("headers", F.lit("x-robots-tag")))
    optional = tuple(c for c in ("x_robots", "title_px", "desc_px") if c in rows.columns)
    checks = page_findings(snapshots.sparkSession.sparkContext.applicationId, optional)
    sources = {"rendered page": s["loaded"]["html"], "requests": F.array_join(s["loaded"]["requestedUrls"], "\n")}
    sources |= {label: F.col(c) for c, label in (("raw_html", "raw HTML"), ("containers", "tag manager container")) if c in cols}
    rows = rows.withColumn("trackers", tech.trackers(sources)).withColumn("security", tech.security(F.col("headers"), s["protocol"] == "https:"))
    html = F.coalesce(F.nullif(s["loaded"]["html"], F.lit("")), F.col("raw_html")) if "raw_html" in cols else s["loaded"]["html"]
    of_tech = F.struct(
        "trackers", tech.platform(html, s["page"]["generator"], F.col("headers")).alias("platform"), tech.verifications(s["otherMeta"]).alias("verifications"), tech.socials(s).alias("socials"),
        "security", tech.summary(F.col("trackers"), s["loaded"]["hosts"]).alias("summary"), FD.evaluate(tech.tech_rules(F.col("trackers"), F.col("security"))).alias("findings"),
    )
    error = s["error"]
    out = rows.select("page_id", F.when(error.isNull(), checks).otherwise(unfinished(error)).alias("checks"), of_tech.alias("tech"))
    out = out.withColumn("findings", F.concat("checks", "tech.findings"))
    own = F.col("findings")
    counts = F.struct(*(FD.of_severity(own, x).alias(x) for x in FD.SEVERITIES), F.size(own).cast("long").alias("total"))
    return out.withColumn("counts", counts).withColumn("worst", F.array_min(FD.in_place(own))["id"])


def tab(area: Column, id_: Column) -> Column:
    """Where a finding is shown besides the list of issues."""
    return (
        F.when(area.isin("ai", "tech"), area).when(id_.startswith("og."), "social").when(area.isin("schema", "international"), "schema")
        .when(area.isin("links", "images"), area).when(id_.startswith("h1.") | id_.startswith("head."), "headings").otherwise("summary")
    )


def badges(found: DataFrame) -> DataFrame:
    """Per page and tab: the number on its badge and of which severity; tabs without failures and warnings have none."""
    c = FD.counts(found.withColumn("tab", tab(F.col("area"), F.col("id"))), ("page_id", "tab"))
    severity = F.when(F.col("fail") > 0, "fail").when(F.col("warn") > 0, "warn")
    return c.select("page_id", "tab", severity.alias("severity"), F.when(F.col("fail") > 0, F.col("fail")).otherwise(F.col("warn")).alias("n")).where("severity is not null")


def badges_in_row(audited: DataFrame) -> DataFrame:
    """badges() of rows that hold their findings as an array: no shuffle."""
    tabs = F.transform("findings", lambda f: F.struct(tab(f["area"], f["id"]).alias("tab"), f["severity"].alias("severity")))
    n = lambda t, x: F.size(F.filter("tabs", lambda r: (r["tab"] == t) & (r["severity"] == x))).cast("long")
    each = F.array(*(F.struct(F.lit(t).alias("tab"), n(t, "fail").alias("fail"), n(t, "warn").alias("warn")) for t in TABS))
    rows = audited.select("page_id", tabs.alias("tabs")).select("page_id", F.inline(each)).where("fail > 0 or warn > 0")
    return rows.select("page_id", "tab", F.when(F.col("fail") > 0, "fail").otherwise("warn").alias("severity"), F.when(F.col("fail") > 0, F.col("fail")).otherwise(F.col("warn")).alias("n"))


def issues_in_row(audited: DataFrame) -> DataFrame:
    """issues() of rows that hold their findings as an array: sorted in the row, no shuffle."""
    areas = F.array(*map(F.lit, AREAS))
    keyed = F.transform(FD.in_place(F.col("findings")), lambda f: F.struct(f["rank"].alias("rank"), F.array_position(areas, f["area"]).alias("at"), f["seq"].alias("seq"), f.alias("f")))
    rows = audited.select("page_id", F.posexplode(F.array_sort(keyed)).alias("place", "x"))
    return rows.select("page_id", (F.col("place") + 1).alias("place"), "x.f.seq", "x.f.severity", "x.f.area", "x.f.id", "x.f.title", "x.f.detail", "x.f.fix")


def field_row_in_row(audited: DataFrame, *prefixes: str) -> DataFrame:
    """field_row() of rows that hold their findings as an array: no shuffle."""
    test = lambda f: F.array_contains(F.array(*(f["id"].startswith(p) for p in prefixes)), True)
    rows = audited.select("page_id", F.array_sort(FD.in_place(F.filter("findings", test))).alias("x")).where("size(x) > 0")
    others = F.filter(F.slice("x", 2, 1_000_000), lambda r: r["severity"] != "pass")
    return rows.select("page_id", F.col("x")[0]["id"].alias("owner"), F.col("x")[0]["severity"].alias("severity"), F.transform(others, lambda r: r["id"]).alias("others"))


def issues(found: DataFrame) -> DataFrame:
    """Findings in reading order: severity, area, then as the rules stand; `place` from 1 in the page."""
    area = F.array_position(F.array(*map(F.lit, AREAS)), F.col("area"))
    order = Window.partitionBy("page_id").orderBy(FD.rank(F.col("severity")), area, "seq")
    return found.withColumn("place", F.row_number().over(order))


def flags(found: DataFrame) -> DataFrame:
    """What is to be said of a page: all findings but passes, in reading order."""
    return issues(found).where("severity <> 'pass'")


def by_prefix(found: DataFrame, *prefixes: str) -> DataFrame:
    """Findings whose ids begin with one of the prefixes; a whole id is its own prefix."""
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col("id").startswith(p)
    return found.where(test)


def field_row(found: DataFrame, *prefixes: str) -> DataFrame:
    """One field of a summary: its gravest finding owns it, the others that aren't passes stand below by rank."""
    order = F.struct(FD.rank(F.col("severity")).alias("rank"), "seq", "id", "severity")
    rows = by_prefix(found, *prefixes).groupBy("page_id").agg(F.array_sort(F.collect_list(order)).alias("x"))
    others = F.filter(F.slice("x", 2, 1_000_000), lambda r: r["severity"] != "pass")
    return rows.select("page_id", F.element_at("x", 1)["id"].alias("owner"), F.element_at("x", 1)["severity"].alias("severity"), F.transform(others, lambda r: r["id"]).alias("others"))


def paged(rows: DataFrame, page: int, size: int = 120, order: tuple[str, ...] = ("pos",), keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The page-th screenful (from 0) of each key's rows."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where((F.col("__n") > page * size) & (F.col("__n") <= (page + 1) * size)).drop("__n")


def all_findings(page: DataFrame, *others: DataFrame) -> DataFrame:
    """Findings arrays (page_id, findings) of several audits as one; pages without one of them keep the rest."""
    out = page.select("page_id", "findings")
    for more in others:
        out = out.join(more.select("page_id", F.col("findings").alias("__more")), "page_id", "left")
        out = out.select("page_id", F.concat("findings", F.coalesce("__more", F.array().cast(FD.FINDING))).alias("findings"))
    return out


def ai_score(site: DataFrame) -> DataFrame:
    """Counts of answer-engine findings with their total."""
    return FD.counts(FD.long(site))


def report(audited: DataFrame) -> DataFrame:
    """audited (page_id, s, findings: audit() with keep) -> one Markdown text a page, made in the row: what is wrong first; passed checks are counted, not listed."""
    own = F.col("findings")
    line = lambda f: F.concat(F.lit("- **"), f["title"], F.lit("**"), F.when(f["detail"].isNotNull(), F.concat(F.lit(": "), f["detail"])).otherwise(""), F.when(f["fix"].isNotNull(), F.concat(F.lit(" Fix: "), f["fix"])).otherwise(""))

    def section(severity: str, title: str) -> Column:
        lines = F.transform(F.filter(own, lambda f: f["severity"] == severity), line)
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"\n## {title}\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")

    n = lambda s: FD.of_severity(own, s).cast("string")
    head = F.concat(F.lit("# Page report\n"), F.coalesce("s.url", F.lit("")), F.lit("\n"), n("fail"), F.lit(" failures, "), n("warn"), F.lit(" warnings, "), n("note"), F.lit(" notes, "), n("pass"), F.lit(" passed\n"))
    return audited.select("page_id", F.concat(head, section("fail", "To fix"), section("warn", "Worth a look"), section("note", "Notes")).alias("report"))


def outline(snapshots: DataFrame) -> DataFrame:
    """The page's headings as indented lines."""
    rows = F.transform("s.headings", lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("H"), h["level"].cast("string"), F.lit(" "), h["text"]))
    return snapshots.select("page_id", F.array_join(rows, "\n").alias("outline"))


def dump(snapshots: DataFrame) -> DataFrame:
    """Snapshots as JSON without the page's own HTML and request list; with how long each step took where snapshots has `timing` (map of step to ms)."""
    row = F.col("s").withField("loaded", F.col("s.loaded").dropFields("html", "requestedUrls"))
    timed = [F.col("timing")] if "timing" in snapshots.columns else []
    return snapshots.select("page_id", F.to_json(row).alias("snapshot"), *timed)


def summary(snapshots: DataFrame) -> DataFrame:
    """The page's headline facts, one row a page."""
    s = F.col("s")
    levels = [F.expr(f"size(filter(s.headings, h -> h.level = {k}))").alias(f"h{k}") for k in range(1, 7)]
    return snapshots.select("page_id", s["url"].alias("url"), s["title"]["text"].alias("title"), s["description"]["content"].alias("description"), s["canonical"]["href"].alias("canonical"), s["robotsMeta"]["content"].alias("robots"), R.first_h1(s).alias("h1_text"), R.page_words(s).alias("words"), s["lang"].alias("lang"), s["viewport"].alias("viewport"), F.coalesce(s["charset"], s["metaCharset"]).alias("charset"), *levels, F.size(s["links"]).alias("links"), F.size(s["images"]).alias("images"))


def social(snapshots: DataFrame) -> DataFrame:
    """What a share would show: Twitter fields fall back on Open Graph, with where each came from."""
    s, out = F.col("s"), ["page_id"]
    for name in ("title", "description", "image"):
        tw, og = F.nullif(F.try_element_at(s["twitter"], F.lit(f"twitter:{name}")), F.lit("")), F.nullif(F.try_element_at(s["og"], F.lit(f"og:{name}")), F.lit(""))
        out += [F.coalesce(tw, og).alias(name), F.when(tw.isNotNull(), "twitter").when(og.isNotNull(), "og").alias(f"{name}_from")]
    return snapshots.select(*out)


def headings(snapshots: DataFrame) -> DataFrame:
    """One row a heading with its marks."""
    both = F.arrays_zip("s.headings", M.heading_marks(F.col("s.headings")).alias("m"))
    return snapshots.select("page_id", F.posexplode(both).alias("pos", "x")).select("page_id", "pos", "x.headings.*", F.transform("x.m", lambda m: m["id"]).alias("marks"))


def heading_levels(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("page_id", F.explode("s.headings.level").alias("level")).groupBy("page_id", "level").count()


def links(snapshots: DataFrame, show: str = "all", severities: tuple[str, ...] | None = None) -> DataFrame:
    """One row a link with its marks; show: all, internal, external, nofollow or problems; severities: of the marks that are listed, by default all."""
    both = F.arrays_zip("s.links", M.link_marks(F.col("s.links")).alias("m"))
    rows = snapshots.select("page_id", F.posexplode(both).alias("pos", "x")).select("page_id", "pos", "x.links.*", F.col("x.m").alias("m"))
    test = {"all": F.lit(True), "internal": F.col("internal").eqNullSafe(True), "external": F.col("internal").eqNullSafe(False), "nofollow": T.has_token(F.col("rel"), "nofollow"), "problems": F.exists("m", lambda m: m["severity"].isNotNull())}[show]
    listed = F.col("m") if severities is None else F.filter("m", lambda m: F.coalesce(m["severity"].isin(*severities), F.lit(False)))
    return rows.where(test).withColumn("marks", F.transform(listed, lambda m: m["id"])).drop("m")


def images(snapshots: DataFrame, show: str = "all") -> DataFrame:
    """One row an image with its marks and file name; show: all, noalt, broken or problems."""
    both = F.arrays_zip("s.images", M.image_marks(F.col("s.images")).alias("m"))
    rows = snapshots.select("page_id", F.posexplode(both).alias("pos", "x")).select("page_id", "pos", "x.images.*", F.col("x.m").alias("m"))
    has = lambda i: F.exists("m", lambda m: m["id"] == i)
    test = {"all": F.lit(True), "noalt": has("img.no-alt"), "broken": has("img.broken"), "problems": F.exists("m", lambda m: m["severity"].isNotNull())}[show]
    name = F.substring_index(F.regexp_replace("src", r"[?#].*$", ""), "/", -1)
    return rows.where(test).select("*", F.transform("m", lambda m: m["id"]).alias("marks"), F.coalesce(F.try_url_decode(name), name).alias("file")).drop("m")


#: Properties of a node and hosts of a page that a view shows.
SHOWN_PROPERTIES, SHOWN_HOSTS = 12, 60


def schema_blocks(snapshots: DataFrame) -> DataFrame:
    """One row a block: severity, types, ids, what is missing, and of each node its first properties."""
    ld = F.col("s.structuredData.jsonLd")
    first = F.transform(ld, lambda b: F.transform(b["nodes"], lambda n: F.slice(F.filter(n["present"], lambda k: ~k.startswith("@")), 1, SHOWN_PROPERTIES)))
    both = F.arrays_zip(M.schema_marks(ld).alias("b"), first.alias("properties"))
    return snapshots.select("page_id", F.explode(both).alias("x")).select("page_id", "x.b.*", "x.properties")


def hreflang(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("page_id", F.posexplode(M.hreflang_marks(F.col("s.hreflang"), F.col("s.url"))).alias("pos", "r")).select("page_id", "pos", "r.*")


def tech_view(audited: DataFrame) -> DataFrame:
    """Trackers of a page by category."""
    return audited.select("page_id", F.explode("trackers").alias("t")).groupBy("page_id", "t.category").agg(F.array_sort(F.collect_list("t.name")).alias("names"))


def tech_page(snapshots: DataFrame) -> DataFrame:
    """The technology view, one row a page: platform, security, trackers by name, and its first hosts, most used first."""
    t = tech_audit(snapshots).join(snapshots.select("page_id", "s.loaded.hosts", F.col("s.loaded.thirdPartyHosts").alias("third_party_hosts")), "page_id")
    order = F.array_sort(F.transform("hosts", lambda h: F.struct((-h["count"]).alias("n"), h["host"].alias("host"))))
    return t.select("page_id", "platform", "security", F.transform("trackers", lambda x: x["name"]).alias("trackers"), F.transform(F.slice(order, 1, SHOWN_HOSTS), lambda h: h["host"]).alias("hosts"), F.size("hosts").alias("n_hosts"), "third_party_hosts")
