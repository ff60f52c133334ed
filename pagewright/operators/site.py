"""Facts about a site that come from fetches: llms.txt, sitemaps, link answers, probes. Input tables, never the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import marks as M

#: How many children of a sitemap index are read, and links checked a page.
CHILDREN, CHECKED_LINKS = 25, 300


def is_html(body: Column) -> Column:
    return F.lower(F.coalesce(body, F.lit(""))).rlike(r"^\s*<(!doctype|html)")


def llms_shape(files: DataFrame) -> DataFrame:
    """files (site, status, body) -> present, html, h1, summary, sections, links of llms.txt."""
    body, ok = F.coalesce("body", F.lit("")), F.col("status").between(200, 299)
    rows = F.split(body, "\r?\n")
    any_row = lambda p: F.exists(rows, lambda x: x.rlike(p))
    shape = lambda c: F.when(ok, c)
    return files.select(
        "site", (ok & (body != "") & ~is_html(body)).alias("present"), is_html(body).alias("html"),
        shape(any_row(r"^#\s+\S")).alias("h1"), shape(any_row(r"^>\s*\S")).alias("summary"),
        shape(F.size(F.filter(rows, lambda x: x.rlike(r"^##\s+\S")))).alias("sections"),
        shape(F.regexp_count(body, F.lit(r"\[[^\]]+\]\([^)]+\)"))).alias("links"),
    )


def llms_files(files: DataFrame) -> DataFrame:
    """files (site, file, status, body) -> site, llms and llms_full: llms_shape() of /llms.txt and of /llms-full.txt, null where it wasn't fetched."""
    of = lambda name, out: llms_shape(files.where(F.col("file") == name)).select("site", F.struct("present", "html", "h1", "summary", "sections", "links").alias(out))
    return of("llms.txt", "llms").join(of("llms-full.txt", "llms_full"), "site", "full")


def sitemap_candidates(parsed_robots: DataFrame, sites: DataFrame) -> DataFrame:
    """sites (site, origin) -> site, place, sitemap: those robots.txt names, else the usual address."""
    from pagewright.operators import robots

    named = robots.sitemaps(parsed_robots).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("line", "sitemap"))).alias("x"))
    rows = sites.join(named, "site", "left")
    urls = F.coalesce(F.transform("x", lambda r: r["sitemap"]), F.array(F.concat("origin", F.lit("/sitemap.xml"))))
    return rows.select("site", F.posexplode(urls).alias("place", "sitemap"))


def locations(sitemaps: DataFrame) -> DataFrame:
    """sitemaps (url, status, body) -> url, is_index, pos, loc."""
    locs = F.regexp_extract_all("body", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return sitemaps.where(F.col("status").between(200, 299)).select("url", F.lower("body").contains("<sitemapindex").alias("is_index"), F.posexplode(locs).alias("pos", "loc"))


def sitemap_membership(sitemaps: DataFrame, targets: DataFrame, children: int = CHILDREN) -> DataFrame:
    """targets (sitemap, url) -> found: listed in the sitemap, or in one of the first children of an index (one level down)."""
    locs = locations(sitemaps)
    direct = locs.where("not is_index").select(F.col("url").alias("sitemap"), T.clean_url(F.col("loc")).alias("clean"))
    child = locs.where(F.col("is_index") & (F.col("pos") < children)).select(F.col("url").alias("root"), F.col("loc").alias("sitemap"))
    listed = direct.unionByName(direct.join(child, "sitemap").select(F.col("root").alias("sitemap"), "clean")).distinct().withColumn("found", F.lit(True))
    asked = targets.withColumn("clean", T.clean_url(F.col("url")))
    return asked.join(listed, ["sitemap", "clean"], "left").select("sitemap", "url", F.coalesce("found", F.lit(False)).alias("found"))


def real_links(snapshots: DataFrame) -> DataFrame:
    """One row a link with an address: page_id, pos, key (address without fragment), and the link."""
    rows = snapshots.select("page_id", F.posexplode("s.links").alias("pos", "link"))
    return rows.where("link.kind = 'link' and link.href is not null").withColumn("key", T.no_fragment(F.col("link.href")))


def unique_targets(snapshots: DataFrame) -> DataFrame:
    """Distinct targets of a page with their first place and number of links."""
    return real_links(snapshots).groupBy("page_id", "key").agg(F.min("pos").alias("pos"), F.count("*").alias("n_links"), F.bool_or(F.coalesce("link.internal", F.lit(False))).alias("internal"))


def links_to_check(snapshots: DataFrame, limit: int = CHECKED_LINKS) -> DataFrame:
    """The first distinct web targets of a page."""
    web = unique_targets(snapshots).where(F.col("key").rlike("^https?:"))
    return web.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("n") <= limit)


def same_origin(checked: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Of the links to check, those on the page's own origin: all that may be asked without leave for other hosts."""
    origins = snapshots.select("page_id", F.col("s.origin").alias("origin"))
    return checked.join(origins, "page_id").where(F.col("key").startswith(F.concat("origin", F.lit("/"))) | (F.col("key") == F.col("origin"))).drop("origin")


def link_status(snapshots: DataFrame, answers: DataFrame) -> DataFrame:
    """Checked targets with their answers (url, status, redirected, error): severity and label, null where there is no answer yet."""
    joined = links_to_check(snapshots).join(answers.withColumnRenamed("url", "key"), "key", "left")
    severity, label = M.link_status_verdict(F.col("status"), F.col("error"), F.col("redirected"))
    known = F.col("status").isNotNull() | ~T.blank(F.col("error"))
    return joined.select("page_id", "key", "status", F.when(known, severity).alias("severity"), F.when(known, label).alias("label"))


def status_results(checked: DataFrame) -> DataFrame:
    """page_id, results: what the link status rules read; a page has at most CHECKED_LINKS of them."""
    rows = checked.where("severity is not null")
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("key").alias("url"), "severity", "status"))).alias("results"))


def host_tally(snapshots: DataFrame) -> DataFrame:
    """Hosts a page loads from, most used first."""
    rows = snapshots.select("page_id", F.explode("s.loaded.hosts").alias("h")).select("page_id", "h.host", "h.count", "h.thirdParty", F.array_join("h.how", ",").alias("how"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("count"), "host")))


def top_hosts(snapshots: DataFrame, n: int = 10) -> DataFrame:
    return host_tally(snapshots).where(F.col("place") <= n)
