import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators import findings as FD
from pagewright.operators import robots as RB
from pagewright.operators import site as ST
from pagewright.plans import audit as A
from pagewright.sources.snapshots import asks, extract, measure, measured, nodes_of, row_schema
from pagewright.streaming import pages as SP

#: Written from the rules that it is to fire: one line for each.
ORCHARD = """<html><body><article>
<h2>Picking calendar</h2><h1></h1><h5>Cellar notes</h5>
<p>Early apples keep for a month.<p>Late ones keep until spring, <a href="javascript:show()">see the list</a>.
<a href="tel:+100">Call</a><a href="../orchard?tree=7">tree seven</a><a href="/orchard/map" rel="ugc nofollow">here</a><a href="//press.example.net/juice">Here</a><a href="/cider">more</a><a name=old></a><a name=older></a><a name=oldest></a>
<table><tr><td>Bramley<td>October<tr><td>Russet<td>November</table>
<img src="/img/bramley.jpeg" alt="Bramley" width="40" height="30"><picture><source src="https://cdn.example.net/r.avif"><img src="russet.png"></picture>
</article><aside role="complementary"><h6>Beside</h6></aside>
<script type="application/ld+json">[{"@type": ["Thing", "Product"], "name": "Juice", "image": "j.png", "@id": "#juice"}]</script><script type="application/ld+json">{unquoted: 1}</script>
<link rel="alternate" hreflang="en_GB" href="https://orchard.example.com/gb/"><link rel="alternate" hreflang="x-default" href="https://orchard.example.com/year">
<meta name="description" content="When to pick."><meta name="description" content="What to keep."><meta http-equiv="refresh" content="30"><meta name="googlebot" content="nosnippet"><meta property="og:description" content="All year"></body></html>"""
YEAR = "https://orchard.example.com/year"


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def ids(df):
    return {r.id: r.severity for r in FD.long(df).collect()}


def test_a_page_that_fires_many_rules(spark):
    s = measure(ORCHARD, YEAR)
    assert s["title"] == {"count": 0, "text": None, "all": []} and s["lang"] is None and s["description"]["all"] == ["When to pick.", "What to keep."]
    assert [(h["level"], h["text"], h["region"]) for h in s["headings"]] == [(2, "Picking calendar", "main"), (1, "", "main"), (5, "Cellar notes", "main"), (6, "Beside", "aside")]
    assert s["specialLinks"] == {"mailto": 0, "tel": 1, "javascript": 1, "fragment": 0} and s["metaRefresh"] == "30"
    assert [(x["href"], x["internal"], x["kind"]) for x in s["links"]][:4] == [("https://orchard.example.com/orchard?tree=7", True, "link"), ("https://orchard.example.com/orchard/map", True, "link"), ("https://press.example.net/juice", False, "link"), ("https://orchard.example.com/cider", True, "link")]
    assert [x["kind"] for x in s["links"]][4:] == ["no-href"] * 3
    assert [(i["ext"], i["inPicture"], i["hasAlt"]) for i in s["images"]] == [("jpeg", False, True), ("png", True, False)]
    assert [b["ok"] for b in s["structuredData"]["jsonLd"]] == [True, False] and s["structuredData"]["jsonLd"][0]["nodes"][0]["types"] == ["Thing", "Product"]
    assert s["content"]["mainSelector"] == "article" and s["content"]["shape"]["paragraphs"] == 2 and s["content"]["shape"]["tables"] == 1
    assert [(h["host"], h["count"], h["thirdParty"]) for h in s["loaded"]["hosts"]] == [("orchard.example.com", 4, False), ("cdn.example.net", 1, True)]
    got = ids(A.audit(extract(pages(spark, (1, YEAR, ORCHARD)))))
    want = {
        "title.missing": "fail", "desc.multiple": "warn", "desc.short": "warn", "index.nosnippet": "note", "index.meta-refresh": "warn", "canon.missing": "warn", "meta.charset": "note", "meta.lang": "warn", "h1.empty": "fail", "head.skipped": "note",
        "content.thin": "warn", "link.javascript": "warn", "link.generic": "note", "link.internal-nofollow": "warn", "link.no-href": "note", "img.no-alt": "warn", "img.no-dims": "warn", "schema.parse": "fail", "schema.required.Product": "warn",
        "schema.product-no-offer": "note", "hreflang.invalid": "warn", "og.partial": "warn",
    }
    assert want.items() <= got.items() and "schema.no-id" not in got


def test_detail_texts(spark):
    found = {f.id: f for f in A.audit(extract(pages(spark, (1, YEAR, ORCHARD)))).first().findings}
    assert found["head.skipped"].title == "Heading levels are skipped: H2 to H5" and found["schema.required.Product"].detail == "offers"
    assert (found["link.generic"].title, found["link.generic"].detail) == ("3 links say", "here, Here, more") and found["hreflang.invalid"].detail == "en_GB"
    assert found["desc.multiple"].title == "2 descriptions" and found["og.partial"].detail == "og:title, og:image"


JUNK = st.lists(st.sampled_from(["<", ">", "</", "<![ b", "a <![[ b ]]>", "<!--", "-->", "<!-->", "<p", "<a href=", "<a b='", '"', "'", "=", "<script>", "</script", "<svg/>", "<table><tr><td>", "<li>", "&amp;", "&#x;", "&#99999999;", "\x00", "<title>", "<body role=main>", "</body>", "<base href='http://['>", "<img src=//[>", "text", " ", "é", "<?x", "</>", "<h1>", "</h2>", '<script type="application/ld+json">[[']), max_size=14).map("".join)


@settings(max_examples=400, deadline=None)
@given(JUNK, st.sampled_from(["https://a.com/", "", "x", "http://["]))
def test_any_string_can_be_read(html, url):
    assert "error" not in measured(html, url) and measure(html, url)["schemaVersion"] == 1


def test_reading_takes_time_in_proportion():
    for part in ("<", "<a ", '<a b="', "<a b=", "<!--", "=", "<p>", "<div>", "</x", "<a b='>"):
        measure(part * 60_000, "https://a.com/")  # would take hours otherwise


def test_a_page_that_cannot_be_measured_is_a_row(spark, monkeypatch):
    from pagewright.sources import snapshots as S

    monkeypatch.setattr(S, "measure", lambda *a: 1 / 0)
    s = S.measured("<p>", "https://a.com/")
    assert s["error"].startswith("ZeroDivisionError") and s["url"] == "https://a.com/"
    df = spark.createDataFrame([(1, s)], row_schema())
    assert ids(A.audit(df)) == {"run.error": "note"}
    facts = spark.sql("SELECT 1L AS page_id, 'read' AS verdict, cast(null as array<struct<id:string,group:string,allowed:boolean>>) AS grid, cast(null as array<struct<agent:string,status:int,bytes:bigint,error:string>>) AS probes, 100L AS base_bytes, named_struct('html', false, 'present', true, 'h1', true, 'summary', true) AS llms")
    assert ids(A.site_audit(df, df, facts)) == {"run.error": "note"}


def test_questions():
    asked = ["What's the price", "Can't I do it", "Who-is-who guide", "Is/are rules", "WHY", "Ready?", "do"]
    assert all(map(asks, asked)) and not any(map(asks, ["Whatever", "Doing", "Area", "The why", "", "canoe", "is_it"]))


def test_parts_of_a_snapshot(spark):
    full, some = measure(ORCHARD, YEAR), measure(ORCHARD, YEAR, ("headings", "content"))
    assert some["headings"] == full["headings"] and some["content"] == full["content"] and some["url"] == full["url"]
    assert some["links"] == [] and "loaded" not in some
    rows = extract(pages(spark, (1, YEAR, ORCHARD)), ("links",)).first().s
    assert len(rows.links) == 7 and rows.headings == [] and rows.content is None


def test_rollups_in_the_row_are_those_of_the_rows(spark):
    audited = A.audit(extract(pages(spark, (1, YEAR, ORCHARD), (2, "http://a.com/", "<h1>x</h1>"))))
    found = FD.long(audited)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(FD.tally(audited), FD.counts(found)) and same(FD.gravest(audited), FD.worst(found))
    assert same(A.badges_in_row(audited), A.badges(found)) and same(A.issues_in_row(audited), A.issues(found))
    assert same(A.field_row_in_row(audited, "desc.", "title."), A.field_row(found, "desc.", "title."))


def test_failures_first_and_fixes(spark):
    found = FD.long(A.audit(extract(pages(spark, (1, "http://example.com/", "<p>x")))))
    order = [r.severity for r in FD.in_order(found).collect()]
    assert order == sorted(order, key=FD.SEVERITIES.index)
    assert all(r.fix for r in found.where("severity in ('fail', 'warn')").collect())
    assert found.where("area is null").count() == 0


def test_null_and_odd_pages(spark):
    rows = A.audit(extract(pages(spark, (1, None, None), (2, "not a url", "<<<>"), (3, "https://a.com", ""), (None, "https://a.com", "<p")))).collect()
    assert len(rows) == 4


def test_tech_and_views(spark):
    html = "<html><head><meta name=generator content='WordPress 6'><link href='/wp-content/themes/astra/a.css' rel=stylesheet></head><body><script>GTM-ABC1234 UA-12345-1 UA-12345-2</script><a href='https://www.facebook.com/me'>f</a>"
    snap = extract(pages(spark, (1, "https://example.com/", html)))
    t = A.tech_audit(snap).first()
    assert [x.key for x in t.trackers] == ["gtm", "ua"] and t.platform.cms == "WordPress" and "Theme: astra" in t.platform.detail
    assert {"tech.dead.ua", "tech.dupe.ua"} <= {f.id for f in t.findings}
    assert A.report(A.audit(snap, keep=True)).first().report.startswith("# Page report\nhttps://example.com/")
    view = A.tech_page(snap).first()
    assert view.platform.cms == "WordPress" and view.trackers == [x.name for x in t.trackers] and view.n_hosts == 1
    got = A.compute(snap.withColumn("headers", F.create_map(F.lit("X-Robots-Tag"), F.lit("noindex")))).first()
    assert {"index.noindex", "tech.dupe.ua"} <= {f.id for f in got.findings} and got.worst == "index.noindex" and got.counts.total == len(got.findings) and got.tech.socials[0].platform
    for view in (A.summary, A.social, A.headings, A.heading_levels, A.links, A.images, A.schema_blocks, A.hreflang, A.dump, A.outline, ST.host_tally, ST.unique_targets, ST.links_to_check):
        view(snap).collect()


def test_site_audit(spark):
    snap = extract(pages(spark, (1, YEAR, ORCHARD)))
    facts = spark.sql("SELECT 1L AS page_id, 'read' AS verdict, array(named_struct('id', 'Googlebot', 'group', 'search', 'allowed', false)) AS grid, array(named_struct('agent', 'GPTBot', 'status', 403, 'bytes', 1L, 'error', cast(null as string))) AS probes, 100L AS base_bytes, named_struct('html', false, 'present', true, 'h1', true, 'summary', true) AS llms")
    got = ids(A.site_audit(snap, snap.where("false"), facts))
    assert {"js.no-raw": "note", "robots.search-blocked": "fail", "probe.blocked.GPTBot": "fail", "llms.present": "pass"}.items() <= got.items()


def test_link_answers(spark):
    snap = extract(pages(spark, (1, "https://a.com/", "<a href='/x#1'>x</a><a href='/x#2'>x</a><a href='/y'>y</a>")))
    answers = spark.sql("SELECT * FROM (VALUES ('https://a.com/x', 404, false, cast(null as string))) AS t(url, status, redirected, error)")
    got = {r.key: r.severity for r in ST.link_status(snap, answers).collect()}
    assert got == {"https://a.com/x": "fail", "https://a.com/y": None}
    assert ST.status_results(ST.link_status(snap, answers)).first().results[0].status == 404


def brute_allowed(rules, target):
    """Longest matching path wins, allow on a tie; no rule, allowed."""
    best = None
    for kind, path in rules:
        if not path:
            continue
        body = path[:-1] if path.endswith("$") else path
        if re.match("".join(".*" if c == "*" else re.escape(c) for c in body) + ("$" if path.endswith("$") else ""), target):
            if best is None or (len(path), kind == "allow") > (len(best[1]), best[0] == "allow"):
                best = (kind, path)
    return best is None or best[0] == "allow"


PATHS = st.text(alphabet="/ab*$.", min_size=0, max_size=5).map(lambda x: "/" + x)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["allow", "disallow"]), PATHS), max_size=6), min_size=8, max_size=8), st.lists(st.text(alphabet="/ab.", max_size=6).map(lambda x: "/" + x), min_size=4, max_size=4))
def test_robots_against_brute_force(spark, files, targets):
    robots = spark.createDataFrame([(str(i), "User-agent: *\n" + "\n".join(f"{k}: {p}" for k, p in f)) for i, f in enumerate(files)], "site string, text string")
    asked = spark.createDataFrame([(str(i), "https://h" + t) for i in range(len(files)) for t in set(targets)], "site string, url string")
    got = {(r.site, r.url): r.allowed for r in RB.grid(RB.lines(robots), asked, [("Googlebot", "search")]).collect()}
    for i, f in enumerate(files):
        for t in set(targets):
            assert got[str(i), "https://h" + t] == brute_allowed(f, t), (f, t)


def test_robots_tables(spark):
    text = "Disallow: /early\nUser-agent: a\n\nbad line\nUser-agent: b\nDisallow: /x\nSitemap: https://h/s.xml\nUser-agent: c\nCrawl-delay: 2\nHost: h"
    p = RB.lines(spark.createDataFrame([("s", text), ("n", None)], "site string, text string"))
    assert {(r.grp, r.token) for r in RB.agents(p).collect()} == {(1, "a"), (1, "b"), (2, "c")}
    assert [r.line for r in RB.errors(p).orderBy("line").collect()] == [1, 4]
    assert RB.sitemaps(p).first().sitemap == "https://h/s.xml" and RB.crawl_delays(p).first().crawl_delay == "2" and RB.unknown(p).first().field == "host"


def test_robots_groups_and_states(spark):
    text = "User-agent: *\nDisallow: /a # why\nUser-agent: claudebot\nAllow: /\nUser-agent: x\nUser-agent: *\nDisallow: /b\nCrawl-delay: 4\nUser-agent: *\nCrawl-delay: 9"
    p = RB.lines(spark.createDataFrame([("s", text)], "site string, text string"))
    got = {r.id: (r.token, r.matched_by, r.n_rules, r.crawl_delay) for r in RB.group_for(p).collect()}
    assert got["Claude-User"] == ("claudebot", "name", 1, None) and got["GPTBot"] == ("*", "wildcard", 2, "4")
    early = RB.errors(RB.lines(spark.createDataFrame([("s", "Disallow: /x   # early")], "site string, text string"))).first()
    assert (early.text, early.problem) == ("Disallow: /x", "rule before any user-agent")
    files = spark.createDataFrame([("a", 200, None, " <HTML>User-agent: *\nDisallow: /"), ("b", 503, None, "x"), ("c", 200, None, "User-agent: *\nDisallow: /")], "site string, status int, error string, text string")
    assert {r.site: (r.verdict, r.html, r.usable) for r in RB.states(files).collect()} == {"a": ("read", True, False), "b": ("blocked", False, False), "c": ("read", False, True)}
    asked = spark.createDataFrame([(x, f"https://{x}/p") for x in "abc"], "site string, url string")
    assert {r.site for r in RB.fetched_grid(files, asked).where("not allowed").collect()} == {"c"}


def test_llms_files(spark):
    files = spark.createDataFrame([("a", "llms.txt", 200, "# A\n> s"), ("a", "llms-full.txt", 200, "# A\n## B"), ("b", "llms-full.txt", 404, "no")], "site string, file string, status int, body string")
    got = {r.site: r for r in ST.llms_files(files).collect()}
    assert got["a"].llms.present and got["a"].llms_full.sections == 1 and got["b"].llms is None and not got["b"].llms_full.present


def test_link_checks_as_they_come(spark, tmp_path):
    checked = spark.createDataFrame([(1, "u1"), (1, "u2"), (2, "u2"), (2, "u3")], "page_id long, key string")
    schema = "url string, status int, redirected boolean, error string"
    for k, rows in enumerate(([("u1", 200, False, None)], [("u2", 404, False, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    answers = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, done = [], []

    def sink(rows, progress, n):
        seen.extend((r.page_id, r.key, r.severity) for r in rows.collect())
        done.append({r.page_id: (r.done, r.total) for r in progress.collect()})

    SP.run_link_checks(answers, checked, sink, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(seen) == [(1, "u1", "pass"), (1, "u2", "fail"), (2, "u2", "fail")]
    assert done[-1] == {1: (2, 2), 2: (1, 2)} and len(done) == 2


def test_urls():
    assert urls.resolve("/a b", "HTTPS://Example.com:443/x") == "https://example.com/a%20b"
    assert urls.resolve("//d.org", "https://a.com") == "https://d.org/" and urls.resolve("?q=1", "https://a.com/p") == "https://a.com/p?q=1"
    assert urls.resolve("http://[bad", "https://a.com") is None and urls.host("https://a.com:8080/") == "a.com:8080"


def test_json_ld_shapes():
    assert nodes_of(None) == [] and nodes_of({"@graph": [{"@type": ["A", "B"], "@id": "x"}, 3]})[0]["types"] == ["A", "B"]


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(40)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    q = SP.run(SP.page_stream(spark, str(tmp_path / "in"), 1), lambda df, n: got.extend(df.select("page_id", "id").collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    want = FD.long(A.audit(extract(rows))).select("page_id", "id").collect()
    assert sorted(got) == sorted(want)


def test_latest_and_stored_snapshots(spark, tmp_path):
    f = spark.sql("SELECT * FROM (VALUES ('u', 1, 'old'), ('u', 2, 'new')) AS t(url, fetched_at, body)")
    assert SP.latest(f).first().body == "new"
    snap = extract(pages(spark, (1, YEAR, ORCHARD)))
    snap.write.parquet(str(tmp_path / "s"))
    from pagewright.sources.snapshots import read

    back = read(spark, str(tmp_path / "s"))
    assert back.schema == row_schema() and ids(A.audit(back)) == ids(A.audit(snap))


def test_tables_and_sinks(spark, tmp_path):
    from pagewright.sources import tables

    rows = spark.createDataFrame([("https://a.com/", {"X-Robots-Tag": "noindex"})], "url string, headers map<string,string>")
    assert tables.x_robots(rows).first().x_robots == "noindex"
    snap = extract(pages(spark, (1, YEAR, ORCHARD)))
    found = FD.long(A.audit(snap))
    tables.write_reports(A.report(A.audit(snap, keep=True)), str(tmp_path / "r"))
    tables.write_dump(A.dump(snap), str(tmp_path / "d"))
    tables.write_findings(found, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("area = 'meta'").count() > 0
    assert spark.read.text(str(tmp_path / "d")).count() == 1
    pages(spark, (1, "u", "h")).write.parquet(str(tmp_path / "p"))
    assert tables.read(spark, "pages", str(tmp_path / "p")).first().html == "h"
    both = A.all_findings(A.audit(snap), A.tech_audit(snap))
    assert "tech.no-analytics" in ids(both) and A.paged(A.links(snap), 0, 2).count() == 2


def test_hot_columns_only_are_read(spark, tmp_path):
    """A stored snapshot's rules read the nested fields that they use, and no others."""
    from pagewright.operators import rules as R
    from pagewright.sources.snapshots import read

    extract(pages(spark, (1, YEAR, ORCHARD))).write.parquet(str(tmp_path / "s"))
    back = read(spark, str(tmp_path / "s"))
    plan = back.select("page_id", F.col("s.title.text").alias("t")).where("t is not null")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<page_id:bigint,s:struct<title:struct<text:string>>>" in plan
    assert R.TITLE_MAX == 580


def test_link_marks_by_severity(spark):
    snap = extract(pages(spark, (1, "https://a.com/", '<a href="/x">this</a><a href="/y"></a><a href="/z" rel="nofollow">here</a>')))
    assert [r.marks for r in A.links(snap).orderBy("pos").collect()] == [["link.generic"], ["link.no-text"], ["link.internal-nofollow", "link.generic"]]
    assert [r.marks for r in A.links(snap, severities=("fail", "warn")).orderBy("pos").collect()] == [[], ["link.no-text"], ["link.internal-nofollow"]]
