"""robots.txt as tables: parsed by windows over lines, matched by a pattern join and a longest-rule arg-max."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

#: Crawlers asked about (id, group), and whose rules one obeys that has none of its own.
AGENTS = [
    ("Googlebot", "search"), ("Google-Extended", "ai"), ("Bingbot", "search"), ("GPTBot", "ai"), ("OAI-SearchBot", "ai"),
    ("ChatGPT-User", "ai"), ("ClaudeBot", "ai"), ("Claude-User", "ai"), ("PerplexityBot", "ai"), ("Perplexity-User", "ai"),
    ("CCBot", "ai"), ("Applebot-Extended", "ai"), ("meta-externalagent", "ai"), ("Bytespider", "ai"), ("Amazonbot", "ai"),
]
FALLBACKS = {"googlebot-image": ["googlebot"], "googlebot-news": ["googlebot"], "claude-user": ["claudebot"], "claude-searchbot": ["claudebot"], "perplexity-user": ["perplexitybot"]}


def lines(robots: DataFrame) -> DataFrame:
    """robots (site, text) -> site, line (from 1), raw, field, value, grp (0: before any group); comments and blank lines are gone.

    A group begins at a user-agent line that doesn't follow another one; lines without a colon don't count in between.
    """
    numbered = robots.where("text is not null").select("site", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("line", "raw"))
    bare = T.squeeze(F.substring_index("raw", "#", 1))
    rows = numbered.select("site", (F.col("line") + 1).alias("line"), "raw", bare.alias("bare")).where("bare <> ''")
    at = F.instr("bare", ":")
    rows = rows.withColumn("field", F.when(at > 0, F.lower(F.trim(F.substring_index("bare", ":", 1))))).withColumn("value", F.when(at > 0, F.trim(F.expr("substring(bare, instr(bare, ':') + 1)"))))
    rows = rows.withColumn("agent", F.coalesce(F.col("field").isin("user-agent", "useragent"), F.lit(False)))
    order = Window.partitionBy("site").orderBy("line")
    before = F.last(F.when(F.col("field").isNotNull(), F.col("agent")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("agent") & ~F.coalesce(before, F.lit(False))
    return rows.withColumn("grp", F.sum(starts.cast("int")).over(order)).drop("agent")


def agents(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("field").isin("user-agent", "useragent")).select("site", "grp", F.lower("value").alias("token")).distinct()


def rules(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("field").isin("allow", "disallow") & (F.col("grp") > 0)).select("site", "grp", F.col("field").alias("type"), F.col("value").alias("path"), "line")


def crawl_delays(parsed: DataFrame) -> DataFrame:
    return parsed.where("field = 'crawl-delay' and grp > 0").groupBy("site", "grp").agg(F.max_by("value", "line").alias("crawl_delay"))


def sitemaps(parsed: DataFrame) -> DataFrame:
    return parsed.where("field = 'sitemap'").select("site", "line", F.col("value").alias("sitemap"))


def errors(parsed: DataFrame) -> DataFrame:
    orphan = F.col("field").isin("allow", "disallow") & (F.col("grp") == 0)
    problem = F.when(F.col("field").isNull(), "no colon").when(orphan, "rule before any user-agent")
    return parsed.withColumn("problem", problem).where("problem is not null").select("site", "line", F.left("bare", F.lit(120)).alias("text"), "problem")


def unknown(parsed: DataFrame) -> DataFrame:
    known = ("user-agent", "useragent", "allow", "disallow", "sitemap", "crawl-delay")
    return parsed.where(F.col("field").isNotNull() & ~F.col("field").isin(*known)).select("site", "line", "field", F.left("value", F.lit(200)).alias("value"))


def pattern(path: Column) -> Column:
    """A rule's path as a regular expression: * is any run, a last $ the end, the rest itself."""
    anchored = path.endswith("$")
    body = F.when(anchored, F.expr("left({0}, length({0}) - 1)".format("path"))).otherwise(path)
    plain = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(plain, r"\*", ".*"), F.when(anchored, "$").otherwise(""))


def path_of(url: Column) -> Column:
    """Path and query of an address, / if it has none."""
    rest = F.regexp_replace(T.no_fragment(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def chain(spark: SparkSession, wanted: list[tuple[str, str]] = AGENTS) -> DataFrame:
    """id, grp_name, token, priority: whose groups an agent may obey, the wildcard last."""
    rows = []
    for name, group in wanted:
        own = name.lower()
        for i, token in enumerate([own, *FALLBACKS.get(own, []), "*"]):
            rows.append((name, group, token, i))
    return spark.createDataFrame(rows, "id string, grp_name string, token string, priority int")


def group_for(parsed: DataFrame, wanted: list[tuple[str, str]] = AGENTS) -> DataFrame:
    """site, id -> the token whose groups an agent obeys, how it was matched, the rules of those groups together, and the first crawl delay that one of them gives."""
    steps = F.broadcast(chain(parsed.sparkSession, wanted))
    obeyed = agents(parsed).join(steps, "token").groupBy("site", "id").agg(F.min_by("token", "priority").alias("token"))
    groups = obeyed.join(agents(parsed), ["site", "token"]).select("site", "id", "token", "grp")
    delays = crawl_delays(parsed).withColumnRenamed("crawl_delay", "delay")
    n = rules(parsed).groupBy("site", "grp").agg(F.count("*").alias("n"))
    every = groups.join(n, ["site", "grp"], "left").join(delays, ["site", "grp"], "left")
    out = every.groupBy("site", "id", "token").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rules"), F.min_by("delay", F.when(F.col("delay").isNotNull(), F.col("grp"))).alias("crawl_delay"))
    return out.select("site", "id", "token", F.when((F.col("token") == "*") & (F.col("id") != "*"), "wildcard").otherwise("name").alias("matched_by"), "n_rules", "crawl_delay")


def is_page(text: Column) -> Column:
    """Whether what answers as robots.txt is a web page; its lines are no rules."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(r"^\s*<(!doctype|html)")


def states(robots: DataFrame) -> DataFrame:
    """robots (site, status, error, text) -> site, verdict, html (a web page answers), usable (its rules count), bytes."""
    verdict = availability(F.col("status"), F.col("error"))
    html = is_page(F.col("text"))
    return robots.select("site", verdict.alias("verdict"), html.alias("html"), ((verdict == "read") & ~html).alias("usable"), F.length(F.coalesce("text", F.lit(""))).alias("bytes"))


def fetched_grid(robots: DataFrame, targets: DataFrame, wanted: list[tuple[str, str]] = AGENTS) -> DataFrame:
    """grid() of fetched files (site, status, error, text): only where a file was read that is no web page."""
    usable = robots.where((availability(F.col("status"), F.col("error")) == "read") & ~is_page(F.col("text")))
    return grid(lines(usable.select("site", "text")), targets.join(usable.select("site"), "site", "left_semi"), wanted)


def grid(parsed: DataFrame, targets: DataFrame, wanted: list[tuple[str, str]] = AGENTS) -> DataFrame:
    """targets (site, url) x agents -> allowed, and the rule, line, token and kind of match that decided.

    Only the dimension of agents is broadcast (three rows an agent). Equal tokens of several groups count as one group.
    """
    steps = F.broadcast(chain(parsed.sparkSession, wanted))
    obeyed = agents(parsed).join(steps, "token").groupBy("site", "id").agg(F.min_by("token", "priority").alias("token"))
    own = obeyed.join(agents(parsed), ["site", "token"]).join(rules(parsed), ["site", "grp"]).where("path <> ''").withColumn("re", pattern(F.col("path")))
    asked = targets.select("site", "url", path_of(F.col("url")).alias("target"))
    weight = F.struct(F.length("path"), F.col("type") == "allow", F.when(F.col("type") == "allow", F.col("line")).otherwise(-F.col("line")))
    hits = asked.join(own, "site").where("target rlike re").groupBy("site", "url", "id").agg(F.max_by(F.struct("type", "path", "line"), weight).alias("rule"))
    dimension = F.array(*(F.struct(F.lit(name).alias("id"), F.lit(group).alias("grp_name")) for name, group in wanted))
    every = asked.select("site", "url", F.inline(dimension))  # a row a crawler
    out = every.join(obeyed, ["site", "id"], "left").join(hits, ["site", "url", "id"], "left")
    return out.select(
        "site", "url", "id", F.col("grp_name").alias("agent_group"),
        F.coalesce(F.col("rule.type") == "allow", F.lit(True)).alias("allowed"),
        F.col("rule.path").alias("rule"), F.col("rule.line").alias("line"), F.col("token").alias("obeys"),
        F.when(F.col("token") == "*", "wildcard").when(F.col("token").isNotNull(), "name").alias("matched_by"),
    )


def availability(status: Column, error: Column) -> Column:
    """What crawlers make of robots.txt's answer: read it, take all as open, or as blocked."""
    return F.when(~T.blank(error) | (status >= 500), "blocked").when(status >= 300, "open").otherwise("read")
