"""Mixing sources to target weights over a tree (domain, language, source), DataFrame operations only.

The token budget flows from the root down. At each node it is poured over the children in proportion to
their weights, no child above what its subtree can supply (tokens times ``max_epochs``); what one child
cannot take goes to its siblings, and only a node whose whole subtree is short leaves anything to its
own siblings. A leaf uses whole epochs first, then the longest prefix, in that epoch's seeded order, of
documents whose tokens fit the remainder.

Seeded orders are md5 of seed, epoch and id. A leaf's prefix is found from sums by hash bucket; rows are
only ranked inside the one bucket that the prefix ends in, so that a leaf with a third of all rows never
meets in one task.

Edge cases: null levels form a node ``(none)``; null or blank texts have 0 tokens and fit any prefix
that reaches them. Rows with equal ids follow one another, shorter first; a null id hashes as ``null``.
Nodes of weight 0 get nothing. An empty table gives no rows. Input columns named like result columns are
replaced, others are not carried by ``mix``; ``keep`` returns the input's own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import documents, stash

LEVELS = ["domain", "lang", "source"]
#: Integer weights by level and value; a value that isn't named has DEFAULT_WEIGHT.
WEIGHTS = {"domain": {"d0": 40, "d1": 30, "d2": 20, "d3": 10}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {"src0": 3}}
DEFAULT_WEIGHT, BUDGET_SHARE, MAX_EPOCHS, SEED, BUCKET_CHARS = 1, (3, 5), 3, "mix-1", 3


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo four; sources without one are d0."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.when(n == "", 0).otherwise(n.try_cast("long") % 4).cast("string"))


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weight(level: str, weights: dict[str, dict[str, int]], default: int) -> Column:
    out = F.lit(default)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, w).otherwise(out)
    return out.cast("double")


def pour(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """nodes (parents, level, w, capacity, and the parent's budget) with `poured`: the level's share of it."""
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy("__r", level)
    w, c = F.col("w"), F.when(F.col("w") > 0, F.col("capacity")).otherwise(0.0)
    full = F.coalesce(F.sum("__c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    n = nodes.withColumn("__c", c).withColumn("__r", F.when(w > 0, c / w).otherwise(0.0))
    n = n.withColumn("__l", (F.col("budget") - full) / F.when(rest > 0, rest))
    n = n.withColumn("__full", (w <= 0) | (F.col("__c") <= w * F.col("__l")))
    n = n.withColumn("__s", F.max(F.when(~F.col("__full"), F.col("__l"))).over(group))
    return n.withColumn("poured", F.when(F.col("__full"), F.col("__c")).otherwise(w * F.col("__s"))).drop("__c", "__r", "__l", "__full", "__s")


def budgets(slim: DataFrame, levels: list[str], weights: dict, default: int, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """One row per leaf: levels, leaf_tokens, leaf_budget."""
    leaves = stash(slim.groupBy(*levels).agg(F.sum("n_tokens").alias("leaf_tokens")))
    total = int(leaves.agg(F.sum("leaf_tokens")).first()[0] or 0)
    budget = F.lit(float(total * share[0] // share[1]))
    for i, level in enumerate(levels):
        parents = levels[:i]
        nodes = leaves.groupBy(*parents, level).agg((F.sum("leaf_tokens") * max_epochs).cast("double").alias("capacity")).withColumn("w", weight(level, weights, default))
        nodes = nodes.join(poured, parents) if parents else nodes.withColumn("budget", budget)  # noqa: F821
        poured = pour(nodes, parents, level).select(*parents, level, F.col("poured").alias("budget"))
    return leaves.join(poured, levels).select(*levels, "leaf_tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("leaf_budget"))


def slim_of(docs: DataFrame, levels: list[str]) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("(none)")).alias(x) for x in levels), "doc_id", tokens_of(F.col("text")).alias("n_tokens"))


def hashed(epoch: Column, seed: str) -> Column:
    """A document's place in an epoch's seeded order."""
    return F.md5(F.concat_ws("/", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def planned(slim: DataFrame, levels: list[str], weights: dict, default: int, share: tuple[int, int], max_epochs: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The leaves with budget, whole epochs, the bucket in which the prefix of the last epoch ends and what is left for it; and the rows of that epoch."""
    plan = budgets(slim, levels, weights, default, share, max_epochs)
    plan = plan.withColumn("__full", F.when(F.col("leaf_tokens") > 0, F.floor(F.col("leaf_budget") / F.greatest("leaf_tokens", F.lit(1)))).otherwise(0).cast("int"))
    plan = stash(plan.withColumn("__rest", F.col("leaf_budget") - F.col("__full") * F.col("leaf_tokens")))
    rows = slim.join(plan, levels).where((F.col("leaf_budget") > 0) | (F.col("leaf_tokens") == 0))
    last = rows.withColumn("epoch", F.col("__full") + 1).where(F.col("__full") < max_epochs).withColumn("__h", hashed(F.col("epoch"), seed)).withColumn("__b", F.left("__h", F.lit(BUCKET_CHARS)))
    sums = last.groupBy(*levels, "__b").agg(F.sum("n_tokens").alias("__t"), F.first("__rest").alias("__rest"))
    upto = Window.partitionBy(*levels).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("__upto", F.sum("__t").over(upto))
    # the first bucket whose sum goes over the remainder
    over = sums.where(F.col("__upto") > F.col("__rest")).groupBy(*levels).agg(F.min(F.struct("__b", (F.col("__rest") - F.col("__upto") + F.col("__t")).alias("left"))).alias("__at"))
    edge = stash(over.select(*levels, F.col("__at.__b").alias("__edge"), F.col("__at.left").alias("__left")))
    return plan.join(edge, levels, "left"), last.join(edge, levels, "left")


def on_edge(last: DataFrame, levels: list[str]) -> DataFrame:
    """Rows of the bucket that the prefix ends in which still fit."""
    rank = Window.partitionBy(*levels).orderBy("__h", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return last.where(F.col("__b") == F.col("__edge")).withColumn("__upto", F.sum("n_tokens").over(rank)).where(F.col("__upto") <= F.col("__left"))


def mix(docs: DataFrame, levels: list[str] = LEVELS, weights: dict = WEIGHTS, default: int = DEFAULT_WEIGHT, share: tuple[int, int] = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Chosen documents: levels, doc_id, epoch, n_tokens, leaf_tokens, leaf_budget. docs has the levels, doc_id and text."""
    slim = stash(slim_of(docs, levels))
    plan, last = planned(slim, levels, weights, default, share, max_epochs, seed)
    out = [*levels, "doc_id", "epoch", "n_tokens", "leaf_tokens", "leaf_budget"]
    whole = slim.join(plan.where(F.col("__full") > 0), levels).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("__full"))))
    before = last.where(F.col("__edge").isNull() | (F.col("__b") < F.col("__edge")))
    return whole.select(*out).unionByName(before.select(*out)).unionByName(on_edge(last, levels).select(*out))


def keep(docs: DataFrame, share: tuple[int, int], levels: list[str] = LEVELS, weights: dict = WEIGHTS, default: int = DEFAULT_WEIGHT, seed: str = SEED) -> DataFrame:
    """The rows of docs (doc_id, lang, source, text) that one epoch of the mixture takes, as they are.

    A prefix is known by its last document, so that rows meet a table of leaves only, and texts are not
    shuffled. Rows with the same id and number of tokens as that document stay together.
    """
    rows = docs.withColumn("domain", domain_of(F.col("source")))
    slim = stash(slim_of(rows, levels))
    plan, last = planned(slim, levels, weights, default, share, 1, seed)
    cut = on_edge(last, levels).groupBy(*levels).agg(F.max(F.struct("__h", "n_tokens")).alias("__cut"))
    plan = stash(plan.join(cut, levels, "left").where((F.col("leaf_budget") > 0) | (F.col("leaf_tokens") == 0)).select(*(F.col(x).alias(f"__k_{x}") for x in levels), "__full", "__edge", "__cut"))
    h = hashed(F.lit(1), seed)
    inside = F.left(h, F.lit(BUCKET_CHARS)) < F.col("__edge")
    cut_off = F.coalesce(F.struct(h.alias("__h"), tokens_of(F.col("text")).alias("n_tokens")) <= F.col("__cut"), F.lit(False))
    on = [F.coalesce(F.col(x).cast("string"), F.lit("(none)")) == F.col(f"__k_{x}") for x in levels]
    return rows.join(plan, on).where((F.col("__full") > 0) | F.col("__edge").isNull() | inside | cut_off).select(*docs.columns)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mix(docs.withColumn("domain", domain_of(F.col("source"))))


def _case(level: str, weights: dict[str, dict[str, int]], default: int) -> str:
    return "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in weights.get(level, {}).items()) + f" ELSE {default} END" if weights.get(level) else str(default)


def _poured(i: int, levels: list[str], weights: dict, default: int, max_epochs: int) -> str:
    """SQL of one level: n<i> has the nodes with their budgets, p<i> what each gets."""
    parents, level = levels[:i], levels[i]
    keys = ", ".join([*parents, level])
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    join = f"JOIN p{i - 1} USING ({', '.join(parents)})" if parents else "CROSS JOIN total"
    return f"""
    n{i} AS (SELECT {", ".join(f"a.{k}" for k in [*parents, level])}, a.c, CAST({_case(f"a.{level}", {f"a.{level}": weights.get(level, {})}, default)} AS DOUBLE) AS w, budget
             FROM (SELECT {keys}, CAST(sum(leaf_tokens) * {max_epochs} AS DOUBLE) AS c FROM leaves GROUP BY {keys}) a {join}),
    l{i} AS (SELECT *, (budget - coalesce(sum(c) OVER ({part} ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                       / sum(w) OVER ({part} ORDER BY c / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM n{i}),
    p{i} AS (SELECT {keys}, CASE WHEN c <= w * l THEN c ELSE w * max(CASE WHEN c > w * l THEN l END) OVER ({part}) END AS budget FROM l{i})"""


def oracle(table: str = "documents", levels: list[str] = LEVELS, weights: dict = WEIGHTS, default: int = DEFAULT_WEIGHT, share: tuple[int, int] = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> str:
    """The same rows in DuckDB SQL, by plain windows over whole leaves."""
    keys = ", ".join(levels)
    return f"""
    WITH slim AS (
      SELECT 'd' || CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 0 ELSE CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 END AS domain,
             coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, doc_id,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM {table}),
    leaves AS (SELECT {keys}, CAST(sum(n_tokens) AS BIGINT) AS leaf_tokens FROM slim GROUP BY {keys}),
    total AS (SELECT CAST(sum(leaf_tokens) * {share[0]} // {share[1]} AS DOUBLE) AS budget FROM leaves),
    {",".join(_poured(i, levels, weights, default, max_epochs) for i in range(len(levels)))},
    plan AS (SELECT {keys}, leaf_tokens, CAST(floor(budget + 1e-6) AS BIGINT) AS leaf_budget FROM leaves JOIN p{len(levels) - 1} USING ({keys})),
    epochs AS (SELECT slim.*, leaf_tokens, leaf_budget, CAST(e.epoch AS INTEGER) AS epoch, md5(concat_ws('/', '{seed}', CAST(e.epoch AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS h
               FROM slim JOIN plan USING ({keys}), (SELECT unnest(range(1, {max_epochs + 1})) AS epoch) e WHERE leaf_budget > 0 OR leaf_tokens = 0),
    sums AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys}, epoch ORDER BY h, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM epochs)
    SELECT {keys}, doc_id, epoch, n_tokens, leaf_tokens, leaf_budget FROM sums
    WHERE CASE WHEN leaf_tokens = 0 THEN epoch = 1 ELSE upto <= leaf_budget - (epoch - 1) * leaf_tokens
               AND (epoch <= leaf_budget // leaf_tokens + 1) END"""
