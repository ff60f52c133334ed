"""Line deduplication: suffix array over line ids by distributed prefix doubling.

Documents are sequences of their non-blank lines, in doc_id order. Lines that occur once break every
repeat, so only the others go on. Their ranks are the suffix order by one line; each round ranks pairs
(rank here, rank 2^k lines further on), the suffix order by 2^(k+1) lines, and drops what has become
unique, until nothing is left: the intervals of equal ranks are the intervals of the suffix array with a
common prefix of that many lines. An interval's smallest place is the copy that stays. A place whose
interval of 2^k lines begins earlier has those lines repeated from an earlier copy; the largest such
stretches at neighbouring places add up to the maximal repeated runs, which are deleted if they have two
lines or more, or one of at least ``min_words`` words.

Ranking never brings an interval to one task: pairs are pre-aggregated before they are shuffled, and the
distinct pairs are numbered by range.

Edge cases: null is kept as null; blank lines stay, unless every other line of the document goes, then
the text is empty. Equal doc_ids follow one another in row order; a null doc_id comes first. Repeats
inside a document count, also overlapping ones. Extra columns pass through ``dedup``. Lines are compared
by 96 bits of hashes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import documents, row_ids, stash, tidied
from pagewright.llm.ordering import numbered

MIN_WORDS = 8
LINE_BITS = 24  # lines in a document


def lines_of(rows: DataFrame, min_words: int) -> DataFrame:
    """uid, i (place among the non-blank lines), h, g (hashes), long (min_words words or more) of every non-blank line."""
    several = rf"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{max(min_words - 1, 0)}}}[^\x20\x09-\x0D]"
    line = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), x.rlike(several).alias("long")))
    return rows.select("uid", F.posexplode(line).alias("i", "x")).select("uid", "i", "x.*")


def repeated(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """uid, covered: (first line, number of lines) of stretches that an earlier copy has; rows has uid, doc_id, text."""
    lines = stash(lines_of(rows.where("text is not null"), min_words))  # a few bytes a line; texts are split once
    several = lines.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1").select("h", "g")
    ranks = numbered(several, ["h", "g"], "rank")
    order = numbered(rows.select("uid", "doc_id"), ["doc_id", "uid"], "n")
    active = lines.join(ranks, ["h", "g"]).join(order.select("uid", "n"), "uid")
    active = active.select((F.col("n") * (1 << LINE_BITS) + F.col("i")).alias("place"), "uid", "i", "long", "rank")
    # written first, so that both sides of the join are plain exchanges, which can be split where a line is very common
    first = stash(active.groupBy("rank").agg(F.min("place").alias("first")))
    now = stash(active.join(first, "rank"))
    found = [now.where("first < place").select("uid", "i", F.lit(1).alias("size"), "long")]
    size = 1
    while True:
        ahead = Window.partitionBy("uid").orderBy("i").rangeBetween(size, size)
        pairs = now.select("place", "uid", "i", "rank", F.max("rank").over(ahead).alias("next")).where("next is not null")
        several = pairs.groupBy("rank", "next").agg(F.count("*").alias("c"), F.min("place").alias("first")).where("c > 1").select("rank", "next", "first")
        ranks = numbered(several, ["rank", "next"], "new")
        now = stash(pairs.join(ranks, ["rank", "next"]).select("place", "uid", "i", F.col("new").alias("rank"), "first"))
        if now.isEmpty():
            break
        size *= 2
        found.append(now.where("first < place").select("uid", "i", F.lit(size).alias("size"), F.lit(False).alias("long")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    longest = every.groupBy("uid", "i").agg(F.max("size").alias("size"), F.max("long").alias("long"))
    kept = longest.where("size > 1 or long")
    return kept.groupBy("uid").agg(F.collect_list(F.struct("i", "size")).alias("covered")).select("uid", F.col("covered.i").alias("at"), F.col("covered.size").alias("sizes"))


def cleaned(text: str | None, at, sizes) -> tuple[str | None, int, int, int]:
    """text without the covered lines; its number of non-blank lines, how many went, and in how many runs."""
    if text is None:
        return None, 0, 0, 0
    lines = text.split("\n")
    real = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
    if at is None or not len(at):
        return text, len(real), 0, 0
    gone = bytearray(len(real) + 1)
    for i, n in zip(at, sizes, strict=True):
        gone[i : i + n] = b"\x01" * n
    drop = {real[k] for k in range(len(real)) if gone[k]}
    runs = sum(1 for k in range(len(real)) if gone[k] and not (k and gone[k - 1]))
    if len(drop) == len(real):
        return "", len(real), len(drop), runs
    return "\n".join(x for k, x in enumerate(lines) if k not in drop), len(real), len(drop), runs


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the cleaned text, n_lines, n_deleted and n_runs."""
    rows = row_ids(docs, "__uid")
    found = stash(repeated(rows.select(F.col("__uid").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words)).select(F.col("uid").alias("__uid"), F.col("at").alias("__at"), F.col("sizes").alias("__sizes"))

    def each(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, at, sizes in parts:
            yield pd.DataFrame([cleaned(t, a, n) for t, a, n in zip(text, at, sizes, strict=True)], columns=["text", "n_lines", "n_deleted", "n_runs"])

    @F.pandas_udf("text string, n_lines long, n_deleted long, n_runs long")
    def clean(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from tidied(each)(parts)

    joined = rows.join(found, "__uid", "left").withColumn("__c", clean.asNondeterministic()("text", "__at", "__sizes"))  # else a filter evaluates it again
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted", "n_runs")]
    return joined.select(*(F.col("__c.text").alias("text") if c == "text" else F.col(c) for c in names), "__c.n_lines", "__c.n_deleted", "__c.n_runs")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "n_lines", "n_deleted", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle(table: str = "documents", min_words: int = MIN_WORDS) -> str:
    """The same in DuckDB SQL: with a least run of two lines, lines and pairs of lines seen before decide."""
    return f"""
    WITH all_lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM {table} WHERE text IS NOT NULL),
    real AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, md5(line) AS h FROM all_lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    pairs AS (SELECT *, h || lead(h) OVER (PARTITION BY doc_id ORDER BY i) AS hh FROM real),
    seen AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS one,
                    hh IS NOT NULL AND row_number() OVER (PARTITION BY hh ORDER BY doc_id, i) > 1 AS two FROM pairs),
    judged AS (SELECT *, (one AND len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= {min_words}) OR two
                         OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY i), false) AS gone FROM seen),
    runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM judged),
    counts AS (SELECT doc_id, count(*) AS n_real, count(*) FILTER (gone) AS n_gone, count(*) FILTER (starts) AS n_starts FROM runs GROUP BY doc_id),
    kept AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.k) AS text FROM all_lines a LEFT JOIN judged j ON a.doc_id = j.doc_id AND a.k = j.k
             WHERE coalesce(j.gone, false) = false GROUP BY a.doc_id)
    SELECT t.doc_id, CAST(coalesce(n_real, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_gone, 0) AS BIGINT) AS n_deleted, CAST(coalesce(n_starts, 0) AS BIGINT) AS n_runs,
           sha256(CASE WHEN n_real = n_gone THEN '' ELSE coalesce(kept.text, '') END) AS kept_sha256
    FROM {table} t LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)"""
