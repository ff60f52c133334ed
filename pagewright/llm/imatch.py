"""Document fingerprints after I-Match, DataFrame operations only.

Terms (lower-cased words) are known by 64-bit hashes. Document frequencies are counted term by term, and the
terms whose inverse document frequency lies in the chosen band form the lexicon. It is kept as a bitmap with
PROBES bits of one word a term and SLACK bits or more for each of them, up to 2^MOST_BITS (16 MB): a term in the band is always
found, one outside it passes for one with a chance of about (PROBES / SLACK)^PROBES, half a percent, as long as the lexicon has fewer than
2^MOST_BITS / SLACK terms (4 million), and more often beyond. A document's terms in the lexicon are made distinct
and sorted; then every randomised lexicon subset keeps the terms that its bits of the term hash select
and hashes what is left. Subsets come in several densities, for short and long documents. A fingerprint
is the list of these hashes; the likeness of two fingerprints is the share of equal hashes, in the density
where it is largest.

Edge cases: null texts are empty. A text without a term in the band is fingerprinted over all its terms;
one without terms has the empty fingerprint, equal to itself only. Documents follow one another by
(doc_id, nulls first, then row order), the last by the first; a single document follows itself. Extra
columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import documents, row_ids, stash

GROUPS, LEVELS = 8, 6
PROBES, SLACK, LEAST_BITS, MOST_BITS = 2, 28, 20, 27
#: The band: a term must occur in MIN_DF documents and in at most this share of them.
MIN_DF, MAX_SHARE = 2, 0.13
SPLIT = r"[\s\p{Punct}]+"


def term_hashes(text: Column) -> Column:
    """Distinct term hashes of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != ""), lambda w: F.xxhash64(w)))


def probes(term: Column, bits: int) -> list[Column]:
    """The slots of a term in a bitmap of 2^bits: PROBES of one word, so that a look-up reads one word."""
    return [word_of(term, bits) * 64 + place for place in places(term)]


def word_of(term: Column, bits: int) -> Column:
    return term.bitwiseAND((1 << bits - 6) - 1)


def places(term: Column) -> list[Column]:
    """The bits of a term in its word."""
    return [F.shiftrightunsigned(term, 64 - 6 * (k + 1)).bitwiseAND(63) for k in range(PROBES)]


def lexicon(docs: DataFrame, min_df: int = MIN_DF, max_share: float = MAX_SHARE, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """One row, `bits`: an array of 64-bit words with the bits of the terms in the band; and the logarithm of how many bits there are."""
    n = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col("text"))).alias("t")).groupBy("t").count()
    band = stash(terms.where(F.col("count").between(min_df, max(min_df, int(max_share * n)))).select("t"))
    size = min(most_bits, max(LEAST_BITS, (SLACK * band.count()).bit_length()))
    slots = band.select(F.explode(F.array(*probes(F.col("t"), size))).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("word"))
    every = docs.sparkSession.range(1 << size - 6).join(words, "id", "left").select(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")).alias("x"))
    return stash(every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["word"]).alias("bits"))), size  # 2^(most_bits - 6) rows at most


def hashes(df: DataFrame, text: str, out: str, bits: DataFrame, size: int) -> DataFrame:
    """df with `out`: array<long> of GROUPS * LEVELS subset hashes of the text column, 0 where a subset is empty."""

    def listed(t: Column) -> Column:
        mask = F.lit(0).cast("long")
        for place in places(t):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")))
        return F.element_at("__bits", (word_of(t, size) + 1).cast("int")).bitwiseAND(mask) == mask

    # A column with the bitmap would be copied for each row (up to 16 MB). It is named once, and every other column
    # beside it is a plain one, so the optimizer puts the subquery itself into the filter, where nothing is copied;
    # __again keeps that projection apart from the one that makes the terms.
    df = df.withColumn("__all", term_hashes(F.col(text))).select("*", F.col("__all").alias("__again"), bits.scalar().alias("__bits"))
    df = df.withColumn("__in", F.filter("__again", listed)).drop("__bits", "__again")
    df = df.withColumn("__p0", F.sort_array(F.when(F.size("__in") > 0, F.col("__in")).otherwise(F.col("__all")))).drop("__all", "__in")
    for level in range(1, LEVELS):  # each level has a quarter of the terms of the one before
        df = df.withColumn(f"__p{level}", F.filter(f"__p{level - 1}", lambda t: F.shiftright(t, 38 + 2 * level).bitwiseAND(3) == 0))  # noqa: B023

    def subset(level: int, group: int) -> Column:
        kept = F.filter(f"__p{level}", lambda t: F.shiftright(t, 24 + 2 * group).bitwiseAND(3) == 0)
        return F.when(F.size(kept) > 0, F.xxhash64(kept, F.lit(level * GROUPS + group)).bitwiseAND(0xFFFFFFFF)).otherwise(F.lit(0).cast("long"))

    return df.withColumn(out, F.array(*(subset(lv, g) for lv in range(LEVELS) for g in range(GROUPS)))).drop(*(f"__p{i}" for i in range(LEVELS)))


def written(fp: str) -> Column:
    """A fingerprint as text: eight hex digits a subset."""
    return F.array_join(F.transform(fp, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes among the subsets that are not empty in both, in the density where it is largest.

    A density counts if at least half of its subsets are not empty; without such a density all subsets count.
    """
    total = lambda x, y, test: F.aggregate(F.zip_with(x, y, lambda p, q: F.when(test(p, q), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    same, either = (lambda p, q: (p == q) & (p != 0)), (lambda p, q: (p != 0) | (q != 0))
    shares = []
    for level in range(LEVELS):
        x, y = F.slice(a, level * GROUPS + 1, GROUPS), F.slice(b, level * GROUPS + 1, GROUPS)
        n = total(x, y, either)
        shares.append(F.when(n * 2 >= GROUPS, total(x, y, same) / n.cast("double")))
    every = total(F.col(a), F.col(b), same) / total(F.col(a), F.col(b), either).cast("double")
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.coalesce(F.greatest(*shares), every))


def successors(rows: DataFrame) -> DataFrame:
    """rows (uid, doc_id, n) -> uid, prev, prev_n: the row before each in (doc_id, uid) order, around the end.

    Rows are dealt to ranges of ids; inside a range a window finds the neighbour, and the ends of the
    ranges, one row each, are joined up.
    """
    dealt = stash(rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id").asc_nulls_first(), "uid").withColumn("range", F.spark_partition_id()))
    order = [F.col("doc_id").asc_nulls_first(), F.col("uid")]
    inside = Window.partitionBy("range").orderBy(*order)
    near = dealt.withColumn("prev", F.lag("uid").over(inside)).withColumn("prev_n", F.lag("n").over(inside)).withColumn("later", F.lead("uid").over(inside))
    tails = near.where(F.col("later").isNull()).select("range", F.struct("uid", "n").alias("tail"))
    around = Window.partitionBy(F.lit(0)).orderBy("range")
    last = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc())
    tails = tails.withColumn("__b", F.coalesce(F.lag("tail").over(around), F.first("tail").over(last))).select("range", "__b")
    return near.join(tails, "range").select("uid", F.coalesce("prev", "__b.uid").alias("prev"), F.coalesce("prev_n", "__b.n").alias("prev_n"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    bits, size = lexicon(docs)
    rows = row_ids(docs.select("doc_id", "text")).select("uid", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    before = stash(successors(rows.select("uid", "doc_id", F.length("text").cast("long").alias("n"))))
    own = hashes(rows, "text", "fp", bits, size)
    both = own.join(before, "uid")
    # every row goes on to the row before it as that one's next document, cut to what the edit takes
    nexts = both.select(F.col("prev").alias("uid"), F.col("doc_id").alias("next_doc_id"), F.expr("left(text, cast(prev_n div 4 as int))").alias("patch"), F.col("fp").alias("next_fp"))
    d = both.select("uid", "doc_id", "text", "fp").join(nexts, "uid")
    n = F.length("text")
    d = d.withColumn("edited", F.expr("concat(left(text, length(text) - cast(length(text) div 4 as int)), patch)"))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", "next_doc_id", "edited", F.sha2("edited", 256).alias("edited_sha256"))
    d = hashes(d, "edited", "edited_fp", bits, size)
    return d.select("doc_id", "n_chars", "edited_sha256", written("fp").alias("fingerprint"), written("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "next_doc_id")


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
