"""From documents to packed training sequences: five stages, each on all that the one before kept.

All stages: an empty table gives an empty table; columns beside those of documents are carried by all stages but
the last, whatever their names; rows of equal or null doc_id are documents of their own; texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import language_id, line_dedup, mixing, ngram_join, packing
from pagewright.llm.common import documents, fold, stash

#: Share of the tokens that reach the mixing stage and that the mixture may take.
MIX_SHARE = (4, 5)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told clearly; a missing lang becomes the told one.

    Null texts and texts without a letter go. Equal texts are told alike. Where nothing can be learnt, no language is told and all go.
    """
    model = language_id.fit(docs, fold("doc_id") != 0)
    told = language_id.predict(docs, model).where("accepted")
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents with nothing else in them go. Null texts stay as they are."""
    clean = line_dedup.dedup(docs)
    left = clean.where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the smallest id (null is smaller than any), the first row of equal ids. Null, empty and blank texts stay."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch of the target mixture over domains, languages and sources; null levels are a node of their own. Documents without a word fit any prefix that reaches them."""
    return mixing.keep(docs, MIX_SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens. A null or empty text is a piece of the end id alone."""
    return packing.pack(stash(packing.pieces(docs, packing.default_tokenizer())))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", delete_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can't express the compression and the packing: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
