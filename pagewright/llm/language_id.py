"""Language identification by compression with per-language raw-content dictionaries.

Each language has a zstandard dictionary made of whole training texts; lines that several
languages have (licences, headers) say nothing of the language and stand once in every dictionary. A text, in lower case,
is compressed whole with every dictionary, in blocks, so that a long text cannot train itself away from
the dictionary; the language whose dictionary gives the fewest bytes wins. Where the best two sizes lie
within ``min_margin`` of each other the answer is kept but marked as not accepted.

Edge cases: a null text, and one without a letter, is ``und`` with score 0 and not accepted. Ties go to
the language with the larger dictionary, then to the alphabetically first. Equal rows get equal answers. With nothing to learn from every row is ``und``. Extra columns pass
through ``predict`` untouched; result columns of the same name are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import documents, fold, tidied

#: Bound of the training sample: so many whole texts a language, none longer than this.
DONORS, DONOR_CHARS = 64, 1_000_000
LEVEL, BLOCK = 9, 2_048
#: Relative difference of the two smallest sizes under which a document is rejected.
MIN_MARGIN = 0.004
RESULT = "lang_pred string, score double, margin double, accepted boolean"


def fit(docs: DataFrame, train: Column, donors: int = DONORS, donor_chars: int = DONOR_CHARS, seed: int = 7) -> dict[str, bytes]:
    """Dictionaries by language, from the ``donors`` texts with the smallest seeded hash among the rows that ``train`` keeps."""
    pool = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.length("text").between(1, donor_chars))
    order = F.xxhash64(F.lit(seed), F.xxhash64("text"))
    # first in each of 64 hash classes of a language, then of the few that are left: no task sees a whole language
    firsts = pool.select("lang", order.alias("__h")).distinct()
    for group in (["lang", F.pmod("__h", F.lit(64))], ["lang"]):
        firsts = firsts.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy("__h"))).where(F.col("__r") <= donors)
    keys = firsts.select("lang", "__h")
    wanted: dict[str, set[int]] = {}
    for lang, h in keys.collect():  # donors rows a language
        wanted.setdefault(lang, set()).add(h)
    if not wanted:
        return {}
    hashes = sorted({h for hs in wanted.values() for h in hs})
    rows = pool.withColumn("__h", order).where(F.col("__h").isin(hashes)).groupBy("lang", "__h").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for lang, h, text in rows:
        if h in wanted[lang]:
            texts.setdefault(lang, []).append((h, text))
    lines = {lang: list(dict.fromkeys(line for _, t in sorted(got) for line in t.split("\n"))) for lang, got in sorted(texts.items())}
    times = Counter(line for own in lines.values() for line in own)
    shared = sorted(line for line, n in times.items() if n > 1)
    return {lang: plain("\n".join([*shared, *(line for line in own if times[line] < 2)])) for lang, own in lines.items()}


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


class Compressors:
    """One compressor a language; sizes() gives the bytes a text takes with each."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, block: int = BLOCK) -> None:
        self.langs, self.block = sorted(dictionaries, key=lambda x: (-len(dictionaries[x]), x)), block
        self.each = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.each.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        raw = plain(text)
        parts = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.each], dtype=np.float64)


def decide(sizes: np.ndarray, langs: list[str], min_margin: float) -> tuple[str, float, float, bool]:
    order = np.lexsort((np.arange(len(sizes)), sizes))
    best = sizes[order[0]]
    second = sizes[order[1]] if len(order) > 1 else best * 2
    margin = float((second - best) / second)
    # each byte of difference counts as one bit of evidence, for the words of a text are not independent
    odds = np.exp2(-np.minimum(sizes - best, 60.0)).sum()
    return langs[order[0]], float(1 / odds), margin, margin >= min_margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin and accepted."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded: DONORS texts a language

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        use = Compressors(held.value)
        for texts in batches:
            out = []
            for t in texts:
                if t is None or not use.langs or not any(map(str.isalpha, t)):
                    out.append(("und", 0.0, 0.0, False))
                else:
                    out.append(decide(use.sizes(t), use.langs, min_margin))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "margin", "accepted"])

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidied(each)(batches)

    # called nondeterministic so that a filter on the result does not evaluate it a second time
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "margin", "accepted", "__lid")]
    return docs.select(*kept, judge.asNondeterministic()(F.col("text")).alias("__lid")).select(*kept, "__lid.*")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, fold("doc_id") != 0)
    slim = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text")
    return predict(slim, model).select("doc_id", "held_out", "lang_pred", "score", "margin", "accepted")
