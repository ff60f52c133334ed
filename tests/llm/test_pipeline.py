"""The pipeline against the operators' plain definitions, on the awkward table."""

from __future__ import annotations

import math
from collections import Counter

import corpus_pipeline as cp
from tests.llm import fixtures
from tests.llm.test_operators import brute_classes


def test_stages(spark, tmp_path):
    docs = fixtures.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = docs.collect()
    told = {r.doc_id for r in seen["language ID"]}
    assert not told & {200, 201, 202, 209} and {0, 1, 2, 203, 204} <= told
    lines = seen["line dedup"]
    kept = Counter(x for r in lines for x in r.text.split("\n") if len(x.split()) >= 8)
    assert max(kept.values()) == 1 and all(r.n_chars == len(r.text) for r in lines)
    classes = {c for _, c, _, _ in brute_classes([(r.doc_id, r.text) for r in lines])}
    assert Counter(r.doc_id for r in seen["n-gram Jaccard join"]) == Counter(classes)
    mixed = {r.doc_id for r in seen["mixing"]}
    assert mixed <= classes and mixed
    packed = seen["packing"]
    assert {r.doc_id for r in packed} == mixed
    assert len({r.sequence_id for r in packed}) == math.ceil(sum(r.length for r in packed) / 4096)
    again = cp.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_stages_keep_the_edge_cases(spark, tmp_path):
    """Empty tables, and columns named like the operators' own: each stage gives back its input's columns."""
    full = fixtures.documents(spark)
    for name, docs in (("full", full), ("empty", fixtures.empty(spark))):
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        for stage_name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, path)
            assert out.columns == docs.columns, stage_name
            rows = out.collect()
            assert bool(rows) == (name == "full"), stage_name
            assert {(r.uid, r.place, r.label, r["at"], r.n) for r in rows} <= {(7, "x", "y", "z", 1)}, stage_name
        packed = cp.STAGES[-1][1](spark, docs, path).collect()
        assert len(packed) >= docs.count() and bool(packed) == (name == "full")


def test_stages_on_ties_nulls_and_long_texts(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "Ein Satz mit vielen Worten steht hier.", "de", None, 1), (5, "the same text of quite a few words", "en", "src1", 1), (5, "the same text of quite a few words", "en", "src1", 1), (6, "the same text of quite a few words", "en", "src1", 1), (7, "word " * 60_000, "en", "src0", 1), (8, "", "en", "src2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    ids = lambda k: sorted((r.doc_id if r.doc_id is not None else -1) for r in cp.STAGES[k][1](spark, docs, str(tmp_path)).collect())
    assert set(ids(0)) <= {-1, 5, 6, 7} and ids(0).count(5) in (0, 2)
    assert ids(2) == [-1, -1, 5, 7, 8]
    packed = cp.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.doc_id == 7 for r in packed) == math.ceil((60_000 + 1) / 4096) and sum(r.doc_id == 5 for r in packed) == 2
