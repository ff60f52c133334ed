"""Each operator against a brute-force version, and on the awkward table, and on an empty one."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from pagewright.llm import bloom, graphs, hashing, hilbert_ann, imatch, language_id, line_dedup, mixing, ngram_join, ordering, packing, registry, repeats, suffix_tree_lm, toxicity
from pagewright.llm.common import fold
from tests.llm import fixtures

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.documents(spark).cache()


@pytest.fixture(scope="module")
def table():
    return [(r[0], r[1]) for r in fixtures.rows()]


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r)
    return out


def same(df, sql, spark, tmp_path, docs):
    path = str(tmp_path / "d")
    docs.write.parquet(path)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = c.sql(sql).fetchall()
    cols = [x[0] for x in c.sql(sql).description]
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# ------------------------------------------------------------ 1
def test_mixing_equals_sql(spark, docs, tmp_path):
    got = mixing.mix(docs.withColumn("domain", mixing.domain_of(docs.source)))
    same(got, mixing.oracle(), spark, tmp_path, docs)


def test_mixing_gives_shortage_to_siblings_first(spark):
    # d0 has two languages; en is short, so de takes what en cannot, and d1 nothing of it
    rows = [(i, "w " * 10, lang, source) for i, (lang, source) in enumerate([("en", "s0")] * 2 + [("de", "s0")] * 40 + [("en", "s1")] * 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(d.withColumn("domain", mixing.domain_of(d.source)), weights={"domain": {"d0": 1, "d1": 1}, "lang": {"en": 1, "de": 1}}, share=(1, 2), max_epochs=1)
    budget = {(r.domain, r.lang): r.leaf_budget for r in got.select("domain", "lang", "leaf_budget").distinct().collect()}
    assert budget == {("d0", "en"): 20, ("d0", "de"): 185, ("d1", "en"): 205}


def test_mixing_empty_and_keep(spark, docs):
    e = fixtures.empty(spark)
    assert mixing.mix(e.withColumn("domain", mixing.domain_of(e.source))).count() == 0
    kept = mixing.keep(docs, (4, 5))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    chosen = mixing.mix(docs.withColumn("domain", mixing.domain_of(docs.source)), share=(4, 5), max_epochs=1)
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(r.doc_id for r in chosen.select("doc_id").collect())


# ------------------------------------------------------------ 2
def test_imatch(spark, docs, table):
    got = imatch.fingerprint_edits(docs).collect()
    assert len(got) == len(table)
    prints, text_of = by_id(got), defaultdict(list)
    order = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0))
    unique = {i: t or "" for i, t in order}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        if len(prints[i]) == 1:
            r = prints[i][0]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            text_of[t].append(r.fingerprint)
    assert all(len(set(v)) == 1 for v in text_of.values()) and len(unique) > 50
    assert prints[204][0].near_next == 1.0  # a copy follows
    assert imatch.fingerprint_edits(fixtures.empty(spark)).count() == 0
    one = imatch.fingerprint_edits(docs.where("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_bitmap_is_no_column(spark, docs):
    """A column with the lexicon's bitmap would be copied for each row: the plan has it as a subquery inside the filter."""
    bits, size = imatch.lexicon(docs)
    plan = imatch.hashes(docs, "text", "fp", bits, size)._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan and "__bits" not in plan


@pytest.mark.parametrize("bits", [27, 12])
def test_lexicon_holds_the_band(spark, docs, table, bits, monkeypatch):
    """Every term in the band, and with room enough hardly any other; by the terms' own frequencies."""
    monkeypatch.setattr(imatch, "LEAST_BITS", 12)
    got, size = imatch.lexicon(docs, most_bits=bits)
    words = got.first().bits
    rows = docs.select(F.explode(imatch.term_hashes(F.col("text"))).alias("t")).groupBy("t").count().select("t", "count", *(x.alias(f"p{i}") for i, x in enumerate(imatch.probes(F.col("t"), size)))).collect()
    has = {r.t: all(words[p >> 6] >> (p & 63) & 1 for p in r[2:]) for r in rows}
    most = max(imatch.MIN_DF, int(imatch.MAX_SHARE * len(table)))
    band = {r.t for r in rows if imatch.MIN_DF <= r["count"] <= most}
    assert band and all(has[t] for t in band)
    other = [has[r.t] for r in rows if r.t not in band]
    assert np.mean(other) < (0.05 if bits == 27 else 1.01)


def test_fingerprints_by_brute_force(spark, docs, table):
    """Terms in the lexicon, distinct and sorted, by subset; likeness from the fingerprints alone."""
    bits, size = imatch.lexicon(docs)
    words = bits.first().bits
    hashed = imatch.hashes(docs.where("doc_id is not null"), "text", "fp", bits, size)
    rows = hashed.select("doc_id", "fp", F.array_sort(imatch.term_hashes(F.col("text"))).alias("terms")).collect()
    flat = {t for r in rows for t in r.terms}
    slots = {r.t: r[1:] for r in spark.createDataFrame([(t,) for t in flat], "t long").select("t", *imatch.probes(F.col("t"), size)).collect()}
    listed = {t: all(words[p >> 6] >> (p & 63) & 1 for p in ps) for t, ps in slots.items()}
    wanted = []
    for r in rows:
        own = [t for t in r.terms if listed[t]] or list(r.terms)
        for level in range(imatch.LEVELS):
            if level:
                own = [t for t in own if (t >> 38 + 2 * level) & 3 == 0]
            for g in range(imatch.GROUPS):
                wanted.append((r.doc_id, level * imatch.GROUPS + g, [t for t in own if (t >> 24 + 2 * g) & 3 == 0], r.fp[level * imatch.GROUPS + g]))
    sums = spark.createDataFrame(wanted, "doc_id long, k int, kept array<long>, got long").withColumn("want", F.when(F.size("kept") > 0, F.xxhash64("kept", "k").bitwiseAND(0xFFFFFFFF)).otherwise(0))
    assert sums.where("got <> want").count() == 0 and sums.where("size(kept) > 0").count() > 500


# ------------------------------------------------------------ 3
class BrutePst:
    """The suffix tree over plain tuples; None is the end symbol."""

    def __init__(self, texts, depth=3):
        self.runs = [Counter() for _ in range(depth + 2)]
        for ws in texts:
            seq = [None, *ws, None]
            for i in range(1, len(seq)):
                for k in range(1, min(depth + 1, i + 1) + 1):
                    self.runs[k][tuple(seq[i - k + 1 : i + 1])] += 1
        self.total, once = sum(self.runs[1].values()), sum(n == 1 for n in self.runs[1].values())
        self.unknown = max(once, 1) / (max(self.total, 1) + (once == 0))
        self.states = {}
        for k in range(1, depth + 1):
            nexts = defaultdict(dict)
            for run, n in self.runs[k + 1].items():
                if n >= suffix_tree_lm.MIN_PAIR and self.runs[k][run[:-1]] >= suffix_tree_lm.MIN_CONTEXT:
                    nexts[run[:-1]][run[-1]] = n
            new = {}
            for ctx, own in nexts.items():
                size = self.runs[k][ctx]
                share = {w: (n - suffix_tree_lm.DISCOUNT) / size for w, n in own.items()}
                rest = 1 - sum(share.values())
                gain = (size - sum(own.values())) * math.log(max(rest, 1e-12))
                for w, n in own.items():
                    shorter = self.p(ctx[1:], w)
                    gain += n * math.log((share[w] + rest * shorter) / shorter)
                if gain > suffix_tree_lm.EVIDENCE * math.log(max(size, 2)):
                    new[ctx] = (share, min(max(rest, 1e-9), 1 - 1e-12))
            self.states |= new

    def p(self, ctx, w):
        n = self.runs[1][w,]
        out = n / self.total * (1 - self.unknown) if n else self.unknown
        for k in range(1, len(ctx) + 1):
            if state := self.states.get(ctx[len(ctx) - k :]):
                out = state[0].get(w, 0.0) + state[1] * out
        return out

    def score(self, ws, depth=3):
        seq = [None, *ws, None]
        return sum(math.log10(self.p(tuple(seq[max(0, i - depth) : i]), seq[i])) for i in range(1, len(seq)))


@pytest.mark.parametrize("q_head", [4e-6, 1e-3, 1.0])
def test_suffix_tree(spark, docs, table, q_head, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "TEXT", 3_000)
    got, total = suffix_tree_lm.score_corpus(docs, docs.where(fold("doc_id") != 1), q_head)
    words = [(i, WORD.findall((t or "").translate(LOW))) for i, t in table]
    trained = [ws for i, ws in words if (0 if i is None else zlib.crc32(str(i).encode()) % 5) != 1]
    c = Counter(w for ws in trained for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    tree = BrutePst(trained)
    assert len(tree.states) > 20 and total == n
    want = sorted((i or -1, len(ws) + 1, sum(c[w] > 0 for w in [*ws, None]), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), 6), round(tree.score(ws), 6)) for i, ws in words)
    rows = sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got.collect())
    for a, b in zip(rows, want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-5)
    assert sum(r[4] for r in rows) > sum(r[3] for r in rows)
    for ctx in list(tree.states)[:20]:  # the symbols and the unknown one make one distribution
        assert sum(tree.p(ctx, w) for w in c) + tree.p(ctx, "never seen") == pytest.approx(1)


def test_suffix_tree_without_training(spark, docs):
    got = suffix_tree_lm.score_corpus(docs, docs.where("false"))[0].collect()
    assert len(got) == docs.count() and all(math.isfinite(r.score) and r.n_known == 0 for r in got)
    assert suffix_tree_lm.score_corpus(fixtures.empty(spark), docs)[0].count() == 0


def test_suffix_tree_grows_with_the_corpus(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"t{i // 10}w{w}" for w in rng.integers(0, 20, 150))) for i in range(800)]
    every = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    kept = []
    for n in (400, 800):  # twice as many topics, as much text a topic
        train = every.where(f"doc_id < {n}")
        units = suffix_tree_lm.unit_counts(train).cache()
        total, _, _ = suffix_tree_lm.totals(units)
        levels = suffix_tree_lm.fit(train, units, total, 1e-6)
        kept.append(sum(int(level.selectExpr("sum(length(key)) div 8").first()[0] or 0) for level in levels[1:]))
    assert kept[0] > 1000 and kept[1] > 1.8 * kept[0]


# ------------------------------------------------------------ 4
def brute_repeats(raws: list[bytes], length: int) -> list[bytearray]:
    seen = Counter(hash(b[k : k + length]) for b in raws for k in range(len(b) - length + 1))
    out = []
    for b in raws:
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[hash(b[k : k + length])] > 1:
                cover[k : k + length] = b"\x01" * length
        out.append(cover)
    return out


def brute_rows(raws, length):
    out = Counter()
    for (i, b), cover in zip(raws, brute_repeats([b for _, b in raws], length), strict=True):
        spans = [m.span() for m in re.finditer(b"\x01+", bytes(cover))]
        out[i, len(b), sum(e - s for s, e in spans), tuple(x for p in spans for x in p), bytes(x for x, c in zip(b, cover, strict=True) if not c)] += 1
    return out


def repeat_rows(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, tuple(r.spans), bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize(("length", "hot"), [(400, 512), (100, 512), (100, 0)])
def test_repeats(spark, docs, table, length, hot):
    want = brute_rows([(i, (t or "").encode()) for i, t in table], length)
    got = repeat_rows(repeats.remove(docs, length, hot))
    assert got == want
    assert any(removed for _, _, removed, _, _ in got)
    assert repeats.remove(fixtures.empty(spark)).count() == 0


def test_repeats_of_more_segments_than_a_task_sorts(spark):
    """A passage in more texts than HOT, each with its own words around it, some of them sharing more."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    passage, more = " ".join(word() for _ in range(110)), " ".join(word() for _ in range(60))
    assert len(passage) > repeats.LENGTH
    rows = []
    for i in range(repeats.HOT + 150):
        lead, tail = " ".join(word() for _ in range(rng.randint(0, 12))), " ".join(word() for _ in range(20))
        cut = rng.choice([0, 0, 0, 40])
        rows.append((i, f"{lead} {passage[cut:]} {more if i % 9 == 0 else ''}{tail}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/hot-passage")
    got = repeat_rows(repeats.remove(spark.read.parquet(path)))
    assert got == brute_rows([(i, t.encode()) for i, t in rows], repeats.LENGTH)


def test_repeats_under_400_bytes_stay(spark, tmp_path):
    """The contract counts bytes, not words: a shared passage of over 50 words and 399 bytes stays, one byte more and it goes."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(4, 7)))
    passage = " ".join(word() for _ in range(80))[:400]
    assert len(passage[:399].split()) > 50
    rows = [(1, f"A{passage[:399]}B"), (2, f"C{passage[:399]}D"), (3, "é" + passage[::-1] + "x"), (4, "ü" + passage[::-1] + "y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.queries()["op4_suffix_dedup"](spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert [got[i] for i in (1, 2)] == [(401, 0, 0, sha(t.encode())) for _, t in rows[:2]]
    # the second bytes of é and ü differ, so the repeat starts after them
    assert [got[i] for i in (3, 4)] == [(403, 400, 1, sha(b)) for b in ("éx".encode(), "üy".encode())]
    shorter = repeats.remove(spark.read.parquet(f"{tmp_path}/documents.parquet"), 271)  # by the operator's own parameter
    assert {r.doc_id: r.n_removed for r in shorter.collect()} == {1: 399, 2: 399, 3: 400, 4: 400}


def test_difference_cover_reaches_every_distance():
    c = np.flatnonzero(repeats.COVER)
    assert {int((a - b) % repeats.PERIOD) for a in c for b in c} == set(range(repeats.PERIOD))
    assert repeats.AHEAD.max() <= repeats.STEP


# ------------------------------------------------------------ 5
def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12)).round(3)
    x[300:420] = x[300]  # many copies
    x[10] = 0
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9100, [1.0, float("nan")] + [0.0] * 10), (9200, [1.0, None] + [0.0] * 10), (9300, [1.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = hilbert_ann.search(df, block=64, orderings=24).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append(r)
    assert set(found) == {i for i in range(0, 700, 100)}
    recall = []
    for q, rs in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q], d[10] = np.inf, np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        assert [r["rank"] for r in rs] == list(range(1, 11)) and all(abs(d[r.vec_id] - r.score) < 1e-12 for r in rs)
        recall.append(len({r.vec_id for r in rs} & set(best.tolist())) / 10)
        if q == 300:
            assert [r.vec_id for r in rs] == best.tolist()
    assert np.mean(recall) >= 0.9
    few = hilbert_ann.search(df.where("vec_id in (100, 101, 102)")).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(100, 1), (100, 2)]
    assert hilbert_ann.search(df.where("false")).count() == 0


def nearest(x: np.ndarray, q: int, k: int = 10) -> list[int]:
    d = ((x - x[q]) ** 2).sum(axis=1)
    d[q] = np.inf
    return np.lexsort((np.arange(len(d)), d))[:k].tolist()


def test_neighbours_reach_follows_the_table(spark):
    x = np.random.default_rng(8).normal(size=(3000, 24))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = defaultdict(set)
    for r in hilbert_ann.search(df, every=20, block=16, orderings=4).collect():
        found[r.query_id].add(r.vec_id)
    assert len(found) == 150
    assert np.mean([len(found[q] & set(nearest(x, q))) / 10 for q in found]) >= 0.9


def test_curves_grow_more_slowly_than_the_table(spark):
    """Windows far smaller than the table, without structure: curves are added until the recall holds."""
    made = {}
    for n in (1000, 4000):
        x = np.random.default_rng(8).normal(size=(n, 24))
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
        points = hilbert_ann.valid(df, "vec_id", "embedding").withColumn("asks", F.col("id") % 20 == 0).cache()
        trial = hilbert_ann.Trial(points, 10, 64)
        _, made[n], block = hilbert_ann.curves_needed(points, n, x, trial, 8, 16, 3, 8, 0.9)
        assert block == 8 or made[n] * 3 * 8 >= n
        assert trial.share(block) >= 0.9
    assert made[1000] < made[4000] < 4 * made[1000]


def test_neighbours_by_length_and_repeated_ids(spark):
    rows = [(100, [1.0, 0.0]), (100, [2.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (200, [1.0, 1.0, 1.0]), (3, [1.0, 1.0, 2.0]), (300, [5.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, digest string, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in hilbert_ann.search(df).collect())
    assert {g[:3] for g in got if g[0] == 200} == {(200, 1, 3)} and not [g for g in got if g[0] == 300]
    assert {g[2] for g in got if g[0] == 100} == {1, 2} and all(g[3] == 1.0 for g in got)


def test_neighbours_closer_than_the_codes_tell(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=24) + rng.normal(size=(400, 24)) * 1e-4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = defaultdict(list)
    for r in sorted(hilbert_ann.search(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append(r.vec_id)
    assert {q: v for q, v in found.items()} == {q: nearest(x, q) for q in (0, 100, 200, 300)}


def test_hilbert_keys_walk_the_grid():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    k = hilbert_ann.hilbert_keys(grid, 3)
    assert sorted(k.tolist()) == list(range(512))
    walk = grid[np.argsort(k)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# ------------------------------------------------------------ 6
def test_line_dedup_equals_sql(spark, docs, tmp_path):
    docs.dropDuplicates(["doc_id"]).where("doc_id is not null").write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    got = line_dedup.dedup(one)
    assert {"uid", "at", "label"} <= set(got.columns)
    sums = got.selectExpr("doc_id", "n_lines", "n_deleted", "n_runs", "sha2(coalesce(text, ''), 256) AS kept_sha256")
    same(sums, line_dedup.oracle(), spark, tmp_path, one)


def test_line_dedup_cases(spark, docs):
    got = by_id(line_dedup.dedup(docs).collect())
    assert got[200][0].text is None and got[201][0].text == ""
    assert sorted((r.n_deleted == r.n_lines) for r in got[206]) == [False, True]  # equal rows: the first stays
    assert got[212][0].n_lines == 40 and got[212][0].n_deleted == 39
    assert line_dedup.dedup(fixtures.empty(spark)).count() == 0


# ------------------------------------------------------------ 7
def test_language_id(spark, docs):
    model = language_id.fit(docs, fold("doc_id") != 0)
    assert set(model) == {"en", "de", "fr"}
    got = language_id.predict(docs, model).collect()
    assert len(got) == docs.count() and set(docs.columns) <= set(got[0].asDict())
    long_enough = [r for r in got if r.n_chars and r.n_chars > 150 and r.doc_id not in (210, 211, 212, 213)]
    assert sum(r.lang == r.lang_pred for r in long_enough) / len(long_enough) > 0.95
    for i in (200, 201, 202, 209):
        r = by_id(got)[i][0]
        assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
    assert all(0 <= r.score <= 1 for r in got)
    nothing = language_id.predict(docs, language_id.fit(docs.where("false"), fold("doc_id") != 0)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_language_sizes_are_those_of_whole_texts(spark, docs, table):
    model = language_id.fit(docs, fold("doc_id") != 0, donors=5)
    whole = defaultdict(list)
    for r in fixtures.rows():
        whole[r[2]].append(r[1] or "")
    for lang, raw in model.items():  # every line of a donor is there, whole
        assert all(any(line in t.lower() for t in whole[lang] + sum(whole.values(), [])) for line in raw.decode().split("\n"))
    got = by_id(language_id.predict(docs, model).collect())
    for i, text in table:
        if not text or not any(c.isalpha() for c in text):
            continue
        raw, sizes = text.lower().encode(), {}
        for lang, d in model.items():
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=language_id.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(raw[k : k + language_id.BLOCK])) for k in range(0, len(raw), language_id.BLOCK))
        best, second = sorted(sizes.values())[:2]
        ties = {lang for lang, n in sizes.items() if n == best}
        assert all(r.lang_pred in ties and r.margin == pytest.approx((second - best) / second) and r.accepted == (r.margin >= language_id.MIN_MARGIN) for r in got[i])


def test_language_held_out_and_ties(spark):
    d = spark.read.parquet(f"{DATA[:-5]}0.01/documents.parquet")
    got = language_id.predict(d.where(fold("doc_id") == 0), language_id.fit(d, fold("doc_id") != 0)).where("lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    twins = {"a": b"one two three four " * 9, "b": b"one two three four " * 9}
    rows = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, "one two three " * 20_000)], "doc_id long, text string")
    same = language_id.predict(rows, twins).collect()
    assert {(r.lang_pred, r.accepted) for r in same} == {("a", False)} and same[0].score == same[1].score == 0.5
    assert language_id.predict(rows.where("false"), twins).count() == 0


# ------------------------------------------------------------ 8
def test_packing(spark, docs, table):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(packing.pieces(docs, packing.default_tokenizer()).cache()).collect()
    want = Counter()
    for i, text in table:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == math.ceil(sum(r.length for r in got) / 4096)
    assert packing.pack(packing.pieces(fixtures.empty(spark), packing.default_tokenizer())).count() == 0


def test_ids_are_the_tokenizers():
    rng = random.Random(5)
    pool = [*"abzAZéÉİıΣσς'’.,-_12²½ \n\t\x0b\x1c\x1d\x1e\x1f\x85\u0301\u0323\u00a0\u2003\u200bªßẞǅﬁ中あ😀<|>ΑÅſK", "'s", "'re", "<|endoftext|>", "I\u0307"]
    odd = ["ab\x1ccd", "İ, x", "ΑΣ ΑΣ. σΣ", "", " ", *("".join(rng.choices(pool, k=rng.randint(1, 14))) for _ in range(4000))]
    enc = packing.WordEncoder(packing.default_tokenizer())
    for lo in range(0, len(odd), 50):  # words met in even and in other texts share the memory
        for text, raw in zip(odd[lo : lo + 50], enc.encode_batch(odd[lo : lo + 50]), strict=True):
            assert np.frombuffer(raw, dtype="<u4").tolist() == enc.t.encode(text, add_special_tokens=False).ids, repr(text)


def test_cover_meets_its_bound():
    rng = np.random.default_rng(3)
    total = np.zeros(257, dtype=np.int64)
    np.add.at(total, np.minimum(rng.lognormal(3.6, 0.9, 4000).astype(int) + 1, 255), 20)
    cover = packing.fractional_cover(total, 256)
    assert cover.bound <= cover.size <= 1.01 * cover.bound
    assert cover.bound >= (total * np.arange(257)).sum() / 256 * 0.999
    used = np.zeros(257)
    for config, amount in cover.amounts.items():
        assert sum(config) <= 256
        np.add.at(used, list(config), amount)
    assert (used <= total * (1 + 1e-6) + 1e-6).all() and (used * np.arange(257)).sum() > 0.7 * (total * np.arange(257)).sum()


def test_knapsack_is_exact():
    rng = np.random.default_rng(4)
    prices = np.full(25, -np.inf)
    prices[[3, 5, 7, 11]] = rng.random(4)
    best, _ = packing.knapsack(prices, 24)
    ways = {0: 0.0}
    for a, b, c, d in itertools.product(range(9), range(5), range(4), range(3)):
        size = 3 * a + 5 * b + 7 * c + 11 * d
        ways[size] = max(ways.get(size, -np.inf), a * prices[3] + b * prices[5] + c * prices[7] + d * prices[11])
    assert best.tolist() == pytest.approx([ways.get(k, -np.inf) for k in range(25)])


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for n, top in ((300, 4096), (5_000, 1_500), (2_000, 4096)):
        histogram = Counter(np.minimum(rng.lognormal(6, 1, n).astype(int) % top + 1, 4096).tolist())
        used = Counter()
        plan = packing.plan_sequences(dict(histogram))
        for config, m in plan:
            assert sum(config) <= 4096
            for length in config:
                used[length] += m
        assert used == histogram
        assert sum(m for _, m in plan) <= 1.01 * math.ceil(sum(k * v for k, v in histogram.items()) / 4096) + 1


# ------------------------------------------------------------ 9
def test_toxicity_held_out(spark):
    d = spark.read.parquet(f"{DATA[:-5]}0.1/documents.parquet")
    labels = spark.read.parquet(f"{DATA[:-5]}0.1/labels.parquet")
    model = toxicity.fit(d, labels, fold("doc_id") != 0)
    held = toxicity.score(d.where(fold("doc_id") == 0), model).join(labels, "doc_id").collect()
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in clean) / len(clean) < 0.02
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.9


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(6)
    y, each = rng.integers(0, 2, 7).astype(float), rng.random(7)
    doc, col = rng.integers(0, 7, 20), rng.integers(0, 4, 20)
    pair, pcol, pval = np.array([0, 0, 1, 1, 2]), np.array([0, 1, 1, 3, 2]), np.array([1.0, -1, 1, -1, 1])

    def loss(w, b):
        z = np.bincount(doc, w[col], 7) + b
        return (each * (np.log1p(np.exp(z)) - y * z)).sum() + 0.05 * (w**2).sum() + 3.0 * (np.bincount(pair, pval * w[pcol], 3) ** 2).mean()

    w, b = rng.normal(size=4), 0.3
    got, got_b = toxicity.gradient(w, b, y, each, doc, col, 3, pair, pcol, pval, 3.0, 0.1)
    want = [(loss(w + e, b) - loss(w - e, b)) / 2e-6 for e in np.eye(4) * 1e-6]
    assert got.tolist() == pytest.approx(want, abs=1e-6) and got_b == pytest.approx((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6, abs=1e-6)


def test_toxicity_scores_are_sums_over_features(spark):
    model = toxicity.Model({"bad": 2.0, "^awfu": 1.0, "^awfu+": 0.5, "^awful": 0.25}, -1.0)
    texts = [None, "", "Bad bad.", "awful", "awful awfully awfulness", "awfu", "ok " * 100_000 + "bad", "Bad bad."]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", fold("doc_id")), model).orderBy("doc_id").collect()
    logit = [-1.0, -1.0, 1.0, 0.0, -1 + 1 + 0.5 + 0.25, -1.0, 1.0, 1.0]
    assert [r.score for r in got] == pytest.approx([1 / (1 + math.exp(-x)) for x in logit])
    assert [r.predicted for r in got] == [int(x >= 0) for x in logit]


def test_learnt_groups_hold_chance_down():
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "wxyzv" for b in "abcdef"]
    texts = [" ".join([*rng.choice(words, 14), *(["scum"] if i % 2 else [])]) for i in range(120)]
    labels = [i % 2 for i in range(120)]
    free, held = (toxicity.train(texts, labels, 0.5, counterfactual=c, least=2, stands_out=0.5) for c in (0.0, 50.0))
    of = lambda m: np.std([m.weights.get(w, 0.0) for w in words])
    assert of(held) < 0.7 * of(free) and held.score("you scum") > 0.5 > held.score("you")


def test_counterfactual_penalty_evens_groups_out():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(40)]
    make = lambda extra: " ".join([*rng.choice(words, 12), *extra])
    texts = [make(["muslim", "scum"]) for _ in range(60)] + [make(["christian"]) for _ in range(60)]
    labels = [1] * 60 + [0] * 60
    neutral = {g: f"the {g} family met here" for g in ("muslim", "christian")}
    gap = {}
    for strength in (0.0, 20.0):
        m = toxicity.train(texts, labels, 0.5, counterfactual=strength, least=2)
        gap[strength] = abs(m.score(neutral["muslim"]) - m.score(neutral["christian"]))
        assert m.score("you scum") > 0.5
    assert gap[20.0] < 0.3 * gap[0.0]


def test_toxicity_cases(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, fold("doc_id") != 0)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    none = toxicity.fit(docs, labels.where("false"), fold("doc_id") != 0)
    assert none.score(None) == pytest.approx(0.5) and none.score("") == none.score("x")
    assert toxicity.score(fixtures.empty(spark), model).count() == 0


# ------------------------------------------------------------ 10
def brute_classes(table):
    sets = []
    for _, t in table:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = []
    for i, a in enumerate(sets):
        different = set()
        for j, b in enumerate(sets):
            if a and b and i != j and len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
                if a != b:
                    different.add(b)
        links.append(len(different))
    copies = [sum(b == a for b in sets) if a else 1 for a in sets]
    classes = defaultdict(list)
    for i in range(len(sets)):
        classes[find(i)].append(i)
    out = [None] * len(sets)
    for members in classes.values():
        known = [table[i][0] for i in members if table[i][0] is not None]
        for i in members:
            out[i] = (table[i][0], min(known, default=None), links[i], copies[i])
    return out


def test_ngram_join(spark, docs, table):
    got = [(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(docs).collect()]
    assert Counter(got) == Counter(brute_classes(table))
    assert ngram_join.join(fixtures.empty(spark)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (205, 206, 208)").count() == 0


def test_links_between_texts_of_equal_sets(spark):
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    texts = [base, base.upper(), base.replace(" ", "\n"), base, " ".join([*words[:-1], "other"]), "alone in this"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(d).collect()}
    assert got == {0: (0, 3, 4), 1: (0, 3, 4), 2: (0, 3, 4), 3: (0, 3, 4), 4: (0, 3, 1), 5: (5, 0, 1)}


def test_near_copies_in_large_groups(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 400, 300)]
    rows = []
    for i in range(420):  # more than a tile
        w = list(base)
        for k in rng.integers(0, 300, i % 12):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = [(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(got) == Counter(brute_classes(rows))


def test_depth_follows_what_is_found(spark):
    """A table of very near copies is done with longer prefixes than one whose copies are barely near enough; either way all are found."""
    rng = np.random.default_rng(13)
    depth = {}
    for changed in (1, 8):
        rows = []
        for k in range(12):
            words = [f"v{x}" for x in rng.integers(0, 5000, 400)]
            other = list(words)
            for at in range(20, 20 + 40 * changed, 40):
                other[at] = f"x{k}_{at}"
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        docs = spark.createDataFrame(rows, "uid long, text string").withColumn("doc_id", F.col("uid"))
        floor = ngram_join.depth_for(0.8)
        signed = ngram_join.signed(docs.select("uid", "doc_id", "text"), 5, floor, ngram_join.TREES).cache()
        links, depth[changed] = ngram_join.candidate_links(signed.select("uid", "keys", "tails", "sig"), 0.8, ngram_join.TREES, ngram_join.TARGET)
        assert {(min(r), max(r)) for r in links.collect()} == {(2 * k, 2 * k + 1) for k in range(12)}
    assert depth[1] > depth[8] == floor


def test_depth_meets_the_target():
    k = ngram_join.depth_for(0.8)
    assert 1 - (1 - 0.8**k) ** ngram_join.TREES >= ngram_join.TARGET > 1 - (1 - 0.8 ** (k + 1)) ** ngram_join.TREES


# ------------------------------------------------------------ helpers
def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 60), (60, 70), (5, 5), (200, 201), (201, 200)]
    got = {r.node: r.label for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 60, 60: 60, 70: 60, 200: 200, 201: 200}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x").repartition(5)
    got = ordering.numbered(df, ["x"], "n").collect()
    assert sorted((r.n, r.x) for r in got) == [(i, i) for i in range(1000)]


def test_bloom_loses_none(spark):
    bits = bloom.build(spark.range(0, 5000).select("id"))
    places = spark.range(0, 20000).select("id", bloom.place("id").alias("p")).toPandas()
    has = bloom.has(bits, places["p"].to_numpy())
    assert has[:5000].all() and has[5000:].mean() < 0.01


def test_window_hashes():
    raw = np.frombuffer(b"abcabcab xyz abc", dtype=np.uint8)
    p = hashing.prefixes(raw)
    h = hashing.windows(p, np.array([0, 3, 1, 13]), np.array([3, 6, 4, 16]))
    assert h[0] == h[1] == h[3] != h[2]
    start, words = hashing.word_hashes(np.frombuffer(b" the cat  the\n", dtype=np.uint8))
    assert start.tolist() == [1, 5, 10] and words[0] == words[2] != words[1]


def test_registry_has_all_ten():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.queries()}) == list(range(1, 11))
