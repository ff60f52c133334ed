"""Nearest neighbours by shifted space-filling curves.

Each curve has its own random projection to DIMS dimensions and its own random shift; a vector's place on a
curve is the Hilbert key of its projected, shifted and quantised coordinates. All vectors are sorted along
every curve (range partitions, numbered across them) and cut into blocks of BLOCK; a query meets the vectors
of its own block and of those beside it. How many curves that takes follows from the table: TRIAL queries
are answered exactly by one scan, and curves are added, ORDERINGS at a time, until TARGET of their pairs of
query and neighbour stand within a block of each other on some curve. A neighbour's chance on a curve falls more
slowly than the share of the table that a block is, so curves grow as a small power of the rows, and the work
of a query more slowly than the table. Where as many curves would meet as many vectors as a scan, the table is small: blocks are
widened instead.

Vectors travel as one byte a component, with the length of what that rounds off, which bounds how wrong a
distance can be; every candidate that could be among the k nearest of those met is reranked on the original
vectors in double precision.

Equal vectors are one point of the curves, with the ``k`` + 1 smallest ids that have it, so that copies
neither fill a window nor meet in one task; any answer needs no more of their ids.

The projections' bounds come from a sample of SAMPLE vectors at most; every vector is indexed.

Edge cases: null or zero vectors, vectors with null or non-finite components, and rows without id take no part.
Vectors of different lengths have no distance: each length is searched by itself. Equal distances go by id. Fewer than k candidates: all of them. Rows with the same
id are candidates of other ids only. Extra columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import stash, tidied
from pagewright.llm.graphs import whole_groups
from pagewright.llm.ordering import numbered

ORDERINGS, DIMS, BITS, BLOCK, SAMPLE, K, EVERY = 16, 16, 3, 640, 10_000, 10, 100
TRIAL, TARGET, WIDEST, TILE = 64, 0.95, 65_536, 2_000_000


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of coordinates below 2^bits (Skilling's transposition, all rows at once)."""
    x = x.astype(np.uint32).copy()
    n = x.shape[1]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = np.uint32(q - 1)
        for i in range(n):
            set_ = (x[:, i] & np.uint32(q)) != 0
            swap = np.where(set_, np.uint32(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.uint32)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where((x[:, n - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | (x[:, i] >> np.uint32(b) & np.uint32(1)).astype(np.uint64)
    return key.astype(np.int64)  # bits * n is 63 at most


class Curves:
    def __init__(self, sample: np.ndarray, orderings: int = ORDERINGS, dims: int = DIMS, bits: int = BITS, seed: int = 5) -> None:
        rng, width = np.random.default_rng(seed), sample.shape[1]
        self.bits, self.axes, self.low, self.scale = bits, [], [], []
        for _ in range(orderings):
            axes = np.linalg.qr(rng.normal(size=(width, min(dims, width))))[0]
            p = sample @ axes
            low, high = np.quantile(p, 0.001, axis=0), np.quantile(p, 0.999, axis=0)
            span = np.maximum(high - low, 1e-12)
            self.axes.append(axes)
            self.low.append(low - rng.random(axes.shape[1]) * span * 0.1)  # the shift
            self.scale.append((1 << bits) / (span * 1.1))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """One column of keys an ordering."""
        top = (1 << self.bits) - 1
        return np.stack([hilbert_keys(np.clip((x @ a - lo) * s, 0, top), self.bits) for a, lo, s in zip(self.axes, self.low, self.scale, strict=True)], axis=1)


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (bytes of doubles), digest of the vectors that take part."""
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.select("id", "v", F.sha2(F.to_json(F.struct("v")).cast("binary"), 256).alias("digest"))


def packed(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def places(points: DataFrame, curves: Curves, first: int = 0) -> DataFrame:
    """o (from `first` on), key, id, asks: each point once an ordering."""
    held = points.sparkSession.sparkContext.broadcast(curves)
    schema = pa.schema([("o", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("asks", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = held.value.keys(packed(b.column("v")))
                n, m = k.shape
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(first, first + m, dtype=np.int32), n)), pa.array(k.ravel()), pa.array(np.repeat(b.column("id").to_numpy(), m)), pa.array(np.repeat(b.column("asks").to_numpy(zero_copy_only=False), m))], schema=schema)

    return points.select("id", "asks", "v").mapInArrow(tidied(run), "o int, key long, id long, asks boolean")


def coded(points: DataFrame) -> DataFrame:
    """id, code (a byte a component), unit (what a step of it is worth), off (the distance between the vector and what its code says)."""
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    codes = points.select("id", "v", F.transform("v", lambda x: F.round(x / largest * 127).cast("byte")).alias("code"), (largest / 127).alias("unit"))
    square = F.aggregate(F.zip_with("v", "code", lambda x, c: (x - c * F.col("unit")) * (x - c * F.col("unit"))), F.lit(0.0), lambda s, x: s + x)
    return codes.select("id", "code", "unit", F.sqrt(square).alias("off"))


def exact_pairs(points: DataFrame, trial: list, k: int) -> list:
    """(q, id) of the k nearest points of each trial row, by one scan."""
    held = points.sparkSession.sparkContext.broadcast((np.array([r.id for r in trial]), np.array([r.v for r in trial], dtype=np.float64)))
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("d2", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, x = held.value
        for b in batches:
            if b.num_rows:
                c, ids = packed(b.column("v")), b.column("id").to_numpy()
                d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * (x @ c.T)
                d[qs[:, None] == ids[None]] = np.inf
                n = min(k, len(ids))
                best = np.argpartition(d, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, n)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(d, best, 1).ravel())], schema=schema)

    got = points.select("id", "v").mapInArrow(tidied(run), "q long, id long, d2 double").where("q <> id")
    return got.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy("d2", "id"))).where(F.col("__r") <= k).select("q", "id").collect()


class Trial:
    """Pairs of a query and one of its k nearest points, and how near each other they have come on a curve so far."""

    def __init__(self, points: DataFrame, k: int, size: int) -> None:
        rows = points.where("asks").orderBy(F.xxhash64("id"), "id").limit(size).select("id", "v").collect()
        self.pairs = [tuple(p) for p in exact_pairs(points, rows, k)] if rows else []
        self.gaps = [math.inf] * len(self.pairs)

    def look(self, at: DataFrame) -> None:
        """at: o, id, n of more curves."""
        ids = sorted({i for p in self.pairs for i in p})
        on: dict[int, dict[int, int]] = {i: {} for i in ids}
        for o, i, n in at.where(F.col("id").isin(ids)).select("o", "id", "n").collect():  # TRIAL * (k + 1) ids at most
            on[i][o] = n
        self.gaps = [min(g, *(abs(n - on[i][o]) for o, n in on[q].items())) for g, (q, i) in zip(self.gaps, self.pairs, strict=True)]

    def share(self, block: int) -> float:
        return sum(g <= block for g in self.gaps) / len(self.gaps) if self.gaps else 1.0

    def width(self, target: float) -> int:
        return sorted(self.gaps)[math.ceil(target * len(self.gaps)) - 1] if self.gaps else 0


def curves_needed(points: DataFrame, total: int, fitted: np.ndarray, trial: Trial, orderings: int, dims: int, bits: int, block: int, target: float) -> tuple[DataFrame, int, int]:
    """o, id, asks, n (place on the curve) of every point on as many curves as it takes; how many these are, and the width of a block."""
    at, made = None, 0
    while True:
        more = numbered(places(points, Curves(fitted, orderings, dims, bits, seed=5 + made), made), ["o", "key", "id"], "n")
        more = more.select("o", "id", "asks", (F.col("n") - (F.col("o") - made) * F.lit(total)).alias("n"))
        trial.look(more)
        at, made = more if at is None else at.unionByName(more), made + orderings
        if trial.share(block) >= target:
            return at, made, block
        if made * 3 * block >= total:
            return at, made, max(block, trial.width(target))


def near_in_blocks(dealt: DataFrame, k: int) -> DataFrame:
    """dealt (o, block, asks, id, code, unit, off), sorted: q, id, low, high (bounds of the distance) of what may be among each query's k nearest in the block."""
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["o", "block"]):
            x = packed(t.column("code").combine_chunks()).astype(np.float32) * t.column("unit").to_numpy().astype(np.float32)[:, None]
            ids, asks, square, off = t.column("id").to_numpy(), t.column("asks").to_numpy(), (x * x).sum(axis=1), t.column("off").to_numpy()
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                own = np.arange(s, e)
                every, c = own[asks[s:e]], own[~asks[s:e]]
                if not len(c):
                    continue
                step = max(1, TILE // len(c))
                for q in (every[i : i + step] for i in range(0, len(every), step)):
                    both = square[q][:, None] + square[c][None]
                    d2 = np.maximum(both - 2 * (x[q] @ x[c].T), 0).astype(np.float64)
                    lost = both * (np.finfo(np.float32).eps * (x.shape[1] + 8))  # by single precision
                    away = off[q][:, None] + off[c][None]
                    low = np.nan_to_num(np.sqrt(np.maximum(d2 - lost, 0)) - away, nan=0.0)
                    high = np.nan_to_num(np.sqrt(d2 + lost) + away, nan=np.inf)
                    may = low <= np.partition(high, k - 1, axis=1)[:, k - 1 : k] if len(c) > k else np.ones(low.shape, dtype=bool)
                    i, j = np.nonzero(may)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q][i]), pa.array(ids[c][j]), pa.array(low[may]), pa.array(high[may])], schema=schema)

    return dealt.mapInArrow(tidied(run), "q long, id long, low double, high double")


def search(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id `every` divides."""
    rows = stash(valid(vectors, id_col, vec_col))
    lengths = [r[0] for r in rows.select(F.size("v")).distinct().orderBy(F.size("v")).collect()]
    out = None
    for n in lengths or [0]:
        own = search_one_length(rows if len(lengths) < 2 else rows.where(F.size("v") == n), k, every, **options)
        out = own if out is None else out.unionByName(own)
    return out


def search_one_length(rows: DataFrame, k: int, every: int, orderings: int = ORDERINGS, dims: int = DIMS, bits: int = BITS, block: int = BLOCK, sample: int = SAMPLE, trial: int = TRIAL, target: float = TARGET) -> DataFrame:
    """search() of rows of valid() whose vectors have one length."""
    spark = rows.sparkSession
    asks = F.col("id") % every == 0
    smallest = rows.select("digest", "id").distinct().withColumn("__r", F.row_number().over(Window.partitionBy("digest", F.pmod(F.xxhash64("id"), F.lit(16))).orderBy("id"))).where(F.col("__r") <= k + 1)
    smallest = smallest.withColumn("__r", F.row_number().over(Window.partitionBy("digest").orderBy("id"))).where(F.col("__r") <= k + 1).groupBy("digest").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = rows.groupBy("digest").agg(F.min("id").alias("id"), F.max(asks).alias("asks"))
    points = stash(rows.join(classes, ["digest", "id"]).dropDuplicates(["id"]).join(smallest, "digest"))
    queries = rows.where(asks).select(F.col("id").alias("query_id"), "digest").distinct().join(points.select("digest", F.col("id").alias("q")), "digest").select("query_id", "q")
    picked = points.select("v").orderBy(F.xxhash64("id")).limit(sample).collect()
    fitted = np.array([r.v for r in picked], dtype=np.float64) if picked else np.zeros((1, 1))
    total = points.count()
    at, _, wide = curves_needed(points, total, fitted, Trial(points, k, trial), orderings, dims, bits, block, target)
    reach = -(-wide // WIDEST)
    at = at.withColumn("block", F.expr(f"n div {-(-wide // reach)}"))
    codes = coded(points)
    as_candidates = at.select("o", "block", F.lit(False).alias("asks"), "id")
    as_queries = at.where("asks").select("o", F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach)).alias("block"), F.lit(True).alias("asks"), "id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = as_candidates.unionByName(as_queries).join(codes, "id").select("o", "block", "asks", "id", "code", "unit", "off").repartition(parts, "o", "block").sortWithinPartitions("o", "block")
    short = near_in_blocks(dealt, k + 1).groupBy("q", "id").agg(F.max("low").alias("low"), F.min("high").alias("high"))
    short = short.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy("high", "id")))
    short = short.withColumn("__cut", F.min(F.when(F.col("__r") == k + 1, F.col("high"))).over(Window.partitionBy("q")))
    short = short.where(F.col("__cut").isNull() | (F.col("low") <= F.col("__cut"))).select("q", "id")
    exact = short.join(points.select("id", "ids", F.col("v").alias("cv")), "id").join(points.select(F.col("id").alias("q"), "v"), "q")
    square = F.aggregate(F.zip_with("v", "cv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    exact = exact.select("q", "id", "ids", F.sqrt(square).alias("score"))
    exact = exact.withColumn("__r", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("__r") <= k + 1)
    answers = queries.join(exact, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
