"""Connected components, and groups of rows in sorted Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import stash


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> node, label: the smallest node of each component. Alternating large and small stars.

    Each round is one aggregation to the smallest neighbour and one join, on edges that only get fewer;
    its result is written before the next. Self-loops and repeated edges do no harm; no edges, no rows.
    """
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: the join then has plain exchanges on both sides, and a node with very many neighbours can be split
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stash(down.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that split no group of equal keys, and where each group starts. The stream must be sorted by keys."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        last, first = [b.column(k)[b.num_rows - 1].as_py() for k in keys], [held[0].column(k)[0].as_py() for k in keys]
        if last == first:
            continue  # all one group so far
        t = pa.Table.from_batches(held)
        at = starts(t)
        yield t.slice(0, at[-1]), at[:-1]
        held = t.slice(at[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def forest(n: int, near) -> Iterator[tuple[int, int]]:
    """Edges that span the components of 0..n-1; near(i, rest) tells which of the places `rest` are linked to i."""
    rest = np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            for j in rest[hit].tolist():
                yield i, j
                queue.append(j)
            rest = rest[~hit]
