"""Near-duplicate join on word n-grams: MinHash LSH forest, then exact Jaccard similarity.

Texts are sets of runs of five words (lower case, split at white space; a text of fewer words is one
run). Equal sets are one class of copies, and one member stands for it from here on. Each of TREES trees has
every representative under its own signature, a path of DEEPEST labels (minima of the set under random
orders). A tree is kept as its sorted paths: nodes are runs of equal prefixes. Matching starts at the whole
path and shortens it label by label. At each length, representatives that meet at a node for the first time
(their longer prefixes differ) are linked when their signatures agree in ESTIMATE of the places, a bound that
a pair at the threshold misses about once in 10^8. How far prefixes are shortened follows from what was found: the
walk ends when a pair as little similar as any that was linked (less MARGIN for the error of signatures)
would have met with probability `target`, and one at the threshold, should none have been seen yet, with
probability UNSEEN; at the latest where a pair at the threshold meets with probability `target`.

Links only decide which texts are looked at
together: inside a component of linked pairs every pair is verified on the exact sets, in tiles of
fixed size, so that no group lands in one task and links are counted without being listed. Members of a node or
component are dealt to tiles by the hash of their number, so nothing is ranked.

Result: one row per document with its class (smallest doc_id connected by links or copies), the number
of links (different texts at the threshold or above, those with an equal set among them) and of copies
(rows with an equal set).

Edge cases: null, empty and blank texts have no runs, are alone in their class and have no links. Rows
with equal or null doc_id are separate documents. Extra columns are not carried. An empty table gives no
rows. Sets are compared by 64-bit hashes of their runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm import bloom, hashing
from pagewright.llm.common import by_size, documents, row_ids, stash, tidied
from pagewright.llm.graphs import components, forest, whole_groups

N, THRESHOLD, TREES, DEEPEST, TARGET, ESTIMATE = 5, 0.8, 24, 8, 0.99999, 0.55
MARGIN, UNSEEN = 0.1, 0.999
BUCKET_TILE, SET_TILE, BATCH = 1_024, 256, 1_000_000


def chance(similarity: float, depth: int, trees: int) -> float:
    """How likely a pair meets in some tree at this depth."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float, trees: int = TREES, target: float = TARGET, deepest: int = DEEPEST) -> int:
    """The longest prefix at which a pair at the threshold meets with probability `target`."""
    return next((k for k in range(deepest, 1, -1) if chance(threshold, k, trees) >= target), 1)


def deep_enough(least: float | None, depth: int, threshold: float, trees: int, target: float) -> bool:
    """Whether prefixes need not be shortened any more; least: the smallest similarity among the pairs linked so far."""
    like_these = least is None or chance(max(threshold, least - MARGIN), depth, trees) >= target
    return like_these and chance(threshold, depth, trees) >= min(UNSEEN, target)


def sets_of(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text one after another, and how many each text has."""
    raw = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    joined = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    start, words = hashing.word_hashes(joined)
    ends = np.cumsum([len(r) + 1 for r in raw])
    first = np.concatenate(([0], np.searchsorted(start, ends)))
    out = [np.unique(hashing.shingles(words[a:b], n)) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.array([len(x) for x in out], dtype=np.int64)


def signatures(values: np.ndarray, sizes: np.ndarray, count: int, seed: int = 10) -> np.ndarray:
    """count minima for each non-empty set, one row a set."""
    rng = np.random.default_rng(seed)
    mul, xor = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)
    full = sizes[sizes > 0]
    starts = (np.cumsum(full) - full).astype(np.int64)
    out = np.empty((len(starts), count), dtype=np.uint64)
    for k in range(count):
        out[:, k] = np.minimum.reduceat((values ^ xor[k]) * mul[k], starts) if len(starts) else 0
    return hashing.mix(out)


def signed(docs: DataFrame, n: int, depth: int, trees: int, deepest: int = DEEPEST) -> DataFrame:
    """uid, doc_id, exact (of the text), same (of the set), keys and tails (one a tree: the prefix of `depth` labels, and a byte for each label after it), sig (a byte a minimum of the prefixes); the last three null for empty sets."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("exact", pa.binary()), ("same", pa.binary()), ("keys", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole, BATCH):
                texts = b.column("text").to_pylist()
                exact = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() if t else None for t in texts]
                values, sizes = sets_of(texts, n)
                minima = signatures(values, sizes, trees * deepest).reshape(-1, trees, deepest)
                keys, tails = np.zeros(minima.shape[:2], dtype=np.uint64), np.zeros(minima.shape[:2], dtype=np.uint64)
                for d in range(deepest):
                    if d < depth:
                        keys = keys * hashing.BASE + minima[:, :, d]
                    else:
                        tails = tails << np.uint64(8) | minima[:, :, d] >> np.uint64(56)
                keys = hashing.mix(keys + np.arange(trees, dtype=np.uint64)).view(np.int64)
                tails = tails.view(np.int64)
                sig = (minima[:, :, :depth] >> np.uint64(56)).astype(np.uint8).reshape(-1, trees * depth)
                same, k, t, s, at, row = [], [], [], [], 0, 0
                for size in sizes.tolist():
                    if size:
                        same.append(hashlib.blake2b(values[at : at + size].tobytes(), digest_size=16).digest())
                        k.append(keys[row]), t.append(tails[row])
                        s.append(sig[row].tobytes())
                        row += 1
                    else:
                        same.append(None), k.append(None), t.append(None), s.append(None)
                    at += size
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(exact, pa.binary()), pa.array(same, pa.binary()), pa.array(k, pa.list_(pa.int64())), pa.array(t, pa.list_(pa.int64())), pa.array(s, pa.binary())], schema=schema)

    return docs.mapInArrow(tidied(run), "uid long, doc_id long, exact binary, same binary, keys array<long>, tails array<long>, sig binary")


def tiles(members: DataFrame, sizes: DataFrame, key: str, tile: int) -> DataFrame:
    """members (key, uid, ...) once for every pair of blocks that the row's block is in: ti <= tj; sizes (key, __n) are counted before."""
    blocks = F.expr(f"cast((__n - 1) div {tile} + 1 as int)")
    dealt = members.join(sizes, key).withColumn("__b", F.pmod(F.xxhash64("uid"), blocks).cast("int")).withColumn("__o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    out = dealt.select(*members.columns, "__b", F.least("__b", "__o").alias("ti"), F.greatest("__b", "__o").alias("tj"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(parts, key, "ti", "tj").sortWithinPartitions(key, "ti", "tj", "__b")


def met_at(nodes: DataFrame, reps: DataFrame, depth: int, estimate: float, deepest: int = DEEPEST, floor: int = 1) -> DataFrame:
    """Links (a, b, s: their similarity as signatures tell it) that span the pairs meeting for the first time at nodes of this depth."""
    cut, longer = 8 * (deepest - depth), 8 * (deepest - depth - 1)
    node = F.col("key") if depth == floor else F.xxhash64("key", F.shiftright("tail", cut))
    before = F.shiftright("tail", longer) if depth < deepest else F.lit(-1).cast("long")  # the prefix that was matched before
    own = nodes.select(node.alias("node"), before.alias("before"), "uid")
    apart = own.groupBy("node").agg(F.count("*").alias("__n"), F.min("before").alias("lo"), F.max("before").alias("hi"))
    apart = apart.where("__n > 1" if depth == deepest else "lo < hi").select("node", "__n")
    tiled = tiles(own.join(reps.select("uid", "sig"), "uid"), apart, "node", BUCKET_TILE)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["node", "ti", "tj"]):
            uid, deep = t.column("uid").to_numpy(), t.column("before").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(uid), -1)
            sizes = np.diff(np.append(starts, len(uid)))
            group = np.repeat(np.arange(len(starts)), sizes)
            small = np.repeat(sizes <= 12, sizes)
            a, b, s = [], [], []
            first = depth == deepest

            def add(i: np.ndarray, j: np.ndarray) -> None:
                a.append(uid[i]), b.append(uid[j]), s.append((sig[i] == sig[j]).mean(axis=1))  # noqa: B023

            for d in range(1, 12):  # all pairs of small groups, one distance at a time
                i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]) & (first | (deep[:-d] != deep[d:]))) if d < len(uid) else np.zeros(0, int)
                if len(i):
                    i = i[(sig[i] == sig[i + d]).mean(axis=1) >= estimate]
                    add(i, i + d)
            for at, n in zip(starts[sizes > 12].tolist(), sizes[sizes > 12].tolist(), strict=True):
                own, own_deep = sig[at : at + n], deep[at : at + n]
                near = lambda i, rest: ((own[rest] == own[i]).mean(axis=1) >= estimate) & (first | (own_deep[rest] != own_deep[i]))  # noqa: B023, E731
                pairs = np.array(list(forest(n, near)), dtype=np.int64).reshape(-1, 2)
                add(at + pairs[:, 0], at + pairs[:, 1])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64()), pa.array(np.concatenate(s), pa.float64())], schema=schema)

    return tiled.select("node", "before", "ti", "tj", "uid", "sig").mapInArrow(tidied(run), "a long, b long, s double").where("a <> b")


def candidate_links(reps: DataFrame, threshold: float, trees: int, target: float, estimate: float = ESTIMATE, deepest: int = DEEPEST) -> tuple[DataFrame, int]:
    """Links (a, b) between representatives (uid, keys, tails, sig), and the depth at which the walk ended."""
    floor = depth_for(threshold, trees, target, deepest)
    every = reps.select("uid", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("tails").alias("tail"))))
    shared = stash(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    nodes = stash(every.join(shared, "key").select("uid", "key", "tail"))
    found, least = None, None
    for depth in range(deepest, floor - 1, -1):
        links = stash(met_at(nodes, reps, depth, estimate, deepest, floor))
        found = links if found is None else found.unionByName(links)
        now = links.where(F.col("s") >= threshold - MARGIN).agg(F.min("s")).first()[0]
        least = min((x for x in (least, now) if x is not None), default=None)
        if deep_enough(least, depth, threshold, trees, target):
            break
    return found.select("a", "b"), depth


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each pair of sets shares; only values that two sets hold are laid out."""
    value, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[where]
    owner, col = owner[keep], column[where[keep]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for lo in range(0, int(shared.sum()), 8_192):
        s, e = np.searchsorted(col, [lo, lo + 8_192])
        x = np.zeros((len(sets), min(8_192, int(shared.sum()) - lo)), dtype=np.float32)
        x[owner[s:e], col[s:e] - lo] = 1
        out += x @ x.T
    return out


def verified(members: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """members (label, uid, texts, grams) and sizes (label, __n) -> uid, links (to texts), and a: a verified neighbour (rows of links 0 only span classes)."""
    schema = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["label", "ti", "tj"]):
            uid, block, texts = t.column("uid").to_numpy(), t.column("__b").to_numpy(), t.column("texts").to_numpy()
            grams, tj, ti = t.column("grams"), t.column("tj").to_numpy(), t.column("ti").to_numpy()
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(uid)], strict=True):
                if e - s < 2:
                    continue
                sets = [np.frombuffer(g.as_py(), dtype=np.uint64) for g in grams[s:e]]
                size = np.array([len(x) for x in sets], dtype=np.float32)
                both = intersections(sets)
                # in integers up to 2^24: i >= t * (a + b - i), with room for the rounding of t only
                near = both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-3
                np.fill_diagonal(near, False)
                if ti[s] != tj[s]:
                    own = block[s:e]
                    near &= own[:, None] != own[None, :]
                links = near @ texts[s:e]
                rows = [(int(uid[s + i]), int(links[i]), int(uid[s + i])) for i in np.flatnonzero(links)]
                rows += [(int(uid[s + i]), 0, int(uid[s + j])) for i, j in forest(e - s, lambda i, rest: near[i, rest])]  # noqa: B023
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return tiles(members, sizes, "label", SET_TILE).select("label", "ti", "tj", "__b", "uid", "texts", "grams").mapInArrow(tidied(run), "uid long, links long, a long")


def grams_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """uid, grams (sorted 64-bit hashes) of the documents whose uid is wanted, and of a few others."""
    held = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted.select("uid")))  # 2 MB
    schema = pa.schema([("uid", pa.int64()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            b = whole.filter(pa.array(bloom.has(held.value, whole.column("place").to_numpy())))
            for part in by_size(b, BATCH):
                values, sizes = sets_of(part.column("text").to_pylist(), n)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                grams = [values[s:e].tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(grams, pa.binary())], schema=schema)

    return docs.select("uid", "text", bloom.place("uid").alias("place")).mapInArrow(tidied(run), "uid long, grams binary")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, uid (the place of the row in docs) and label (of the class) for every row of docs (doc_id, text)."""
    rows = row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("uid", "doc_id", "text")
    all_signed = stash(signed(rows, n, depth_for(threshold, trees, target), trees))
    full = all_signed.where("same is not null")
    by_text = full.groupBy("same", "exact").agg(F.min(F.struct("uid", "keys", "tails", "sig")).alias("r"), F.count("*").alias("copies"))
    reps = stash(by_text.groupBy("same").agg(F.min("r").alias("r"), F.sum("copies").alias("copies"), F.count("*").alias("texts")).select("same", "copies", "texts", "r.*"))
    label = stash(components(candidate_links(reps, threshold, trees, target)[0]).withColumnRenamed("node", "uid"))
    sizes = stash(label.groupBy("label").agg(F.count("*").alias("__n")))
    found = stash(verified(label.join(reps.select("uid", "texts"), "uid").join(grams_of(rows, label, n), "uid"), sizes, threshold))
    links = found.groupBy("uid").agg(F.sum("links").alias("n_links"))
    group = components(found.where("links = 0").select(F.col("uid").alias("b"), "a")).withColumnRenamed("node", "uid")
    heads = stash(reps.select("same", "uid", "copies", "texts").join(group, "uid", "left").join(links, "uid", "left").select("same", F.coalesce("label", "uid").alias("label"), (F.coalesce("n_links", F.lit(0)) + F.col("texts") - 1).cast("long").alias("n_links"), F.col("copies").alias("n_copies")))
    member = stash(all_signed.select("uid", "doc_id", "same").join(heads, "same", "left").select("uid", "doc_id", F.coalesce("label", "uid").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")))
    smallest = member.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return member.join(smallest, "label").select("doc_id", "class_id", "n_links", "n_copies", "uid", "label")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the first document (doc_id, then row order) of each class."""
    classes = stash(join(docs.select("doc_id", "text"), **options).select("uid", "doc_id", "label"))
    first = classes.groupBy("label").agg(F.min(F.struct("doc_id", "uid")).alias("x")).select("x.uid")
    # what goes is less than what stays, and the join that is told of it need not shuffle texts for as long
    gone = stash(classes.join(first, "uid", "left_anti").select(F.col("uid").alias("__uid")))
    return row_ids(docs, "__uid").join(gone, "__uid", "left_anti").select(*docs.columns)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).drop("uid", "label")
