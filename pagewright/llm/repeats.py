"""Removal of repeated byte strings, by suffix sorting one bucket at a time with a difference cover.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too. Every window of
that length is put under its anchor: the 64-byte string inside it whose hash is smallest, the leftmost of
equals. Equal windows have equal anchors at equal offsets, so the windows under one anchor hash are one
bucket of the suffix array, and no bucket needs another. Anchors that occur once are left out.

1. Anchors of every document are counted by hash.
2. The texts meet their recurring anchors again and give off, for each, the bytes that the windows under it
   span (a segment). Equal segments are one row from there on: their windows all recur.
3. Buckets are sorted. Suffixes at difference-cover residues (by distance from the anchor, modulo 64) get
   ranks first, by 64-byte blocks and doubling; any other suffix is ordered by the up to eight bytes before
   its next cover position and that position's rank. Neighbours that share ``length`` bytes are repeats.
4. The repeated windows of each document are joined, and taken out of its text.

A bucket with more than HOT distinct segments (a passage that very many texts share, each going on in its
own way) is too large for one task. It is split by its next bytes: the windows that start in the first half of the
distances to the anchor have more bytes in common than the anchor, and so have those of the second half;
the hash of these bytes names the new bucket, and the segment is cut to the windows' span. Equal windows stay
together, segments that only differed outside become one, those that differ inside part. Splitting goes on
while a bucket is too large, log2(length) times at most, for then a bucket is one window. So memory is that of
HOT segments, and every bucket is sorted the same way. Ids are the rows' places, so equal or null doc_ids are
separate documents.

Edge cases: null is empty (sha of nothing); texts under ``length`` bytes are kept whole; matches never
cross documents; overlapping repeats inside one document count. Extra columns are not carried. An empty
table gives no rows. Windows are compared by 64-bit hashes after sorting. A batch that joins more than 2^POSITION bytes is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import hashing
from pagewright.llm.common import by_size, documents, row_ids, stash, tidied
from pagewright.llm.graphs import whole_groups

LENGTH, GRAM, PERIOD, STEP = 400, 64, 64, 8
POSITION = 30  # bits for the place in a batch: texts up to 1 GiB
BATCH, HOT = 1_000_000, 2_048  # bytes of text at once; distinct segments that a task sorts together

#: Difference cover of 64: 0..7 and every eighth from 7 on; each distance is a difference of two of these.
COVER = np.zeros(PERIOD, dtype=bool)
COVER[:STEP] = True
COVER[STEP - 1 :: STEP] = True
AHEAD = np.array([next(t for t in range(PERIOD) if COVER[(r + t) % PERIOD]) for r in range(PERIOD)])


def loaded(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def anchors(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts joined: bytes, and for every run of windows under one anchor its document, first and last start, anchor place and hash."""
    joined = np.frombuffer(b"".join(raw), dtype=np.uint8)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    none = np.zeros(0, np.int64)
    if len(joined) >= 1 << POSITION:
        raise ValueError(f"a text of {len(joined)} bytes is longer than places can tell")
    if len(joined) < length:
        return joined, none, none, none, none, none
    prefix = hashing.prefixes(joined)
    n = len(joined) - GRAM + 1
    h = hashing.windows(prefix, slice(0, n), slice(GRAM, GRAM + n))
    low = np.uint64((1 << POSITION) - 1)
    key = (h & ~low) | np.arange(n, dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if width > have:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(raw)), np.maximum(sizes - length + 1, 0))
    first = np.cumsum(np.maximum(sizes - length + 1, 0))
    start = np.arange(len(doc)) - (first - np.maximum(sizes - length + 1, 0))[doc] + (ends - sizes)[doc]
    if not len(start):
        return joined, none, none, none, none, none
    at = (key[start] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((new[1:] - 1, [len(at) - 1]))
    return joined, doc[new], start[new], start[last], at[new], h[at[new]].view(np.int64)


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """hash, uid, times (1, or 2 for more) of the anchors of each document."""
    schema = pa.schema([("hash", pa.int64()), ("uid", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole, BATCH):
                _, doc, _, _, _, h = anchors(loaded(b.column("text").to_pylist()), length)
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, int)
                times = np.minimum(np.diff(np.append(new, len(h))), 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(b.column("uid").to_numpy()[doc[new]]), pa.array(times, pa.int64())], schema=schema)

    return docs.mapInArrow(tidied(run), "hash long, uid long, times long")


#: Rows with seg: a distinct segment (of this task). Rows with uid: where one occurs (lo), or, without digest, windows lo..hi known to recur.
SEGMENTS = "digest binary, hash long, seg binary, anchor int, times long, uid long, lo long, hi long"


def segments(texts: DataFrame, length: int) -> DataFrame:
    """texts (uid, text, hashes) -> SEGMENTS of their recurring anchors."""
    schema = pa.schema([("digest", pa.binary()), ("hash", pa.int64()), ("seg", pa.binary()), ("anchor", pa.int32()), ("times", pa.int64()), ("uid", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for whole in batches:
            for b in by_size(whole, BATCH):
                raw = loaded(b.column("text").to_pylist())
                joined, doc, lo, hi, at, h = anchors(raw, length)
                lists = b.column("hashes")
                want_doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy())
                keep = np.isin(np.rec.fromarrays([doc, h]), np.rec.fromarrays([want_doc, lists.flatten().to_numpy()])) if len(h) and len(want_doc) else np.zeros(len(h), bool)
                data, base = joined.tobytes(), np.cumsum([0, *map(len, raw)])
                uids = b.column("uid").to_numpy()
                found: dict[bytes, list[tuple[int, int, int]]] = {}
                rows: list[tuple] = []
                for d, l, r, a, x in zip(doc[keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), at[keep].tolist(), h[keep].tolist(), strict=True):
                    seg = data[l : r + length]
                    digest = hashlib.blake2b(seg, digest_size=16, salt=(a - l).to_bytes(8, "little")).digest()
                    found.setdefault(digest, []).append((d, l, r))
                    times = seen.get(digest, 0)
                    if times < 2:
                        rows.append((digest, x, None if times else seg, a - l, 1, None, None, None))
                        seen[digest] = times + 1
                for digest, places in found.items():
                    for d, l, r in places:
                        start = l - int(base[d])
                        rows.append((digest if len(places) == 1 else None, None, None, None, None, int(uids[d]), start, start + r - l))
                if len(seen) > 200_000:
                    seen.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return texts.select("uid", "text", "hashes").mapInArrow(tidied(run), SEGMENTS)


def repeated_starts(segs: list[bytes], anchor: np.ndarray, bucket: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment the window starts whose `length` bytes also start elsewhere in its bucket."""
    pad = b"\x00" * PERIOD
    s = np.frombuffer(pad.join(segs) + pad * 2, dtype=np.uint8).copy()
    sizes = np.array([len(x) for x in segs], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + PERIOD)[:-1]))
    owner = np.repeat(np.arange(len(segs)), sizes)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[owner]  # places of the segments' bytes
    s[pos] += 1  # UTF-8 has no byte 255; 0 stands for what lies behind a segment
    end = begin + sizes
    residue = (pos - begin[owner] - anchor[owner]) % PERIOD
    # ranks of the cover positions: 64-byte blocks, then doubled to 512 bytes
    sample = pos[COVER[residue]]
    stop = end[owner[COVER[residue]]]
    blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(s, PERIOD)[sample]).view(f"S{PERIOD}").ravel()
    rank = np.zeros(len(s) + 8 * PERIOD, dtype=np.int64)
    rank[sample] = np.unique(blocks, return_inverse=True)[1] + 1
    ahead = PERIOD
    while ahead < length:
        next_ = np.where(sample + ahead < stop, rank[sample + ahead], 0)
        rank[sample] = np.unique(rank[sample] * (len(sample) + 2) + next_, return_inverse=True)[1] + 1
        ahead *= 2
    # all suffixes that are long enough
    is_start = pos + length <= end[owner]
    i, own, t = pos[is_start], owner[is_start], AHEAD[residue[is_start]]
    word = np.zeros(len(i), dtype=np.uint64)
    for k in range(STEP):
        word = np.where(k < t, word << np.uint64(8) | s[i + k].astype(np.uint64), word)
    delta = i - begin[own] - anchor[own]
    order = np.lexsort((rank[i + t], word, delta, bucket[own]))
    h = hashing.windows(hashing.prefixes(s), i, i + length)
    a, b = order[:-1], order[1:]
    same = (h[a] == h[b]) & (delta[a] == delta[b]) & (bucket[own[a]] == bucket[own[b]])
    hit = np.zeros(len(i), dtype=bool)
    hit[a[same]] = True
    hit[b[same]] = True
    cuts = np.searchsorted(own[hit], np.arange(len(segs) + 1))
    rel = (i - begin[own])[hit]
    return [rel[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def ranges(starts: np.ndarray) -> list[int]:
    """[from, to, from, to, ...] of runs of consecutive numbers."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
    return np.stack([starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)]], axis=1).ravel().tolist()


def sorted_buckets(distinct: DataFrame, length: int, at_once: int = 400) -> DataFrame:
    """distinct segments (digest, hash, seg, anchor, times) -> digest, ranges of window starts that recur."""
    schema = pa.schema([("digest", pa.binary()), ("ranges", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, ["hash"]):
            bounds = [*starts.tolist(), t.num_rows]
            at = 0
            while at < len(bounds) - 1:  # as many whole buckets as come to about at_once segments
                to = at + 1
                while to < len(bounds) - 1 and bounds[to + 1] - bounds[at] <= at_once:
                    to += 1
                part = t.slice(bounds[at], bounds[to] - bounds[at])
                group = np.repeat(np.arange(to - at), np.diff(bounds[at : to + 1]))
                segs, digest, times = part.column("seg").to_pylist(), part.column("digest").to_pylist(), part.column("times").to_pylist()
                alone = np.bincount(group)[group] == 1
                mixed = np.flatnonzero(~alone)
                out: dict[int, list[int]] = {}
                if len(mixed):
                    anchor = part.column("anchor").to_numpy().astype(np.int64)[mixed]
                    for k, got in zip(mixed.tolist(), repeated_starts([segs[k] for k in mixed], anchor, group[mixed], length), strict=True):
                        out[k] = ranges(got)
                for k, n in enumerate(times):
                    if n > 1:
                        out[k] = [0, len(segs[k]) - length]
                rows = [(digest[k], r) for k, r in out.items() if r]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                at = to

    return distinct.mapInArrow(tidied(run), "digest binary, ranges array<long>")


#: A distinct segment: its bucket, bytes, the place in it that distances are counted from, how often it occurs, and the distances its bucket has.
DISTINCT = "digest binary, hash long, seg binary, anchor int, times long, lo int, hi int"


def halves(large: DataFrame, length: int) -> DataFrame:
    """Segments of buckets that are too large, each as one or two of smaller buckets: DISTINCT, and parent (digest) and offset."""
    schema = pa.schema([("digest", pa.binary()), ("hash", pa.int64()), ("seg", pa.binary()), ("anchor", pa.int32()), ("times", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("parent", pa.binary()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole, BATCH, "seg"):
                rows = []
                for parent, seg, c0, times, lo, hi in zip(*(b.column(c).to_pylist() for c in ("digest", "seg", "anchor", "times", "lo", "hi")), strict=True):
                    mid, last = (lo + hi) // 2, len(seg) - length
                    for near, far in ((lo, mid), (mid + 1, hi)):  # windows start `near` to `far` bytes before c0
                        first, end = max(0, c0 - far), min(last, c0 - near)
                        if near > far or first > end:
                            continue
                        own = seg[first : end + length]
                        core = seg[c0 - near : c0 - far + length]  # all of these windows have it
                        name = hashlib.blake2b(core, digest_size=8, salt=near.to_bytes(4, "little") + far.to_bytes(4, "little")).digest()
                        place = c0 - first
                        digest = hashlib.blake2b(own, digest_size=16, salt=place.to_bytes(4, "little") + near.to_bytes(4, "little"), person=far.to_bytes(4, "little")).digest()
                        rows.append((digest, int.from_bytes(name, "little", signed=True), own, place, times, near, far, parent, first))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return large.select("digest", "seg", "anchor", "times", "lo", "hi").mapInArrow(tidied(run), f"{DISTINCT}, parent binary, offset long")


def distinct_segments(found: DataFrame) -> DataFrame:
    firsts = [F.max(c).alias(c) for c in ("hash", "seg", "anchor", "lo", "hi")]
    return found.groupBy("digest").agg(*firsts, F.sum("times").alias("times"))


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """uid, windows: [from, to, ...] of the window starts (bytes) of each document that recur; docs has uid and text."""
    parts_n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = stash(anchor_counts(docs, length))
    again = stash(own.groupBy("hash").agg(F.sum("times").alias("n")).where("n > 1").select("hash"))
    per_doc = own.join(again, "hash").groupBy("uid").agg(F.collect_list("hash").alias("hashes"))
    parts = stash(segments(docs.join(per_doc, "uid"), length))
    level = parts.where("times is not null").select("digest", "hash", "seg", "anchor", "times", F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"))
    flagged, links = None, []
    while True:
        # a bucket of one distance is one window, whose segments are equal: it is never too large
        large = stash(level.where("lo < hi").select("hash", "digest").distinct().groupBy("hash").count().where(F.col("count") > hot).select("hash"))
        last = large.isEmpty()
        # each segment is shuffled in one of the two only
        rest = level if last else level.join(large, "hash", "left_anti")
        dealt = distinct_segments(rest).repartition(parts_n, "hash").sortWithinPartitions("hash")
        here = sorted_buckets(dealt.select("digest", "hash", "seg", "anchor", "times"), length)
        flagged = here if flagged is None else flagged.unionByName(here)
        if last:
            break
        split = stash(halves(distinct_segments(level.join(large, "hash", "left_semi")).repartition(min(parts_n, 32)), length))
        links.append(split.select("parent", "digest", "offset"))
        level = split.drop("parent", "offset")
    if links:
        flagged = stash(flagged)
    for link in reversed(links):  # from the smallest buckets up
        of_parents = link.join(flagged, "digest").select(F.col("parent").alias("digest"), F.transform("ranges", lambda x: x + F.col("offset")).alias("ranges"))
        flagged = stash(flagged.unionByName(of_parents).groupBy("digest").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
    places = parts.where("uid is not null")
    known = places.where("digest is null").select("uid", F.array("lo", "hi").alias("windows"))
    met = places.where("digest is not null").select("digest", "uid", "lo").join(flagged, "digest").select("uid", F.transform("ranges", lambda x: x + F.col("lo")).alias("windows"))
    return met.unionByName(known).groupBy("uid").agg(F.flatten(F.collect_list("windows")).alias("windows"))


def spans(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans (from, to) that windows [from, to, ...] cover, merged where they touch."""
    w = windows.reshape(-1, 2)
    w = w[np.argsort(w[:, 0], kind="stable")]
    end = np.maximum.accumulate(w[:, 1] + length)
    new = np.flatnonzero(np.concatenate(([True], w[1:, 0] > end[:-1])))
    return list(zip(w[new, 0].tolist(), end[np.append(new[1:] - 1, len(w) - 1)].tolist(), strict=True))


def remove(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of from, to in bytes), kept (binary) for every row of docs (doc_id, text)."""
    rows = row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("uid", "doc_id", "text")
    found = stash(repeats(rows.select("uid", "text"), length, hot))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole, BATCH):
                out = []
                for doc, raw, w in zip(b.column("doc_id").to_pylist(), loaded(b.column("text").to_pylist()), b.column("windows"), strict=True):
                    cut = spans(np.asarray(w.values), length) if w.is_valid and len(w.values) else []
                    at, kept = 0, []
                    for s, e in cut:
                        kept.append(raw[at:s])
                        at = e
                    kept.append(raw[at:])
                    out.append((doc, len(raw), sum(e - s for s, e in cut), [x for p in cut for x in p], b"".join(kept)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.join(found, "uid", "left").select("doc_id", "text", "windows").mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove(documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
