"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are words and one end symbol. A context is the last one to ``depth`` words; it is a node of the
tree when it was seen MIN_CONTEXT times, and stays a state when a divergence test says that its
next-symbol distribution differs from that of the next shorter context by more than its size explains.
Next symbols of a state are kept when the pair was seen MIN_PAIR times, are discounted by a constant, and
hand what is left to the next shorter state; the root is the unigram distribution with the mass of words
seen once set aside for one unknown symbol. Each distribution sums to one over the training words and the
unknown symbol, the event space of the base score. The least counts are the same for every corpus, so the
tree grows with it.

The log probability of a text is a sum over its runs of 1 to depth + 1 words: the logarithm of what the
run's last word has after it over what it has after the next shorter context, and of what the run, as
a state, leaves to shorter ones. The model is therefore one table from run to value. Runs are known by 64-bit
hashes; the first bits of a hash name its list, and runs travel packed, a row for each list and batch, so
that a shuffle costs a few bytes a run and no rows. There are as many lists as keep one to about LIST_TOKENS training
tokens:

1. words are counted by list;
2. for each size from 2 to depth + 1, runs that can matter (the run without its last word is a context, the one
   without its first a kept run: bitmaps of a fixed size tell) are counted, meet the probability of their
   last word after the shorter context in the list of the latter, and then the other runs of their
   own context, where the test is made;
3. every text gives off its runs, these meet the model list by list, and the sums come back by batch.

Runs that make Q_HEAD of the training tokens, 1 / Q_HEAD a length at most, are broadcast instead, so that no run is
sent very often.

Edge cases: a null text is empty and has one token, the end. Rows with equal or null ids are scored one
by one. A corpus without training rows gives base and model scores of the uniform kind (counts 0, one
unknown symbol). Extra columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import by_size, documents, drop_shuffles, fold, release, stash, tidied, tidied_group, tidied_groups
from pagewright.llm.hashing import word_hashes

MIN_CONTEXT, MIN_PAIR, DEPTH, DISCOUNT, EVIDENCE = 8, 2, 3, 0.6, 2.0
Q_HEAD, PLACES, COUNT_PLACES, LEAST_LISTS, LIST_TOKENS = 2e-6, 27, 26, 6, 2_000_000  # bits of the bitmaps in scoring and in counting; lists: two to the power of LEAST_LISTS at least
ITEMS = 8_192  # in a row: rows of megabytes wear the JVM's memory down
FLUSH, TEXT, DOCS = 1_200_000, 12_000_000, 30_000  # runs counted, bytes of text and documents scored, before a task gives off rows
END_KEY, STEP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
KINDS = {"key": "<u8", "ctx": "<u8", "suf": "<u8", "n": "<i8", "p": "<f8", "value": "<f8", "doc": "<u2", "known": "<i4"}


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts, each ending in END and all preceded by one: the keys of the symbols, their places in their texts (-1 for the first END) and their texts."""
    raws = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    start, key = word_hashes(np.frombuffer(b"\n".join([*raws, b""]), dtype=np.uint8))
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), start, side="right")
    n = np.bincount(owner, minlength=len(raws)) + 1
    out = np.full(int(n.sum()) + 1, END_KEY, dtype=np.uint64)
    out[np.arange(len(key)) + owner + 1] = key
    place = np.arange(len(out) - 1) - np.repeat(np.cumsum(n) - n, n)
    return out, np.concatenate(([-1], place)), np.concatenate(([0], np.repeat(np.arange(len(raws)), n)))


def longer(keys: np.ndarray) -> np.ndarray:
    """keys: of runs of one size. Keys of the runs one symbol longer that end at the same places."""
    out = np.zeros_like(keys)
    out[1:] = joint(keys[:-1], keys[1:])
    return out


def joint(ctx: np.ndarray, suf: np.ndarray) -> np.ndarray:
    """Key of a run from those of the run without its last symbol and without its first."""
    return ctx * STEP + suf


def list_bits(tokens: int) -> int:
    return max(LEAST_LISTS, math.ceil(math.log2(max(tokens, 1) / LIST_TOKENS)))


def bit_places(keys: np.ndarray, bits: int, places: int) -> list[np.ndarray]:
    """Three places of each key in a bitmap of 2^places bits, all in the share of its list."""
    share = places - bits
    own = (keys >> np.uint64(64 - bits)).astype(np.int64) << share
    return [own | (keys >> np.uint64(shift) & np.uint64((1 << share) - 1)).astype(np.int64) for shift in (64 - places, 20, 0)]


def passes(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for p in bit_places(keys, bits, (len(bitmap) * 8).bit_length() - 1):
        out &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & np.uint8(1) == 1
    return out


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 48 bits of keys behind those that name the list."""
    return (keys << np.uint64(bits)) >> np.uint64(16)


def six_bytes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


# ---------------------------------------------------------------- packed rows
def packed(by: np.ndarray, bits: int, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows for each list that `by` (keys) names, with ITEMS of its items at most, of each column as bytes."""
    at = (by >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = slice(None) if len(at) < 2 or (at[1:] >= at[:-1]).all() else np.argsort(at, kind="stable")
    lists, first = np.unique(at[order], return_index=True)
    cuts = [x for s, e in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True) for x in range(s, e, ITEMS)]
    arrays = [pa.array(at[order][cuts].astype(np.int32))]
    cuts.append(len(at))
    for name, values in columns.items():
        kind = KINDS.get(name, "u1")  # other columns are rows of bytes
        raw, size = np.ascontiguousarray(values[order].astype(kind, copy=False)).tobytes(), np.dtype(kind).itemsize * (values.shape[1] if values.ndim > 1 else 1)
        arrays.append(pa.array([raw[s * size : e * size] for s, e in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["list", *columns])


def fields(*columns: str) -> str:
    return ", ".join(["list int", *(f"{c} binary" for c in columns)])


def opened(t: pa.Table, *columns: str) -> tuple[np.ndarray, ...]:
    """The items of packed rows."""
    return tuple(np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=KINDS[c]) for c in columns)


def nothing(*columns: str) -> pa.Table:
    return pa.table({"list": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in columns}})


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of one of each, and their sums."""
    if not len(key):
        return key, np.zeros(0, np.int64), n
    order = np.argsort(key)
    sorted_ = key[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    return sorted_[first], order[first], np.add.reduceat(n[order], first)


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted stand in the sorted keys, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


# ---------------------------------------------------------------- fitting
def unit_counts(train: DataFrame, flush: int = FLUSH) -> DataFrame:
    """Packed key and n of the symbols; LEAST_LISTS bits of lists, for the tokens are not known yet: rows of a task are split by them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        have = 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            return packed(key, LEAST_LISTS + 4, key=key, n=n)

        for b in batches:
            for part in by_size(b, 1_000_000):
                kept.append(symbols(part.column("text").to_pylist())[0][1:])
                if (have := have + len(kept[-1])) >= flush:
                    yield out()
                    have = 0
        if kept:
            yield out()

    def count(t: pa.Table) -> pa.Table:
        key, _, n = summed(*opened(t, "key", "n"))
        return pa.Table.from_batches([packed(key, LEAST_LISTS + 4, key=key, n=n)]) if len(key) else nothing("key", "n")

    return train.select("text").mapInArrow(tidied(run), fields("key", "n")).groupBy("list").applyInArrow(tidied_group(count), fields("key", "n"))


def totals(units: DataFrame) -> tuple[int, int, int]:
    """Tokens, distinct symbols, symbols seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (n,) = opened(pa.Table.from_batches([b]), "n")
            yield pa.RecordBatch.from_pydict({"a": [int(n.sum())], "b": [len(n)], "c": [int((n == 1).sum())]})

    s = units.mapInArrow(run, "a long, b long, c long").agg(F.sum("a"), F.sum("b"), F.sum("c")).first()
    return tuple(int(x or 0) for x in s)


def first_level(units: DataFrame, total: int, unknown: float, bits: int) -> DataFrame:
    """units as a level (key, n, p, value), in `bits` bits of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = opened(pa.Table.from_batches([b]), "key", "n")
            if len(key):
                p = n / max(total, 1) * (1 - unknown)
                yield packed(key, bits, key=key, n=n, p=p, value=np.log10(p))

    return units.select("key", "n").mapInArrow(tidied(run), fields("key", "n", "p", "value"))


def bitmaps(level: DataFrame, bits: int, places: int, columns: tuple[str, ...], of) -> list[np.ndarray]:
    """Bitmaps (2^places bits) of keys. of(*columns) gives a test for each of them; p is not a number in rows of states."""
    share_bits = places - bits

    def share(t: pa.Table) -> pa.Table:
        key, *given = opened(t, "key", *columns)
        maps = []
        for test in of(*given):
            own = np.zeros(1 << share_bits, dtype=bool)
            for at in bit_places(key[test], bits, places):
                own[at & ((1 << share_bits) - 1)] = True
            maps.append(np.packbits(own, bitorder="little").tobytes())
        return pa.table({"list": t.column("list")[:1], **{f"m{i}": pa.array([m], pa.binary()) for i, m in enumerate(maps)}})

    kinds = len(of(*[np.zeros(0)] * len(columns)))
    got = level.select("list", "key", *columns).groupBy("list").applyInArrow(tidied_group(share), ", ".join(["list int", *(f"m{i} binary" for i in range(kinds))])).collect()
    out = np.zeros((kinds, 1 << bits, 1 << share_bits - 3), dtype=np.uint8)
    for r in got:
        for i in range(kinds):
            out[i, r[0]] = np.frombuffer(r[1 + i], dtype=np.uint8)
    return [x.ravel() for x in out]


def run_counts(train: DataFrame, size: int, bits: int, contexts: np.ndarray, suffixes: np.ndarray, flush: int = FLUSH) -> DataFrame:
    """Packed by suf: ctx (the run without its last symbol), suf (without its first) and n of the runs of `size` symbols seen MIN_PAIR times whose ctx and suf pass the bitmaps."""
    held = train.sparkSession.sparkContext.broadcast((contexts, suffixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        have, (of_ctx, of_suf) = 0, held.value

        def out() -> pa.RecordBatch:
            ctx, suf = (np.concatenate(c) for c in zip(*kept, strict=True))
            kept.clear()
            key, first, n = summed(joint(ctx, suf), np.ones(len(ctx), np.int64))
            return packed(key, bits, ctx=ctx[first], suf=suf[first], known=n)

        for b in batches:
            for part in by_size(b, 1_000_000):
                suf, place, _ = symbols(part.column("text").to_pylist())
                for _ in range(size - 2):
                    suf = longer(suf)
                ok = np.flatnonzero((place >= 0) & (place + 2 >= size))
                ok = ok[passes(of_ctx, suf[ok - 1], bits)]
                ok = ok[passes(of_suf, suf[ok], bits)]
                kept.append((suf[ok - 1], suf[ok]))
                if (have := have + len(ok)) >= flush:
                    yield out()
                    have = 0
        if have:
            yield out()

    def count(t: pa.Table) -> pa.Table:
        ctx, suf, n = opened(t, "ctx", "suf", "known")
        _, first, n = summed(joint(ctx, suf), n.astype(np.int64))
        first, n = first[n >= MIN_PAIR], n[n >= MIN_PAIR]
        return pa.Table.from_batches([packed(suf[first], bits, ctx=ctx[first], suf=suf[first], n=n)]) if len(n) else nothing("ctx", "suf", "n")

    return train.select("text").mapInArrow(tidied(run), fields("ctx", "suf", "known")).groupBy("list").applyInArrow(tidied_group(count), fields("ctx", "suf", "n"))


def next_level(level: DataFrame, runs: DataFrame, bits: int, discount: float, evidence: float) -> DataFrame:
    """The level of the runs (key, n, p, value, packed by key), and with p not a number the values of the contexts that are states."""

    def sorted_level(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, n, p = opened(t, "key", "n", "p")
        own = np.flatnonzero(~np.isnan(p))
        own = own[np.argsort(key[own])]
        return key[own], n[own], p[own]

    def parent(left: pa.Table, right: pa.Table) -> pa.Table:
        key, _, p = sorted_level(right)
        ctx, suf, n = opened(left, "ctx", "suf", "n")
        at, hit = found(key, suf)
        if not hit.any():
            return nothing("ctx", "suf", "n", "p")
        return pa.Table.from_batches([packed(ctx[hit], bits, ctx=ctx[hit], suf=suf[hit], n=n[hit], p=p[at[hit]])])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        key, sizes, _ = sorted_level(right)
        ctx, suf, n, p = opened(left, "ctx", "suf", "n", "p")
        at, hit = found(key, ctx)
        if len(key):
            hit &= sizes[at] >= MIN_CONTEXT
        if not hit.any():
            return nothing("key", "n", "p", "value")
        ctx, suf, n, p, size = ctx[hit], suf[hit], n[hit], p[hit], sizes[at[hit]]
        contexts, own, which = np.unique(ctx, return_index=True, return_inverse=True)
        share, of = np.maximum(n - discount, 0) / size, size[own]
        rest = 1 - np.bincount(which, share)
        mixed = share + rest[which] * p
        gain = np.bincount(which, n * np.log(mixed / p)) + (of - np.bincount(which, n)) * np.log(np.maximum(rest, 1e-12))
        state = gain > evidence * np.log(np.maximum(of, 2))
        lam = np.clip(rest, 1e-9, 1 - 1e-12)
        mine = state[which]
        new = np.where(mine, share + lam[which] * p, p)
        worth = np.where(mine, np.log10(new) - np.log10(p) - np.log10(lam[which]), 0.0)
        out = [packed(joint(ctx, suf), bits, key=joint(ctx, suf), n=n, p=new, value=worth)]
        if state.any():
            out.append(packed(contexts[state], bits, key=contexts[state], n=of[state], p=np.full(int(state.sum()), np.nan), value=np.log10(lam[state])))
        return pa.Table.from_batches(out)

    own = level.select("list", "key", "n", "p").groupBy("list")
    with_parent = runs.groupBy("list").cogroup(own).applyInArrow(tidied_groups(parent), fields("ctx", "suf", "n", "p"))
    return with_parent.groupBy("list").cogroup(own).applyInArrow(tidied_groups(judge), fields("key", "n", "p", "value"))


def fit(train: DataFrame, units: DataFrame, total: int, unknown: float, depth: int = DEPTH, discount: float = DISCOUNT, evidence: float = EVIDENCE) -> list[DataFrame]:
    """The model: packed levels of runs of one to depth + 1 symbols."""
    bits = list_bits(total)
    levels = [first_level(units, total, unknown, bits)]
    for size in range(2, depth + 2):
        maps = bitmaps(levels[-1], bits, COUNT_PLACES, ("n", "p"), lambda n, p: [(n >= MIN_CONTEXT) & ~np.isnan(p), (n >= MIN_PAIR) & ~np.isnan(p)])
        runs = stash(run_counts(train, size, bits, *maps), "zstd")  # by itself: what counting shuffles goes before the rest is shuffled
        levels.append(stash(next_level(levels[-1], runs, bits, discount, evidence), "zstd"))
        release(train.sparkSession, runs)
    return levels


# ---------------------------------------------------------------- scoring
def compact(levels: list[DataFrame], bits: int) -> DataFrame:
    """The model: packed key, n, value and known (1: a word) of all that has a value; runs of contexts that are no states have none."""

    def of(level: DataFrame, word: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key, n, value = opened(pa.Table.from_batches([b]), "key", "n", "value")
                if (hit := value != 0).any():
                    yield packed(key[hit], bits, key=key[hit], n=n[hit], value=value[hit], known=np.full(int(hit.sum()), word))

        return level.select("key", "n", "value").mapInArrow(tidied(run), fields("key", "n", "value", "known"))

    out = of(levels[0], 1)
    for level in levels[1:]:
        out = out.unionByName(of(level, 0))
    return out


def head_of(model: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, value and word count (0: no word) of the runs with that count, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, value, word = opened(pa.Table.from_batches([b]), "key", "n", "value", "known")
            if (hit := n >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([x[hit].tobytes()], pa.binary()) for x in (key, n * word, value)], names=["key", "n", "value"])

    key, n, value = opened(model.select("key", "n", "value", "known").mapInArrow(run, "key binary, n binary, value binary").toArrow(), "key", "n", "value")
    keys, _, values = summed(key, value)
    words = np.zeros(len(keys), np.int64)
    np.maximum.at(words, np.searchsorted(keys, key), n)
    return keys, values, words


def score_by_model(docs: DataFrame, model: DataFrame, total: int, distinct: int, unknown: float, depth: int = DEPTH, q_head: float = Q_HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs, by a stored compact() model."""
    bits = list_bits(total)
    least = max(q_head * total, 1)
    heads, worth, head_words = head_of(model, least)
    (may_be,) = bitmaps(model, bits, PLACES, ("n", "known"), lambda n, word: [(n < least) & (word == 0)])
    held = docs.sparkSession.sparkContext.broadcast((heads, worth, head_words, may_be))
    lookup = "batch long, doc binary, key binary, base binary"  # for sums: doc, value as key, base, known; for a batch's own row: list is null

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_of, values, words, cold = held.value
        bases = np.where(words > 0, np.log10(words + 0.5), 0.0)
        number, parts, asked, size_, docs_n = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            doc_ids = pa.concat_arrays([p[0] for p in parts])
            numbers = [np.concatenate([p[k] for p in parts]) for k in range(1, 5)]
            mask = np.asarray(doc_ids.is_valid())
            head = [np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes(), mask.astype("u1").tobytes(), np.stack(numbers).astype("<f8").tobytes()]
            own = np.uint64((number * 0x9E3779B97F4A7C15) % (1 << 64))
            row = pa.RecordBatch.from_arrays([pa.array([int(own >> np.uint64(64 - bits))], pa.int32()), pa.array([number]), *(pa.array([x], pa.binary()) for x in head), pa.array([True])], names=["list", "batch", "doc", "key", "base", "own"])
            yield row
            key, doc = (np.concatenate(c) for c in zip(*asked, strict=True))
            if len(key):
                b = packed(key, bits, doc=doc, asked=six_bytes(short(key, bits)))
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("list"), pa.array([number] * n, pa.int64()), b.column("doc"), b.column("asked"), pa.nulls(n, pa.binary()), pa.array([False] * n)], names=["list", "batch", "doc", "key", "base", "own"])

        for part in (x for whole in batches for at in range(0, whole.num_rows, DOCS) for x in by_size(whole.slice(at, DOCS), 1_000_000)):
            if docs_n + part.num_rows > DOCS:
                yield from out()
                number, parts, asked, size_, docs_n = number + 1, [], [], 0, 0
            symbol, place, owner = symbols(part.column("text").to_pylist())
            n, keys = part.num_rows, symbol
            model, base, n_known = np.zeros(n), np.zeros(n), np.zeros(n)
            for size in range(1, depth + 2):
                ok = np.flatnonzero((place >= 0) & (place + 2 >= size))
                key, own = keys[ok], owner[ok]
                at, hit = found(keys_of, key)
                model += np.bincount(own[hit], values[at[hit]], n)
                if size == 1:
                    is_word = hit & (words[at] > 0) if len(words) else hit
                    base += np.bincount(own[is_word], bases[at[is_word]], n)
                    n_known += np.bincount(own[is_word], minlength=n)
                rest = np.flatnonzero(~hit if size == 1 else ~hit & passes(cold, key, bits))
                asked.append((key[rest], ((own[rest] + docs_n) * 2 + (size == 1)).astype(np.uint16)))
                keys = longer(keys)
            parts.append((part.column("doc_id"), np.bincount(owner[1:], minlength=n), n_known, base, model))
            docs_n += n
            size_ += part.column("text").nbytes
            if size_ >= TEXT:
                yield from out()
                number, parts, asked, size_, docs_n = number + 1, [], [], 0, 0
        if parts:
            yield from out()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        key, value, word = opened(right, "key", "value", "known")
        keys, _, values = summed(key, value)
        counts = np.zeros(len(keys), np.int64)
        np.maximum.at(counts, np.searchsorted(keys, key), word)
        keys, rows = short(keys, bits), []
        for batch, doc, asked, base, own in zip(*(left.column(c).to_pylist() for c in ("batch", "doc", "key", "base", "own")), strict=True):
            if own:
                rows.append((batch, doc, asked, base, None, True))
                continue
            which, wanted = np.frombuffer(doc, "<u2"), from_six_bytes(asked)
            at, hit = found(keys, wanted)
            is_word = (which & 1) == 1
            count = np.where(hit, counts[at], 0) if len(keys) else np.zeros(len(wanted), np.int64)
            worth = np.where(hit, values[at], 0.0) if len(keys) else np.zeros(len(wanted))
            worth = np.where(is_word & (count == 0), worth + math.log10(unknown), worth)
            used = is_word | hit
            docs_, of = np.unique(which[used] >> 1, return_inverse=True)
            sums = [np.bincount(of, x[used], len(docs_)) for x in (worth, np.where(is_word, np.log10(count + 0.5), 0.0), is_word & (count > 0))]
            rows.append((batch, docs_.astype("<u2").tobytes(), sums[0].astype("<f8").tobytes(), sums[1].astype("<f8").tobytes(), sums[2].astype("<i4").tobytes(), False))
        names = ("batch", "doc", "key", "base", "known", "own")
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        return pa.table({k: pa.array(c, t) for k, t, c in zip(names, kinds, zip(*rows, strict=True) if rows else [[]] * 6, strict=True)})

    norm = math.log10(total + 0.5 * (distinct + 1))

    def gather(t: pa.Table) -> pa.Table:
        numbers = ids = None
        sums = []
        for doc, key, base, known, own in zip(*(t.column(c).to_pylist() for c in ("doc", "key", "base", "known", "own")), strict=True):
            if own:
                ids = pa.array(np.frombuffer(doc, "<i8"), mask=np.frombuffer(key, "u1") == 0)
                numbers = np.frombuffer(base, "<f8").reshape(4, -1)
            else:
                sums.append((np.frombuffer(doc, "<u2"), np.frombuffer(key, "<f8"), np.frombuffer(base, "<f8"), np.frombuffer(known, "<i4")))
        n_tokens, n_known, base, model = numbers.copy()
        for which, worth, more, known in sums:
            model[which] += worth
            base[which] += more
            n_known[which] += known
        return pa.table({"doc_id": ids, "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)), "base_score": pa.array(base - n_tokens * norm), "score": pa.array(model)})

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """known: how often a word is counted, which is less than `least` here."""
        for b in batches:
            key, n, value, word = opened(pa.Table.from_batches([b]), "key", "n", "value", "known")
            if (hit := n < least).any():
                yield packed(key[hit], bits, key=key[hit], value=value[hit], known=(n * word)[hit])

    rare = model.select("key", "n", "value", "known").mapInArrow(tidied(cold), fields("key", "value", "known"))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(ask), f"list int, {lookup}, own boolean")
    met = asked.groupBy("list").cogroup(rare.groupBy("list")).applyInArrow(tidied_groups(meet), f"{lookup}, known binary, own boolean")
    return met.groupBy("batch").applyInArrow(tidied_group(gather), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_corpus(docs: DataFrame, train: DataFrame, q_head: float = Q_HEAD) -> tuple[DataFrame, int]:
    """Scores of docs by the model of train, and the number of training tokens."""
    units = stash(unit_counts(train), "zstd")
    total, distinct, once = totals(units)
    unknown = max(once, 1) / (max(total, 1) + (once == 0))
    levels = fit(train, units, total, unknown)
    model = stash(compact(levels, list_bits(total)), "zstd")
    release(docs.sparkSession, units, *levels[1:])
    return score_by_model(docs, model, total, distinct, unknown, len(levels) - 1, q_head), total


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    drop_shuffles(spark)
    got, total = score_corpus(docs, docs.where(fold("doc_id") != 1))
    return got.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
