"""Packing tokenised documents into fixed-size sequences by a configuration linear program.

The only thing the program sees is the histogram of piece lengths, which has at most ``capacity`` bins
however large the corpus is. A configuration is a multiset of lengths that fits one sequence; the program
asks for the least fractional number of configurations that cover every length as often as it occurs.

It is solved by multiplicative weights in up to ROUNDS small steps. A round prices each length by its size
times exp(ETA * how far its cover lags behind the round's goal); a knapsack dynamic program gives the most
valuable filling of every size, and each length that lags is covered up to the goal by the best
configuration that has it. The sum of the steps is the fractional cover; each round's prices also give a
bound that no packing can beat (`Cover.bound`). Full configurations are rounded down one by one with the
fractions carried on, never beyond what there is; what remains (what the rounds left open, and the
configurations that aren't full) is placed best-fit decreasing, which can still fill them.

Pieces meet the plan by their rank among pieces of equal length. Ranks come from counts per (length,
hash bucket), with as many buckets as the corpus needs, so that one very common length is ranked by many
tasks.

Edge cases: a null text is empty and gives one piece, the end id alone. Equal rows and equal ids are
packed as separate documents, each piece on its own. An empty table gives no rows. Extra columns are
not carried.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import by_size, documents, stash, tidied

CAPACITY, END_ID = 4096, 1
ROUNDS, ETA = 200, 2.0
BUCKETS, BUCKET_ROWS = 1 << 20, 50_000  # hash buckets that pieces carry; pieces that a task ranks
CACHE = 550_000  # chunks remembered
BATCH = 250_000  # bytes of text at once


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters to which normalising does nothing but lower-case one by one end at U+024F, but for the dotted capital I.
UNEVEN = re.compile("[^\x00-\u024f]|\u0130")
#: Python's split() takes these for white space, the tokenizer doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
WORD = re.compile(r"([^\W\d_]+)([^\w\s]*)")


class WordEncoder:
    """Token ids as little-endian unsigned 32-bit bytes, remembered by space-delimited chunk.

    The vocabulary drops white space and lower-cases, so a text's ids are those of its chunks in order, and a
    chunk of letters with marks behind it has the ids of both. New words are encoded together, without the
    normalising that does nothing to them, and cut apart after the tokens that end a word; other chunks go through the whole tokenizer, set apart by a
    special token. The memory is emptied at ``CACHE`` chunks. A text with a special token's string, or with white space
    that only one side knows, goes through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.t, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.t.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.apart, self.apart_id = next((a.content, i) for i, a in self.t.get_added_tokens_decoder().items() if a.special)
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.memory: dict[str, bytes] = {}

    def encode(self, chunks: list[str]) -> Iterator[bytes]:
        """Ids of each chunk, by the whole tokenizer."""
        for lo in range(0, len(chunks), 1024):
            ids = np.array(self.t.encode_batch_fast([self.apart.join(chunks[lo : lo + 1024])], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == self.apart_id)
            raw = ids.tobytes()
            yield from map(raw.__getitem__, map(slice, [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), 4 * len(ids)]))

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of even lower-case letters."""
        for lo in range(0, len(words), 256):
            part = words[lo : lo + 256]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) != len(part):
                yield from self.encode(part)
            else:
                raw = ids.tobytes()
                yield from map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))

    def learn(self, unknown: set[str], even: bool) -> None:
        """even: whether all have even letters, in lower case."""
        memory, marked, rest, stems, tails = self.memory, [], [], set(), set()
        for w in unknown:
            m = WORD.fullmatch(w)
            if m and m[1].isalpha() and (even or not UNEVEN.search(w) and w == w.lower()):
                marked.append((w, m[1], m[2]))
                stems.add(m[1])
                tails.add(m[2])
            else:
                rest.append(w)
        words, marks = list(stems.difference(memory)), list(tails - {""})
        known = dict(zip(words, self.encode_words(words), strict=True))
        behind = dict(zip(marks, self.encode(marks), strict=True)) if marks else {}
        behind[""] = b""
        for w, stem, tail in marked:
            memory[w] = (known.get(stem) or memory[stem]) + behind[tail]
        if rest:
            memory.update(zip(rest, self.encode(rest), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        memory = self.memory
        if len(memory) > CACHE:
            memory.clear()
        whole, chunks, every = [], [], True
        for i, t in enumerate(texts):
            if any(c in t for c in SEPARATORS) or any(x in t for x in self.special):
                whole.append(i)
                chunks.append([])
            else:
                even = not UNEVEN.search(t)
                every &= even
                chunks.append((t.lower() if even else t).split())
        if unknown := set().union(*chunks).difference(memory):
            self.learn(unknown, every)
        out = [b"".join(map(memory.__getitem__, words)) for words in chunks]
        for i in whole:
            out[i] = np.array(self.t.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; the vocabulary is loaded once."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, buckets: int = BUCKETS) -> DataFrame:
    """One row per piece of each document: where it starts, how long it is, the checksum of its ids, and a hash bucket."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bucket", pa.int32())])
    end, step = np.array([end_id], dtype="<u4").tobytes(), capacity * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for part in by_size(b, BATCH):
                ids, group = part.column("doc_id").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
                rows: list[tuple] = []
                for doc, raw in zip(ids, enc.encode_batch(group), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), step)):
                        piece = raw[at : at + step]
                        crc = zlib.crc32(piece)
                        rows.append((doc, k, at // 4, len(piece) // 4, crc, (crc ^ (doc or 0) * 2654435761 ^ k) % buckets))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        enc.memory.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), PIECE)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """For every size up to the capacity, the value of a most valuable multiset of just that size (-inf: there is none), and a length of it.

    prices[l] is the price of length l, -inf where there is none.
    """
    best, choice = np.full(capacity + 1, -np.inf), [0] * (capacity + 1)
    backward = np.full(capacity + 1, -np.inf)  # backward[capacity - c] = best[c], so that a slice of it is best[c - 1], best[c - 2], ...
    best[0] = backward[capacity] = 0.0
    for c in range(1, capacity + 1):
        value = prices[1 : c + 1] + backward[capacity - c + 1 :]
        l = int(value.argmax())
        best[c] = backward[capacity - c] = value[l]
        choice[c] = l + 1
    return best, choice


def filled(fit: list[int], choice: list[int], capacity: int) -> list[int]:
    """The lengths that knapsack() chose for the largest size up to capacity that there is; fit[c] is that size."""
    out, c = [], fit[capacity]
    while c:
        out.append(choice[c])
        c -= choice[c]
    return out


@dataclass
class Cover:
    """Fractional cover: how much of each configuration (lengths, ascending), a bound from below on any cover, and its own size."""

    amounts: dict[tuple[int, ...], float]
    bound: float
    size: float


def fractional_cover(total: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, eta: float = ETA) -> Cover:
    """Cover of total[l] pieces of every length l by multiplicative weights; what no round could cover counts as filled to the brim."""
    lengths = np.flatnonzero(total).tolist()
    count, left = total.tolist(), total.astype(np.float64).tolist()
    amounts: dict[tuple[int, ...], float] = {}
    bound, rounds = 0.0, min(rounds, 16 + len(lengths) // 8)
    for k in range(1, rounds + 1):
        goal = min(1.0, k / (0.75 * rounds))  # the last quarter is for lengths that were left behind
        open_ = [l for l in lengths if left[l] > 1e-6 * count[l]]
        if not open_:
            break
        prices = np.full(capacity + 1, -np.inf)
        prices[open_] = [l / capacity * math.exp(eta * (left[l] / count[l] - (1 - goal))) for l in open_]
        best, choice = knapsack(prices, capacity)
        bound = max(bound, sum(count[l] * prices[l] for l in open_) / best.max())
        fit = np.maximum.accumulate(np.where(np.isfinite(best), np.arange(capacity + 1), 0)).tolist()
        for l in sorted(open_, key=lambda x: (-left[x] / count[x], -x)):
            while (lag := left[l] - (1 - goal) * count[l]) > 1e-6 * count[l]:
                config = [l, *filled(fit, choice, capacity - l)]
                have: dict[int, int] = {}
                for x in config:
                    have[x] = have.get(x, 0) + 1
                amount = min(lag / have[l], *(left[x] / n for x, n in have.items()))
                if amount <= 1e-9:  # something that it wants has run out: the next round's prices leave that alone
                    break
                key = tuple(sorted(config))
                amounts[key] = amounts.get(key, 0.0) + amount
                for x, n in have.items():
                    left[x] -= amount * n
    return Cover(amounts, bound, sum(amounts.values()) + sum(left[l] * l for l in lengths) / capacity)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, eta: float = ETA) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences): together they use every piece exactly once."""
    total = np.zeros(capacity + 1, dtype=np.int64)
    for l, n in histogram.items():
        total[l] = n
    plan: list[tuple[list[int], int]] = []
    if total[capacity]:
        plan.append(([capacity], int(total[capacity])))
        total[capacity] = 0
    cover, rest, carried = fractional_cover(total, capacity, rounds, eta), total.tolist(), 0.0
    for config, amount in sorted(cover.amounts.items(), key=lambda x: (sum(x[0]) < capacity, -x[1], x[0])):
        if sum(config) < capacity:
            break  # the last step can do better than these
        have: dict[int, int] = {}
        for x in config:
            have[x] = have.get(x, 0) + 1
        carried += amount
        m = min(int(carried + 1e-9), *(rest[x] // n for x, n in have.items()))
        if m:
            carried -= m
            for x, n in have.items():
                rest[x] -= m * n
            plan.append((list(config), m))
    return plan + best_fit(np.array(rest, dtype=np.int64), capacity)


def best_fit(rest: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts by length; equal sequences are laid out together."""
    rest, plan = rest.copy(), []
    while (have := np.flatnonzero(rest)).size:
        config, gap, used = [], capacity, {}
        while gap:
            at = int(np.searchsorted(have, gap, side="right")) - 1
            while at >= 0 and used.get(int(have[at]), 0) >= rest[have[at]]:
                at -= 1
            if at < 0:
                break
            l = int(have[at])
            if config and l < gap and (pair := exact_pair(have, rest, used, gap)):
                for x in pair:
                    used[x] = used.get(x, 0) + 1
                    config.append(x)
                gap = 0
                break
            used[l] = used.get(l, 0) + 1
            config.append(l)
            gap -= l
        m = min(int(rest[l]) // n for l, n in used.items())
        for l, n in used.items():
            rest[l] -= m * n
        plan.append((config, m))
    return plan


def exact_pair(have: np.ndarray, rest: np.ndarray, used: dict[int, int], gap: int) -> tuple[int, int] | None:
    """Two lengths still to be had that fill the gap exactly."""
    free = have[have < gap]
    partner = gap - free
    for a, b in zip(free[::-1].tolist(), partner[::-1].tolist(), strict=True):
        if b > a:
            return None
        if rest[b] and rest[a] - used.get(a, 0) >= 1 + (a == b) and rest[b] - used.get(b, 0) >= 1:
            return a, b
    return None


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (already cut off from their lineage) with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in cut_pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_sequences(histogram, capacity)
    buckets = max(256, max(histogram.values(), default=0) // BUCKET_ROWS)
    cut_pieces = cut_pieces.withColumn("bucket", F.col("bucket") % buckets)
    given: dict[int, int] = {}
    table, sequence = [], 0
    for config, m in plan:
        at = 0
        for l in config:
            first = given.get(l, 0)
            table.append((l, first, sequence, at))
            given[l] = first + m
            at += l
        sequence += m
    table.sort()
    cols = np.array(table, dtype=np.int64).reshape(-1, 4)
    held = spark.sparkContext.broadcast((cols[:, 0] << 40 | cols[:, 1], cols[:, 1], cols[:, 2], cols[:, 3]))  # bounded by the plan: ROUNDS configurations a length, and the remainder's

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, first, seq, at = held.value
        i = np.searchsorted(key, length.to_numpy() << 40 | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": seq[i] + rank.to_numpy() - first[i], "offset": at[i]})

    counts = cut_pieces.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__s"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut_pieces.withColumn("__n", F.row_number().over(inside)).join(starts, ["length", "bucket"])
    placed = ranked.withColumn("__p", place("length", (F.col("__s") + F.col("__n") - 1).cast("long")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "__p.sequence_id", "__p.offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stash(pieces(documents(spark, sf_dir), default_tokenizer())))
