"""Toxicity scores by a logistic classifier with counterfactual regularisation.

Features are the presence of words, of word beginnings of four to six letters, and of beginnings that several
different words of the text have (letters only, lower case), so one insult in a long text counts as much
as in a short one. Only features whose log-odds stand out of the training sample are kept.

Besides the logistic loss and a ridge, training penalises the squared change of the score when an identity
term of a labelled sentence is swapped for another of its group; what remains between a neutral mention of
one group and of another is driven towards nothing. Groups are given by language (IDENTITY), a parameter, and
learnt from the sample (`learnt_groups`): common words that are about as frequent under either label, grouped
by the texts they share, so that none of them comes to speak for a label by chance either.

Training is on a bounded sample (SAMPLE labelled texts a class, none over SAMPLE_CHARS), equal texts once.
Both classes weigh the same in it, and nothing is added for their shares in the corpus.

Edge cases: null and empty texts score the intercept. Null labels are left out, of rows with equal ids
any marked 1 makes the id 1. With no labels, or one class only, every row scores the share of label 1
(0.5 without labels). Scores do not depend on other columns. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import documents, fold, stash

SAMPLE, SAMPLE_CHARS, LEAST, STANDS_OUT = 2_000, 65_536, 4, 3.0
RIDGE, COUNTERFACTUAL, STEPS = 2e-4, 1.0, 400
#: Learnt groups: so many words, in so many texts, with log-odds of at most this many standard errors, and words a group.
NEUTRAL, COMMON, EVEN, GROUP = 64, 0.02, 1.0, 8
SEVERAL = 3  # different words that make a beginning count again
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
#: Groups of terms that may stand for one another in a neutral mention, by language.
IDENTITY = {
    "en": (
        ("women", "men"), ("woman", "man"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "natives", "refugees", "locals"), ("young", "old"), ("disabled", "abled"),
    ),
    "de": (
        ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"),
        ("schwarze", "weiße", "asiatische", "arabische"), ("schwul", "lesbisch", "bisexuell", "heterosexuell"), ("einwanderer", "einheimische", "flüchtlinge"), ("junge", "alte"),
    ),
    "fr": (
        ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("musulman", "chrétien", "juif", "hindou", "bouddhiste"),
        ("noirs", "blancs", "asiatiques", "arabes"), ("gay", "lesbienne", "bisexuel", "hétérosexuel"), ("immigrés", "réfugiés", "habitants"), ("jeunes", "vieux"),
    ),
    "es": (
        ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("musulmán", "cristiano", "judío", "hindú", "budista"),
        ("negros", "blancos", "asiáticos", "árabes"), ("gay", "lesbiana", "bisexual", "heterosexual"), ("inmigrantes", "refugiados", "vecinos"), ("jóvenes", "viejos"),
    ),
}
GROUPS = tuple(g for own in IDENTITY.values() for g in own)


def beginnings(words) -> Iterator[str]:
    """Beginnings of words, marked; with a + those of SEVERAL words."""
    seen = Counter("^" + w[:k] for w in words for k in (4, 5, 6) if len(w) > k)
    for f, n in seen.items():
        yield f
        if n >= SEVERAL:
            yield f + "+"


def features(words) -> set[str]:
    """Words and their beginnings of four to six letters."""
    out = set(words)
    out.update(beginnings(list(out)))
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.starts = {f[1:5] for f in self.weights if f[0] == "^"}
        self.words = {f for f in self.weights if f[0] != "^"}

    def score(self, text: str | None) -> float:
        get, words = self.weights.get, set(WORD.findall(text.lower())) if text else set()
        total = self.bias + sum(map(self.weights.__getitem__, sorted(words & self.words)))
        # beginnings: only words with a four-letter start that has any weight are looked at more closely
        starts = self.starts
        total += sum(get(f, 0.0) for f in sorted(beginnings([w for w in words if w[:4] in starts])))
        return 1 / (1 + float(np.exp(-np.clip(total, -30, 30))))


def swaps(text: str, groups=GROUPS) -> Iterator[tuple[set[str], set[str]]]:
    """Features of each sentence with an identity term, and of its counterfactuals."""
    partners: dict[str, list[str]] = {}
    for g in groups:
        for t in g:
            partners.setdefault(t, []).extend(o for o in g if o != t)
    low = text.lower()
    if not partners.keys() & set(WORD.findall(low)):
        return
    for sentence in SENTENCE.split(low):
        words = WORD.findall(sentence)
        for t in sorted(partners.keys() & set(words)):
            for o in partners[t]:
                yield features(words), features([o if w == t else w for w in words])


def one_swap(text: str, groups) -> Iterator[tuple[set[str], set[str]]]:
    """As swaps(), but of each group the first sentence of the text that has a term of it, and the next term of the group."""
    low = text.lower()
    sentences = [WORD.findall(s) for s in SENTENCE.split(low)]
    for g in groups:
        for words in sentences:
            if own := sorted(set(words) & set(g)):
                t, o = own[0], g[(g.index(own[0]) + 1) % len(g)]
                yield features(words), features([o if w == t else w for w in words])
                break


def learnt_groups(number: dict[str, int], has: list[np.ndarray], z: np.ndarray, count: np.ndarray, most: int = NEUTRAL, common: float = COMMON, even: float = EVEN, size: int = GROUP) -> list[tuple[str, ...]]:
    """Groups of common words with even log-odds z; has: the feature numbers of each text."""
    names = [f for f in number if f[0] != "^"]
    ids = np.array([number[f] for f in names], dtype=np.int64)
    if not len(ids):
        return []
    fit_ = np.flatnonzero((count[ids] >= common * len(has)) & (np.abs(z[ids]) <= even))
    fit_ = fit_[np.argsort(-count[ids[fit_]], kind="stable")][:most]
    place = np.full(len(z), -1)
    place[ids[fit_]] = np.arange(len(fit_))
    table = np.zeros((len(has), len(fit_)), dtype=np.float32)
    for row, own in enumerate(has):
        at = place[own]
        table[row, at[at >= 0]] = 1
    both, alone = table.T @ table, table.sum(axis=0)
    likeness = both / np.maximum(alone[:, None] + alone[None, :] - both, 1)
    left, out = list(range(len(fit_))), []
    while len(left) > 1:
        seed = left[0]
        own = sorted(left, key=lambda j: (j != seed, -likeness[seed, j], j))[:size]  # noqa: B023
        left = [j for j in left if j not in own]
        out.append(tuple(names[fit_[j]] for j in own))
    return out


def gradient(w: np.ndarray, b: float, y: np.ndarray, each: np.ndarray, doc: np.ndarray, col: np.ndarray, pairs: int, pair: np.ndarray, pcol: np.ndarray, pval: np.ndarray, counterfactual: float, ridge: float) -> tuple[np.ndarray, float]:
    """Of the loss sum(each * logistic) + ridge / 2 * |w|^2 + counterfactual * mean over pairs of the squared change, by w and b."""
    error = (1 / (1 + np.exp(-np.clip(np.bincount(doc, w[col], len(y)) + b, -30, 30))) - y) * each
    grad = np.bincount(col, error[doc], len(w)) + ridge * w
    if pairs:
        change = np.bincount(pair, pval * w[pcol], pairs)
        grad += 2 * counterfactual / pairs * np.bincount(pcol, pval * change[pair], len(w))
    return grad, float(error.sum())


def train(texts: list[str], labels: list[int], prior: float, groups=GROUPS, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, steps: int = STEPS, least: int = LEAST, stands_out: float = STANDS_OUT, learn: bool = True) -> Model:
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    number: dict[str, int] = {}  # of each feature; a text is kept as the numbers of its own
    rows = []
    for t in texts:
        own = features(WORD.findall(t.lower()))
        rows.append(np.fromiter((number.setdefault(f, len(number)) for f in sorted(own)), dtype=np.int32, count=len(own)))
    doc, all_ = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    p, n = y.sum(), len(y) - y.sum()
    a, b = np.bincount(all_, y[doc], len(number)), np.bincount(all_, 1 - y[doc], len(number))
    z = (np.log((a + 0.5) / (p - a + 0.5)) - np.log((b + 0.5) / (n - b + 0.5))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    learnt = learnt_groups(number, rows, z, a + b) if learn else []
    chosen = (a + b >= least) & (np.abs(z) >= stands_out)
    for term in {t for g in (*groups, *learnt) for t in g} & number.keys():
        chosen[number[term]] |= a[number[term]] + b[number[term]] >= least
    place = np.where(chosen, np.cumsum(chosen) - 1, -1)
    index = {f: int(place[k]) for f, k in number.items() if chosen[k]}
    keep = chosen[all_]
    doc, col = doc[keep], place[all_[keep]]
    pairs, sign = 0, []
    for t in texts:
        for before, after in (*swaps(t, groups), *one_swap(t, learnt)):
            sign += [(pairs, index[f], 1.0 if f in before else -1.0) for f in sorted(before ^ after) if f in index]
            pairs += 1
    pair, pcol, pval = (np.array(x) for x in zip(*sign, strict=True)) if sign else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    each = np.where(y == 1, 0.5 / p, 0.5 / n)  # both classes weigh the same
    w, bias, velocity, speed = np.zeros(len(index)), 0.0, np.zeros(len(index)), 0.0
    curve = 1.0 + np.bincount(col, each[doc], len(index))
    curve += 2 * counterfactual * np.bincount(pcol, minlength=len(index)) / max(pairs, 1)
    for _ in range(steps):
        grad, grad_bias = gradient(w, bias, y, each, doc, col, pairs, pair, pcol, pval, counterfactual, ridge)
        velocity = 0.9 * velocity - 0.5 * grad / curve
        speed = 0.9 * speed - 0.5 * grad_bias
        w, bias = w + velocity, bias + speed
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, seed: int = 9, **options) -> Model:
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    slim = docs.where(keep & F.col("text").isNotNull() & (F.length("text") <= chars)).select("doc_id", F.xxhash64(F.lit(seed), F.xxhash64("text")).alias("h"))
    marked = stash(slim.join(marks, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")))
    share = marked.agg(F.avg((F.col("toxic") > 0).cast("int"))).first()[0]
    # the first by hash of each class: every task hands on `sample` rows at most
    chosen = [r for one in (False, True) for r in marked.where((F.col("toxic") > 0) == one).orderBy("h").limit(sample).select("doc_id", "h", "toxic").collect()]
    if not chosen:
        return train([], [], 0.5)
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id, r.h, r.toxic) for r in chosen], "doc_id long, h long, toxic int")
    texts = docs.join(F.broadcast(ids), "doc_id").where(F.xxhash64(F.lit(seed), F.xxhash64("text")) == F.col("h")).groupBy("h").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("h").collect()
    return train([r.text for r in texts], [int(r.toxic > 0) for r in texts], float(share), **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, judge("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, fold("doc_id") != 0)
    return score(docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
