"""Small tables with every awkward case: null and equal ids, null, empty, blank and long texts, copies, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, score double, place string, label string, `at` string, n int"
VOCABULARY = {k: [f"{a}{b}" for a in "ba ke lo mi nu ra".split() for b in ends.split()] for k, ends in (("en", "th ing ed"), ("de", "sch ung keit"), ("fr", "eau ment oux"))}


def prose(rng: random.Random, lang: str, words: int) -> str:
    out = [rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "s", ",", "."]) for _ in range(words)]
    return "".join(w + ("\n" if i % 12 == 11 else " ") for i, w in enumerate(out)).strip()


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", "fr"])
        out.append((i, prose(rng, lang, rng.randint(5, 160)), lang, f"src{i % 5}"))
    long = prose(rng, "en", 6_000)
    shared = prose(rng, "en", 90)
    base = out[3][1] + " " + prose(rng, "en", 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    out += [
        (200, None, "en", "src1"), (201, "", "de", None), (202, " \n\t ", None, "src2"), (203, long, "en", "src0"), (204, base, "en", "src0"), (205, base, "en", "src0"), (206, near, "en", "src3"), (206, near, "en", "src3"),
        (None, prose(rng, "fr", 30), "fr", "other"), (207, "one two", "en", "src1"), (208, "one two", "en", "src1"), (209, "12345 !!!", "en", "src1"), (210, prose(rng, "de", 20) + "\n" + shared + "\n" + prose(rng, "de", 20), "de", "src1"),
        (211, prose(rng, "fr", 20) + "\n" + shared + "\nend", "fr", "src1"), (212, "same line of eight words that is long\n" * 40, "en", "src4"), (213, "ab" * 600, "en", "src4"), (214, "naïve café <|endoftext|> 😀😀 don't", "en", "src4"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None, 7, 0.5, "x", "y", "z", 1) for i, t, lang, s in out]


def documents(spark, **options):
    return spark.createDataFrame(rows(**options), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
