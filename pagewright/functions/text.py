"""Text and URL expressions. All are Column functions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Browser white space, for character classes.
WS = r"\s   -     　﻿"
#: Words that open a question.
QUESTION_WORDS = "who what when where why how which can do does is are should will".split()
#: Anchor texts that say nothing of their target.
GENERIC_ANCHORS = ["click here", "here", "read more", "learn more", "more", "this", "link", "find out more", "see more", "details", "view"]


def squeeze(c: Column, limit: int | None = None) -> Column:
    """White space collapsed and trimmed, cut to limit; null becomes empty."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), f"[{WS}]+", " ")
    out = F.trim(out)
    return F.left(out, F.lit(limit)) if limit else out


def words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"[^{WS}]+"))


def blank(c: Column) -> Column:
    """Null or empty, what the rules call missing."""
    return F.coalesce(c, F.lit("")) == ""


def word_in(c: Column, word: str) -> Column:
    """Whether word stands in c between characters that are not ASCII word characters."""
    return F.coalesce(c, F.lit("")).rlike(rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])")


def no_fragment(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def clean_url(c: Column) -> Column:
    """Without fragment and without one trailing slash."""
    return F.regexp_replace(no_fragment(c), "/$", "")


def host_of(c: Column) -> Column:
    """Host with a port that is given, lower case; null if there is none."""
    h = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    return F.when(h != "", h)


def some_of(items: Column, n: int = 3) -> Column:
    """First n items, and how many more there are."""
    more = F.size(items) - n
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def is_question(c: Column) -> Column:
    t = F.trim(c)
    return (t != "") & (t.endswith("?") | F.lower(t).rlike(f"^({'|'.join(QUESTION_WORDS)})(?![A-Za-z0-9_])"))


def generic_anchor(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(GENERIC_ANCHORS)


def has_token(rel: Column, token: str) -> Column:
    return F.array_contains(F.split(F.lower(F.coalesce(rel, F.lit(""))), f"[{WS}]+"), token)
