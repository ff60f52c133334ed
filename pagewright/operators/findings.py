"""Rules as expressions: a predicate over a snapshot, and the finding it gives.

A page's findings are one array made in place (no shuffle), in rule order; ``long`` turns them into rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ["fail", "warn", "note", "pass"]
FINDING = "array<struct<severity:string,area:string,id:string,title:string,detail:string,fix:string>>"


def lit(x: Column | str | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


@dataclass(frozen=True)
class Rule:
    area: str
    id: str | Column
    severity: str | Column
    when: Column
    title: str | Column
    detail: str | Column | None = None
    fix: str | None = None

    def column(self) -> Column:
        row = F.struct(lit(self.severity).alias("severity"), F.lit(self.area).alias("area"), lit(self.id).alias("id"), lit(self.title).alias("title"), lit(self.detail).alias("detail"), lit(self.fix).alias("fix"))
        return F.when(self.when, row)


def evaluate(rules: Iterable[Rule | Column]) -> Column:
    """Findings of the rules that fire, in order. A plain Column is an array of findings by itself."""
    parts: list[Column] = []
    held: list[Column] = []
    for r in rules:
        if isinstance(r, Rule):
            held.append(r.column())
            continue
        if held:
            parts.append(F.array_compact(F.array(*held)))
        parts.append(r)
        held = []
    if held:
        parts.append(F.array_compact(F.array(*held)))
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0] if parts else F.lit(None).cast(FINDING)


def rank(severity: Column) -> Column:
    out = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        out = F.when(severity == s, i).otherwise(out)
    return out


def long(df: DataFrame, column: str = "findings", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row a finding, `seq` its place among the page's."""
    return df.select(*keys, F.posexplode(column).alias("seq", "f")).select(*keys, "seq", "f.*")


def in_order(df: DataFrame) -> DataFrame:
    """Failures first, then warnings, notes, passes; inside a severity as the rules stand."""
    return df.orderBy("page_id", rank(F.col("severity")), "seq")


def in_place(findings: Column) -> Column:
    """Findings with their rank and place: structs that sort into reading order inside an area."""
    return F.transform(findings, lambda f, i: F.struct(rank(f["severity"]).alias("rank"), i.alias("seq"), f["severity"].alias("severity"), f["area"].alias("area"), f["id"].alias("id"), f["title"].alias("title"), f["detail"].alias("detail"), f["fix"].alias("fix")))


def of_severity(findings: Column, severity: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["severity"] == severity)).cast("long")


def tally(audited: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """counts() of rows that hold their findings as an array: no shuffle."""
    own = F.col("findings")
    return audited.select(*keys, *(of_severity(own, s).alias(s) for s in SEVERITIES), F.size(own).cast("long").alias("total"))


def gravest(audited: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """worst() of rows that hold their findings as an array; rows without findings have none."""
    least = audited.select(*keys, F.array_min(in_place(F.col("findings"))).alias("f")).where("f is not null")
    return least.select(*keys, F.col("f.id").alias("worst_id"), F.col("f.severity").alias("worst_severity"))


def counts(findings: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """How many findings of each severity a page has."""
    return findings.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES), F.count("*").alias("total"))


def verdict(counted: DataFrame) -> DataFrame:
    """The headline: broken if anything fails, else to improve, else not run where nothing was checked, else clean."""
    c = F.col
    return counted.withColumn("verdict", F.when(c("fail") > 0, "broken").when(c("warn") > 0, "improve").when(c("total") == 0, "not run").otherwise("clean"))


def worst(findings: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Each page's gravest finding, the first of equals."""
    order = F.struct(rank(F.col("severity")), F.col("seq"))
    return findings.groupBy(*keys).agg(F.min_by("id", order).alias("worst_id"), F.min_by("severity", order).alias("worst_severity"))
