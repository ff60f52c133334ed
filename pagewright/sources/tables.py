"""Input tables that stand for what a browser would fetch, with their schemas, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> columns
TABLES = {
    "pages": "page_id long, url string, html string",
    "fetches": "requested string, url string, ok boolean, status int, redirected boolean, headers map<string,string>, text string, bytes long, ms long, error string, ua string, fetched_at timestamp",
    "agent_probes": "url string, agent string, status int, bytes long, error string",
    "link_status": "url string, status int, finalUrl string, redirected boolean, error string, ms long, method string",
    "robots": "site string, status int, error string, text string",
    "sitemaps": "url string, status int, body string",
    "llms": "site string, status int, body string",
}


def read(spark: SparkSession, name: str, path: str, form: str = "parquet") -> DataFrame:
    """One of the tables, with its fixed schema; columns that are not used are not read."""
    return spark.read.schema(TABLES[name]).format(form).load(path)


def x_robots(fetches: DataFrame) -> DataFrame:
    """url, x_robots: the header of a fetched page, whatever its case."""
    from pyspark.sql import functions as F

    lower = F.transform_keys("headers", lambda k, v: F.lower(k))
    return fetches.select("url", F.try_element_at(lower, F.lit("x-robots-tag")).alias("x_robots"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports (page_id, report) as text files, one folder a page id bucket."""
    reports.selectExpr("page_id % 64 AS bucket", "report AS value").write.partitionBy("bucket").mode("overwrite").text(path)


def write_dump(dumps: DataFrame, path: str) -> None:
    """Snapshots (page_id, snapshot) as lines of JSON."""
    dumps.selectExpr("snapshot AS value").write.mode("overwrite").text(path)


def write_findings(found: DataFrame, path: str) -> None:
    """Findings rows by area, so that a reader of one area opens its files only."""
    found.write.partitionBy("area").mode("overwrite").parquet(path)
