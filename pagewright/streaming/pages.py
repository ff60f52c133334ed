"""The audit as a stream: new page files in, findings out, and counts kept up by micro-batch.

The rules are row-local, so the batch expression runs unchanged; each micro-batch is audited when the one
before is done. Facts that a later fetch replaces are keyed by url and the latest wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import findings as FD
from pagewright.operators import marks as M
from pagewright.plans import audit
from pagewright.sources.snapshots import extract


def page_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files of pages (page_id, url, html) as they come."""
    return spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_at_once).parquet(path)


def findings_stream(pages: DataFrame) -> DataFrame:
    return FD.long(audit.audit(extract(pages)))


def run(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Audit each micro-batch and hand its findings to sink; with `once`, all there is and no more."""
    writer = findings_stream(pages).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def severity_stream(pages: DataFrame) -> DataFrame:
    """Running number of findings by severity (complete or update mode)."""
    return findings_stream(pages).groupBy("severity").count()


def progress(checked: DataFrame, answers: DataFrame) -> DataFrame:
    """page_id, done, total: how many of a page's links to check (page_id, key) have an answer (url) so far."""
    known = answers.select(F.col("url").alias("key")).distinct().withColumn("__known", F.lit(True))
    return checked.join(known, "key", "left").groupBy("page_id").agg(F.count("__known").alias("done"), F.count("*").alias("total"))


def run_link_checks(answers: DataFrame, checked: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Answers (url, status, redirected, error) as they come: each micro-batch's severities and labels go to sink, with the progress of the pages.

    Answers are kept in `store`, a folder for each micro-batch, so that a batch that is run again replaces itself.
    """
    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={n}")
        spark = batch.sparkSession
        own = spark.read.schema(batch.schema).parquet(f"{store}/batch={n}")
        severity, label = M.link_status_verdict(F.col("status"), F.col("error"), F.col("redirected"))
        rows = checked.join(own.withColumnRenamed("url", "key"), "key").select("page_id", "key", "status", severity.alias("severity"), label.alias("label"))
        sink(rows, progress(checked, spark.read.schema(batch.schema).parquet(store)), n)

    writer = answers.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(fetches: DataFrame) -> DataFrame:
    """The last fetch of each url (url, fetched_at, ...)."""
    rest = [c for c in fetches.columns if c != "url"]
    return fetches.groupBy("url").agg(F.max_by(F.struct(*rest), "fetched_at").alias("x")).select("url", "x.*")
