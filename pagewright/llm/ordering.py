"""Numbering the rows of a sorted DataFrame without bringing them to one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pagewright.llm.common import stash


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df (written and reread) with `name`: each row's place from 0 in the order of `by`, nulls first.

    Rows are range-partitioned and sorted; each task numbers its own rows, and the tasks' row counts, one
    number a partition, shift them.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*df.schema.fields, StructField("__part", IntegerType()), StructField("__place", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], names=[*b.schema.names, "__part", "__place"])
            at += n

    dealt = stash(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(run, schema))
    counts = dict(dealt.groupBy("__part").count().collect())  # a row a partition
    shift, total = [], 0
    for p in sorted(counts):
        shift.append((p, total))
        total += counts[p]
    shifts = spark.createDataFrame(shift, "__part int, __shift long")
    return dealt.join(F.broadcast(shifts), "__part").withColumn(name, F.col("__place") + F.col("__shift")).drop("__part", "__place", "__shift")
