"""Positions in a global order, without sorting or counting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder

LOW_BITS = 33  #: of ``monotonically_increasing_id``, which hold a row's place in its partition


def numbered(df: DataFrame, order: list, name: str = "seq", start: int = 1) -> DataFrame:
    """``df`` with ``name`` = start .. in the order of ``order`` (null first unless a column says otherwise).

    Rows are dealt out by ranges of all order columns, so tied leading columns don't meet in one
    task, sorted there and written to the shared folder with their place in the partition.  What is
    added up in order is one row count per partition.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "order")
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", LOW_BITS))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    base = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))  # as many rows as partitions
    inside = F.col("_at").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    return rows.join(base, "_part").withColumn(name, (F.col("_base") + inside + start).cast("long")).drop("_at", "_part", "_base")
