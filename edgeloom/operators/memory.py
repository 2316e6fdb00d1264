"""Scores of remembered edges and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seen_flag(asked: DataFrame, memory: DataFrame, keys: list[str], name: str = "score") -> DataFrame:
    """``asked`` with 1 where its keys are in ``memory`` and 0 elsewhere."""
    mark = memory.select(*keys).distinct().withColumn(name, F.lit(1))
    return asked.join(mark, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("int"))


def recent_window(edges: DataFrame, share: float) -> DataFrame:
    """Edges of the last ``share`` of the time quantiles."""
    low = edges.agg(F.percentile("t", 1 - share).alias("low"))
    return edges.join(F.broadcast(low)).filter(F.col("t") >= F.col("low")).drop("low")


def repeat_interval(edges: DataFrame) -> DataFrame:
    """One row: the sum of mean gaps of repeated edges over the number of distinct edges."""
    gaps = edges.withColumn("gap", F.col("t") - F.lag("t").over(W.partitionBy("u", "v").orderBy("seq")))
    return gaps.groupBy("u", "v").agg(F.avg("gap").alias("gap")).agg((F.coalesce(F.sum("gap"), F.lit(0.0)) / F.count("*")).alias("width"))


def frequent(edges: DataFrame) -> DataFrame:
    """Edges that occur at least as often as edges do on average."""
    often = edges.groupBy("u", "v").agg(F.count("*").alias("n"))
    return often.join(F.broadcast(often.agg(F.avg("n").alias("mean")))).filter(F.col("n") >= F.col("mean")).select("u", "v")


def sliding_bank(edges: DataFrame, size: int, share: float) -> DataFrame:
    """(seq, u, v, score): has the directed edge been seen, in batches before its own, within the
    window that ends at the latest time of those batches?

    The last earlier occurrence is carried along each edge's own stream; batch ends are few rows.
    """
    from .graph import batches

    rows = batches(edges, size)
    ends = rows.groupBy("batch").agg(F.max("t").alias("upto")).withColumn("batch", F.col("batch") + 1)
    width = edges.agg(((F.max("t") - F.min("t")) * share).alias("width"))
    last = F.max(F.struct("batch", "t")).over(W.partitionBy("u", "v").orderBy("batch").rangeBetween(W.unboundedPreceding, -1))
    out = rows.withColumn("last", last.getField("t")).join(ends, "batch", "left").join(F.broadcast(width))
    hit = F.col("last").isNotNull() & (F.col("last") >= F.col("upto") - F.col("width"))
    return out.select("seq", "u", "v", F.when(hit, 1).otherwise(0).alias("score"))
