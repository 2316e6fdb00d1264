"""Edge streams from the tables: one row per interaction, in one total order.

Columns: seq (1..n in stream order), eid, u, v, t (microseconds), w.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import numbered

ITEM_BASE = 1_000_000
PART_BASE = 10_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a time stamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(
        F.col("event_id").alias("eid"),
        F.col("user_id").alias("u"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        micros(F.col("ts")).alias("t"),
        F.col("value").alias("w"),
        "event_type",
    )


def _stream(rows: DataFrame) -> DataFrame:
    ranked = numbered(rows, ["t", "eid"])
    return ranked.select("seq", "eid", "u", "v", "t", "w")


def bip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and items in two id spaces."""
    return _stream(events(spark, sf_dir).withColumn("v", F.col("k") + ITEM_BASE))


def uni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and items in one id space: has self loops and triangles."""
    return _stream(events(spark, sf_dir).withColumn("v", F.col("k")))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts of their orders; many tied dates, broken by the row's content."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"]
    rows = o.join(line.select(*ties), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.withColumn("t", micros(F.col("o_orderdate")))
    ranked = numbered(rows, ["t", *ties])
    return ranked.select("seq", F.col("l_orderkey").alias("eid"), F.col("o_custkey").alias("u"), (F.col("l_partkey") + PART_BASE).alias("v"), "t", F.col("l_extendedprice").alias("w"))
