"""Structured Streaming jobs over the event table.

State is kept by Spark per key and survives restarts through the checkpoint; a late or
unordered event is folded in where it arrives.  ``drain`` runs a job over what is there
(``availableNow``) and returns what its sink holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kept import EVENT, KeptGraph, Manifest
from ..operators.rolling import DECAY, Fold
from ..session import shared_folder
from ..sources.edges import micros

STATS = "n long, ema double, std double, max_change double"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """The event table, a file or a folder of files, as a stream of (eid, u, k, t, w)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, as a stream takes a plain path for a folder.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/event[s].parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    return stream.select(F.col("event_id").alias("eid"), F.col("user_id").alias("u"), k.alias("k"), micros(F.col("ts")).alias("t"), F.col("value").alias("w"))


def rolling_state(stream: DataFrame, key: str = "u", value: str = "w", decay: float = DECAY) -> DataFrame:
    """(node, n, ema, std, max_change) of each node that a micro-batch touches, after it.

    Ticks of one micro-batch are folded in the order of (t, eid); what a task holds is one
    node's part of one micro-batch, which ``files_per_trigger`` bounds.
    """

    def fold(node: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step = Fold(decay, decay)
        n, *values = state.get if state.exists else (0, *[0.0] * 6)
        if n:
            step.node, step.state = node[0], tuple(values)
        ticks = pd.concat(list(parts)).sort_values(["t", "eid"])
        out = step(pd.DataFrame({"node": node[0], "n": range(len(ticks)), "value": ticks["value"].astype(float).to_numpy()})).iloc[-1]
        n += len(ticks)
        state.update((n, *map(float, step.state)))
        yield pd.DataFrame({"node": [node[0]], "n": [n], "ema": [out["ema"]], "std": [out["std"]], "max_change": [out["max_change"]]})

    rows = stream.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node"), "t", "eid", F.col(value).cast("double").alias("value"))
    held = "n long, last double, ema double, sq double, slow double, change double, since double"
    return rows.groupBy("node").applyInPandasWithState(fold, f"node long, {STATS}", held, "update", GroupStateTimeout.NoTimeout)


def edge_memory(stream: DataFrame) -> DataFrame:
    """(u, k, n, last_t) of each edge: how often and when last it was seen."""
    return stream.groupBy("u", "k").agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


def edge_window(stream: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """(u, k, n, last_t, state): edges that are in a sliding window of event time, and those that leave it.

    An edge is ``in`` with each micro-batch that brings it and ``out`` once the watermark is ``width`` beyond its
    last occurrence; its state is dropped then, so what is held is the window.  An edge that was out for longer than
    ``width`` and came back counts anew, whether both happen in one micro-batch or not.  Rows later than ``late``
    behind the latest time are left out.
    """
    span = int(pd.Timedelta(width).total_seconds() * 1_000_000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"u": [key[0]], "k": [key[1]], "n": [n], "last_t": [last], "state": ["out"]})
            return
        for t in sorted(int(x) for p in parts for x in p["t"]):
            n, last = n + 1 if n and t <= last + span else 1, max(last, t)
        state.update((n, last))
        state.setTimeoutTimestamp(max((last + span) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"u": [key[0]], "k": [key[1]], "n": [n], "last_t": [last], "state": ["in"]})

    timed = stream.filter("u is not null and k is not null").withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)
    rows = timed.select("u", "k", "t", "at")
    return rows.groupBy("u", "k").applyInPandasWithState(step, "u long, k long, n long, last_t long, state string", "n long, last_t long", "update", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, u, n): events of each user per tumbling window; what is later than ``late`` is left out."""
    timed = stream.withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "u").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start"), "u", "n")


def advance(stream: DataFrame, kept: KeptGraph, last: bool = False) -> Manifest:
    """Advance a kept graph by all events (u, k, t, eid) that a stream has; its manifest after them.

    The graph cuts batches of its own fixed size out of the micro-batches and keeps what is left over for the next
    ones, so that files may be of any length; with ``last`` the rest is taken as one more, shorter batch.  A later call
    with the same folder goes on where this one ended.
    """
    spark, done = stream.sparkSession, []
    checkpoint = f"{kept.folder}/stream"
    rows = stream.filter("u is not null and k is not null").select("u", F.col("k").alias("v"), "t", "eid")

    def step(batch: DataFrame, number: int) -> None:
        kept.take(batch, number + 1)
        done.append(number + 1)

    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    upto = max(done, default=0)
    return kept.take(rows_of_none(spark), upto + 1, last=True) if last else kept.manifest(upto)


def rows_of_none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT)


def drain(updates: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run a stream in update mode over all that is there; the last row of each key.

    With the ``folder`` of an earlier run, that run's state is restored and goes on with what is new.
    Micro-batches are written under their number, so one that is run again replaces its rows.
    """
    spark = updates.sparkSession
    folder = folder or shared_folder(spark, "stream")
    out, checkpoint = f"{folder}/out", f"{folder}/state"
    schema = updates.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(schema.add("batch", "long")).parquet(out)
    values = F.struct(*[F.col(f.name) for f in schema.fields if f.name not in [*keys, "batch"]])
    last = rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("v"))
    return last.select(*keys, "v.*")


def read_state(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """Keys and values that the state store of a ``drain`` holds, now or after micro-batch ``version``, by Spark's state source."""
    source = spark.read.format("statestore")
    if version is not None:
        source = source.option("batchId", version)
    return source.load(f"{folder}/state")
