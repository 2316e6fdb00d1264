"""Rolling statistics of node indicators: a fold over each node's ticks in order.

``trace`` is (node, n, value) with one row per tick.  Plain statistics are windows; the
decayed ones are a recurrence, which is folded in Arrow batches per node, so that a node
with many ticks costs linear time and every prefix is emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DECAY = 0.95
STATS = ("current", "ema", "std", "delta", "max_change", "trend", "recency")


def plain(trace: DataFrame) -> DataFrame:
    """(node, n, current, delta, recency): the change since the previous tick (0 at first) and
    log1p of the ticks since the last change, without a fold."""
    order = W.partitionBy("node").orderBy("n")
    out = trace.withColumn("before", F.lag("value").over(order)).withColumn("tick", F.row_number().over(order))
    out = out.withColumn("delta", F.coalesce(F.col("value") - F.col("before"), F.lit(0.0)))
    changed = F.when((F.col("delta") != 0) | (F.col("tick") == 1), F.col("tick"))
    out = out.withColumn("since", F.col("tick") - F.last(changed, ignorenulls=True).over(order))
    return out.select("node", "n", F.col("value").cast("double").alias("current"), F.col("delta").cast("double").alias("delta"), F.log1p(F.col("since").cast("double")).alias("recency"))


class Fold:
    """The recurrence over ticks in order; remembers the node that a batch breaks off in."""

    def __init__(self, decay: float, trend_decay: float):
        self.decay, self.trend_decay, self.node = decay, trend_decay, None
        self.state = (0.0,) * 6

    def fold(self, nodes: list, values: list[float], starts: np.ndarray | None = None) -> tuple[list[tuple], list[tuple]]:
        """STATS at each tick and, with ``starts``, the state after it: a node that comes up begins with its row of
        ``starts``, or anew where that is NaN."""
        d, td, node = self.decay, self.trend_decay, self.node
        last, ema, sq, slow, change, since = self.state
        rows, after = [], []
        for i, (key, x) in enumerate(zip(nodes, values)):
            fresh = key != node
            if fresh and starts is not None and starts[i, 0] == starts[i, 0]:
                node, fresh = key, False
                last, ema, sq, slow, change, since = starts[i].tolist()
            if fresh:
                node, ema, sq, slow, change, since, delta = key, x, x * x, x, 0.0, 0, 0.0
            else:
                delta = x - last
                ema, sq, slow = d * ema + (1 - d) * x, d * sq + (1 - d) * x * x, td * slow + (1 - td) * x
                change = max(d * change, abs(delta))
                since = 0 if delta else since + 1
            last = x
            rows.append((x, ema, max(sq - ema * ema, 0.0) ** 0.5, delta, change, ema - slow, math.log1p(since)))
            if starts is not None:
                after.append((last, ema, sq, slow, change, since))
        self.node, self.state = node, (last, ema, sq, slow, change, since)
        return rows, after

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, _ = self.fold(pdf["node"].tolist(), pdf["value"].tolist())
        return pd.concat([pdf[["node", "n"]].reset_index(drop=True), pd.DataFrame(rows, columns=list(STATS), dtype=np.float64)], axis=1)


def rolling(trace: DataFrame, decay: float = DECAY, trend_decay: float = 0.99) -> DataFrame:
    """(node, n) and the columns of STATS at every tick.

    Nodes are clustered and sorted by Spark; a task streams through its nodes, so a hub's
    ticks are never held together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = Fold(decay, trend_decay)
        for pdf in batches:
            if len(pdf):
                yield step(pdf)

    rows = trace.select(F.col("node").cast("long"), F.col("n").cast("long"), F.col("value").cast("double"))
    rows = rows.repartition("node").sortWithinPartitions("node", "n")
    return rows.mapInPandas(run, "node long, n long, " + ", ".join(f"{s} double" for s in STATS))


def stat_columns(groups: list[str]) -> list[str]:
    """Columns of the wanted groups, in their order: all, static (the current value), dynamic (the rest) or names."""
    if not groups or groups == ["all"]:
        return list(STATS)
    if groups == ["static"]:
        return ["current"]
    if groups == ["dynamic"]:
        return [c for c in STATS if c != "current"]
    unknown = [g for g in groups if g not in STATS]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}: choose from {STATS} or all, static, dynamic")
    return [c for c in STATS if c in groups]


def select_stats(stats: DataFrame, groups: list[str]) -> DataFrame:
    return stats.select("node", "n", *stat_columns(groups))


def state_bytes(stats: DataFrame, indicators: int = 1) -> int:
    """Bytes of the latest statistics of all nodes as 32-bit numbers."""
    return stats.select("node").distinct().count() * len(STATS) * indicators * 4


def as_of(queries: DataFrame, history: DataFrame, keys: list[str], query_at: str, history_at: str, values: list[str], strict: bool = True) -> DataFrame:
    """``queries`` with the values of the latest history row of their keys before (or at) their time.

    One shuffle on the keys and a window that carries the last history row forward.
    """
    tag = F.struct(*[F.col(v) for v in values])
    past = history.select(*keys, F.col(history_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), tag.alias("_v"), F.lit(None).cast(queries_struct(queries)).alias("_q"))
    ask = queries.select(*keys, F.col(query_at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(past.schema["_v"].dataType).alias("_v"), F.struct(*[F.col(c) for c in queries.columns]).alias("_q"))
    order = W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = past.unionByName(ask).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).filter("_q is not null")
    return joined.select("_q.*", *[F.col("_v").getField(v).alias(v) for v in values])


def queries_struct(queries: DataFrame):
    from pyspark.sql import types as T

    return T.StructType(queries.schema.fields)
