"""Table functions for SQL: Arrow batches of a table, partitioned by a key and ordered, in; rows out.

    SELECT * FROM rolling_stats(TABLE(ticks) PARTITION BY node ORDER BY n)
    SELECT * FROM history_slots(5, TABLE(rows) PARTITION BY node ORDER BY seq)

Spark gives each partition an instance of its own and hands its rows over in batches, so a hub streams through.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..operators.rolling import DECAY, STATS, Fold

#: SQL functions over arrays in order; Catalyst inlines their bodies.
ARRAY_FUNCTIONS = {
    "ema_of": ("xs ARRAY<DOUBLE>, d DOUBLE", "DOUBLE", "if(size(xs) > 0, aggregate(slice(xs, 2, size(xs)), xs[0], (a, x) -> d * a + (1 - d) * x), NULL)"),
    "max_change_of": ("xs ARRAY<DOUBLE>, d DOUBLE", "DOUBLE", "if(size(xs) > 0, aggregate(slice(xs, 2, size(xs)), struct(xs[0] AS l, 0D AS m), (a, x) -> struct(x AS l, greatest(d * a.m, abs(x - a.l)) AS m), a -> a.m), NULL)"),
}


class RollingStats:
    """The statistics of STATS at each row of (node, n, value)."""

    def __init__(self):
        self.step = Fold(DECAY, 0.99)

    def eval(self, ticks: pa.RecordBatch) -> Iterator[pa.Table]:
        rows, _ = self.step.fold(ticks.column("node").to_pylist(), ticks.column("value").cast(pa.float64()).to_pylist())
        columns = {"node": ticks.column("node").cast(pa.int64()), "n": ticks.column("n").cast(pa.int64())}
        yield pa.table(columns | {name: pa.array([r[i] for r in rows], pa.float64()) for i, name in enumerate(STATS)})


class HistorySlots:
    """(node, seq, slot, nbr) of rows (node, seq, nbr): the last ``k`` neighbours strictly before each row, oldest first from slot 1."""

    def __init__(self):
        self.past: deque | None = None

    def eval(self, k: pa.Array, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        if self.past is None:
            self.past = deque(maxlen=k[0].as_py())
        out = []
        for node, seq, nbr in zip(*(rows.column(c).to_pylist() for c in ("node", "seq", "nbr"))):
            out += [(node, seq, i, x) for i, x in enumerate(self.past, 1)]
            self.past.append(nbr)
        yield pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("node", "seq", "slot", "nbr"))})


TABLE_FUNCTIONS = {
    "rolling_stats": (RollingStats, "node long, n long, " + ", ".join(f"{s} double" for s in STATS)),
    "history_slots": (HistorySlots, "node long, seq long, slot long, nbr long"),
}


def register_tables(spark: SparkSession) -> list[str]:
    """Make the functions above known to the session's SQL."""
    for name, (kind, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, arrow_udtf(kind, returnType=schema))
    for name, (parameters, result, body) in ARRAY_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return sorted([*TABLE_FUNCTIONS, *ARRAY_FUNCTIONS])
