"""A graph that is kept and advanced in batches of a fixed number of events.

Adjacency and node values are views that are maintained, not computed anew.  A version of the graph is a base
and the deltas after it, all in one shared folder: edges that came or went, and nodes that moved with the state
of their rolling statistics.  A batch joins only its new and its pruned edges with the neighbourhoods that they
touch, and every few versions the deltas are folded into a new base.

A version is written under its number and a micro-batch's manifest last of all, so a micro-batch that is run
again after a failure starts from the manifest before it and replaces what it had left behind.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, read_text, write_text
from ..sources.order import numbered
from .graph import BATCH, cut, stays
from .rolling import DECAY, STATS, Fold

EDGE = "n long, m long, n0 long, t long, batch long, gone boolean"
HELD = ("last", "ema_", "sq", "slow", "change", "since")
MOVE = "node long, batch long, phase int, n0 long, degree long, triangles long, clustering double, " + ", ".join(f"{c} double" for c in (*STATS, *HELD))
EVENT = "u long, v long, t long, eid long"


@dataclass
class Manifest:
    """What a micro-batch leaves: events taken, edges numbered, versions since the base, and where pending events are."""

    seq: int = 0
    edges: int = 0
    base: int = 0
    versions: list[int] = field(default_factory=list)
    pending: str = ""


class KeptGraph:
    """The evolving simple graph in ``folder``; ``rolled`` is the indicator whose statistics are kept.

    With a ``width`` a batch first prunes the edges that came more than that before its latest event.  If any
    go, all nodes known by then tick, and then the nodes that the batch's new edges affect.  Self loops and repeats
    of a present edge change nothing; a pruned edge may come again as a new one.  Null ends are left out.

    With ``rolled`` of None edges are kept only, and no nodes: then all full batches of a micro-batch are advanced at once.
    """

    def __init__(self, spark: SparkSession, folder: str, size: int = BATCH, width: int = 0, rolled: str | None = "degree", together: int = 16, fold_every: int = 8):
        """As many batches as there were before, but ``together`` at least, are advanced at once where no width asks for each
        on its own: the steps grow with the logarithm of the events, and what one reads anew is no more than what it brings."""
        self.spark, self.folder, self.size, self.width, self.rolled = spark, folder.rstrip("/"), size, width, rolled
        self.together, self.fold_every = 1 if width else together, fold_every

    # -- what is there ------------------------------------------------------------------

    def manifest(self, micro_batch: int) -> Manifest:
        return Manifest(**json.loads(read_text(self.spark, f"{self.folder}/manifest/{micro_batch}"))) if micro_batch else Manifest()

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def _parts(self, m: Manifest, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/base/{m.base}/{name}"] if m.base else []
        paths += [f"{self.folder}/delta/{v}/{name}" for v in m.versions if v > m.base]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def edges(self, m: Manifest) -> DataFrame:
        """(n, m, n0, t): both directions of the present edges."""
        log = self._parts(m, "edges", EDGE)
        came = log.filter("not gone").drop("gone", "batch")
        return came.join(log.filter("gone").select("n", "m", "n0"), ["n", "m", "n0"], "left_anti") if self.width else came

    def nodes(self, m: Manifest) -> DataFrame:
        """The latest move of every node ever seen: its values and the state of its statistics."""
        moves = self._parts(m, "moves", MOVE)
        rest = [f for f in moves.columns if f != "node"]
        return moves.groupBy("node").agg(F.max_by(F.struct(*rest), F.struct("batch", "phase", "n0")).alias("x")).select("node", "x.*")

    def moves(self, m: Manifest) -> DataFrame:
        """All ticks so far: (node, batch, phase, n0), phase 0 after a prune, the indicators and the statistics."""
        paths = [f"{self.folder}/delta/{v}/moves" for v in m.versions]
        return self.spark.read.schema(MOVE).parquet(*paths) if paths else self.spark.createDataFrame([], MOVE)

    def stays(self, m: Manifest) -> DataFrame:
        """(a, b, t_in, batch_in, batch_out): when each edge was in the graph; an open stay has a null batch_out.

        Read from the record of what came and went, so the micro-batches that brought the events make no difference.
        """
        paths = [f"{self.folder}/delta/{v}/edges" for v in m.versions]
        log = (self.spark.read.schema(EDGE).parquet(*paths) if paths else self.spark.createDataFrame([], EDGE)).filter("n < m")
        came = log.filter("not gone").select(F.col("n").alias("a"), F.col("m").alias("b"), "n0", F.col("t").alias("t_in"), F.col("batch").alias("batch_in"))
        went = log.filter("gone").select(F.col("n").alias("a"), F.col("m").alias("b"), "n0", F.col("batch").alias("batch_out"))
        return came.join(went, ["a", "b", "n0"], "left").drop("n0")

    # -- advance ------------------------------------------------------------------------

    def take(self, events: DataFrame, micro_batch: int, last: bool = False) -> Manifest:
        """Advance by all full batches of the events left over and ``events`` (u, v, t, eid); the ``last`` may be short.

        Events are taken in the order of (t, eid); those of a micro-batch must not be before those of an earlier one.
        """
        m = self.manifest(micro_batch - 1)
        left = self._read(m.pending, EVENT) if m.pending else self.spark.createDataFrame([], EVENT)
        rows = numbered(left.union(events.select("u", "v", "t", "eid")), ["t", "eid"], "seq", m.seq + 1)
        many = rows.count()
        full = many if last else many // self.size * self.size
        end = m.seq + full
        while m.seq < end:
            before = 0 if self.width else m.seq // self.size
            upto = min(end, m.seq + self.size * max(self.together, before)) if self.rolled else end
            taken = rows.filter(F.col("seq").between(m.seq + 1, upto))
            if self.rolled:
                self._advance(m, taken)
            else:
                self._advance_edges(m, taken)
            m.seq = upto
        m.pending = f"{self.folder}/pending/{micro_batch}" if many > full else ""
        if m.pending:
            rows.filter(F.col("seq") > end).select("u", "v", "t", "eid").write.mode("overwrite").parquet(m.pending)
        write_text(self.spark, f"{self.folder}/manifest/{micro_batch}", json.dumps(asdict(m)))
        return m

    def _advance(self, m: Manifest, rows: DataFrame) -> None:
        version = m.seq // self.size + 1  # the first batch that it takes
        path = f"{self.folder}/delta/{version}"
        before = self.edges(m)
        batch = F.floor((F.col("seq") - 1) / F.lit(self.size)).cast("long")
        first = rows.filter("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min(F.struct("seq", "t")).alias("f"))
        first = first.select("a", "b", "f.seq", "f.t")
        gone = None
        if self.width:
            latest = rows.agg(F.max("t")).first()[0]
            gone = before.filter(F.col("t") < latest - self.width)
            present = before.filter(F.col("t") >= latest - self.width)
        else:
            present = before
        fresh = first.join(present.select(F.col("n").alias("a"), F.col("m").alias("b")), ["a", "b"], "left_anti")
        fresh = numbered(fresh, ["seq"], "n0", m.edges + 1).select("a", "b", "n0", "t", batch.alias("batch"))
        came = fresh.select(F.col("a").alias("n"), F.col("b").alias("m"), "n0", "t", "batch").union(fresh.select(F.col("b").alias("n"), F.col("a").alias("m"), "n0", "t", "batch"))
        log = came.withColumn("gone", F.lit(False))
        if gone is not None:
            log = log.union(gone.select("*", F.lit(version - 1).cast("long").alias("batch"), F.lit(True).alias("gone")))
        log.write.mode("overwrite").parquet(f"{path}/edges")
        written = self._read(f"{path}/edges", EDGE)
        old = self.nodes(m)
        steps = self._steps(fresh, old, present, written.filter("not gone"))
        if gone is not None and not (lost := written.filter("gone")).isEmpty():
            steps = steps.union(self._pruned(lost, before, old, version - 1))
        self._fold(steps, old).write.mode("overwrite").parquet(f"{path}/moves")
        m.edges += fresh.count()
        m.versions = [*m.versions, version]
        if len([v for v in m.versions if v > m.base]) >= self.fold_every:
            self._fold_base(m, version)

    def _advance_edges(self, m: Manifest, rows: DataFrame) -> None:
        """The edges that come and go in any number of batches: stays of their occurrences, after those of the edges that are there."""
        version = m.seq // self.size + 1
        path = f"{self.folder}/delta/{version}"
        batch = F.floor((F.col("seq") - 1) / F.lit(self.size)).cast("long")
        there = self.edges(m).filter("n < m").select(F.col("n").alias("a"), F.col("m").alias("b"), (-F.col("n0")).alias("seq"), "t", F.lit(version - 2).cast("long").alias("batch"))
        seen = rows.filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "seq", "t", batch.alias("batch"))
        limit = rows.groupBy(batch.alias("batch")).agg((F.max("t") - F.lit(self.width)).alias("t"))
        if not self.width:
            limit = limit.withColumn("t", F.lit(None).cast("long"))
        found = cut(stays(there.union(seen), limit))
        fresh = numbered(found.filter("seq > 0"), ["seq"], "n0", m.edges + 1).select("a", "b", "n0", F.col("t_in").alias("t"), F.col("batch_in").alias("batch"), "batch_out")
        held = found.filter("seq < 0").select("a", "b", (-F.col("seq")).alias("n0"), F.col("t_in").alias("t"), F.col("batch_in").alias("batch"), "batch_out")
        went = fresh.union(held).filter("batch_out is not null").select("a", "b", "n0", "t", F.col("batch_out").alias("batch"), F.lit(True).alias("gone"))
        log = fresh.select("a", "b", "n0", "t", "batch", F.lit(False).alias("gone")).union(went)
        ends = F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m")), F.struct(F.col("b").alias("n"), F.col("a").alias("m"))))
        log.select(ends.alias("e"), "n0", "t", "batch", "gone").select("e.*", "n0", "t", "batch", "gone").write.mode("overwrite").parquet(f"{path}/edges")
        m.edges += found.filter("seq > 0").count()
        discard(found)
        m.versions = [*m.versions, version]
        if len([v for v in m.versions if v > m.base]) >= self.fold_every:
            self._fold_base(m, version)

    def _closed(self, asked: DataFrame, near: DataFrame, old: DataFrame) -> DataFrame:
        """(a, b, n0, w, x0, y0): common neighbours of asked edges (a, b, n0) in ``near`` and the numbers of both sides.

        The end with the smaller degree is expanded: in ``near`` where many batches come at once, or before the batch.
        """
        degree = old if self.width else near.groupBy(F.col("n").alias("node")).agg(F.count("*").alias("degree"))
        for side in ("a", "b"):
            asked = asked.join(degree.select(F.col("node").alias(side), F.col("degree").alias(f"d{side}")), side, "left")
        turn = F.coalesce("da", F.lit(0)) > F.coalesce("db", F.lit(0))
        asked = asked.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), "n0", *[c for c in asked.columns if c == "batch"])
        one = asked.join(near.select(F.col("n").alias("a"), F.col("m").alias("w"), F.col("n0").alias("x0")), "a")
        return one.join(near.select(F.col("n").alias("b"), F.col("m").alias("w"), F.col("n0").alias("y0")), ["b", "w"])

    def _steps(self, fresh: DataFrame, old: DataFrame, present: DataFrame, came: DataFrame) -> DataFrame:
        """(node, batch, phase, n0, dd, dt): what each new edge adds; a triangle closes with the last of its edges."""
        near = present.select("n", "m", "n0").union(came.select("n", "m", "n0"))
        closed = self._closed(fresh.select("a", "b", "n0", "batch"), near, old).filter("x0 < n0 and y0 < n0")
        ends = fresh.select(F.explode(F.array("a", "b")).alias("node"), "batch", "n0", F.lit(1).alias("dd"), F.lit(0).alias("dt"))
        hits = closed.select(F.explode(F.array("a", "b", "w")).alias("node"), "batch", "n0", F.lit(0).alias("dd"), F.lit(1).alias("dt"))
        moved = ends.union(hits).groupBy("node", "batch", "n0").agg(F.sum("dd").alias("dd"), F.sum("dt").alias("dt"))
        return moved.select("node", "batch", F.lit(1).alias("phase"), "n0", "dd", "dt")

    def _pruned(self, lost: DataFrame, before: DataFrame, old: DataFrame, batch: int) -> DataFrame:
        """As ``_steps`` for a prune: a step of every known node, most of them by 0; a triangle opens with the first of its lost edges."""
        mark = lost.select("n", "m", F.col("n0").alias("g0"))
        near = before.join(mark, ["n", "m"], "left").select("n", "m", F.coalesce("g0", F.lit((1 << 62))).alias("n0"))
        edges = lost.filter("n < m").select(F.col("n").alias("a"), F.col("m").alias("b"), "n0")
        opened = self._closed(edges, near, old).filter("x0 > n0 and y0 > n0")
        ends = edges.select(F.explode(F.array("a", "b")).alias("node"), F.lit(-1).alias("dd"), F.lit(0).alias("dt"))
        hits = opened.select(F.explode(F.array("a", "b", "w")).alias("node"), F.lit(0).alias("dd"), F.lit(-1).alias("dt"))
        every = old.select("node", F.lit(0).alias("dd"), F.lit(0).alias("dt"))
        moved = ends.union(hits).union(every).groupBy("node").agg(F.sum("dd").alias("dd"), F.sum("dt").alias("dt"))
        return moved.select("node", F.lit(batch).cast("long").alias("batch"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("n0"), "dd", "dt")

    def _fold(self, steps: DataFrame, old: DataFrame) -> DataFrame:
        """Moves of the steps: values run on from the node's last move, and so do its statistics."""
        order = W.partitionBy("node").orderBy("batch", "phase", "n0")
        state = old.select("node", F.col("degree").alias("d_"), F.col("triangles").alias("t_"), *[F.col(c).alias(f"{c}_old") for c in HELD])
        out = steps.join(state, "node", "left")
        for name, step, last in (("degree", "dd", "d_"), ("triangles", "dt", "t_")):
            out = out.withColumn(name, (F.coalesce(last, F.lit(0)) + F.sum(step).over(order)).cast("long"))
        k = F.col("degree")
        out = out.withColumn("clustering", F.when(k < 2, F.lit(0.0)).otherwise(2.0 * F.col("triangles") / (k * (k - 1))))
        out = out.withColumn("value", F.col(self.rolled).cast("double"))
        keep = ["node", "batch", "phase", "n0", "degree", "triangles", "clustering"]
        out = out.select(*keep, "value", *[f"{c}_old" for c in HELD]).repartition("node").sortWithinPartitions("node", "batch", "phase", "n0")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            step = Fold(DECAY, 0.99)
            for pdf in parts:
                if len(pdf):
                    starts = pdf[[f"{c}_old" for c in HELD]].to_numpy(float)
                    stats, after = step.fold(pdf["node"].tolist(), pdf["value"].tolist(), starts)
                    both = [pd.DataFrame(rows, columns=list(names), dtype=float) for rows, names in ((stats, STATS), (after, HELD))]
                    yield pd.concat([pdf[keep].reset_index(drop=True), *both], axis=1)

        return out.mapInPandas(run, MOVE)

    def _fold_base(self, m: Manifest, version: int) -> None:
        """Fold the deltas into a new base; moves stay where they are, as the record of ticks."""
        self.edges(m).select("*", F.lit(None).cast("long").alias("batch"), F.lit(False).alias("gone")).write.mode("overwrite").parquet(f"{self.folder}/base/{version}/edges")
        if self.rolled:
            self.nodes(m).write.mode("overwrite").parquet(f"{self.folder}/base/{version}/moves")
        m.base = version
