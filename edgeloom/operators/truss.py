"""Truss numbers by parts of the graph that hold whole triangles.

Edges point from the lower to the higher (degree, id), and a triangle lies in the part of its lowest node.  An edge is an inner one
where all its triangles lie in one part; these are iterated to their fixpoint within the part, without a shuffle.  For the
others, each part counts how far its triangles support them, and the counts are added up between the parts.  Values only
fall from the number of an edge's triangles, so any order of steps ends at the same, largest fixpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard
from . import blocks as B
from . import graph as G

PART_TRIANGLES = 2_000_000  #: so many triangles (three numbers of 32 bits each) are a part, and all of one lowest node
CADENCE_TRIANGLES = 8_000_000  #: the same where values are told at snapshots; there a part's values k are dealt out to several tasks


class Parts:
    """Triangles dealt out by their lowest nodes.

    ``corners`` (part, a, b, blk, both): words of the third corners of triangles, at the arc between the two lower ones; ``shared``
    (part, a, b): the parts of each arc that has triangles in several; ``triangles``: how many there are.
    """

    def __init__(self, ab: DataFrame, size: int | None = None):
        arcs = G.cut(G.arcs(ab))
        own = G.cut(B.words(arcs.select(F.col("s").alias("n"), F.col("e").alias("m"))))
        met = G.cut(B.met_words(arcs.select(F.col("s").alias("u"), F.col("e").alias("v")), own))
        discard(arcs)
        discard(own)
        self.triangles = met.agg(F.sum(F.bit_count("both"))).first()[0] or 0
        self.count = max(1, -(-self.triangles // (size or PART_TRIANGLES)))
        self.corners = met.select(self._part("u"), F.col("u").alias("a"), F.col("v").alias("b"), "blk", "both")
        last = B.members(self.corners.groupBy("part", "b", "blk").agg(F.bit_or("both").alias("both")), F.col("both"))
        last = G.cut(last.select("part", F.col("b").alias("a"), F.col("w").alias("b")))
        there = last.union(last.select(self._part("a"), "a", "b")).distinct()
        several = there.groupBy("a", "b").agg(F.count("*").alias("c")).filter("c > 1").select("a", "b")
        self.shared = G.cut(there.join(several, ["a", "b"]).select("part", "a", "b"))
        discard(last)

    def _part(self, node: str):
        return F.pmod(F.xxhash64(F.col(node).cast("long")), F.lit(self.count)).alias("part")

    def held(self) -> DataFrame:
        """A row for each part: its edges (a, b), the ``outer`` first ones of which have triangles elsewhere, too; its triangles as
        places of their edges (x, y, z); how many of these each edge has (own)."""
        none = self.shared.select("part", "a", "b", F.lit(0).cast("long").alias("blk"), F.lit(0).cast("long").alias("both"))
        rows = self.corners.select("part", F.col("a").cast("long"), F.col("b").cast("long"), F.col("blk").cast("long"), "both").union(none)
        rows = rows.repartition(self.count, "part").sortWithinPartitions("part")
        return rows.mapInArrow(_held, "part long, outer int, a array<long>, b array<long>, x array<int>, y array<int>, z array<int>, own array<int>")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, (a, b, blk, both) in _runs(batches):
        some = both != 0
        ra, rb = a[~some], b[~some]
        a, b, blk, both = a[some], b[some], blk[some], both[some]
        if not len(a):
            continue
        at, place = np.nonzero(np.unpackbits(both.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        last = blk[at] * 64 + place
        nodes = np.unique(np.concatenate([a, b, last]))
        s, p, q = np.searchsorted(nodes, a)[at], np.searchsorted(nodes, b)[at], np.searchsorted(nodes, last)
        codes, places = np.unique(np.concatenate([s * len(nodes) + p, s * len(nodes) + q, p * len(nodes) + q]), return_inverse=True)
        known = np.isin(ra, nodes) & np.isin(rb, nodes)
        outer = np.isin(codes, np.searchsorted(nodes, ra[known]) * len(nodes) + np.searchsorted(nodes, rb[known]))
        order = np.argsort(~outer, kind="stable")
        moved = np.empty(len(order), np.int32)
        moved[order] = np.arange(len(order), dtype=np.int32)
        codes, places = codes[order], moved[places]
        lists = [nodes[codes // len(nodes)], nodes[codes % len(nodes)], *np.split(places, 3), np.bincount(places).astype(np.int32)]
        yield _row([part, int(outer.sum())], lists, ["part", "outer", "a", "b", "x", "y", "z", "own"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns of each run of rows with the same first column."""
    key, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if rows and columns[0][i] != key:
                yield key, [np.concatenate(c) for c in zip(*rows)]
                rows = []
            key = int(columns[0][i])
            rows.append([c[i:j].copy() for c in columns[1:]])
    if rows:
        yield key, [np.concatenate(c) for c in zip(*rows)]


def _row(values: list[int], lists: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
    first = [pa.array([values[0]], pa.int64()), *[pa.array([v], pa.int32()) for v in values[1:]]]
    return pa.RecordBatch.from_arrays([*first, *map(one, lists)], names)


def h_index(of: np.ndarray, low: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each item i the largest h up to ``most[i]`` such that h of its rows (``of`` is i) have a ``low`` of at least h."""
    starts = np.concatenate([[0], np.cumsum(most.astype(np.int64) + 1)])
    counts = np.bincount(starts[of] + np.minimum(low, most[of]), minlength=starts[-1])
    upto = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    sizes = np.diff(starts)
    h = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
    return np.maximum.reduceat(np.where(upto[:-1] - np.repeat(upto[starts[1:]], sizes) >= h, h, 0), starts[:-1])


def settle(value: np.ndarray, outer: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
    """Lower the values of the edges from ``outer`` on to their largest fixpoint, the others' given."""
    ask = np.ones(len(value), bool)
    while True:
        ask[:outer] = False
        of, low = [], []
        for e, one, two in ((x, y, z), (y, x, z), (z, x, y)):
            rows = np.flatnonzero(ask[e])
            of.append(e[rows])
            low.append(np.minimum(value[one[rows]], value[two[rows]]))
        of, low = np.concatenate(of), np.concatenate(low)
        short = ask & (np.bincount(of[low >= value[of]], minlength=len(value)) < value)
        if not short.any():
            return
        rows, items = short[of], np.flatnonzero(short)
        value[items] = h_index(np.searchsorted(items, of[rows]), low[rows], value[items])
        near = short[x] | short[y] | short[z]
        ask = np.zeros(len(value), bool)
        for e in (x, y, z):
            ask[e[near]] = True


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (``held``, inner, told): inner edges at their fixpoint under the values that were told of outer ones, and how many
    triangles support these how far."""
    for batch in batches:
        for i in range(batch.num_rows):
            a, b, x, y, z, own = (batch.column(c)[i].values.to_numpy() for c in ("a", "b", "x", "y", "z", "own"))
            part, n, value = batch.column("part")[i].as_py(), batch.column("outer")[i].as_py(), own.astype(np.int32)
            if batch.column("inner")[i].is_valid:
                value[n:] = batch.column("inner")[i].values.to_numpy()
            if n:
                told = batch.column("told")[i].values
                ta, tb, ts = (told.field(c).to_numpy() for c in ("a", "b", "s"))
                have = {k: j for j, k in enumerate(zip(a[:n].tolist(), b[:n].tolist()))}
                for k, s in zip(zip(ta.tolist(), tb.tolist()), ts.tolist()):
                    if k in have:
                        value[have[k]] = s
            settle(value, n, x, y, z)
            of, low = [], []
            for e, one, two in ((x, y, z), (y, x, z), (z, x, y)):
                rows = np.flatnonzero(e < n)
                of.append(e[rows])
                low.append(np.minimum(np.minimum(value[one[rows]], value[two[rows]]), value[e[rows]]))
            pairs, c = np.unique(np.concatenate(of).astype(np.int64) << 32 | np.concatenate(low), return_counts=True)
            at = pairs >> 32
            yield _row([part], [value[n:], a[at], b[at], (pairs & 0xFFFFFFFF).astype(np.int32), c.astype(np.int64)], ["part", "inner", "a", "b", "low", "c"])


def supports(ab: DataFrame, frontier_rows: int) -> DataFrame:
    """(a, b, s) with a < b: see ``arc_supports``."""
    parts = Parts(ab)
    return _edges(arc_supports(parts, G.cut(parts.held()), frontier_rows), "s")


def _edges(arcs: DataFrame, *more: str) -> DataFrame:
    return arcs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *more)


def arc_supports(parts: Parts, held: DataFrame, frontier_rows: int) -> DataFrame:
    """(a, b, s): for each arc with triangles the largest h such that h of them have other edges of at least h each.

    From ``frontier_rows`` triangles on a round asks only parts with an edge whose value fell in the round before.
    """
    first = held.select(F.explode(F.slice(F.arrays_zip("a", "b", "own"), F.lit(1), F.col("outer"))).alias("e")).select("e.*")
    now = G.cut(first.groupBy("a", "b").agg(F.sum("own").alias("s"), F.lit(True).alias("changed")))
    told = None
    while True:
        asked = parts.shared.join(now.filter("changed").select("a", "b"), ["a", "b"]).select("part").distinct()
        some = told is not None and parts.triangles >= frontier_rows
        values = parts.shared.join(now, ["a", "b"]).groupBy("part").agg(F.collect_list(F.struct("a", "b", F.col("s").cast("int").alias("s"))).alias("told"))
        ask = (held.join(asked, "part", "left_semi") if some else held).join(values, "part", "left")
        ask = ask.join(told.select("part", "inner"), "part", "left") if told is not None else ask.withColumn("inner", F.lit(None).cast("array<int>"))
        new = ask.mapInArrow(_settled, "part long, inner array<int>, a array<long>, b array<long>, low array<int>, c array<long>")
        new = G.cut(new.union(told.join(asked, "part", "left_anti")) if some else new)
        if told is not None:
            discard(told)
        told = new
        level = told.select(F.explode(F.arrays_zip("a", "b", "low", "c")).alias("e")).select("e.*").groupBy("a", "b", "low").agg(F.sum("c").alias("c"))
        upto = F.sum("c").over(W.partitionBy("a", "b").orderBy(F.desc("low")))
        now = G._lowered(now, level.withColumn("least", F.least("low", upto)).groupBy("a", "b").agg(F.max("least").alias("h")), ["a", "b"], "s")
        if now.filter("changed").isEmpty():
            break
    ends = F.slice(F.arrays_zip("a", "b"), F.col("outer") + 1, F.size("a"))
    inner = held.select("part", ends.alias("ends")).join(told.select("part", "inner"), "part").select(F.explode(F.arrays_zip("ends", "inner")).alias("e"))
    return inner.select("e.ends.a", "e.ends.b", F.col("e.inner").cast("long").alias("s")).union(now.select("a", "b", "s"))


# -- at snapshots -----------------------------------------------------------------------


def first_snapshots(edges: DataFrame, last: int) -> DataFrame:
    """(a, b, k, s): for each edge the first snapshot, up to ``last``, at which k of its triangles have other edges that reach k, too.

    ``edges`` (a, b, since) name the first snapshot that has the edge.  Each k is found by itself.  Within a part, snapshots are taken
    away from the last one down, and what no longer has k triangles goes with them: each triangle goes once.  Edges with triangles in
    several parts begin with their own snapshots; their k-th least triangle over all parts tells the parts when they are there,
    which only rises, until nothing does.
    """
    edges = G.cut(edges.filter(F.col("since") <= last).select("a", "b", F.col("since").cast("int").alias("since")))
    parts = Parts(edges, CADENCE_TRIANGLES)
    held = G.cut(parts.held())
    arcs = arc_supports(parts, held, G.FRONTIER_ROWS).withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    arcs = G.cut(arcs.join(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "since"), ["x", "y"]).select("a", "b", "since", F.col("s").cast("int").alias("most")))
    places = held.select("part", F.posexplode(F.arrays_zip("a", "b")).alias("at", "e")).select("part", "at", "e.*")
    told_of = places.join(arcs, ["a", "b"]).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "since", "most"))).alias("e"))
    whole = held.drop("own").join(told_of.select("part", F.col("e.since").alias("since"), F.col("e.most").alias("most")), "part")
    whole = G.cut(whole)
    discard(held)
    levels = F.explode(F.sequence(F.lit(1), "most")).alias("k")
    now = G.cut(parts.shared.select("a", "b").distinct().join(arcs, ["a", "b"]).select("a", "b", levels, F.col("since").alias("s"), F.lit(True).alias("changed")))
    asked = whole.select("part", F.explode(F.sequence(F.lit(1), F.array_max("most"))).alias("k"))
    groups = max(1, -(-edges.sparkSession.sparkContext.defaultParallelism // parts.count))
    schema = "part long, k int, ia array<long>, ib array<long>, f array<int>, a array<long>, b array<long>, s array<int>, c array<long>"
    told = None
    while True:
        values = parts.shared.join(now, ["a", "b"]).groupBy("part", "k").agg(F.collect_list(F.struct("a", "b", "s")).alias("told"))
        asks = asked.join(values, ["part", "k"], "left").groupBy("part", (F.col("k") % groups).alias("g")).agg(F.collect_list(F.struct("k", "told")).alias("asks"))
        new = whole.join(asks, "part").repartition(8 * groups * parts.count, "part", "g").drop("g").mapInArrow(_peeled(last), schema)
        if told is not None:
            kept = told.join(asked, ["part", "k"], "left_anti").select(*new.columns)
            new = new.union(kept)
        step = G.cut(new)
        if told is not None:
            discard(told)
        told = step
        level = told.select("k", F.explode(F.arrays_zip("a", "b", "s", "c")).alias("e")).select("k", "e.*").groupBy("a", "b", "k", "s").agg(F.sum("c").alias("c"))
        upto = F.sum("c").over(W.partitionBy("a", "b", "k").orderBy("s"))
        kth = level.withColumn("upto", upto).filter(F.col("upto") >= F.col("k")).groupBy("a", "b", "k").agg(F.min("s").alias("kth"))
        later = F.coalesce("kth", F.lit(last + 1)).cast("int")
        step = G.cut(now.drop("changed").join(kth, ["a", "b", "k"], "left").select("a", "b", "k", later.alias("s"), (later != F.col("s")).alias("changed")))
        discard(now)
        now = step
        asked = G.cut(parts.shared.join(now.filter("changed"), ["a", "b"]).select("part", "k").distinct())
        if asked.isEmpty():
            break
    inner = told.select("k", F.explode(F.arrays_zip("ia", "ib", "f")).alias("e")).select(F.col("e.ia").alias("a"), F.col("e.ib").alias("b"), "k", F.col("e.f").alias("s"))
    return _edges(inner.union(now.filter(F.col("s") <= last).select("a", "b", "k", "s")), "k", "s")


def peel(k: int, last: int, key: np.ndarray, alive: np.ndarray, outer: int, tri: np.ndarray, starts: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The first snapshot at which each edge has k triangles of edges that have, too, or ``last`` + 1.

    ``key`` is the snapshot at which an edge comes; of the first ``outer`` ones that is all that counts.  ``alive`` are those that may ever have
    k.  Triangles ``tri`` are three rows of edges; those of edge e are ``by[starts[e] : starts[e + 1]]``.
    """
    found = np.full(len(key), last + 1, np.int32)
    live = alive[tri[0]] & alive[tri[1]] & alive[tri[2]]
    count = sum(np.bincount(e[live], minlength=len(key)) for e in tri)
    order = np.flatnonzero(alive)
    order = order[np.argsort(-key[order], kind="stable")]
    cuts = [0, *(np.flatnonzero(np.diff(key[order])) + 1).tolist(), len(order)]
    going = [(last + 1, np.flatnonzero(alive & (count < k) & (np.arange(len(key)) >= outer)))]
    going += [(int(key[order[i]]), order[i:j]) for i, j in zip(cuts, cuts[1:]) if i < j]
    for s, dead in going:
        dead = dead[alive[dead]]
        while len(dead):
            alive[dead] = False
            found[dead] = s
            sizes = starts[dead + 1] - starts[dead]
            ends = np.cumsum(sizes)
            gone = by[np.repeat(starts[dead] - ends + sizes, sizes) + np.arange(ends[-1])]
            gone = np.unique(gone[live[gone]])
            live[gone] = False
            hit = tri[:, gone].ravel()
            np.subtract.at(count, hit, 1)
            dead = np.unique(hit[(hit >= outer) & alive[hit] & (count[hit] < k)])
    return found


def _peeled(last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, x, y, z, since, most = (batch.column(c)[i].values.to_numpy() for c in ("a", "b", "x", "y", "z", "since", "most"))
                part, n, tri = batch.column("part")[i].as_py(), batch.column("outer")[i].as_py(), np.stack([x, y, z])
                ends = tri.ravel()
                by = (np.argsort(ends, kind="stable") % len(x)).astype(np.int32)
                starts = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=len(a)))])
                outer = {e: j for j, e in enumerate(zip(a[:n].tolist(), b[:n].tolist()))}
                asks = batch.column("asks")[i].values
                for j in range(len(asks)):
                    k, told, key, alive = asks.field("k")[j].as_py(), asks.field("told")[j], since.copy(), most >= asks.field("k")[j].as_py()
                    if told.is_valid:
                        for e in told.as_py():
                            if (e["a"], e["b"]) in outer:
                                key[outer[e["a"], e["b"]]] = e["s"]
                    some = np.flatnonzero(alive[x] & alive[y] & alive[z])
                    found = peel(k, last, key, alive & (key <= last), n, tri, starts, by)
                    found[:n] = key[:n]
                    at, least, c = _least(k, last, found, n, tri[:, some])
                    there = n + np.flatnonzero(found[n:] <= last)
                    yield _row([part, k], [a[there], b[there], found[there], a[at], b[at], least, c], ["part", "k", "ia", "ib", "f", "a", "b", "s", "c"])

    return run


def _least(k: int, last: int, found: np.ndarray, outer: int, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edge, snapshot, count) of the k triangles of each of the first ``outer`` edges that are there first, none before the edge itself."""
    of, when = [], []
    for i in range(3):
        rows = np.flatnonzero(tri[i] < outer)
        of.append(tri[i][rows])
        when.append(np.maximum(np.maximum(found[tri[i - 1][rows]], found[tri[i - 2][rows]]), found[of[-1]]))
    of, when = np.concatenate(of), np.concatenate(when)
    pairs, c = np.unique(of[when <= last].astype(np.int64) << 32 | when[when <= last], return_counts=True)
    at, before = pairs >> 32, np.cumsum(c) - c
    if len(at):
        first = np.concatenate([[True], at[1:] != at[:-1]])
        before -= np.maximum.accumulate(np.where(first, before, 0))
    keep = before < k
    return at[keep], (pairs[keep] & 0xFFFFFFFF).astype(np.int32), c[keep].astype(np.int64)
