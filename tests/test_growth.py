"""Steps whose rows or rounds must not multiply with the input."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from edgeloom.operators import cadence as C
from edgeloom.operators import graph as G
from edgeloom.operators import history as H
from edgeloom.operators import indicators as I
from edgeloom.operators import negatives as N
from edgeloom.operators import truss as T
from edgeloom.operators.kept import KeptGraph
from edgeloom.session import shared_folder

from .test_dense_and_incremental import truss_of
from .test_operators import edges


def test_cadence_copies_no_edge_into_snapshots(spark, monkeypatch):
    draw = random.Random(3)
    pairs = list(dict.fromkeys(tuple(sorted(draw.sample(range(14), 2))) for _ in range(300)))
    written = []
    monkeypatch.setattr(C, "cut", lambda df: written.append(G.cut(df)) or written[-1])
    monkeypatch.setattr(C, "discard", lambda df: None)
    C.core_trace(G.first_edges(edges(spark, pairs), 10), 1).count()
    assert max(df.count() for df in written) <= 2 * len(pairs)


def test_kth_least_over_batches_and_bounded_rows(monkeypatch):
    monkeypatch.setattr(C, "HELD_ROWS", 5)
    draw = np.random.default_rng(4)
    rows = [(key, int(draw.integers(1, 9)), 3, sorted(draw.integers(1, 9, draw.integers(0, 4)).tolist())) for key in (1, 2, 3) for _ in range(7 * key)]
    parts = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + 4]], pa.int64()), *(pa.array([r[c] for r in rows[i : i + 4]], pa.int32()) for c in (1, 2)), pa.array([r[3] for r in rows[i : i + 4]], pa.list_(pa.int32()))], ["n", "since", "most", "f"]) for i in range(0, len(rows), 4)]
    got = {k: v for b in C._kth_least(1, 7)(iter(parts)) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    for key in (1, 2, 3):
        latest = [sorted(max(s, f[k]) for n, s, _, f in rows if n == key and len(f) > k) for k in range(3)]
        want = [latest[k][k] for k in range(3) if len(latest[k]) > k and latest[k][k] <= 7]
        assert got[key] == want


def test_next_value_looks_down_from_the_latest_row(spark):
    """A frame that ends with its partition is added up anew for each row."""
    rows = spark.createDataFrame([(t, t if t % 7 == 0 else None) for t in range(50)], "t long, p long")
    found = G.next_value(rows.union(rows.filter("p is null")), "t", "p")
    assert {(r.t, r.p) for r in found.collect()} == {(t, min((x for x in range(t + (t % 7 > 0), 50) if x % 7 == 0), default=None)) for t in range(50)}
    assert "UNBOUNDED FOLLOWING" not in found._jdf.queryExecution().toString().upper().replace("UNBOUNDEDFOLLOWING$()", "UNBOUNDED FOLLOWING")


def test_kept_edges_advance_all_batches_at_once(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(6), draw.randrange(6), 10 * i + draw.randrange(9), i) for i in range(157)]
    told = []
    for rolled in ("degree", None):
        kept = KeptGraph(spark, shared_folder(spark, "kept"), size=20, width=300, rolled=rolled, fold_every=2)
        m = None
        for number, part in enumerate((rows[:70], rows[70:130], rows[130:]), 1):
            m = kept.take(spark.createDataFrame(part, "u long, v long, t long, eid long"), number, last=number == 3)
        told.append((sorted(map(str, kept.stays(m).collect())), sorted(map(str, kept.edges(m).collect()))))
    assert len(m.versions) == 3 and told[0] == told[1]


def test_what_closes_few_wedges_goes_to_them(spark, monkeypatch):
    draw = random.Random(6)
    pairs = [(draw.randrange(8), draw.randrange(40)) for _ in range(150)]
    first = G.first_edges(edges(spark, pairs), 10)
    found = G.triangles(first.select("a", "b", "n0"), "n0")
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    plain = G.triangles(first.select("a", "b", "n0"), "n0")
    assert "strategy=broadcast" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(found.collect()) == sorted(plain.collect()) != []


def test_affected_nodes_build_no_ticks(spark):
    draw = random.Random(7)
    first = G.first_edges(edges(spark, [(draw.randrange(12), draw.randrange(12)) for _ in range(90)]), 10)
    batch = {r.n0: r.batch0 for r in first.collect()}
    found = I.affected(first)
    assert {(r.batch, r.node) for r in found.collect()} == {(batch[r.n0], r.node) for r in I.ticks(first).collect()}
    assert "n0" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_draws_from_a_taken_pool_end_in_few_rounds(spark, monkeypatch):
    """One free place of 400, the last that the row comes to: 9 rounds, not 200."""
    places = [(5 * 7919 + j * 104729) % 400 for j in range(400)]
    asked = spark.createDataFrame([(1, 5, 1)], "seq long, salt long, need int")
    taken = spark.createDataFrame([(1, places[j]) for j in range(399)], "seq long, neg long")
    rounds = []
    monkeypatch.setattr(N, "cut", lambda df: rounds.append(1) or G.cut(df))
    found = N.draw_free(asked, N.pool(spark.range(400).withColumnRenamed("id", "value")), [(taken, ["seq"])], ["seq"])
    assert [tuple(r) for r in found.collect()] == [(1, 399, places[399])]
    assert len(rounds) <= 1 + 2 * 9


def test_recent_pool_makes_no_row_for_each_place(spark):
    e = edges(spark, [(i % 3, 10 + i % 4) for i in range(30)])
    x = spark.createDataFrame([(n, float(n)) for n in (0, 1, 2, 10, 12, 13)], "node long, x double")
    found = H.recent_pool(e, x, 4)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    value, near, want = {r.node: r.x for r in x.collect()}, {}, {}
    for i in range(30):
        ends = (i % 3, 10 + i % 4)
        for n in ends:
            last = near.get(n, [])[-4:]
            want[n, i + 1] = round(sum(value.get(m, 0) for m in last) / max(len(last), 1) / 4 + value.get(n, 0), 9)
        for n, m in (ends, ends[::-1]):
            near.setdefault(n, []).append(m)
    assert {(r.node, r.seq): round(r.pooled, 9) for r in found.collect()} == want


def test_truss_rounds_are_those_between_parts(spark, monkeypatch):
    """Values of a strip fall from its ends inwards, one hop a round; a part takes all of these by itself."""
    written = []
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(1) or cut(df))
    strip = G.pairs(edges(spark, [(i, i + 1) for i in range(60)] + [(i, i + 2) for i in range(59)]))
    assert {r.truss for r in G.k_truss(strip).collect()} == {3}
    assert len(written) < 15


def test_truss_over_several_parts(spark, monkeypatch):
    draw = random.Random(8)
    pairs = {tuple(sorted(draw.sample(range(26), 2))) for _ in range(150)} | {(i, i + 1) for i in range(30, 40)}
    ab, want = G.cut(G.pairs(edges(spark, sorted(pairs)))), truss_of(sorted(pairs))
    monkeypatch.setattr(T, "PART_TRIANGLES", 20)
    assert T.Parts(ab).count > 3 and T.Parts(ab).shared.count() > 20
    for rows in (0, G.FRONTIER_ROWS):
        assert {(r.a, r.b): r.truss for r in G.k_truss(ab, frontier_rows=rows).collect()} == want


def test_truss_cadence_writes_no_wings(spark, monkeypatch):
    """A table of wings has three rows for each triangle; a clique of 18 nodes has 816 of them and 153 edges."""
    pairs = [(i, j) for i in range(18) for j in range(i)]
    random.Random(2).shuffle(pairs)
    written, cut = [], G.cut
    for module in (G, C):
        monkeypatch.setattr(module, "cut", lambda df: written.append(cut(df)) or written[-1])
    for module in (G, C, T):
        monkeypatch.setattr(module, "discard", lambda df: None)
    assert C.truss_trace(G.first_edges(edges(spark, pairs), 10), 1).agg({"truss": "max"}).first()[0] == 18
    assert max(df.count() for df in written) <= 2 * len(pairs)


def test_truss_cadence_over_several_parts(spark, monkeypatch):
    draw = random.Random(12)
    pairs = list(dict.fromkeys(tuple(sorted(draw.sample(range(18), 2))) for _ in range(140)))
    first = G.cut(G.first_edges(edges(spark, pairs), 10))
    last = len(pairs) // 5
    since = first.selectExpr("a", "b", "ceil(n0 / 5) since")
    monkeypatch.setattr(T, "CADENCE_TRIANGLES", 12)
    assert T.Parts(since, 12).count > 3 and T.Parts(since, 12).shared.count() > 20
    reached = {}
    for r in T.first_snapshots(since, last).collect():
        assert reached.setdefault((r.a, r.b, r.k), r.s) == r.s
    order = [(r.a, r.b) for r in first.orderBy("n0").collect()]
    for s in range(1, last + 1):
        got = {(a, b): max((k for k in range(1, 18) if reached.get((a, b, k), last + 1) <= s), default=0) + 2 for a, b in order[: 5 * s]}
        assert got == truss_of(order[: 5 * s]), s


def test_landing_has_more_tasks_for_more_interactions(spark, monkeypatch):
    """A task holds sums of all its interactions' nodes; with as many tasks as ever (4 here) these grow with the stream."""
    draw = random.Random(4)
    e = edges(spark, [(draw.randrange(9), 9 + draw.randrange(9)) for _ in range(300)])
    want = sorted(map(str, H.landing(e, 3, 2).collect()))
    monkeypatch.setattr(H, "TASK_ROWS", 10, raising=False)
    found = H.landing(e, 3, 2)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 15
    assert H.trees(e, 3, 2).filter("hop = 2").select(F.spark_partition_id().alias("p")).distinct().count() > 15
    assert sorted(map(str, found.collect())) == want
