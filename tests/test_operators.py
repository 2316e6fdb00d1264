"""Small graphs and sequences with known results."""

import math
import random

import pytest

from edgeloom.operators import graph as G
from edgeloom.operators import rolling as R
from edgeloom.operators import splits as S

TRIANGLE = [(0, 1), (1, 2), (2, 0), (0, 3)]


def edges(spark, pairs):
    rows = [(i + 1, u, v, 10 * i) for i, (u, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, "seq long, u long, v long, t long")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_triangle_with_pendant(spark):
    ab = G.pairs(edges(spark, TRIANGLE))
    assert as_dict(G.degree(ab)) == {0: 3, 1: 2, 2: 2, 3: 1}
    assert {k: v for k, v in as_dict(G.triangle_count(ab)).items() if v} == {0: 1, 1: 1, 2: 1}
    cc = as_dict(G.clustering(ab))
    assert cc[1] == pytest.approx(1.0) and cc[0] == pytest.approx(1 / 3)


def test_self_loops_and_repeats_leave_the_graph_alone(spark):
    ab = G.pairs(edges(spark, [*TRIANGLE, (1, 0), (2, 2)]))
    assert ab.count() == 4


def test_empty_graph(spark):
    ab = G.pairs(edges(spark, []))
    assert G.degree(ab).count() == 0 and G.k_core(ab).count() == 0 and G.k_truss(ab).count() == 0


def test_star_and_clique(spark):
    star = as_dict(G.k_core(G.pairs(edges(spark, [(0, i) for i in range(1, 6)]))))
    assert set(star.values()) == {1}
    clique = G.pairs(edges(spark, [(i, j) for i in range(5) for j in range(i)]))
    assert set(as_dict(G.k_core(clique)).values()) == {4}
    assert set(as_dict(G.node_truss(clique)).values()) == {5}


def peel(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        n = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[n]))
        core[n] = k
        for m in near.pop(n):
            near[m].discard(n)
    return core


def test_core_of_a_random_graph(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(250)}
    assert as_dict(G.k_core(G.pairs(edges(spark, sorted(pairs))))) == peel(pairs)


def test_core_and_truss_end_only_at_the_fixpoint(spark, monkeypatch):
    """Values fall from the ends of a path or strip inwards, one hop a round; a limit of rounds, here lowered to 5, would leave the middle."""
    for f in (G.k_core, G.k_truss):
        monkeypatch.setattr(f, "__defaults__", (5,))
    path = [(i, i + 1) for i in range(40)]
    assert set(as_dict(G.k_core(G.pairs(edges(spark, path)))).values()) == {1}
    strip = G.pairs(edges(spark, path + [(i, i + 2) for i in range(39)]))
    assert {r.truss for r in G.k_truss(strip).collect()} == {3}


def test_rolling_fold(spark):
    trace = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 4.0), (2, 1, 7.0)], "node long, n long, value double")
    got = {(r.node, r.n): r for r in R.rolling(trace, decay=0.5).collect()}
    assert (got[1, 2].ema, got[1, 2].std, got[1, 2].delta, got[1, 2].max_change) == (3.0, 1.0, 2.0, 2.0)
    assert (got[1, 3].delta, got[1, 3].max_change) == (0.0, 1.0)
    assert got[1, 3].recency == pytest.approx(math.log1p(1))
    assert (got[2, 1].ema, got[2, 1].std, got[2, 1].trend) == (7.0, 0.0, 0.0)


def test_as_of_is_strict(spark):
    history = spark.createDataFrame([(1, 5, 50), (1, 9, 90)], "k long, at long, x long")
    asked = spark.createDataFrame([(1, 5), (1, 6), (1, 10), (2, 7)], "k long, t long")
    got = {(r.k, r.t): r.x for r in R.as_of(asked, history, ["k"], "t", "at", ["x"]).collect()}
    assert got == {(1, 5): None, (1, 6): 50, (1, 10): 90, (2, 7): None}
    same = {(r.k, r.t): r.x for r in R.as_of(asked, history, ["k"], "t", "at", ["x"], strict=False).collect()}
    assert same[1, 5] == 50


def test_positional_split_covers_all(spark):
    e = edges(spark, [(i, i + 1) for i in range(20)])
    counts = {r[0]: r[1] for r in S.positional_split(e).groupBy("split").count().collect()}
    assert counts == {"train": 14, "val": 3, "test": 3}


def test_rounds_that_ask_only_what_changed_give_the_same_values(spark):
    draw = random.Random(5)
    pairs = {tuple(sorted(draw.sample(range(24), 2))) for _ in range(90)} | {(i, i + 1) for i in range(30, 40)}
    ab = G.pairs(edges(spark, sorted(pairs)))
    assert as_dict(G.k_core(ab, frontier_rows=0)) == peel(pairs)
    assert {tuple(r) for r in G.k_truss(ab, frontier_rows=0).collect()} == {tuple(r) for r in G.k_truss(ab).collect()}
