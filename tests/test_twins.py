"""Pair features found once for all twins, and from a neighbourhood's sums where the pair is an edge."""

import math
import random

import pytest

from edgeloom.operators import blocks as B
from edgeloom.operators import graph as G
from edgeloom.operators import pairwise as P


def _graph(rng):
    """Groups of nodes with the same neighbours, hubs, and plain edges."""
    edges = set()
    for g in range(6):
        near = rng.sample(range(40), rng.randrange(1, 8))
        edges |= {tuple(sorted((1000 + 100 * g + i, x))) for i in range(rng.randrange(1, 9)) for x in near}
    edges |= {tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}
    return sorted(edges)


def _near(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def _parts(near, u, v):
    two = set().union(*(near[x] for x in near.get(u, ()))) - {u}
    about = near.get(v, set()) - {u}
    cn = about & near.get(u, set())
    return cn, (about & two) - cn, about & two


@pytest.mark.parametrize("seed", [1, 2])
def test_features_of_twins_edges_and_strangers(spark, seed):
    rng = random.Random(seed)
    edges = _graph(rng)
    near = _near(edges)
    nodes = sorted(near)
    asked = [rng.choice(edges) for _ in range(60)] + [rng.choice(edges)[::-1] for _ in range(60)] + [(rng.choice(nodes), rng.choice(nodes)) for _ in range(120)]
    asked += [(nodes[0], nodes[0]), (9999, nodes[0]), (nodes[0], 9999), (9999, 9999)]
    x = {n: rng.randrange(1, 50) for n in nodes[::2]}
    st = {n: tuple(round(rng.uniform(-3, 3), 6) for _ in range(4)) for n in nodes[1::2]}
    ab = spark.createDataFrame(edges, "a long, b long")
    queries = spark.createDataFrame(asked, "u long, v long")
    values = spark.createDataFrame(sorted(x.items()), "node long, x long")
    stats = spark.createDataFrame([(n, *s) for n, s in st.items()], "node long, ema double, delta double, std double, max_change double")
    truss = spark.createDataFrame([(n, n % 7) for n in nodes], "node long, truss long")
    got = {(r.u, r.v): r.asDict() for r in P.pair_features(queries, ab, values, truss=truss, stats=stats).collect()}
    assert set(got) == set(asked)
    for (u, v), r in got.items():
        cn, c2, br = _parts(near, u, v)
        aa = lambda s: sum(1 / math.log(len(near[w])) for w in s if len(near[w]) > 1)
        total = lambda s, i: sum(st.get(w, (0,) * 4)[i] for w in s)
        want = {"cn": math.log1p(len(cn)), "cn2": math.log1p(len(c2)), "aa": aa(cn), "aa2": aa(c2), "ra": sum(1 / len(near[w]) for w in cn)}
        want |= {"cn_x_sum": math.log1p(sum(x.get(w, 0) for w in cn)), "cn_x_max": max((x.get(w, 0) for w in cn), default=0), "cn2_x_sum": math.log1p(sum(x.get(w, 0) for w in c2))}
        want |= {"cn_truss_sum": math.log1p(sum(w % 7 for w in cn)), "bridge": len(br), "bridge_x": sum(x.get(w, 0) for w in br)}
        want |= {f"cn_x_{n}_sum": total(cn, i) for i, n in enumerate(("ema", "delta", "std", "mxch"))} | {f"cn2_x_{n}_sum": total(c2, i) for i, n in enumerate(("ema", "delta"))}
        want |= {"cn_x_dneg": math.log1p(sum(st[w][1] < 0 for w in cn if w in st)), "cn2_x_dpos": math.log1p(sum(st[w][1] > 0 for w in c2 if w in st))}
        assert {k: r[k] for k in want} == pytest.approx(want, abs=1e-9), (u, v)
    counts = {(r.u, r.v): (r.cn, r.bridge, r.bridge_value) for r in B.pair_counts(queries, ab, values.withColumnRenamed("x", "value")).collect()}
    assert counts == {(u, v): (len(p[0]), len(p[2]), sum(x.get(w, 0) for w in p[2])) for u, v in set(asked) for p in [_parts(near, u, v)]}


def test_pairs_whose_words_are_joined_do_not_grow_with_copies(spark, monkeypatch):
    """With more users of the same items, edges join no words of a second end, and twins join them once."""
    rng = random.Random(5)
    items = {u: rng.sample(range(20), 6) for u in range(30)}
    joined = []
    plain = B.pair_words
    monkeypatch.setattr(B, "pair_words", lambda queries, *rest: joined.append(queries.select("u", "v").distinct().count()) or plain(queries, *rest))
    for copies in (1, 8):
        edges = [(x, 1000 + 100 * c + u) for c in range(copies) for u in items for x in items[u]]
        ab = spark.createDataFrame(edges, "a long, b long")
        asked = [(b, a) for a, b in edges] + [(1000 + 100 * c + u, (items[u][0] + 1) % 20) for c in range(copies) for u in items]
        queries = spark.createDataFrame(asked, "u long, v long")
        assert P.pair_features(queries, ab, G.degree(ab).withColumnRenamed("degree", "x")).count() == len(set(asked))
    assert joined[0] == joined[1] <= 30
