"""Draws on dense graphs, cadence by interval, word-block sets, layouts and models after graph iterations."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import blocks as B
from edgeloom.operators import cadence as C
from edgeloom.operators import graph as G
from edgeloom.operators import history as H
from edgeloom.operators import indicators as I
from edgeloom.operators import negatives as N
from edgeloom.operators import predictor
from edgeloom.sources import files as L
from edgeloom.sources import layouts as Y
from edgeloom.sources.order import numbered

from .test_operators import edges, peel


def test_order_over_ties_and_partitions(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(500)], "a int, b long").repartition(7)
    got = {(r.a, r.b): r.seq for r in numbered(rows, ["a", F.desc("b")]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(got, key=lambda k: (k[0], -k[1])), 1)}
    assert numbered(rows.limit(0), ["a"]).count() == 0


def test_pairs_of_a_nearly_complete_graph(spark):
    """All but three of 12 * 10 pairs are taken; every row gets one of the three."""
    free = {(2, 104), (2, 109), (7, 100)}
    taken = spark.createDataFrame([(u, v) for u in range(12) for v in range(100, 110) if (u, v) not in free], "u long, v long")
    sides = [N.pool(spark.createDataFrame([(x,) for x in r], "value long")) for r in (range(12), range(100, 110))]
    rows = spark.range(1, 201).withColumnRenamed("id", "seq")
    got = N.free_pairs(rows, *sides, F.col("seq"), taken).collect()
    assert len(got) == 200 and {(r.neg_u, r.neg_v) for r in got} == free
    full = taken.union(spark.createDataFrame(sorted(free), "u long, v long"))
    none = N.free_pairs(rows, *sides, F.col("seq"), full).collect()
    assert len(none) == 200 and {(r.neg_u, r.neg_v) for r in none} == {(None, None)}


def test_past_pairs_never_lose_a_row(spark):
    """Batches that have nearly all that they know, and ones that know nothing."""
    draw = random.Random(2)
    pairs = [(draw.randrange(3), 10 + draw.randrange(4)) for _ in range(120)]
    e = edges(spark, pairs)
    for observed in (0, 60):
        got = {r.seq: r for r in N.past_pairs(e, e, 20, observed).collect()}
        assert len(got) == 120
        first = {}
        for i, p in enumerate(pairs, 1):
            first.setdefault(p, i)
        for seq, r in got.items():
            batch = (seq - 1) // 20
            own = set(pairs[batch * 20 : batch * 20 + 20])
            pool = {p for p, i in first.items() if observed < i <= batch * 20} - own
            assert (r.kind == "historical") == bool(pool)
            every = {(u, v) for u in {p[0] for p in pairs} for v in {p[1] for p in pairs}} - own
            assert (r.neg_u, r.neg_v) in (pool or every or {(None, None)})


def truss_of(pairs):
    near, number, k = {}, {}, 3
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    left = set(pairs)
    while left:
        gone = [e for e in left if len(near[e[0]] & near[e[1]]) < k - 2]
        for a, b in gone:
            number[a, b] = k - 1
            near[a].discard(b)
            near[b].discard(a)
            left.discard((a, b))
        if not gone:
            k += 1
    return number


@pytest.mark.parametrize("every", [1, 7])
def test_core_and_truss_traces_by_peeling_each_snapshot(spark, every):
    draw = random.Random(11)
    pairs = list(dict.fromkeys(tuple(sorted(draw.sample(range(16), 2))) for _ in range(90)))[:60]
    first = G.first_edges(edges(spark, pairs), 10)
    for trace, find in ((C.core_trace, peel), (C.truss_trace, lambda seen: _node_truss(truss_of(seen)))):
        points = {}
        for r in trace(first, every).collect():
            points.setdefault(r.node, {})[r.s] = r[3]
        for s in range(1, len(pairs) // every + 1):
            want = find(pairs[: s * every])
            got = {n: p[max(x for x in p if x <= s)] for n, p in points.items() if min(p) <= s}
            assert {n: v for n, v in got.items() if v} == want, s


def _node_truss(number):
    out = {}
    for (a, b), k in number.items():
        out[a], out[b] = max(out.get(a, 2), k), max(out.get(b, 2), k)
    return out


def test_cadence_of_an_empty_graph(spark):
    assert C.trace_as_of(edges(spark, []), C.core_trace, "core").count() == 0
    assert {r.core for r in C.trace_as_of(edges(spark, [(0, 1), (1, 2)]), C.core_trace, "core").collect()} == {0}


def test_sets_of_words_are_those_of_plain_sets(spark):
    draw = random.Random(12)
    ids = [draw.randrange(-300, 2_000_000_000) if i % 3 else draw.randrange(200) for i in range(60)]
    pairs = [tuple(draw.sample(ids, 2)) for _ in range(300)] + [(ids[0], x) for x in ids[1:]]
    ab = G.pairs(edges(spark, pairs))
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    asked = [tuple(draw.sample(ids, 2)) for _ in range(80)]
    want = set()
    for u, v in set(asked):
        two = set().union(*(near[x] for x in near.get(u, ()))) - {u}
        want |= {(u, v, w, w in near.get(u, ()), w in two) for w in near.get(v, set()) - {u}}
    queries = spark.createDataFrame(asked, "u long, v long")
    assert {tuple(r) for r in G.neighborhoods(queries, ab).collect()} == want
    shared = {(r.u, r.v, r.w) for r in G.common_neighbors(queries, ab).collect()}
    assert shared == {(u, v, w) for u, v, w, direct, _ in want if direct}
    weight = {n: draw.randrange(1000) for n in near}
    planes = B.Planes(spark.createDataFrame(sorted(weight.items()), "node long, value long"))
    total = planes.join(B.pair_words(queries, ab)).groupBy("u", "v").agg(F.sum(planes.total(F.col("near").bitwiseAND(F.col("two")))).alias("s"))
    sums = Counter()
    for u, v, w, _, two in want:
        sums[u, v] += weight[w] * two
    assert {(r.u, r.v): r.s for r in total.collect()} == {k: sums[k] for k in {(u, v) for u, v, *_ in want}}


def test_time_aware_draws_follow_the_weights(spark):
    """Chi-square of 4,000 draws against exp(p), and no trouble with times that are far apart."""
    import math

    times = [0, 10, 30, 31, 45, 60]
    e = spark.createDataFrame([(i + 1, 0, i + 1, t) for i, t in enumerate(times)] + [(7, 0, 9, 70)], "seq long, u long, v long, t long")
    p, near = [], 0.0
    for i, t in enumerate(times):
        near = 1 + near * math.exp(0.05 * (times[i - 1] - t)) if i else 1.0
        p.append(math.exp(1 / near))
    # Many draws of one row: an equal spread of places stands for them.
    k = 4000
    drawn = Counter(r.nbr for r in H.time_aware_draws(e, k, 0.05, stride=0, step=104_729, grain=1_000_003).filter("seq = 7").collect())
    chi = sum((drawn[i + 1] - k * w / sum(p)) ** 2 / (k * w / sum(p)) for i, w in enumerate(p))
    assert drawn.total() == k and chi < 20.5  # 0.999 of five degrees
    far = spark.createDataFrame([(i + 1, 0, i + 1, i * 10**15) for i in range(5)], "seq long, u long, v long, t long")
    assert H.time_aware_draws(far, 3, 1.0).filter("nbr is null").count() == 0


def test_layouts_of_raw_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,src,dst,callsign,typecode\n2020-01-02,B,A,LONGNAME9,\n86400,A,C,x1,B738\n,A,C,x,y\n")
    rows = L.load(spark, "flight", str(tmp_path / "a.csv")).orderBy("seq").collect()
    assert [(r.u, r.v, r.t) for r in rows] == [(0, 1, 1577923200.0), (1, 2, 86400.0)]
    assert rows[0].msg == [-1.0] * 16 and rows[1].msg[:3] == [53.0, 1.0, -1.0]
    (tmp_path / "b.csv").write_text("ts,u,k,v,s\n1,x,p,2.5,1\n2,y,p,1,0\n3,x,q,1,1\n")
    rows = Y.read_layout(spark, str(tmp_path / "b.csv"), "token", offset=2).orderBy("seq").collect()
    assert [(r.u, r.v, r.w, r.msg) for r in rows] == [(2, 0, 2.5, [2.5, 1.0]), (3, 0, 1.0, [1.0, 0.0]), (2, 1, 1.0, [1.0, 1.0])]
    with pytest.raises(Exception, match="more than 1 destinations"):
        Y.read_layout(spark, str(tmp_path / "b.csv"), "token", offset=1).collect()


def test_a_model_fits_and_scores_after_graph_iterations(spark):
    """Iterations leave nothing in the session that a model would carry into its tasks."""
    draw = random.Random(4)
    events = [(draw.randrange(12), 100 + draw.randrange(15)) for _ in range(200)]
    e = edges(spark, events)
    assert G.k_core(G.pairs(e)).count() > 0 and G.k_truss(G.pairs(e)).count() > 0
    scored = predictor.link_scores(e).collect()
    assert scored and all(0 <= r.score <= 1 for r in scored)


@pytest.mark.parametrize("fusion", predictor.FUSIONS)
def test_a_perceptron_beats_a_line_on_a_planted_graph(spark, fusion):
    """Ends of equal kind, high or low in what their events weigh, are linked: no weighted sum of both ends tells that."""
    from pyspark.ml.classification import LogisticRegression

    from edgeloom.operators import metrics as M

    draw = random.Random(8)
    rows = []
    for t in range(1, 3001):
        kind, other = draw.random() < 0.5, draw.random() < 0.05
        u, v = 2 * draw.randrange(20) + kind, 1000 + 2 * draw.randrange(20) + (kind != other)
        rows.append((t, u, v, t, 3.0 * kind + draw.random()))
    e = spark.createDataFrame(rows, "seq long, u long, v long, t long, w double")
    mrr = lambda scored: M.mrr_hits(scored.select("qid", "is_pos", "score")).first().mrr
    bent = mrr(predictor.perceptron_scores(e, fusion, negatives=8, features=("pa",)))
    straight = mrr(predictor.perceptron_scores(e, fusion, negatives=8, features=("pa",), model=LogisticRegression(regParam=1e-4)))
    print(fusion, bent, straight)
    assert bent > straight + 0.05, (bent, straight)


def test_an_indicator_of_ones_own(spark):
    """Snapshot and trace of a new indicator reach tables, statistics and features without edits."""
    twice = I.Indicator("twice", lambda ab: G.degree(ab).select("node", (F.col("degree") * 2.0).alias("value")), lambda first: G.degree_trace(first).select("node", F.col("n0").alias("n"), (F.col("degree") * 2.0).alias("value")))
    first = G.first_edges(edges(spark, [(0, 1), (1, 2), (2, 0), (0, 3)]))
    both = {(r.indicator, r.node, r.n): r.value for r in I.traces(first, ["degree", twice]).collect()}
    assert all(both["twice", node, n] == 2 * x for (name, node, n), x in both.items() if name == "degree")
    asked = spark.createDataFrame([(0, 4), (0, 5), (9, 5)], "node long, n long")
    got = {(r.node, r.n): (r.twice_current, r.twice_delta) for r in I.features_as_of(asked, first, [twice]).collect()}
    assert got == {(0, 4): (4.0, 2.0), (0, 5): (6.0, 2.0), (9, 5): (0.0, 0.0)}
    with pytest.raises(ValueError, match="no trace"):
        I.traces(first, [I.Indicator("bare", G.degree)])


def test_common_neighbours_of_hubs(spark):
    """A pair with a hub is looked up by the words of its other end: equal to sets, also for equal ends, loops, strangers
    and neighbours that are each other's."""
    rng = random.Random(3)
    edges = {(0, i) for i in range(2, 4000)} | {(1, i) for i in range(3000, 5000)} | {tuple(sorted(rng.sample(range(2, 5000), 2))) for _ in range(4000)} | {(0, 1)}
    ab = spark.createDataFrame(sorted(edges), "a long, b long")
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = [(0, 1), (1, 0), (7, 7), (0, 0), (0, 9999), (9999, 1)] + [(rng.randrange(5000), rng.choice([0, 1, 5, 3500])) for _ in range(300)]
    want = {(u, v, w) for u, v in asked for w in near.get(u, set()) & near.get(v, set())}
    queries = spark.createDataFrame(asked, "u long, v long")
    assert {(r.u, r.v, r.w) for r in G.common_neighbors(queries, ab).collect()} == want and len(want) > 1000
    hub = spark.createDataFrame([(i, 0) for i in range(3900, 3999)], "u long, v long")
    words = B.shared_words(hub, ab)
    assert words.count() <= sum(len({w // 64 for w in near[i] & near[0]}) for i in range(3900, 3999))
