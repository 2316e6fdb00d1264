"""Readers, sinks, samplers, registries and streams on small tables with known results."""

import math

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import register
from edgeloom.operators import cadence as C
from edgeloom.operators import decoder as D
from edgeloom.operators import graph as G
from edgeloom.operators import history as H
from edgeloom.operators import indicators as I
from edgeloom.operators import negatives as N
from edgeloom.operators import pairwise as P
from edgeloom.operators import rolling as R
from edgeloom.operators import splits as S
from edgeloom.operators import stats as T
from edgeloom.sources import files as L
from edgeloom.streaming import jobs as J

EDGES = "seq long, u long, v long, t long"


def edges(spark, pairs):
    return spark.createDataFrame([(i + 1, u, v, 10 * i) for i, (u, v) in enumerate(pairs)], EDGES)


def test_interactions_from_csv(spark, tmp_path):
    file = tmp_path / "wiki.csv"
    file.write_text("user,item,ts,label,features\n0,0,5.0,0,0.1,0.2\n1,1,3.0,1,0.3,0.4\nbroken,row\n\n0,1,5.0,0\n")
    rows = L.load(spark, "bipartite", str(file)).orderBy("seq").collect()
    assert [(r.seq, r.u, r.v, r.t, r.label, r.msg) for r in rows] == [(1, 1, 3, 3.0, 1.0, [0.3, 0.4]), (2, 0, 2, 5.0, 0.0, [0.1, 0.2]), (3, 0, 3, 5.0, 0.0, [])]
    with pytest.raises(Exception, match="malformed row"):
        L.read_interactions(spark, str(file), malformed="fail").collect()
    with pytest.raises(ValueError):
        L.load(spark, "other", str(file))
    cache = f"file://{tmp_path}/cache"
    assert L.load(spark, "interactions", str(file), cache).count() == 3 == L.load(spark, "interactions", "/nowhere", cache).count()
    raw = L.read_interactions(spark, str(file))
    assert L.check_ascending(raw, "seq", "t") == 0 and L.check_ascending(raw.withColumn("t", -F.col("t")), "seq", "t") == 1
    L.check_contiguous(raw, ["u"])
    with pytest.raises(ValueError):
        L.check_contiguous(raw.withColumn("u", F.col("u") * 2), ["u"])
    names = L.encode_names(spark.createDataFrame([(1, "b", "a"), (2, "c", "b")], "p long, s string, d string"), "p", ["s", "d"])
    assert {(r.p, r.s, r.d) for r in names.collect()} == {(1, 0, 1), (2, 2, 0)}


def test_label_tables(spark):
    rows = spark.createDataFrame([(1, 0, 7, 3, 0.5), (2, 0, 7, 3, 0.25), (3, 0, 7, 4, 1.0), (4, 1, 7, 3, 2.0)], "pos long, t long, u long, v long, w double")
    assert {(r.t, r.u): r.labels for r in L.label_vectors(rows).collect()} == {(0, 7): {3: 0.25, 4: 1.0}, (1, 7): {3: 2.0}}
    ids = spark.createDataFrame([("x", 0), ("y", 1)], "raw string, id long")
    named = spark.createDataFrame([(1, 0, "x", "y", 0.5), (2, 0, "x", "z", 0.5)], "pos long, t long, u string, v string, w double")
    assert [(r.t, r.u, r.labels) for r in L.coded_label_vectors(named, ids, ids).collect()] == [(0, 0, {1: 0.5})]
    # day, node, label: the row that changes the day is recorded nowhere, one that changes the node goes to the run before.
    stream = [(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (1, 2, "d"), (2, 2, "e"), (2, 2, "f"), (3, 5, "g")]
    rows = spark.createDataFrame([(i + 1, t, n, x, float(i)) for i, (t, n, x) in enumerate(stream)], "seq long, t long, node long, label string, w double")
    want = [(1, 1, {"a": 0.0, "b": 1.0, "c": 2.0}), (1, 2, {"d": 3.0}), (2, 2, {"f": 5.0})]
    assert [(r.t, r.node, r.labels) for r in L.run_length_labels(rows).orderBy("run").collect()] == want


def test_names_and_node_tables(spark):
    text = spark.createDataFrame([("1,China, mainland,3",), ("a,b,c,d,e",)], "x string")
    assert text.limit(1).select(L.clean_names(F.col("x"))).first()[0] == "1,China mainland,3"
    with pytest.raises(Exception, match="too many fields"):
        text.select(L.clean_names(F.col("x"))).collect()
    nodes = spark.createDataFrame([(1, 10, "big", "EU", "GB-1", 2.0, 50.0), (2, 11, "small", "EU", "x", -3.0, 1.0)], "p long, node long, kind string, continent string, region string, lon double, lat double")
    found = {r.node: r.features for r in L.node_features(nodes, "p").collect()}
    assert found[10][:3] == [1.0, 0.0, 1.0] and found[11][:3] == [0.0, 1.0, 1.0] and found[10][-2:] == [2.0, 50.0] and len(found[10]) == 13
    genres = spark.createDataFrame([(1, "rock"), (2, "pop"), (3, "rock")], "p long, g string")
    assert {r.raw: r.id for r in L.genre_ids(genres.filter("p < 3"), "p", "g").collect()} == {"rock": 0, "pop": 1}
    with pytest.raises(ValueError, match="rock"):
        L.genre_ids(genres, "p", "g")
    scored = L.word_scores(spark.createDataFrame([(500, 3)], "num_words long, score long")).first()
    assert scored.msg == [0.1, 0.1] and scored.w == 3.0


def test_sinks(spark, tmp_path):
    e = S.positional_split(edges(spark, [(i % 3, i % 4) for i in range(20)]))
    short = L.prefix(e, 15).collect()
    assert len(short) == 15 and {r.split for r in short} == {"train", "val"} and min(r.u for r in short) == 1
    x = spark.createDataFrame([(1, [0.5, 0.5])], "id long, x array<double>")
    L.write_processed(e, x, x, f"file://{tmp_path}/p", 2)
    back = spark.read.parquet(f"file://{tmp_path}/p/edge_features")
    assert {r.id: r.x for r in back.collect()} == {0: [0.0, 0.0], 1: [0.5, 0.5]}
    assert L.differences(spark.read.parquet(f"file://{tmp_path}/p/edges"), e) == 0 and L.differences(e, e.union(e.limit(1))) == 1
    for i in range(2):
        L.append_record(spark, {"run": i, "mrr": 0.5}, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 2
    L.write_summary(e.groupBy("split").count(), f"file://{tmp_path}/sum")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/sum").count() == 3
    L.save_negatives(spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "seq long, neg long"), f"file://{tmp_path}/neg")
    sets = spark.read.parquet(f"file://{tmp_path}/neg")
    asked = spark.createDataFrame([(1,), (2,)], "seq long")
    assert sorted((r.seq, r.neg) for r in N.look_up(asked, sets, ["seq"]).collect()) == [(1, 5), (1, 6), (2, 7)]
    with pytest.raises(Exception, match="no negatives for"):
        N.look_up(asked.union(spark.createDataFrame([(9,)], "seq long")), sets, ["seq"]).collect()


def test_draws_without_replacement(spark):
    pool = N.pool(spark.createDataFrame([(i,) for i in range(12)], "value long"))
    asked = spark.createDataFrame([(s, s, 10) for s in range(1, 6)], "seq long, salt long, need int")
    taken = spark.createDataFrame([(1, i) for i in range(6)], "seq long, neg long")
    got = {}
    for r in N.draw_free(asked, pool, [(taken, ["seq"])], ["seq"]).collect():
        got.setdefault(r.seq, []).append(r.neg)
    assert sorted(got[1]) == list(range(6, 12)) and all(len(got[s]) == 10 == len(set(got[s])) for s in range(2, 6))
    assert N.draw_free(asked, pool.limit(0), [], ["seq"]).count() == 0
    e = edges(spark, [(0, 1), (0, 2), (0, 1), (0, 3), (0, 1), (0, 2)])
    rows = {r.seq: r for r in N.past_pairs(e, e.filter("seq > 4"), 2).collect()}
    assert (rows[5].neg_u, rows[5].neg_v, rows[5].kind) == (0, 3, "historical") == (rows[6].neg_u, rows[6].neg_v, rows[6].kind)


def test_modes_groups_and_registry(spark):
    assert [len(P.columns_of(m)) for m in ("none", "generic", "cohesion", "all")] == [0, 7, 23, 30]
    assert R.stat_columns(["static"]) == ["current"] and len(R.stat_columns(["dynamic"])) == len(R.STATS) - 1 and R.stat_columns(["std", "ema"]) == ["ema", "std"]
    for bad in (lambda: P.columns_of("x"), lambda: R.stat_columns(["x"]), lambda: I.build(["x"])):
        with pytest.raises(ValueError):
            bad()
    assert I.for_size(20_000_000) == ["degree", "core"] and "truss" in I.for_size(10) and "truss" not in I.for_size(2_000_000)
    mine = I.Indicator("one", lambda ab: G.degree(ab).select("node", F.lit(1.0).alias("value")))
    clique = G.pairs(edges(spark, [(i, j) for i in range(4) for j in range(i)]))
    got = I.snapshot(clique, [*I.REGISTRY, mine]).collect()
    assert {tuple(r)[1:] for r in got} == {(3.0, 3.0, 3.0, 1.0, 4.0, 1.0)} and len(got) == 4
    ticks = {(r.node, r.n0): (r.degree, r.triangles) for r in I.ticks(G.first_edges(edges(spark, [(0, 1), (1, 2), (2, 0)]))).collect()}
    assert ticks == {(0, 1): (1, 0), (1, 1): (1, 0), (1, 2): (2, 0), (2, 2): (1, 0), (0, 3): (2, 1), (1, 3): (2, 1), (2, 3): (2, 1)}
    assert R.state_bytes(spark.createDataFrame([(1,), (1,), (2,)], "node long")) == 2 * 7 * 4
    gone = G.remove_edges(clique, spark.createDataFrame([(0, 1), (8, 9)], "u long, v long")).filter("removed").collect()
    assert [(r.a, r.b) for r in gone] == [(0, 1)]
    two = spark.createDataFrame([(1,), (2,)], "u long")
    assert G.possible_edges(two, two.withColumnRenamed("u", "v")).count() == 4
    with pytest.raises(ValueError):
        G.possible_edges(two, two.withColumnRenamed("u", "v"), most=3)
    day = 10
    ticked = {(r.batch, r.node) for r in I.pruned_ticks(edges(spark, [(0, 1), (2, 3), (4, 5), (4, 6)]), day, 1).collect()}
    assert ticked == {(2, n) for n in range(4)} | {(3, n) for n in range(6)}  # those of the batch itself come after the prune


def test_core_snapshots_by_peeling(spark):
    import random

    from .test_operators import peel

    rng = random.Random(6)
    pairs = [tuple(rng.sample(range(25), 2)) for _ in range(160)]
    e = edges(spark, pairs)
    seen, new = [], {}
    for i, (u, v) in enumerate(pairs):
        if tuple(sorted((u, v))) not in seen:
            seen.append(tuple(sorted((u, v))))
            if len(seen) % 16 == 0:
                new[i // 10] = peel(seen)
    got = C.trace_as_of(e, C.core_trace, "core", every=16, size=10).collect()
    for r in got:
        before = [b for b in new if b < (r.seq - 1) // 10]
        assert r.core == (new[max(before)].get(r.node, 0) if before else 0)
    assert len(got) > 50 and max(r.core for r in got) >= 3


def test_split_rows_and_figures(spark):
    e = S.positional_split(edges(spark, [(i % 7, 10 + i % 11) for i in range(60)] + [(50, 60)]))
    roles = {r.role: r.n for r in S.inductive_rows(e).groupBy("role").agg(F.count("*").alias("n")).collect()}
    assert sum(roles.values()) == 61 and roles["new"] >= 1
    sizes = {r.part: r.n for r in S.inductive_split(e).collect()}
    assert sizes["train"] == roles["kept"] and sum(n for p, n in sizes.items() if p.startswith("new_")) == roles["new"]
    halves = S.halves(spark.range(100).withColumnRenamed("id", "node")).groupBy("half").count().collect()
    assert len(halves) == 2 and sum(r["count"] for r in halves) == 100
    T.expect(e, edges=61, max_v=60, min_u=0)
    with pytest.raises(ValueError):
        T.expect(e, edges=60)
    assert [tuple(r) for r in T.table_shapes({"e": e}).collect()] == [("e", 61, 20)]
    results = spark.createDataFrame([("core_current", 0.6), ("core_ema", 0.7), ("core_std", 0.9)], "feature string, disc_auc double")
    assert {(r.indicator, r.kind): (round(r["mean"], 6), r.best) for r in T.study(results).collect()} == {("core", "static"): (0.6, 0.6), ("core", "dynamic"): (0.8, 0.9)}


def test_decoder(spark):
    ab = G.pairs(edges(spark, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (1, 4)]))
    asked = spark.createDataFrame([(0, 1), (0, 3)], "u long, v long")
    kinds = lambda mode: {(r.u, r.v, r.w, r.kind) for r in D.near_pairs(asked, ab, mode).collect()}
    assert kinds(1) == {(0, 1, 2, "11"), (0, 3, 2, "11")}
    assert kinds(0) == kinds(1) | {(0, 1, 0, "01"), (0, 1, 1, "10")}
    assert {k for k in kinds(2) if k[:2] == (0, 3)} >= {(0, 3, 2, "11"), (0, 3, 1, "12"), (0, 3, 4, "21")}
    vec = spark.createDataFrame([(2, [1.0, 2.0]), (0, [1.0]), (1, [0.5, 0.5])], "w long, x array<double>")
    sums = {(r.u, r.v): r.sums for r in D.vector_sums(D.near_pairs(asked, ab, 0), vec, "w", "x", ["u", "v"]).collect()}
    assert sums == {(0, 1): [2.5, 2.5], (0, 3): [1.0, 2.0]}
    a, b = D.unpack(D.pack(F.lit(7), F.lit(4_000_000_000)))
    assert tuple(spark.range(1).select(a, b).first()) == (7, 4_000_000_000)
    entries = spark.createDataFrame([(0, c) for c in range(50)] + [(1, 9)], "row long, col long")
    drawn = D.sample_rows(entries, 8)
    assert {r.row: round(r.s, 9) for r in drawn.groupBy("row").agg(F.sum("weight").alias("s")).collect()} == {0: 50.0, 1: 1.0}
    assert D.sample_rows(entries, 8, keep_short=True).filter("row = 1").first().weight == 1.0
    left = D.drop_edges(entries, 0.5).collect()
    assert 10 < len(left) < 40 and {r.weight for r in left} == {2.0}


def test_history_pools_and_walks(spark):
    e = edges(spark, [(0, 1), (0, 2), (0, 3), (1, 2)])
    walks = {(r.root, r.seq, tuple(x.nbr for x in r.walk)) for r in H.multi_hop(e, 2, 2).collect()}
    assert {w for w in walks if w[:2] == (0, 3)} == {(0, 3, (1,)), (0, 3, (2,)), (0, 3, (2, 1))} - {(0, 3, (2, 1))} | set()
    assert (2, 4, (0,)) in walks and (2, 4, (0, 1)) in walks
    x = spark.createDataFrame([(i, float(i)) for i in range(4)], "node long, x double")
    pooled = {(r.node, r.seq): r.pooled for r in H.recent_pool(e, x, 2).collect()}
    assert pooled[0, 3] == pytest.approx((1 + 2) / 2 / 2) and pooled[1, 1] == 1.0
    masked = spark.range(1).select(H.mask_padding(F.array(F.lit(5.0), F.lit(6.0)), F.array(F.lit(0), F.lit(3)))).first()[0]
    assert masked == [0.0, 6.0]
    held = H.last_edges(e, 1).collect()
    assert {(r.node, r.nbr) for r in held} == {(0, 3), (1, 2), (2, 1), (3, 0)} and {r.local for r in held} == {0, 1, 2, 3}
    assert H.biased_sample(e, spark.createDataFrame([(0,)], "node long"), 100).count() == 3


def test_sql_functions(spark):
    assert "sigmoid" in register(spark)
    got = spark.sql("select sigmoid(0), log2_weight(0), feature_clip(-10, 10), parse_epoch('1970-01-02'), parse_epoch('77'), pack_pair(1, 2)").first()
    assert tuple(got) == (0.5, 0.0, pytest.approx(-10 * math.log(2)), 86400, 77, (1 << 32) + 2)


def _write_events(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, day int, value double").select("event_id", "user_id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval("day")).alias("ts"), F.lit("{\"k\": 1}").alias("props"), "value").coalesce(1).write.mode("append").parquet(path)


def test_streams_go_on_after_a_restart_and_drop_late_rows(spark, tmp_path):
    sf, folder = f"file://{tmp_path}", f"file://{tmp_path}/job"
    path = f"{sf}/events.parquet"
    jobs = {"rolling": (J.rolling_state, ["node"]), "counts": (lambda s: J.windowed_counts(s, late="2 days"), ["start", "u"]), "window": (lambda s: J.edge_window(s, "3 days", "1 day"), ["u", "k"])}
    run = lambda name: {tuple(r)[: len(jobs[name][1])]: r for r in J.drain(jobs[name][0](J.read_events(spark, sf)), jobs[name][1], f"{folder}/{name}").collect()}
    _write_events(spark, path, [(1, 7, 0, 2.0), (2, 8, 1, 5.0), (3, 7, 10, 4.0)])
    first = {name: run(name) for name in jobs}
    assert first["rolling"][7,].n == 2 and sum(r.n for r in first["counts"].values()) == 3
    _write_events(spark, path, [(4, 7, 11, 4.0), (5, 8, 1, 9.0)])  # the second is ten days late
    second = {name: run(name) for name in jobs}
    assert second["rolling"][7,].n == 3 and second["rolling"][7,].ema == pytest.approx(0.95 * (0.95 * 2 + 0.05 * 4) + 0.05 * 4)
    assert sum(r.n for r in second["counts"].values()) == 4
    assert second["window"][7, 1].state == "in" and second["window"][7, 1].n == 2 and second["window"][8, 1].state == "out"


def test_state_is_read_back_as_of_each_micro_batch(spark, tmp_path):
    sf, folder = f"file://{tmp_path}", f"file://{tmp_path}/job"
    path = f"{sf}/events.parquet"
    arrivals = [[(1, 7, 0, 2.0), (2, 8, 1, 5.0)], [(3, 7, 2, 4.0), (4, 9, 3, 1.0)]]
    for rows in arrivals:
        _write_events(spark, path, rows)
        J.drain(J.edge_memory(J.read_events(spark, sf)), ["u", "k"], folder)
    counts = lambda version: {r.u: r.n for r in J.read_state(spark, folder, version).select("key.u", F.col("value.count").alias("n")).collect()}
    assert counts(0) == {7: 1, 8: 1}
    assert counts(1) == counts(None) == {7: 2, 8: 1, 9: 1}
