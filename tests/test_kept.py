"""The kept graph against a plain simulation, the whole-stream ticks and a restart in the middle."""

import random

import pytest
from pyspark.sql import functions as F

from edgeloom.operators import graph as G
from edgeloom.operators import indicators as I
from edgeloom.operators import kept as K
from edgeloom.operators import rolling as R
from edgeloom.session import shared_folder
from edgeloom.sources import edges as E
from edgeloom.streaming import jobs as J


def simulate(events, size, width):
    """(node, batch, phase, n0, degree, triangles) of every tick, by sets of neighbours."""
    near, since, ticks, n0, known = {}, {}, [], 0, set()
    tri = {}

    def common(a, b):
        return near.get(a, set()) & near.get(b, set())

    for at in range(0, len(events), size):
        part, batch = events[at : at + size], at // size
        if width:
            low = max(t for *_, t in part) - width
            old = [e for e, t in since.items() if t < low]
            for a, b in old:
                for w in common(a, b):
                    for x in (a, b, w):
                        tri[x] -= 1
                near[a].discard(b)
                near[b].discard(a)
                del since[a, b]
            if old:
                ticks += [(x, batch, 0, 0, len(near[x]), tri.get(x, 0)) for x in known]
        for u, v, t in part:
            a, b = min(u, v), max(u, v)
            if a == b or (a, b) in since:
                continue
            n0 += 1
            third = common(a, b)
            for w in third:
                for x in (a, b, w):
                    tri[x] = tri.get(x, 0) + 1
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            since[a, b] = t
            known |= {a, b}
            ticks += [(x, batch, 1, n0, len(near[x]), tri.get(x, 0)) for x in {a, b} | third]
    return sorted(ticks)


def random_events(n, nodes, seed):
    draw = random.Random(seed)
    t, out = 0, []
    for _ in range(n):
        t += draw.choice([0, 1, 1, 3, 40])
        out.append((draw.randrange(nodes), draw.randrange(nodes), t))
    return out


@pytest.mark.parametrize("width", [0, 60])
def test_batches_prune_and_tick_as_a_simulation(spark, width):
    events = random_events(170, 14, 6)
    kept = K.KeptGraph(spark, shared_folder(spark, "kept"), size=25, width=width, rolled="triangles", together=2, fold_every=3)
    rows = spark.createDataFrame([(*e, i) for i, e in enumerate(events)], "u long, v long, t long, eid long")
    for no, (lo, hi) in enumerate([(0, 60), (60, 61), (61, 120)], 1):
        kept.take(rows.filter(F.col("eid").between(lo, hi - 1)), no)
    kept.take(rows.filter("eid >= 120"), 4, last=True)  # run twice, as after a failure
    m = kept.take(rows.filter("eid >= 120"), 4, last=True)
    got = kept.moves(m).select("node", "batch", "phase", "n0", "degree", "triangles").collect()
    assert sorted(map(tuple, got)) == simulate(events, 25, width)
    trace = kept.moves(m).select("node", (F.col("batch") * 1_000_000 + F.col("phase") * 100_000 + F.col("n0")).alias("n"), F.col("triangles").alias("value"))
    want = {(r.node, r.n): tuple(r)[2:] for r in R.rolling(trace).collect()}
    have = {(r.node, r.batch * 1_000_000 + r.phase * 100_000 + r.n0): tuple(r[c] for c in R.STATS) for r in kept.moves(m).collect()}
    assert have.keys() == want.keys()
    assert all(have[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_stream_in_fixed_batches_with_a_restart_equals_whole_stream_ticks(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").toPandas()
    source = f"file://{tmp_path}/events.parquet"
    cuts = [0, 250, 580, 1000]

    def arrive(i):
        part = events.iloc[cuts[i] : cuts[i + 1]]
        schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    kept = K.KeptGraph(spark, shared_folder(spark, "kept"), size=200, together=1, fold_every=2)
    arrive(0)
    J.advance(J.read_events(spark, f"{tmp_path}", 1), kept)
    arrive(1)
    J.advance(J.read_events(spark, f"{tmp_path}", 1), K.KeptGraph(spark, kept.folder, size=200, together=1, fold_every=2))
    assert kept.manifest(2).seq == 400
    arrive(2)
    m = J.advance(J.read_events(spark, f"{tmp_path}", 1), kept, last=True)
    want = I.ticks(G.first_edges(E.uni(spark, sf_dir)))
    got = kept.moves(m).select("node", "n0", "degree", "triangles", "clustering")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    last = want.groupBy("node").agg(F.max_by(F.struct("degree", "triangles"), "n0").alias("x")).select("node", "x.*")
    assert kept.nodes(m).select("node", "degree", "triangles").exceptAll(last).count() == 0
    assert kept.edges(m).count() == 2 * G.first_edges(E.uni(spark, sf_dir)).count()
