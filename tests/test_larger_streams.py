"""What a longer stream must not multiply, and values that the small tables lack."""

import datetime

from edgeloom.operators import graph as G
from edgeloom.operators import indicators as I
from edgeloom.operators.kept import KeptGraph
from edgeloom.plans import catalog
from edgeloom.session import shared_folder

from .compare import check


def test_pruned_ticks_does_not_shuffle_its_copies(spark):
    rows = [(i + 1, i, i % 50, 50 + i % 7, i * 10_000_000) for i in range(2000)]
    edges = spark.createDataFrame(rows, "seq long, eid long, u long, v long, t long")
    found = I.pruned_ticks(edges, 3_600_000_000, 20)
    assert found.count() > 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan.split("Generate explode(sequence")[0]


def test_kept_graph_takes_as_many_batches_as_it_had(spark):
    """24 batches in steps of 2, 2, 4, 8 and 8 instead of 12 steps, with the ticks of the whole stream at once."""
    rows = [(i % 13, 13 + (i * i) % 17, i, i) for i in range(100)] + [((3 * i) % 13, (i * i) % 13, 100 + i, 100 + i) for i in range(20)]
    kept = KeptGraph(spark, shared_folder(spark, "kept"), size=5, together=2)
    m = kept.take(spark.createDataFrame(rows, "u long, v long, t long, eid long"), 1, last=True)
    assert len(m.versions) == 5
    edges = spark.createDataFrame([(i + 1, u, v, t) for i, (u, v, t, _) in enumerate(rows)], "seq long, u long, v long, t long")
    want = {(r.node, r.n0, r.degree, r.triangles) for r in I.ticks(G.first_edges(edges, 5)).collect()}
    got = [(r.node, r.n0, r.degree, r.triangles) for r in kept.moves(m).collect()]
    assert len(got) == len(want) and set(got) == want


def test_coin_loads_weights_of_zero_as_its_sql(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=i), i % 4, "view", float(i % 3), f'{{"k": {i % 5}}}') for i in range(20)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert check(spark, catalog.queries()["load_coin"], catalog.oracle_sql()["load_coin"], str(tmp_path)) == 20
