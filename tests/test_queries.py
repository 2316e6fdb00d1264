"""Every registered query against its SQL on the smallest tables."""

import pytest

from edgeloom.plans import catalog

from .compare import check

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    check(spark, QUERIES[name], ORACLES[name], sf_dir)


def test_link_predictor_tells_edges_from_drawn_pairs(spark):
    """Labels are those of the split, every test edge has one drawn pair, and held-out AUC is above chance."""
    from pyspark.sql import functions as F

    from edgeloom.operators import metrics as M
    from edgeloom.operators import splits as S
    from edgeloom.sources import edges as E

    sf = "/root/testdata/sf0.01"
    got = QUERIES["link_predictor"](spark, sf).cache()
    test = S.quantile_split(E.bip(spark, sf)).filter("split = 'test'").select("seq", "u", "v")
    assert got.filter("label = 1").select("seq", "u", "v").exceptAll(test).count() == 0
    assert got.filter("label = 1").count() == test.count() == got.filter("label = 0").count()
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
    auc = M.roc_auc(got.select(F.lit(0).alias("grp"), "score", F.col("label").alias("is_pos"))).first().auc
    print("held-out AUC", auc)
    assert auc > 0.5
    assert set(QUERIES) - set(ORACLES) == {"link_predictor", "link_perceptron", "truss_cadence_asof"}


def test_truss_cadence_by_peeling(spark, sf_dir):
    """Each batch's sources against a peel of all edges of the snapshots that earlier batches closed."""
    from edgeloom.operators import graph as G
    from edgeloom.sources import edges as E

    from .test_dense_and_incremental import _node_truss, truss_of

    e = [(r.seq, r.u, r.v) for r in E.uni(spark, sf_dir).orderBy("seq").collect()]
    first = [(r.a, r.b, r.batch0) for r in G.first_edges(E.uni(spark, sf_dir)).orderBy("n0").collect()]
    want, held = {}, {}
    for seq, u, _ in e:
        batch = (seq - 1) // 200
        closed = max((k for k in range(64, len(first) + 1, 64) if first[k - 1][2] < batch), default=0)
        if closed not in held:
            held[closed] = _node_truss(truss_of([(a, b) for a, b, _ in first[:closed]]))
        want.setdefault((batch, u), (seq, held[closed].get(u, 0)))
    got = {((r.seq - 1) // 200, r.node): (r.seq, r.truss) for r in QUERIES["truss_cadence_asof"](spark, sf_dir).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
