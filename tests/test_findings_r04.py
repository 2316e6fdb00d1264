import math
import random

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import log2_weight
from edgeloom.operators import blocks as B
from edgeloom.operators import graph as G
from edgeloom.operators import indicators as I
from edgeloom.operators import pairwise as P
from edgeloom.operators import predictor, tiles


def test_weights_have_the_logarithm_of_the_sql(spark):
    """Logarithms whose tenth digit is a 5 as far as doubles go: 4.5264375785 and 6.1907590435."""
    rows = spark.createDataFrame([(23.04589,), (73.0473,), (0.0,), (-1.0,), (math.nan,), (None,)], "w double")
    got = [r.x for r in rows.select(F.round(log2_weight(F.col("w")) * 1e9).alias("x")).collect()]
    assert got[:3] == [4526437579.0, 6190759043.0, 0.0] and got[3] is None and math.isnan(got[4]) and got[5] is None
    assert [r.x for r in rows.limit(2).select(log2_weight(F.col("w")).alias("x")).collect()] == [math.log2(23.04589), math.log2(73.0473)]


@pytest.mark.parametrize("stripe, dense", [(12, 4), (1, 1), (2, 1000)])
def test_strangers_met_in_tiles(spark, monkeypatch, stripe, dense):
    """Tiles give what joined words give, over several stripes and blocks, with full rows, with lists, and with ids that nothing links."""
    rng = random.Random(stripe)
    edges = sorted({tuple(sorted((rng.randrange(30), rng.choice([rng.randrange(30), 100 + rng.randrange(400)])))) for _ in range(700)})
    edges = [(a, b) for a, b in edges if a != b]
    nodes = sorted({n for e in edges for n in e})
    asked = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(900)] + [(nodes[0], nodes[0]), (9999, 1), (1, 9999)]
    ab, queries = spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(asked, "u long, v long")
    x = spark.createDataFrame([(n, rng.randrange(1, 50)) for n in nodes], "node long, x long")
    every = lambda: (P.pair_features(queries, ab, x).collect(), B.pair_counts(queries, ab, x.withColumnRenamed("x", "value")).collect())
    joined = every()
    for name, value in (("MOST_ROWS", -1), ("STRIPE", stripe), ("BLOCK", 100), ("DENSE", dense)):
        monkeypatch.setattr(tiles, name, value)
    monkeypatch.setattr(B, "pair_words", None)
    met = every()
    for was, now in zip(joined, met):
        was, now = ({(r.u, r.v): tuple(r)[2:] for r in rows} for rows in (was, now))
        assert was.keys() == now.keys()
        for k in was:
            assert now[k] == pytest.approx(was[k], abs=1e-9), k


def test_scorers_are_fitted_on_all_validation_rows(spark, monkeypatch):
    rng = random.Random(8)
    edges = spark.createDataFrame([(i + 1, rng.randrange(12), 100 + rng.randrange(9), i, 1.0) for i in range(400)], "seq long, u long, v long, t long, w double")
    fitted = []

    class Counted(predictor.LogisticRegression):
        def fit(self, rows, params=None):
            fitted.append(rows.count())
            return super().fit(rows, params)

    monkeypatch.setattr(predictor, "FIT_ROWS", 10, raising=False)
    monkeypatch.setattr(predictor, "LogisticRegression", Counted)
    assert predictor.link_scores(edges).count() > 0
    assert predictor.perceptron_scores(edges, negatives=1, model=Counted()).count() > 0
    assert fitted == [120, 120]


def test_pruned_ticks_by_runs_and_blocks(spark, monkeypatch):
    """All rows once, over many runs of batches and blocks of nodes, and stored in runs of few values."""
    rng = random.Random(6)
    edges = [(i + 1, rng.randrange(40 + i // 10), 1000 + rng.randrange(9), i) for i in range(600)]
    df = spark.createDataFrame(edges, "seq long, u long, v long, t long")
    since = {}
    for seq, u, v, _ in edges:
        for n in (u, v):
            since.setdefault(n, (seq - 1) // 4)
    prunes = {r.batch_out for r in G.window_validity(df, 90, 4).collect() if r.batch_out is not None}
    monkeypatch.setattr(I, "TICK_BATCHES", 16, raising=False)
    monkeypatch.setattr(I, "TICK_BLOCK", 5, raising=False)
    got = I.pruned_ticks(df, 90, 4).withColumn("part", F.spark_partition_id())
    rows = [tuple(r) for r in got.collect()]
    assert sorted((b, n) for b, n, _ in rows) == sorted((b, n) for b in prunes for n in since if since[n] < b)
    for part in {p for *_, p in rows}:
        seen = [(b // 16, n) for b, n, p in rows if p == part]
        runs = [x for x, y in zip(seen, [None, *seen]) if x != y]
        assert len(runs) == len(set(runs))
    assert len({p for *_, p in rows}) > 4
