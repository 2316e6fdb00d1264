"""A logistic regression over pair features of the training graph."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G
from . import negatives as N
from . import pairwise as P
from . import splits as S

FEATURES = ("cn", "aa", "ra", "jaccard", "pa", "cn2", "aa2", "cn2_x_sum", "x_u", "x_v", "bridge", "bridge_x")


def link_scores(edges: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(seq, u, v, label, score) of the test edges and one drawn pair for each.

    The graph is that of the training edges, the model is fitted on all validation edges
    and their drawn pairs.  Without validation edges of both kinds there is no result.
    """
    e = S.quantile_split(edges)
    pool = N.pool(e.select(F.col("v").alias("value")))
    later = e.filter("split <> 'train'").select("seq", "u", "v", "split")
    drawn = N.draw(later, pool, F.col("seq"), 1).select("seq", "u", F.col("neg").alias("v"), "split", F.lit(0.0).alias("label"))
    rows = G.cut(later.withColumn("label", F.lit(1.0)).unionByName(drawn))
    ab = G.cut(G.pairs(e.filter("split = 'train'")))
    x = G.degree(ab).select("node", F.log1p(F.col("degree").cast("double")).alias("x"))
    found = rows.join(P.pair_features(rows, ab, x), ["u", "v"])
    found = G.cut(found.select("seq", "u", "v", "split", "label", F.array(*features).alias("x")))
    val = found.filter("split = 'val'")
    model = LogisticRegression(regParam=1e-4, maxIter=50).fit(val.select(array_to_vector("x").alias("features"), "label"))
    # Scored by columns: a fitted model carries its training summary, and with it the session, into every task.
    z = F.lit(float(model.intercept))
    for i, w in enumerate(model.coefficients):
        z = z + F.lit(float(w)) * F.get("x", F.lit(i))
    return found.filter("split = 'test'").select("seq", "u", "v", F.col("label").cast("int").alias("label"), (1.0 / (1.0 + F.exp(-z))).alias("score"))


NODE_STRUCTURE = ("degree", "triangles", "clustering")
NODE_ACTIVITY = ("count", "mean", "std")
FUSIONS = ("concat", "additive")


def node_blocks(train: DataFrame, fusion: str) -> DataFrame:
    """(node, h): standardised structure and activity of the training graph's nodes, side by side or, for ``additive``, added up."""
    if fusion not in FUSIONS:
        raise ValueError(f"unknown fusion {fusion}: one of {FUSIONS}")
    ab = G.cut(G.pairs(train))
    structure = G.degree(ab).join(G.triangle_count(ab), "node").join(G.clustering(ab), "node").select("node", F.log1p("degree").alias("degree"), F.log1p("triangles").alias("triangles"), "clustering")
    ends = train.select(F.explode(F.array("u", "v")).alias("node"), "w")
    activity = ends.groupBy("node").agg(F.log1p(F.count("*")).alias("count"), F.avg("w").alias("mean"), F.coalesce(F.stddev_pop("w"), F.lit(0.0)).alias("std"))
    rows = G.cut(activity.join(structure, "node", "left").fillna(0.0))
    names = [*NODE_STRUCTURE, *NODE_ACTIVITY]
    m = rows.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
    scaled = [(F.col(c) - F.lit(m[f"mean_{c}"] or 0.0)) / F.lit(m[f"std_{c}"] or 1.0) for c in names]
    h = scaled if fusion == "concat" else [a + b for a, b in zip(scaled[:3], scaled[3:])]
    return rows.select("node", F.array(*h).alias("h"))


def asked_pairs(edges: DataFrame, negatives: int = 20, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(qid, u, v, is_pos, part, p): validation edges with a drawn destination each and test edges with ``negatives``, with their pair
    features on the training graph."""
    e = S.quantile_split(edges)
    pool = N.pool(e.select(F.col("v").alias("value")))

    def with_drawn(split: str, n: int) -> DataFrame:
        true = e.filter(F.col("split") == split).select(F.col("seq").alias("qid"), "u", "v")
        drawn = N.draw(true.select("qid", "u"), pool, F.col("qid"), n).select("qid", "u", F.col("neg").alias("v"))
        return true.withColumn("is_pos", F.lit(1)).union(drawn.withColumn("is_pos", F.lit(0))).withColumn("part", F.lit(split))

    rows = G.cut(with_drawn("val", 1).union(with_drawn("test", negatives)))
    ab = G.cut(G.pairs(e.filter("split = 'train'")))
    pairs = P.pair_features(rows, ab, G.degree(ab).select("node", F.log1p(F.col("degree").cast("double")).alias("x"))).select("u", "v", F.array(*[F.log1p(F.abs(c)) for c in features]).alias("p"))
    return G.cut(rows.join(pairs, ["u", "v"]))


def perceptron_scores(edges: DataFrame, fusion: str = "concat", hidden: tuple[int, ...] = (16,), negatives: int = 20, seed: int = 3, model=None, features: tuple[str, ...] = FEATURES, asked: DataFrame | None = None) -> DataFrame:
    """(qid, u, v, is_pos, score): test edges and ``negatives`` drawn destinations each, by a multilayer perceptron.

    Its inputs are both ends' fused blocks and the pair features on the training graph; it is fitted on all
    validation edges with a drawn destination each.  ``model`` is another classifier of pyspark.ml to fit
    instead.  Nodes that training never saw have zeros.  ``asked`` are ``asked_pairs`` of the same edges, to share them between fits.
    """
    train = S.quantile_split(edges).filter("split = 'train'")
    found = asked if asked is not None else asked_pairs(edges, negatives, features)
    blocks = G.cut(node_blocks(train, fusion))
    width = 6 if fusion == "concat" else 3
    zeros = F.array_repeat(F.lit(0.0), width)
    for side in ("u", "v"):
        found = found.join(blocks.select(F.col("node").alias(side), F.col("h").alias(f"h{side}")), side, "left")
    found = G.cut(found.select("qid", "u", "v", "is_pos", "part", array_to_vector(F.concat(F.coalesce("hu", zeros), F.coalesce("hv", zeros), "p")).alias("features")))
    val = found.filter("part = 'val'")
    fitted = G.cut(val.select("features", F.col("is_pos").cast("double").alias("label")))
    learner = model or MultilayerPerceptronClassifier(layers=[2 * width + len(features), *hidden, 2], maxIter=80, seed=seed, blockSize=256)
    scored = learner.fit(fitted).transform(found.filter("part = 'test'"))
    return scored.select("qid", "u", "v", "is_pos", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
