"""Dataset statistics and set algebra on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_stats(edges: DataFrame) -> DataFrame:
    """One row: edges, distinct directed edges, nodes, time stamps, edges per time stamp."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("x")).agg(F.count_distinct("x").alias("nodes"))
    main = edges.agg(F.count("*").alias("edges"), F.count_distinct("u", "v").alias("unique_edges"), F.count_distinct("t").alias("stamps"))
    return main.join(F.broadcast(nodes)).withColumn("edges_per_stamp", F.col("edges") / F.col("stamps"))


def degree_per_stamp(edges: DataFrame) -> DataFrame:
    """One row: the mean over time stamps of the mean multigraph degree, 2 E_t / N_t."""
    ends = edges.select("t", F.explode(F.array("u", "v")).alias("x"))
    per = ends.groupBy("t").agg((F.count("*") / F.count_distinct("x")).alias("d"))
    return per.agg(F.avg("d").alias("degree_per_stamp"))


def surprise(split: DataFrame) -> DataFrame:
    """One row: distinct test edges unseen before over test rows, and shared ones over earlier rows."""
    past, test = split.filter("split <> 'test'"), split.filter("split = 'test'")
    p, t = past.select("u", "v").distinct(), test.select("u", "v").distinct()
    fresh = t.join(p, ["u", "v"], "left_anti").agg(F.count("*").alias("fresh"))
    shared = t.join(p, ["u", "v"], "left_semi").agg(F.count("*").alias("shared"))
    n = split.agg(F.count_if(F.col("split") == "test").alias("nt"), F.count_if(F.col("split") != "test").alias("np"))
    return n.join(F.broadcast(fresh)).join(F.broadcast(shared)).select((F.col("fresh") / F.col("nt")).alias("surprise"), (F.col("shared") / F.col("np")).alias("reoccurrence"))


def new_node_ratio(split: DataFrame) -> DataFrame:
    """(split, ratio): share of an evaluation set's nodes that training did not see."""
    ends = split.select("split", F.explode(F.array("u", "v")).alias("x")).distinct()
    known = ends.filter("split = 'train'").select("x", F.lit(1).alias("known"))
    rest = ends.filter("split <> 'train'").join(known, "x", "left")
    return rest.groupBy("split").agg(F.avg(F.col("known").isNull().cast("double")).alias("ratio"))


def activity(edges: DataFrame, steps=(10, 100, 1000)) -> DataFrame:
    """One row: nodes with at least so many interactions."""
    n = edges.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").count()
    return n.agg(F.count("*").alias("nodes"), *[F.count_if(F.col("count") >= s).alias(f"at_least_{s}") for s in steps])


def three_way(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with ``part``: both, left or right; one shuffle of each."""
    a, b = x.select(*keys).distinct().withColumn("_l", F.lit(1)), y.select(*keys).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, keys, "full")
    return both.select(*keys, F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both").alias("part"))


def table_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, edges, nodes) of each edge stream."""
    out = None
    for name, edges in tables.items():
        nodes = edges.select(F.explode(F.array("u", "v")).alias("x")).agg(F.count_distinct("x").alias("nodes"))
        one = edges.agg(F.count("*").alias("edges")).join(F.broadcast(nodes)).select(F.lit(name).alias("name"), "edges", "nodes")
        out = one if out is None else out.union(one)
    return out


def expect(stream: DataFrame, **want: int) -> None:
    """Raises ValueError unless the stream has the wanted figures: edges, nodes, min_u, max_u, min_v, max_v."""
    ends = stream.select(F.explode(F.array("u", "v")).alias("x")).agg(F.count_distinct("x").alias("nodes"))
    got = stream.agg(F.count("*").alias("edges"), *[f(c).alias(f"{n}_{c}") for c in ("u", "v") for n, f in (("min", F.min), ("max", F.max))]).join(F.broadcast(ends)).first()
    wrong = {k: (got[k], v) for k, v in want.items() if got[k] != v}
    if wrong:
        raise ValueError(f"figures and what was expected: {wrong}")


def study(results: DataFrame) -> DataFrame:
    """(indicator, kind, mean, best): discriminability of features named <indicator>_<statistic>, by indicator and
    whether the statistic is the current value (static) or a rolling one (dynamic)."""
    name = F.substring_index("feature", "_", 1)
    kind = F.when(F.col("feature").endswith("_current"), "static").otherwise("dynamic")
    return results.groupBy(name.alias("indicator"), kind.alias("kind")).agg(F.avg("disc_auc").alias("mean"), F.max("disc_auc").alias("best"))
