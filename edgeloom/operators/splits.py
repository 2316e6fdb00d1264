"""Id encoding, splits and samples of an edge stream."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.order import numbered


def first_seen_ids(rows: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """(raw, id): dense ids by first appearance; within a row, by the order of ``columns``."""
    n = len(columns)
    sides = F.explode(F.array(*[F.struct((F.col(position) * n + i).alias("p"), F.col(c).cast("string").alias("raw")) for i, c in enumerate(columns)]))
    first = rows.select(sides.alias("x")).groupBy("x.raw").agg(F.min("x.p").alias("p"))
    return numbered(first, ["p"], "id", 0).select("raw", "id")


def reindex_bipartite(rows: DataFrame) -> DataFrame:
    """Items move behind the users; then all ids and the index count from 1."""
    top = rows.agg(F.max("u").alias("top"))
    return rows.join(F.broadcast(top)).select((F.col("u") + 1).alias("u"), (F.col("v") + F.col("top") + 2).alias("v"), (F.col("idx") + 1).alias("idx"))


def quantile_split(edges: DataFrame, val: float = 0.70, test: float = 0.85) -> DataFrame:
    """Adds ``split`` by exact, linearly interpolated time quantiles."""
    cuts = edges.agg(F.percentile("t", F.array(F.lit(val), F.lit(test))).alias("cuts"))
    t, c = F.col("t"), F.col("cuts")
    return edges.join(F.broadcast(cuts)).withColumn("split", F.when(t <= c[0], "train").when(t <= c[1], "val").otherwise("test")).drop("cuts")


def positional_split(edges: DataFrame, val: float = 0.70, test: float = 0.85) -> DataFrame:
    n = edges.agg(F.max("seq").alias("n"))
    seq = F.col("seq")
    return edges.join(F.broadcast(n)).withColumn("split", F.when(seq <= F.floor(F.lit(val) * F.col("n")), "train").when(seq <= F.floor(F.lit(test) * F.col("n")), "val").otherwise("test")).drop("n")


def inductive_split(edges: DataFrame, share: int = 10) -> DataFrame:
    """(part, n): sizes of the training set without a tenth of the nodes, of the evaluation
    sets, and of their rows that touch a node which training never saw.

    Held-out nodes are drawn by integer arithmetic on their id from those active after training.
    """
    ends = edges.select("split", F.explode(F.array("u", "v")).alias("x"))
    total = ends.select("x").distinct().count()
    draw = (F.col("x") * 7919) % 100003
    late = ends.filter("split <> 'train'").select("x").distinct()
    held = late.orderBy(draw, "x").limit(total // share)
    train = edges.filter("split = 'train'")
    for side in ("u", "v"):
        train = train.join(held.withColumnRenamed("x", side), side, "left_anti")
    known = train.select(F.explode(F.array("u", "v")).alias("x")).distinct()
    later = edges.filter("split <> 'train'")
    for side in ("u", "v"):
        later = later.join(known.select(F.col("x").alias(side), F.lit(True).alias(f"k{side}")), side, "left")
    fresh = later.filter("ku is null or kv is null").groupBy(F.concat(F.lit("new_"), "split").alias("part")).agg(F.count("*").alias("n"))
    sizes = later.groupBy(F.col("split").alias("part")).agg(F.count("*").alias("n"))
    return train.agg(F.lit("train").alias("part"), F.count("*").alias("n")).union(sizes).union(fresh)


def strided(edges: DataFrame, k: int) -> DataFrame:
    """Rows at positions floor(i * n / k), i = 0 .. k - 1."""
    n = edges.agg(F.max("seq").alias("n"))
    i = F.ceil((F.col("seq") - 1) * F.lit(k) / F.col("n"))  # the least i that can reach this position
    hit = (F.floor(i * F.col("n") / F.lit(float(k))) == F.col("seq") - 1) & (i < k)
    return edges.join(F.broadcast(n)).filter(hit).drop("n")


def halves(nodes: DataFrame) -> DataFrame:
    """Adds ``half`` (0 or 1) to (node): disjoint halves of a node set, by integer arithmetic on the id."""
    return nodes.withColumn("half", (F.pmod(F.col("node") * 7919, F.lit(100003)) % 2).cast("int"))


def inductive_rows(edges: DataFrame, share: int = 10) -> DataFrame:
    """The split's rows with ``role``: kept for training, left_out of it, or an evaluation row that touches
    (new) or doesn't touch (known) a node which the kept rows lack."""
    draw = (F.col("x") * 7919) % 100003
    ends = edges.select("split", F.explode(F.array("u", "v")).alias("x"))
    want = ends.select("x").distinct().agg(F.floor(F.count("*") / F.lit(share)).alias("want"))
    late = numbered(ends.filter("split <> 'train'").select("x").distinct(), [draw, "x"], "place")
    held = late.join(F.broadcast(want)).filter(F.col("place") <= F.col("want")).select("x")
    rows = edges
    for side in ("u", "v"):
        rows = rows.join(held.select(F.col("x").alias(side), F.lit(True).alias(f"h{side}")), side, "left")
    kept = (F.col("split") == "train") & F.col("hu").isNull() & F.col("hv").isNull()
    known = rows.filter(kept).select(F.explode(F.array("u", "v")).alias("x")).distinct()
    for side in ("u", "v"):
        rows = rows.join(known.select(F.col("x").alias(side), F.lit(True).alias(f"k{side}")), side, "left")
    role = F.when(kept, "kept").when(F.col("split") == "train", "left_out").when(F.col("ku").isNull() | F.col("kv").isNull(), "new").otherwise("known")
    return rows.select(*edges.columns, role.alias("role"))
