"""The evolving simple graph as tables, and its node and edge indicators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, shared_folder
from ..sources.order import numbered

BATCH = 200
BROADCAST_ROWS = 2_000_000  #: so many edges that close wedges go to the wedges (three numbers each); with more, wedges are shuffled
FRONTIER_ROWS = 5_000_000  #: so many adjacency rows or triangles make a round's own joins dearer than finding what to ask


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of an iterated table in the shared folder (``spark.checkpoint.dir``)."""
    path = shared_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(edges: DataFrame, size: int = BATCH) -> DataFrame:
    """Adds the micro-batch of each row: positions in runs of ``size``."""
    return edges.withColumn("batch", F.floor((F.col("seq") - 1) / F.lit(size)).cast("long"))


def first_edges(edges: DataFrame, size: int = BATCH) -> DataFrame:
    """(a, b, seq0, t0, batch0, n0): each undirected edge at its first occurrence.

    Self loops are dropped before anything else; repeats change nothing.  ``n0`` is the
    edge's rank among new edges.
    """
    simple = edges.filter("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min(F.struct("seq", "t")).alias("f"))
    simple = simple.select("a", "b", F.col("f.seq").alias("seq0"), F.col("f.t").alias("t0"))
    simple = simple.withColumn("batch0", F.floor((F.col("seq0") - 1) / F.lit(size)).cast("long"))
    return numbered(simple, ["seq0"], "n0")


def pairs(edges: DataFrame) -> DataFrame:
    """Undirected edges (a < b) of a snapshot, without repeats and self loops."""
    return edges.filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def remove_edges(ab: DataFrame, gone: DataFrame) -> DataFrame:
    """(a, b, removed): the edges with whether ``gone`` (u, v) names them in either direction; nodes are kept elsewhere."""
    mark = gone.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.lit(True).alias("_g")).distinct()
    return ab.join(mark, ["a", "b"], "left").select("a", "b", F.coalesce("_g", F.lit(False)).alias("removed"))


def possible_edges(sources: DataFrame, targets: DataFrame, most: int = 10_000_000) -> DataFrame:
    """All (u, v) of two id lists; an error beyond ``most`` pairs, as draws by place need no product."""
    n = sources.count() * targets.count()
    if n > most:
        raise ValueError(f"{n} pairs, more than {most}")
    return sources.select("u").crossJoin(targets.select("v"))


def adjacency(ab: DataFrame, *more: str) -> DataFrame:
    """(n, m): both directions of (a, b)."""
    return ab.select(F.col("a").alias("n"), F.col("b").alias("m"), *more).unionByName(ab.select(F.col("b").alias("n"), F.col("a").alias("m"), *more))


def degree(ab: DataFrame) -> DataFrame:
    return adjacency(ab).groupBy("n").agg(F.count("*").alias("degree")).withColumnRenamed("n", "node")


def arcs(ab: DataFrame, *more: str) -> DataFrame:
    """(s, e): each edge from its lower to its higher end by (degree, id), so no node has more arcs than the square root of twice the edges."""
    d = degree(ab)
    da, db = d.select(F.col("node").alias("a"), F.col("degree").alias("da")), d.select(F.col("node").alias("b"), F.col("degree").alias("db"))
    r = ab.join(da, "a").join(db, "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    return r.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("e"), *more)


def triangles(ab: DataFrame, *more: str) -> DataFrame:
    """(x, y, z) with x < y < z.

    Edges point from the lower to the higher (degree, id), so a hub is the start of few
    wedges: their number is at most edges to the power of 1.5, whatever the skew.  What closes a wedge is an edge between
    two ends of arcs; where hubs are few, so are these edges, and they go to the wedges.
    """
    up = arcs(ab, *more)
    one = up.select("s", F.col("e").alias("p"), *[F.col(c).alias(f"{c}_1") for c in more])
    two = up.select("s", F.col("e").alias("q"), *[F.col(c).alias(f"{c}_2") for c in more])
    wedges = one.join(two, "s").filter("p < q")
    ends = up.select("e").distinct()
    close = ab.select(F.col("a").alias("p"), F.col("b").alias("q"), *[F.col(c).alias(f"{c}_3") for c in more])
    close = cut(close.join(ends.withColumnRenamed("e", "p"), "p", "left_semi").join(ends.withColumnRenamed("e", "q"), "q", "left_semi"))
    found = wedges.join(F.broadcast(close) if close.count() <= BROADCAST_ROWS else close, ["p", "q"])
    nodes = F.array_sort(F.array("s", "p", "q"))
    return found.select(nodes[0].alias("x"), nodes[1].alias("y"), nodes[2].alias("z"), *[F.greatest(f"{c}_1", f"{c}_2", f"{c}_3").alias(c) for c in more])


def triangle_count(ab: DataFrame) -> DataFrame:
    """(node, triangles) for every node with an edge."""
    hit = triangles(ab).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count("*").alias("c"))
    return degree(ab).join(hit, "node", "left").select("node", F.coalesce("c", F.lit(0)).alias("triangles"))


def clustering(ab: DataFrame) -> DataFrame:
    both = degree(ab).join(triangle_count(ab), "node")
    d = F.col("degree")
    return both.select("node", F.when(d < 2, F.lit(0.0)).otherwise(2.0 * F.col("triangles") / (d * (d - 1))).alias("clustering"))


def _h_index(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Largest h such that h rows of the key have a value of at least h.

    Rows are counted per value first, so a hub is as many rows as it has different values.
    """
    level = rows.groupBy(*key, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*key).orderBy(F.desc(value)))
    return level.withColumn("least", F.least(F.col(value), upto)).groupBy(*key).agg(F.max("least").alias("h"))


def _lowered(now: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """``now`` with the values that ``new`` (key, h) lowers and whether it did, written in place of ``now``."""
    least = F.least(F.col(value), F.coalesce("h", F.col(value))).cast("long")
    step = cut(now.drop("changed").join(new, key, "left").select(*key, least.alias(value), (least < F.col(value)).alias("changed")))
    discard(now)
    return step


def k_core(ab: DataFrame, *keys: str, frontier_rows: int = FRONTIER_ROWS) -> DataFrame:
    """(keys, node, core): iterated h-index of the neighbours' values, from the degrees to the fixpoint.

    ``keys`` name columns of ``ab`` that tell snapshots apart; all snapshots are iterated together.
    From ``frontier_rows`` rows on a round asks only nodes next to one whose value fell in the round
    before; the values are the same.
    """
    adj = cut(adjacency(ab, *keys))
    rows = adj.count()
    if not rows:
        return adj.select(*keys, F.col("n").alias("node"), F.lit(0).cast("long").alias("core"))
    now = cut(adj.groupBy(*keys, "n").agg(F.count("*").alias("core")).withColumn("changed", F.lit(True)))
    while not now.filter("changed").isEmpty():
        ask = adj
        if rows >= frontier_rows:
            moved = now.filter("changed").select(*keys, F.col("n").alias("m"))
            ask = adj.join(adj.join(moved, [*keys, "m"], "left_semi").select(*keys, "n").distinct(), [*keys, "n"], "left_semi")
        seen = ask.join(now.select(*keys, F.col("n").alias("m"), "core"), [*keys, "m"])
        new = _h_index(seen.select(*keys, "n", "core"), [*keys, "n"], "core")
        now = _lowered(now, new, [*keys, "n"], "core")
    discard(adj)
    return now.drop("changed").withColumnRenamed("n", "node")


def k_truss(ab: DataFrame, frontier_rows: int = FRONTIER_ROWS) -> DataFrame:
    """(a, b, truss): h-index over an edge's triangles of the lesser of their other two edges, plus 2.

    From ``frontier_rows`` triangles on a round asks only parts with an edge whose value fell in the round
    before; the values are the same.
    """
    from . import truss as T

    ab = cut(ab.select("a", "b"))
    return ab.join(T.supports(ab, frontier_rows), ["a", "b"], "left").select("a", "b", (F.coalesce("s", F.lit(0)) + 2).cast("long").alias("truss"))


def node_truss(ab: DataFrame) -> DataFrame:
    return adjacency(k_truss(ab), "truss").groupBy("n").agg(F.max("truss").alias("truss")).withColumnRenamed("n", "node")


def common_neighbors(queries: DataFrame, ab: DataFrame) -> DataFrame:
    """(u, v, w): each shared neighbour of the asked pairs, found by intersecting words of ids."""
    from . import blocks as B

    return B.members(B.shared_words(queries, ab), F.col("both")).select("u", "v", "w")


def neighborhoods(queries: DataFrame, ab: DataFrame) -> DataFrame:
    """(u, v, w, direct, two): v's neighbours w other than u, whether w is u's neighbour too, and
    whether it is two steps from u.

    Flags are found on words of 64 ids and told apart last, so that what is joined and shuffled are words.
    """
    from . import blocks as B

    rows = B.members(B.pair_words(queries, ab), F.col("near"))
    has = lambda c: F.getbit(F.col(c), F.col("w").bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.select("u", "v", "w", has("one").alias("direct"), has("two").alias("two"))


# -- traces over the stream -------------------------------------------------------------


def degree_trace(first: DataFrame) -> DataFrame:
    """(node, n0, degree): a node's degree after each of its new edges."""
    adj = adjacency(first, "n0")
    return adj.select(F.col("n").alias("node"), "n0", F.row_number().over(W.partitionBy("n").orderBy("n0")).cast("long").alias("degree"))


def triangle_trace(first: DataFrame) -> DataFrame:
    """(node, n0, triangles): triangles closed up to each new edge that closes some.

    A triangle closes with the last of its three edges.
    """
    t = triangles(first.select("a", "b", "n0"), "n0")
    hits = t.select(F.explode(F.array("x", "y", "z")).alias("node"), "n0").groupBy("node", "n0").agg(F.count("*").alias("c"))
    run = F.sum("c").over(W.partitionBy("node").orderBy("n0"))
    return hits.select("node", "n0", run.alias("triangles"))


def window_validity(edges: DataFrame, width: int, size: int = BATCH) -> DataFrame:
    """(a, b, t_in, batch_in, batch_out): stays of an edge in a sliding window.

    A stay begins with an occurrence in batch i at time t and ends in batch p, the first
    one after i that there is and whose latest time less ``width`` is above t; occurrences meanwhile change
    nothing and the next stay may begin in p itself.  An open stay has a null batch_out.
    Each occurrence's own end is one as-of join; following the ends is a fold that streams through the sorted
    occurrences, so an edge with many of them is never held together.
    """
    rows = batches(edges.filter("u <> v"), size).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "seq", "t", "batch")
    limit = batches(edges, size).groupBy("batch").agg((F.max("t") - F.lit(width)).alias("t"))
    return stays(rows, limit).drop("seq")


def stays(rows: DataFrame, limit: DataFrame) -> DataFrame:
    """(a, b, seq, t_in, batch_in, batch_out): stays, with the place of the occurrence that begins each.

    ``rows`` (a, b, seq, t, batch) are occurrences; what was there before can be given as one of an earlier place and batch.
    ``limit`` (batch, t) has for each batch the time before which edges are out.
    """
    # floor_t never falls along the batches: an occurrence's end is the first mark above its time.
    occurrences = rows.select("t").distinct().withColumn("p", F.lit(None).cast("long")).withColumn("asked", F.lit(True))
    marks = limit.groupBy("t").agg(F.min("batch").alias("p")).withColumn("asked", F.lit(False))
    ends = next_value(occurrences.union(marks), "t", "p").filter("asked").select("t", "p")
    own = rows.join(ends, "t", "left").join(F.broadcast(limit.agg(F.max("batch").alias("last"))))
    after = F.greatest("p", F.col("batch") + 1)
    own = own.withColumn("p", F.when(F.col("p").isNotNull() & (after <= F.col("last")), after))
    ordered = own.select("a", "b", "seq", "t", "batch", "p").repartition("a", "b").sortWithinPartitions("a", "b", "seq")
    return ordered.mapInPandas(_stays, "a long, b long, seq long, t_in long, batch_in long, batch_out long")


def _stays(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of edges' occurrences in order, those that begin a stay; only the last edge's end is held."""
    edge, end = None, None
    for pdf in parts:
        began = []
        ends = [None if x != x else int(x) for x in pdf["p"].tolist()]
        for i, (key, batch) in enumerate(zip(zip(pdf["a"].tolist(), pdf["b"].tolist()), pdf["batch"].tolist())):
            if key != edge or (end is not None and end <= batch):
                edge, end = key, ends[i]
                began.append(i)
        out = pdf.iloc[began]
        yield pd.DataFrame({"a": out["a"], "b": out["b"], "seq": out["seq"], "t_in": out["t"], "batch_in": out["batch"], "batch_out": out["p"].astype("Int64")})


def next_value(rows: DataFrame, order: str, value: str, hours: int = 1) -> DataFrame:
    """Fills null values with the next later one, strictly above in ``order``.

    Rows are cut into slices of time; a slice looks into itself and, beyond it, at the first
    value of later slices (one row per slice).
    """
    rows = rows.withColumn("_s", F.floor(F.col(order) / F.lit(hours * 3_600_000_000)))
    heads = rows.filter(F.col(value).isNotNull()).groupBy("_s").agg(F.min(value).alias("_h"))
    slices = rows.select("_s").distinct().join(heads, "_s", "left")
    # From the latest row down, as a frame that ends with its partition is added up anew for each row.
    later = W.orderBy(F.desc("_s")).rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select("_s", F.min("_h").over(later).alias("_later"))
    inside = W.partitionBy("_s").orderBy(F.desc(order)).rangeBetween(W.unboundedPreceding, -1)
    return rows.join(slices, "_s").withColumn(value, F.coalesce(value, F.min(value).over(inside), "_later")).drop("_s", "_later")
