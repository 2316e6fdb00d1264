"""Common-neighbour decoding: which nodes near a pair are summed, and sampling of adjacency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import adjacency, common_neighbors


def pack(row: Column, col: Column) -> Column:
    """Two 32-bit numbers as one long: row in the upper half."""
    return F.shiftleft(row.cast("long"), 32).bitwiseOR(col.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32), key.bitwiseAND(F.lit(0xFFFFFFFF))


def vector_sums(found: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, keys: list[str]) -> DataFrame:
    """(keys, sums): component sums of the vectors of each group's nodes, partial sums before the shuffle.

    Vectors are as wide as the widest; a shorter one counts 0 beyond its end.
    """
    width = vectors.agg(F.max(F.size(vec_col))).first()[0] or 0
    sums = [F.coalesce(F.sum(F.get(vec_col, F.lit(i)).cast("double")), F.lit(0.0)) for i in range(width)]
    return found.join(vectors, id_col).groupBy(*keys).agg((F.array(*sums) if sums else F.array().cast("array<double>")).alias("sums"))


def near_pairs(queries: DataFrame, ab: DataFrame, mode: int) -> DataFrame:
    """(u, v, w, kind): nodes whose vectors a decoder of ``mode`` sums for each pair; kind is (hops from u)(hops from v).

    Mode 1 takes common neighbours (11).  Mode 0 adds u itself where it is v's neighbour (01) and v where
    it is u's (10).  Mode 2 adds to mode 1 nodes one step from the one and two from the other end (12, 21) and
    two from both (22); walks over the edge (u, v) itself do not count, and a node counts once per kind.
    """
    if mode not in (0, 1, 2):
        raise ValueError(f"unknown mode {mode}: 0, 1 or 2")
    asked = queries.select("u", "v").distinct()
    adj = adjacency(ab)

    def step(rows: DataFrame, at: str, to: str) -> DataFrame:
        """One step from ``at`` that is not along the pair's own edge."""
        moved = rows.join(adj.select(F.col("n").alias(at), F.col("m").alias(to)), at)
        a, b = F.least(at, to), F.greatest(at, to)
        return moved.filter((a != F.least("u", "v")) | (b != F.greatest("u", "v")))

    out = common_neighbors(asked, ab).withColumn("kind", F.lit("11"))
    if mode == 0:
        linked = asked.join(adj.select(F.col("n").alias("u"), F.col("m").alias("v")), ["u", "v"], "left_semi")
        for s, kind in (("u", "01"), ("v", "10")):
            out = out.union(linked.select("u", "v", F.col(s).alias("w"), F.lit(kind).alias("kind")))
    if mode == 2:
        one = {s: step(asked.withColumn("x", F.col(s)), "x", "w").select("u", "v", "w").distinct() for s in ("u", "v")}
        two = {s: step(one[s].withColumnRenamed("w", "x"), "x", "w").filter(F.col("w") != F.col(s)).select("u", "v", "w").distinct() for s in ("u", "v")}
        for a, b, kind in ((one["u"], two["v"], "12"), (two["u"], one["v"], "21"), (two["u"], two["v"], "22")):
            out = out.union(a.join(b, ["u", "v", "w"], "left_semi").withColumn("kind", F.lit(kind)))
    return out


def sample_rows(entries: DataFrame, k: int, salt: int = 0, keep_short: bool = False) -> DataFrame:
    """(row, col, weight): ``k`` draws with replacement from each row of (row, col), equal ones added up.

    Weights are draws times row length over k, so that a row's sum keeps its expectation; with
    ``keep_short`` rows of at most k entries stay whole with weight 1.
    """
    placed = entries.withColumn("place", F.row_number().over(W.partitionBy("row").orderBy("col")) - 1)
    size = placed.groupBy("row").agg(F.count("*").alias("size"))
    long = size.filter(F.col("size") > k) if keep_short else size
    draws = long.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    draws = draws.withColumn("place", F.pmod(F.col("row") * 7919 + F.col("j") * 104729 + salt * 31, F.col("size")).cast("int"))
    drawn = draws.join(placed, ["row", "place"]).groupBy("row", "col").agg((F.count("*") * F.first("size") / F.lit(k)).alias("weight"))
    if not keep_short:
        return drawn
    short = placed.join(size.filter(F.col("size") <= k), "row").select("row", "col", F.lit(1.0).alias("weight"))
    return drawn.union(short)


def drop_edges(entries: DataFrame, p: float, salt: int = 0) -> DataFrame:
    """(row, col, weight) without about a share ``p`` of the entries, by hash; the rest weighs 1 / (1 - p)."""
    kept = F.pmod(F.col("row") * 7919 + F.col("col") * 104729 + salt * 31, F.lit(1_000_003)) >= int(p * 1_000_003)
    return entries.filter(kept).withColumn("weight", F.lit(1.0 / (1.0 - p)) if p < 1 else F.lit(0.0))
