"""Neighbourhoods as words of 64 ids, so that sets are united and intersected by bit operations.

A row (n, blk, bits) holds which of the ids 64 * blk .. 64 * blk + 63 are neighbours of n.  Dense neighbourhoods
shrink up to 64 times; sparse ones have a row per neighbour, as plain adjacency has.  A hub is split over its words.
All of it is built-in functions: bit_or merges sets in the map-side combine, bit_count counts intersections, and sums of
whole numbers over a set are counts against their binary digits (``planes``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph as G

SHIFT = 6  #: 64 ids a word


def block(id_: Column | str) -> Column:
    return F.shiftright(id_, SHIFT)


def bit(id_: Column | str) -> Column:
    id_ = F.col(id_) if isinstance(id_, str) else id_
    place = id_.bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def without(bits: Column, blk: Column, id_: Column) -> Column:
    """``bits`` of a word without one id, if the word has it."""
    return F.when(block(id_) == blk, bits.bitwiseAND(F.bitwise_not(bit(id_)))).otherwise(bits)


def words(adj: DataFrame) -> DataFrame:
    """(n, blk, bits) of an adjacency (n, m)."""
    return adj.groupBy("n", block("m").alias("blk")).agg(F.bit_or(bit("m")).alias("bits"))


def two_steps(sources: DataFrame, adj: DataFrame, near: DataFrame) -> DataFrame:
    """(u, blk, two): what is two steps from each of ``sources`` (u) other than itself; ``near`` are the words of ``adj``."""
    over = sources.select("u").distinct().join(adj.select(F.col("n").alias("u"), F.col("m").alias("x")), "u")
    met = over.join(near.select(F.col("n").alias("x"), "blk", "bits"), "x").groupBy("u", "blk").agg(F.bit_or("bits").alias("two"))
    return met.withColumn("two", without(F.col("two"), F.col("blk"), F.col("u")))


def pair_words(queries: DataFrame, ab: DataFrame, second: bool = True) -> DataFrame:
    """(u, v, blk, near, one, two) of the asked pairs: v's neighbours other than u, and which of the word's ids are one and
    two steps from u."""
    adj = G.adjacency(ab)
    own = G.cut(words(adj))
    asked = queries.select("u", "v").distinct()
    near = asked.join(own.select(F.col("n").alias("v"), "blk", F.col("bits").alias("near")), "v")
    near = near.withColumn("near", without(F.col("near"), F.col("blk"), F.col("u"))).filter("near <> 0")
    out = near.join(own.select(F.col("n").alias("u"), "blk", F.col("bits").alias("one")), ["u", "blk"], "left")
    if second:
        out = out.join(two_steps(asked, adj, own), ["u", "blk"], "left")
    else:
        out = out.withColumn("two", F.lit(None).cast("long"))
    zero = F.lit(0).cast("long")
    return out.select("u", "v", "blk", "near", F.coalesce("one", zero).alias("one"), F.coalesce("two", zero).alias("two"))


def shared_words(queries: DataFrame, ab: DataFrame) -> DataFrame:
    """(u, v, blk, both): words of the ids that both ends of the asked pairs have as neighbours, those with some.

    A pair takes the words of its end with fewer of them and looks these up at its other end, so a pair with a hub is as
    many rows as its other end has words.
    """
    return met_words(queries.select("u", "v").distinct(), G.cut(words(G.adjacency(ab))))


def met_words(asked: DataFrame, own: DataFrame) -> DataFrame:
    """(u, v, blk, both): of the different pairs ``asked`` (u, v), words of the ids that both ends have in ``own`` (n, blk, bits)."""
    held = own.groupBy("n").agg(F.count("*").alias("c"))
    for side in ("u", "v"):
        asked = asked.join(held.select(F.col("n").alias(side), F.col("c").alias(f"_{side}")), side)
    few, many = F.struct("_u", "u"), F.struct("_v", "v")
    ends = asked.select("u", "v", F.when(few <= many, F.col("u")).otherwise(F.col("v")).alias("_few"), F.when(few <= many, F.col("v")).otherwise(F.col("u")).alias("_many"))
    told = ends.join(own.select(F.col("n").alias("_few"), "blk", F.col("bits").alias("_bits")), "_few")
    met = told.join(own.select(F.col("n").alias("_many"), "blk", F.col("bits").alias("both")), ["_many", "blk"])
    return met.select("u", "v", "blk", F.col("_bits").bitwiseAND(F.col("both")).alias("both")).filter("both <> 0")


def members(rows: DataFrame, bits: Column, name: str = "w") -> DataFrame:
    """A row for each id of ``bits``, as ``name``."""
    places = F.filter(F.sequence(F.lit(0), F.lit((1 << SHIFT) - 1)), lambda i: F.getbit(bits, i) == 1)
    return rows.withColumn("_at", F.explode(places)).withColumn(name, F.shiftleft("blk", SHIFT) + F.col("_at")).drop("_at")


class Twins:
    """A graph with one node, the least, for all nodes that have the same neighbours.

    Twins are never linked, and a node's neighbours are whole classes of them, so what a pair's neighbours add up to is
    found once for each pair of classes: ``rep`` is (n, rep), ``ab`` the edges between classes.  Neighbours are compared by their
    number and two hashes of 64 bits.
    """

    def __init__(self, ab: DataFrame):
        adj = G.adjacency(ab)
        sign = ("c", "h1", "h2")
        hashed = adj.groupBy("n").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("m")).alias("h1"), F.bit_xor(F.xxhash64("m", F.lit(1))).alias("h2"))
        hashed = G.cut(hashed)
        self.rep = G.cut(hashed.join(hashed.groupBy(*sign).agg(F.min("n").alias("rep")), list(sign)).select("n", "rep"))
        ends = self._named(ab.select("a", "b"), "a", "b")
        self.ab = G.cut(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())

    def _named(self, rows: DataFrame, *sides: str) -> DataFrame:
        for side in sides:
            rows = rows.join(self.rep.select(F.col("n").alias(side), F.col("rep").alias(f"_{side}")), side)
        return rows

    def asked(self, queries: DataFrame) -> DataFrame:
        """(u, v, ru, rv, linked): the distinct pairs of known nodes, their classes, and whether they are an edge."""
        rows = self._named(queries.select("u", "v").distinct(), "u", "v").select("u", "v", F.col("_u").alias("ru"), F.col("_v").alias("rv"))
        edge = self.ab.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("_e"))
        rows = rows.withColumn("_a", F.least("ru", "rv")).withColumn("_b", F.greatest("ru", "rv")).join(edge, ["_a", "_b"], "left")
        return G.cut(rows.select("u", "v", "ru", "rv", F.coalesce("_e", F.lit(False)).alias("linked")))

    def pairs(self, asked: DataFrame, linked: bool) -> DataFrame:
        """(u, v): the distinct pairs of classes of ``asked``, those that are an edge or those that are none."""
        return asked.filter(F.col("linked") == linked).select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()

    def totals(self, nodes: DataFrame, aggs: list[Column]) -> DataFrame:
        """(node, aggs): ``aggs`` over each class of ``nodes`` (node, ...)."""
        return nodes.join(self.rep.withColumnRenamed("n", "node"), "node").groupBy("rep").agg(*aggs).withColumnRenamed("rep", "node")

    def around(self, totals: DataFrame, names: list[str]) -> DataFrame:
        """(rv, names): sums of ``totals`` over all neighbours of a class."""
        near = G.adjacency(self.ab).select(F.col("n").alias("rv"), F.col("m").alias("node")).join(totals, "node")
        return near.groupBy("rv").agg(*[F.sum(c).alias(c) for c in names])


def pair_counts(queries: DataFrame, ab: DataFrame, values: DataFrame) -> DataFrame:
    """(u, v, cn, bridge, bridge_value) of the asked pairs, whole numbers: common neighbours, v's neighbours other than u that are
    two steps from u, and the sum of these nodes' ``values`` (node, value).

    All neighbours of v are two steps from u where (u, v) is an edge, so nothing is looked up then but v's sums.  Words
    are joined for the other pairs, once for all twins, or met in tiles where they are many (``tiles``).
    """
    from . import tiles

    twins = Twins(ab)
    asked = twins.asked(queries)
    nodes = twins.rep.select(F.col("n").alias("node")).join(values, "node", "left").select("node", F.lit(1).cast("long").alias("one_"), F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("value_"))
    totals = G.cut(twins.totals(nodes, [F.sum("one_").alias("one_"), F.sum("value_").alias("value_")]))
    sizes = Planes(totals.select("node", F.col("one_").alias("value")), "_s")
    sums = Planes(totals.select("node", F.col("value_").alias("value")), "_v")
    met = sizes.join(shared_words(twins.pairs(asked, True), twins.ab)).groupBy(F.col("u").alias("ru"), F.col("v").alias("rv")).agg(F.sum(sizes.total(F.col("both"))).alias("cn"))
    near = asked.filter("linked").join(twins.around(totals, ["one_", "value_"]), "rv").join(nodes.select(F.col("node").alias("u"), F.col("value_").alias("own")), "u")
    near = near.join(met, ["ru", "rv"], "left").select("u", "v", F.coalesce("cn", F.lit(0)).alias("cn"), (F.col("one_") - 1).alias("bridge"), (F.col("value_") - F.col("own")).alias("bridge_value"))
    strangers = G.cut(twins.pairs(asked, False))
    if tiles.word_rows(strangers, twins.ab) > tiles.MOST_ROWS:
        far = tiles.sums(strangers, twins.ab, totals, {"cn": ["one_"], "met": [], "br": ["one_", "value_"]})
        far = far.select(F.col("u").alias("ru"), F.col("v").alias("rv"), F.col("cn_one_").alias("cn"), F.col("br_one_").alias("bridge"), F.col("br_value_").alias("bridge_value"))
    else:
        direct, two = (F.col("near").bitwiseAND(F.col(c)) for c in ("one", "two"))
        far = sums.join(sizes.join(pair_words(strangers, twins.ab))).groupBy(F.col("u").alias("ru"), F.col("v").alias("rv"))
        far = far.agg(F.sum(sizes.total(direct)).alias("cn"), F.sum(sizes.total(two)).alias("bridge"), F.sum(sums.total(two)).alias("bridge_value"))
    out = near.unionByName(asked.filter(~F.col("linked")).join(far, ["ru", "rv"]).select(*near.columns))
    return queries.select("u", "v").distinct().join(out, ["u", "v"], "left").na.fill(0, ["cn", "bridge", "bridge_value"])


class Planes:
    """Binary digits of whole, non-negative node values (node, value): per word one set of ids a digit."""

    def __init__(self, values: DataFrame, name: str = "_p"):
        """``name`` begins the columns' names, to tell several apart that are joined to the same rows."""
        self.name = name
        top = values.agg(F.max("value")).first()[0] or 0
        self.digits = max(1, int(top).bit_length())
        digit = lambda j: F.bit_or(F.when(F.getbit(F.col("value").cast("long"), F.lit(j)) == 1, bit("node")).otherwise(F.lit(0).cast("long")))
        self.rows = values.groupBy(block("node").alias("blk")).agg(*[digit(j).alias(f"{name}{j}") for j in range(self.digits)])

    def join(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.rows, "blk", "left")

    def total(self, bits: Column) -> Column:
        """Sum of the values of the ids in ``bits`` of a joined row."""
        out = F.lit(0).cast("long")
        for j in range(self.digits):
            out = out + F.bit_count(bits.bitwiseAND(F.coalesce(F.col(f"{self.name}{j}"), F.lit(0).cast("long")))).cast("long") * F.lit(1 << j)
        return out
