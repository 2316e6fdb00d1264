"""Interaction histories of nodes, as windows over the undirected interaction table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.order import numbered
from .graph import cut
from .rolling import as_of


TASK_ROWS = 50_000  #: so many interactions, with their trees, go to one task; with more, there are more tasks


def _tasks(edges: DataFrame) -> int:
    """How many tasks to deal interactions and their trees out to, so that none grows with the stream."""
    return max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // TASK_ROWS))


def interactions(edges: DataFrame) -> DataFrame:
    """(node, nbr, seq, t): each interaction from both ends; repeats are kept."""
    one = edges.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "seq", "t")
    return one.union(edges.select(F.col("v").alias("node"), F.col("u").alias("nbr"), "seq", "t"))


def last_k(edges: DataFrame, k: int | None, tasks: int | None = None) -> DataFrame:
    """(node, nbr, seq, t, hist): the ``k`` interactions of the node strictly before this one, oldest
    first; all of them for ``k`` of None.  Histories are read along the stream, one sort per node, by so many ``tasks``."""
    frame = W.partitionBy("node").orderBy("seq").rowsBetween(-k if k else W.unboundedPreceding, -1)
    rows = interactions(edges)
    rows = rows.repartition(tasks, "node") if tasks else rows
    return rows.withColumn("hist", F.collect_list(F.struct("seq", "t", "nbr")).over(frame))


def whole_past(edges: DataFrame) -> DataFrame:
    """(node, nbr, seq, t, n, total, oldest): size, sum of neighbours and first neighbour of all that is
    strictly before, as running aggregates; no prefix is copied."""
    past = W.partitionBy("node").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return interactions(edges).select("*", F.count("*").over(past).alias("n"), F.coalesce(F.sum("nbr").over(past), F.lit(0)).alias("total"), F.first("nbr").over(past).alias("oldest"))


def uniform_draws(edges: DataFrame, k: int, stride: int = 7919, step: int = 104729) -> DataFrame:
    """(node, seq, j, nbr): ``k`` draws with replacement from all that is strictly before.

    Interactions are numbered per node and drawn places are joined on (node, place), so a draw costs
    one row whatever the length of the past.  Draw j takes place (seq * stride + j * step) mod its length.
    """
    rows = interactions(edges).withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("seq")) - 1)
    asked = rows.filter("place > 0").select("node", "seq", F.col("place").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    asked = asked.select("node", "seq", "j", ((F.col("seq") * stride + F.col("j") * step) % F.col("n")).cast("int").alias("place"))
    return asked.join(rows.select("node", "place", "nbr"), ["node", "place"]).select("node", "seq", "j", "nbr")


def time_aware_draws(edges: DataFrame, k: int, scale: float, stride: int = 7919, step: int = 104729, grain: int = 1_000_003) -> DataFrame:
    """(node, seq, j, nbr): ``k`` draws with replacement from all that is strictly before, by weights of recency.

    Interaction i of a node has p_i = exp(scale * t_i) over the sum of the same up to i, and weighs exp(p_i).  The sum is
    carried relative to the latest term, S_i = 1 + S_(i-1) * exp(scale * (t_(i-1) - t_i)), so old ones do not underflow.
    Weights add up along a node; draw j takes the interaction in whose part of the sum the place
    ((seq * stride + j * step) mod grain) / grain of what is before falls: one as-of join of draws with sums.
    """

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, last, near, total = None, 0, 0.0, 0.0
        for pdf in parts:
            begins = []
            for key, t in zip(pdf["node"].tolist(), pdf["t"].tolist()):
                if key != node:
                    node, near, total = key, 1.0, 0.0
                else:
                    near = 1.0 + near * math.exp(scale * (last - t))
                begins.append(total)
                total, last = total + math.exp(1.0 / near), t
            yield pdf[["node", "seq", "nbr"]].assign(begin=begins)

    rows = interactions(edges).filter("node <> nbr").repartition("node").sortWithinPartitions("node", "seq", "nbr")
    sums = cut(rows.mapInPandas(add_up, "node long, seq long, nbr long, begin double"))
    place = ((F.col("seq") * stride + F.col("j") * step) % grain).cast("double") / grain
    asked = sums.filter("begin > 0").select("node", "seq", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"), "begin")
    asked = asked.select("node", "seq", "j", (place * F.col("begin")).alias("at"))
    return as_of(asked, sums, ["node"], "at", "begin", ["nbr"], strict=False).select("node", "seq", "j", "nbr")


def peer_flags(values: Column, other: Column) -> Column:
    """1 for each entry of ``values`` that is in ``other``, else 0; 0 for padding."""
    return F.transform(values, lambda x: F.when((x != 0) & F.array_contains(other, x), F.lit(1)).otherwise(F.lit(0)))


def mask_padding(values: Column, ids: Column) -> Column:
    """``values`` with 0 where the id beside is padding."""
    return F.zip_with(values, ids, lambda x, i: F.when(i == 0, F.lit(0).cast("double")).otherwise(x))


def recent_pool(edges: DataFrame, features: DataFrame, gap: int) -> DataFrame:
    """(node, seq, pooled): mean over the last ``gap`` places of the neighbours' ``x`` (node, x), where places
    that have no neighbour count as 0 and softmax weights of the others are their share, so the sum is over
    present neighbours' mean, scaled by 1 / ``gap``; the node's own x is added.  A neighbour's x comes to its interaction
    once, before the places that it is then in."""
    x = features.select(F.col("node").alias("nbr"), F.coalesce("x", F.lit(0.0)).alias("_x"))
    frame = W.partitionBy("node").orderBy("seq").rowsBetween(-gap, -1)
    pool = F.sum(F.coalesce("_x", F.lit(0.0))).over(frame) / F.greatest(F.count("nbr").over(frame), F.lit(1)) / gap
    mean = interactions(edges).join(x, "nbr", "left").select("node", "seq", pool.alias("pool"))
    return mean.join(features, "node", "left").select("node", "seq", (F.coalesce("pool", F.lit(0.0)) + F.coalesce("x", F.lit(0.0))).alias("pooled"))


def multi_hop(edges: DataFrame, k: int, hops: int) -> DataFrame:
    """(root, seq, walk): walks of up to ``hops`` steps back in time from each interaction's node.

    Each step takes one of the last ``k`` interactions strictly before the one that led there; a walk
    is an array of (nbr, seq), and every walk's prefix is a walk, too.
    """
    h = last_k(edges, k).select(F.col("node").alias("at"), F.col("seq").alias("at_seq"), "hist")
    start = h.select(F.col("at").alias("root"), F.col("at_seq").alias("seq"), F.explode("hist").alias("x"))
    level = start.select("root", "seq", F.array(F.struct("x.nbr", F.col("x.seq").alias("seq"))).alias("walk"))
    out = level
    for _ in range(hops - 1):
        last = F.element_at("walk", -1)
        level = level.select("*", last["nbr"].alias("at"), last["seq"].alias("at_seq")).join(h, ["at", "at_seq"])
        level = level.select("root", "seq", "walk", F.explode("hist").alias("x"))
        level = level.select("root", "seq", F.concat("walk", F.array(F.struct("x.nbr", F.col("x.seq").alias("seq")))).alias("walk"))
        out = out.union(level)
    return out


def trees(edges: DataFrame, k: int, hops: int) -> DataFrame:
    """(root, seq, hop, slot, node, at): the nodes of each interaction's tree of up to ``hops`` steps back in time.

    A node's children are its last ``k`` interactions strictly before the one at ``at`` that led to it, in slots
    ``slot`` * k + place, so hop h has k ** h slots; those without an interaction have no row.  ``edges`` has no self loops.
    """
    tasks = _tasks(edges)
    h = last_k(edges, k, tasks).select(F.col("node").alias("of"), F.col("seq").alias("of_seq"), F.posexplode("hist").alias("place", "x"))
    h = h.select("of", "of_seq", "place", F.col("x.nbr").alias("node"), F.col("x.seq").alias("at"))
    level = h.select(F.col("of").alias("root"), F.col("of_seq").alias("seq"), F.lit(1).alias("hop"), F.col("place").cast("long").alias("slot"), "node", "at")
    out = level
    for hop in range(2, hops + 1):
        up = level.select("root", "seq", "slot", F.col("node").alias("of"), F.col("at").alias("of_seq"))
        level = up.repartition(tasks, "of", "of_seq").join(h.repartition(tasks, "of", "of_seq"), ["of", "of_seq"])
        level = level.select("root", "seq", F.lit(hop).alias("hop"), (F.col("slot") * k + F.col("place")).alias("slot"), "node", "at")
        out = out.union(level)
    return out


def landing(edges: DataFrame, k: int, hops: int) -> DataFrame:
    """(seq, node, u, v): how likely walks of each length (0 .. ``hops``) from either end of an interaction land on a
    node: at each hop the share of all slots, those without an interaction included, that hold it.

    Nodes are told apart by id within an interaction; ``trees`` has their times.
    """
    tasks = _tasks(edges)
    below = trees(edges, k, hops).select("root", "seq", "hop", "node")
    roots = interactions(edges).select(F.col("node").alias("root"), "seq", F.lit(0).alias("hop"), "node")
    share = F.lit(1.0) / F.pow(F.lit(float(k)), F.col("hop"))
    ends = edges.select("seq", "u", "v").repartition(tasks, "seq")
    found = roots.union(below).repartition(tasks, "seq").join(ends, "seq").withColumn("p", share)
    side = lambda c: F.array(*[F.sum(F.when((F.col("root") == F.col(c)) & (F.col("hop") == h), F.col("p")).otherwise(0.0)) for h in range(hops + 1)])
    return found.groupBy("seq", "node").agg(side("u").alias("pu"), side("v").alias("pv")).select("seq", "node", F.col("pu").alias("u"), F.col("pv").alias("v"))


def last_edges(edges: DataFrame, k: int) -> DataFrame:
    """(node, nbr, seq, local): each node's last ``k`` interactions, an edge once per node, with nodes
    numbered densely among those that occur (``local``)."""
    latest = F.row_number().over(W.partitionBy("node").orderBy(F.desc("seq"), "nbr"))
    held = interactions(edges).dropDuplicates(["node", "nbr", "seq"]).withColumn("r", latest).filter(F.col("r") <= k).drop("r", "t")
    ids = held.select("node").union(held.select("nbr")).distinct()
    local = numbered(ids, ["node"], "local", 0)
    return held.join(local, "node")


def hashed_sample(edges: DataFrame, k: int, salt: int = 0) -> DataFrame:
    """(node, nbr, seq): at most ``k`` interactions of each node, drawn without replacement by an arithmetic hash."""
    order = W.partitionBy("node").orderBy((F.col("seq") * 7919 + F.lit(salt) * 104729) % 1_000_003, "seq", "nbr")
    return interactions(edges).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("node", "nbr", "seq")


def biased_sample(edges: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Edges that touch ``nodes`` (node), thinned evenly to about ``size`` times their number by hash; a
    node with many edges keeps many, which is the bias."""
    touching = edges.join(nodes.select(F.col("node").alias("u"), F.lit(1).alias("a")), "u", "left").join(nodes.select(F.col("node").alias("v"), F.lit(1).alias("b")), "v", "left").filter("a is not null or b is not null").select(edges.columns)
    share = touching.agg(F.count("*").alias("have")).join(F.broadcast(nodes.agg((F.count("*") * size).alias("want")))).select((F.col("want") / F.greatest("have", F.lit(1))).alias("share"))
    return touching.join(F.broadcast(share)).filter(F.pmod(F.col("seq") * 7919, F.lit(1_000_003)) < F.col("share") * 1_000_003).select(edges.columns)


def slots(edges: DataFrame, k: int) -> DataFrame:
    """(seq, slot, u, v): each interaction's peer ``u`` and the node ``v`` in each slot, oldest first from 1, of its source's last ``k``."""
    h = last_k(edges, k).select(F.col("node").alias("s"), "seq", F.col("hist.nbr").alias("nb")).distinct()
    rows = edges.select("seq", F.col("u").alias("s"), F.col("v").alias("u")).join(h, ["s", "seq"]).select("seq", "u", F.posexplode("nb").alias("slot", "v"))
    return rows.select("seq", (F.col("slot") + 1).alias("slot"), "u", "v")


def slot_features(edges: DataFrame, k: int, provider: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(seq, slot, features): what ``provider`` says of each slot's pair.

    The provider maps the distinct pairs (u, v) of all slots to one row of features for each; pairs that it leaves out
    have null features.
    """
    held = cut(slots(edges, k))
    found = provider(held.select("u", "v").distinct())
    return held.join(found, ["u", "v"], "left").drop("u", "v")


def pad_left(values: Column, k: int) -> Column:
    """Right-aligned in ``k`` places, zeros in front."""
    return F.concat(F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(k) - F.size(values))), values)


def pad_sequence(own: Column, values: Column, length: int, patch: int) -> Column:
    """The node itself and its latest ``length`` - 1 neighbours, zero-padded on the right to a
    multiple of ``patch``."""
    kept = F.concat(F.array(own), F.when(F.size(values) > length - 1, F.slice(values, -(length - 1), length - 1)).otherwise(values))
    need = F.ceil(F.size(kept) / F.lit(patch)).cast("int") * patch - F.size(kept)
    return F.concat(kept, F.array_repeat(F.lit(0).cast("long"), need))


def counts_in(values: Column, other: Column) -> Column:
    """How often each entry of ``values`` occurs in ``other``; 0 for padding."""
    return F.transform(values, lambda x: F.when(x == 0, F.lit(0)).otherwise(F.size(F.filter(other, lambda y: y == x))))


def time_encoding(seconds: Column, dim: int) -> Column:
    """cos(t * 10^(-9 i / (dim - 1))) for i = 0 .. dim - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.cos(seconds * F.pow(F.lit(10.0), -9.0 * i / (dim - 1))))
