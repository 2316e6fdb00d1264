"""Negative sampling by integer arithmetic, so that draws repeat and SQL can state them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.order import numbered
from .graph import cut
from .rolling import as_of

STRIDE, STEP = 7919, 104729


def pool(values: DataFrame) -> DataFrame:
    """(value, place): distinct values numbered from 0 in their order."""
    return numbered(values.select("value").distinct(), ["value"], "place", 0)


def draw(rows: DataFrame, pool_: DataFrame, key: Column, n: int) -> DataFrame:
    """``n`` draws with replacement for each row: the pool's value at (key * 7919 + j * 104729) mod its size."""
    size = pool_.agg(F.count("*").alias("_size"))
    asked = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(F.broadcast(size))
    asked = asked.withColumn("place", (key * STRIDE + F.col("j") * STEP) % F.col("_size")).drop("_size")
    return asked.join(pool_, "place").drop("place").withColumnRenamed("value", "neg")


def draw_free(asked: DataFrame, pool_: DataFrame, taken: list[tuple[DataFrame, list[str]]], keys: list[str]) -> DataFrame:
    """(keys, j, neg): each row's first ``need`` draws without replacement that are not ``taken``.

    ``asked`` has the keys, ``salt`` and ``need``; ``taken`` is a list of (table with ``neg``, the
    columns of ``asked`` that it shares).  Draw j of a row is the pool's place (salt * 7919 + j * 104729)
    mod its size, which passes every place once before any comes again.  Draws are made in
    rounds of twice what is missing, and twice as many times that in each further round: a row costs about its need,
    and the rounds grow with the logarithm of the pool where nearly all of it is taken.
    """
    size = pool_.count()
    if not size:
        return asked.limit(0).select(*keys, F.lit(0).alias("j"), F.lit(None).cast("long").alias("neg"))
    step = STEP if size % STEP else STRIDE
    rest = asked.withColumn("from", F.lit(0))
    taken = [(cut(table.select(*on, "neg").distinct()), on) for table, on in taken]
    out, times = None, 2
    while True:
        upto = F.least(F.col("from") + times * F.col("need").cast("long"), F.lit(size)).cast("int")
        wide = F.explode(F.sequence(F.col("from"), upto - 1))
        tries = rest.filter((F.col("need") > 0) & (F.col("from") < size)).withColumn("j", wide)
        tries = tries.withColumn("place", (F.col("salt") * STRIDE + F.col("j") * step) % size).join(pool_, "place").withColumnRenamed("value", "neg")
        for table, on in taken:
            tries = tries.join(table, [*on, "neg"], "left_anti")
        found = tries.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("j"))).filter("r <= need").select(*keys, "j", "neg")
        found = cut(found)
        out = found if out is None else out.union(found)
        got = found.groupBy(*keys).agg(F.count("*").alias("got"))
        rest = rest.join(got, keys, "left").withColumn("from", upto).withColumn("need", F.col("need") - F.coalesce("got", F.lit(0))).drop("got")
        rest = cut(rest.filter((F.col("need") > 0) & (F.col("from") < size)))
        times *= 2
        if rest.limit(1).count() == 0:
            return out


def nth_free(asked: DataFrame, taken: DataFrame, keys: list[str], nth: str, place: str) -> DataFrame:
    """``asked`` with the ``nth`` (from 0) of the places 0, 1, 2 .. that its keys have not ``taken``, as ``place``.

    ``taken`` is (keys, place).  Before its i-th taken place p (from 0) a key has p - i free ones, so the answer
    is ``nth`` and the number of taken places with p - i <= nth: one as-of join, whatever is taken.
    """
    order = W.partitionBy(*keys).orderBy(place)
    before = taken.select(*keys, place).distinct().withColumn("_i", F.row_number().over(order))
    steps = before.select(*keys, (F.col(place) - F.col("_i") + 1).alias("_free"), F.col("_i"))
    last = steps.groupBy(*keys, "_free").agg(F.max("_i").alias("_i"))
    found = as_of(asked, last, keys, nth, "_free", ["_i"], strict=False)
    return found.withColumn(place, (F.col(nth) + F.coalesce("_i", F.lit(0))).cast("long")).drop("_i")


def random_pairs(rows: DataFrame, sources: DataFrame, targets: DataFrame, key: Column) -> DataFrame:
    """``rows`` with ``neg_u`` and ``neg_v``, drawn independently from two pools by place.  Their product is never built."""
    sizes = sources.agg(F.count("*").alias("_s")).join(F.broadcast(targets.agg(F.count("*").alias("_t"))))
    asked = rows.join(F.broadcast(sizes)).withColumn("_ps", (key * STRIDE) % F.col("_s")).withColumn("_pt", (key * STEP) % F.col("_t")).drop("_s", "_t")
    return asked.join(sources.select(F.col("place").alias("_ps"), F.col("value").alias("neg_u")), "_ps").join(targets.select(F.col("place").alias("_pt"), F.col("value").alias("neg_v")), "_pt").drop("_ps", "_pt")


def free_pairs(rows: DataFrame, sources: DataFrame, targets: DataFrame, key: Column, taken: DataFrame) -> DataFrame:
    """``rows`` with a pair of the pools that is not ``taken`` (u, v), for every row.

    The source is drawn among those that are not linked to all targets, the target among the source's
    free places, which are numbered and not tried: a dense graph costs no more than a sparse one.  If all
    pairs are taken, both columns are null.
    """
    held = taken.select("u", "v").distinct().join(targets.select(F.col("value").alias("v"), "place"), "v").select("u", "place")
    n = targets.count()
    full = held.groupBy("u").agg(F.count("*").alias("held"))
    able = sources.select(F.col("value").alias("u")).join(full, "u", "left").select("u", (F.lit(n) - F.coalesce("held", F.lit(0))).alias("free")).filter("free > 0")
    able = cut(numbered(able, ["u"], "place", 0))
    size = able.count()
    asked = rows.withColumn("_k", key)
    if not size:
        return asked.drop("_k").withColumn("neg_u", F.lit(None).cast("long")).withColumn("neg_v", F.lit(None).cast("long"))
    asked = asked.withColumn("_s", (F.col("_k") * STRIDE) % size).join(able.select(F.col("place").alias("_s"), F.col("u").alias("neg_u"), "free"), "_s")
    # With the quotient, so that sources and places that share a divisor do not go together.
    turn = F.col("_k") * STEP + F.floor(F.col("_k") / F.lit(size)) * STRIDE
    asked = asked.withColumn("_nth", turn % F.col("free")).drop("_k", "_s", "free")
    found = nth_free(asked, held.withColumnRenamed("u", "neg_u"), ["neg_u"], "_nth", "place")
    return found.join(targets.select("place", F.col("value").alias("neg_v")), "place").select(*rows.columns, "neg_u", "neg_v")


def past_of(edges: DataFrame, size: int, observed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What batches of ``size`` may draw of the past: (n0, u, v), (batch, known, own, free) and (batch, n0).

    Distinct directed edges first seen after ``observed`` are numbered from 0 by first appearance.  A batch knows
    those first seen before it begins: the places below ``known``.  Those that it has itself are its ``own``, the
    third table; the pool of a batch is what is left, and is never copied.
    """
    rows = edges.select("seq", "u", "v", F.floor((F.col("seq") - 1) / F.lit(size)).cast("long").alias("batch"))
    first = rows.groupBy("u", "v").agg(F.min("seq").alias("at")).filter(F.col("at") > observed)
    last = edges.agg(F.max("seq")).first()[0] or 0
    # Edges and the batches' beginnings in one order: a beginning's place less its batch is how many edges are before it.
    marks = edges.sparkSession.range(0, -(-last // size)).select(F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v"), (F.col("id") * size + 1).alias("at"), F.lit(0).alias("kind"))
    line = numbered(marks.union(first.select("u", "v", "at", F.lit(1).alias("kind"))), ["at", "kind"], "p", 0)
    line = line.withColumn("batch", F.floor((F.col("at") - 1) / F.lit(size)).cast("long"))
    seen = line.filter("kind = 1").select((F.col("p") - F.col("batch") - 1).alias("n0"), "u", "v")
    known = line.filter("kind = 0").select("batch", (F.col("p") - F.col("batch")).alias("known"))
    own = rows.select("batch", "u", "v").distinct().join(seen.select("u", "v", "n0"), ["u", "v"]).join(known, "batch").filter("n0 < known").select("batch", "n0")
    own = cut(own)
    pools = known.join(own.groupBy("batch").agg(F.count("*").alias("own")), "batch", "left").select("batch", "known", F.coalesce("own", F.lit(0)).alias("own"))
    return seen, cut(pools.withColumn("free", F.col("known") - F.col("own"))), own


def past_pairs(edges: DataFrame, asked: DataFrame, size: int, observed: int = 0) -> DataFrame:
    """(seq, u, v, neg_u, neg_v, kind): an edge of the past for each of ``asked``, not one of its own batch.

    A row draws among the free places of its batch's pool (``historical``).  Where the pool is empty, it
    draws a pair of a source and a destination that its batch lacks (``random``); places of pairs are numbered
    too, so every row gets one unless its batch has all pairs, and its columns are null then.
    """
    seen, pools, own = past_of(edges, size, observed)
    batch = F.floor((F.col("seq") - 1) / F.lit(size)).cast("long")
    ask = asked.select("seq", "u", "v", batch.alias("batch")).join(pools.select("batch", "free"), "batch")
    drawn = nth_free(ask.filter("free > 0").withColumn("nth", (F.col("seq") * STRIDE) % F.col("free")), own, ["batch"], "nth", "n0")
    past = drawn.select("seq", "u", "v", "n0").join(seen.select("n0", F.col("u").alias("neg_u"), F.col("v").alias("neg_v")), "n0")
    sides = [pool(edges.select(F.col(c).alias("value"))) for c in ("u", "v")]
    s, t = (side.count() for side in sides)
    named = [side.select(F.col("value").alias(c), F.col("place").alias(f"p{c}")) for side, c in zip(sides, ("u", "v"))]
    held = edges.select(batch.alias("batch"), "u", "v").distinct().join(named[0], "u").join(named[1], "v").select("batch", (F.col("pu") * t + F.col("pv")).alias("pair"))
    empty = ask.filter("free = 0").join(held.groupBy("batch").agg(F.count("*").alias("held")), "batch").withColumn("left", F.lit(s * t) - F.col("held"))
    start = ((F.col("seq") * STRIDE) % s) * t + (F.col("seq") * STEP) % t
    fill = nth_free(empty.filter("left > 0").withColumn("nth", start % F.col("left")), held, ["batch"], "nth", "pair")
    fill = fill.withColumn("pu", F.floor(F.col("pair") / F.lit(t)).cast("long")).withColumn("pv", F.col("pair") % t)
    fill = fill.join(named[0].withColumnRenamed("u", "neg_u"), "pu").join(named[1].withColumnRenamed("v", "neg_v"), "pv")
    none = empty.filter("left <= 0").withColumn("neg_u", F.lit(None).cast("long")).withColumn("neg_v", F.lit(None).cast("long"))
    part = lambda rows, kind: rows.select("seq", "u", "v", "neg_u", "neg_v", F.lit(kind).alias("kind"))
    return part(past, "historical").union(part(fill, "random")).union(part(none, "random"))


def own_past(asked: DataFrame, past: DataFrame, true: DataFrame, k: int) -> DataFrame:
    """(seq, neg): at most ``k`` destinations, without replacement, that the source of a row (seq, t, u) has in ``past``
    (u, neg) and that are not ``true`` (t, u, neg) at the row's time.

    A source's destinations are numbered once.  A row passes over them in steps that visit every place, and as
    many as it can lose to true ones are drawn beyond ``k``; a hub's past is never copied to its rows.
    """
    numbered_ = cut(past.select("u", "neg").distinct().withColumn("place", F.row_number().over(W.partitionBy("u").orderBy("neg")) - 1))
    size = numbered_.groupBy("u").agg(F.count("*").alias("size"))
    lost = true.groupBy("t", "u").agg(F.count_distinct("neg").alias("lost"))
    rows = asked.select("seq", "t", "u").join(size, "u").join(lost, ["t", "u"], "left")
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.lit(k) + F.coalesce("lost", F.lit(0))).cast("int") - 1)))
    step = F.when(F.col("size") % STEP != 0, STEP).when(F.col("size") % STRIDE != 0, STRIDE).otherwise(1)
    rows = rows.withColumn("place", ((F.col("seq") * STRIDE + F.col("j") * step) % F.col("size")).cast("int"))
    free = rows.join(numbered_, ["u", "place"]).join(true.select("t", "u", "neg").distinct(), ["t", "u", "neg"], "left_anti")
    return free.withColumn("r", F.row_number().over(W.partitionBy("seq").orderBy("j"))).filter(F.col("r") <= k).select("seq", "neg")


def look_up(asked: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` with its rows of stored negatives; a key that has none is an error."""
    held = sets.select(*keys, "neg")
    joined = asked.join(held, keys, "left")
    miss = F.raise_error(F.concat(F.lit("no negatives for "), F.to_json(F.struct(*keys))))
    return joined.withColumn("neg", F.when(F.col("neg").isNull(), miss.cast("long")).otherwise(F.col("neg")))
