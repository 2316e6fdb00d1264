"""Mixing sources to target weights along a time-varying curriculum.

1. Sizes are summed per source and per slice of a hashed order.
2. Water filling turns weights into token targets, none above ``max_repeat`` times
   its source.
3. Every source is read pass by pass in hashed order, so a document is taken 0 to
   ``max_repeat`` times.  The last pass takes what lies before the target as a whole, and
   what is missing is filled by later documents, as many of the largest that fit first.
4. Each source has a schedule of relative weights over training time.  Its integral is
   the cumulative demand; inverting it at the place of a copy gives the copy's training
   position, and a range sort by position gives the training order.

Only DataFrame functions are used.  A running sum over a hot source is a sum over at
most ``16 ** HEX`` slices plus a window inside one slice, so no task holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table, word_count

#: Slices of a source's hashed order: hex digits of the key.
HEX = 3
#: Relative weight at equally spaced points of training time; sources take one in turn.
SCHEDULES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5))


def invert_schedule(weights: Sequence[float], share: Column) -> Column:
    """Training time in [0, 1] at which a piecewise linear schedule has asked for
    ``share`` (0 to 1) of its whole demand."""
    n = len(weights) - 1
    areas = [(weights[i] + weights[i + 1]) / 2 / n for i in range(n)]
    total, before, out = sum(areas), 0.0, None
    for i, area in enumerate(areas):
        a, b = weights[i], weights[i + 1]
        need = share * F.lit(total) - F.lit(before)  # area asked for inside this piece
        slope = (b - a) * n
        inside = need / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * need, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        here = F.lit(i / n) + inside
        before += area
        last = i == n - 1
        cond = share * F.lit(total) <= F.lit(before)
        out = F.when(cond, here) if out is None else (out.otherwise(here) if last else out.when(cond, here))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """(src, source_size) -> also src_no, weight, target.  One row per source.

    Sources capped at ``max_repeat`` times their size come first in the order of
    cap / weight; the level that the others share is the largest one over all prefixes.
    """
    by_name, all_rows = W.orderBy("src"), W.partitionBy()
    out = sizes.withColumn("src_no", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("src_no") % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("cap", F.col("source_size") * F.lit(int(max_repeat)))
    rising = W.orderBy(F.col("cap") / F.col("weight"), "src")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(rising.rowsBetween(0, W.unboundedFollowing))
    out = out.withColumn("level", (F.sum("source_size").over(all_rows) - before).cast("double") / left)
    out = out.withColumn("level", F.max("level").over(all_rows))
    return out.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).drop("cap", "level")


def fill_border(placed: DataFrame) -> DataFrame:
    """(src, picks): which later documents of each source fill its last pass, as an array of (size, key, before): of
    each of these sizes all documents up to that place in the order of (key, before), or all where it is null.

    ``placed`` is (src, slice, key, size, before, left), ``left`` the words that the last pass lacks.  Its first
    documents up to that fit as they come.  The others are counted by size, and sizes are gone through from the largest:
    of each, as many are taken as fit.  At last one more of the smallest size that is left, which is too large, is taken
    if the source is nearer its target with it.  A source's picks have fewer different sizes than the root of twice
    the size of its largest document, as they add up to less than that.
    """
    fits = F.col("before") + F.col("size") <= F.col("left")
    gaps = placed.groupBy("src").agg((F.max("left") - F.coalesce(F.max(F.when(fits, F.col("before") + F.col("size"))), F.lit(0))).alias("gap"))
    later = materialize(placed.filter(~fits & (F.col("size") > 0)).drop("left"), "mix-later")
    counted = later.groupBy("src", "size").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))  # as many as there are different sizes
    none = F.array().cast("array<struct<size:bigint,n:bigint,m:bigint>>")

    def take(acc: Column, x: Column) -> Column:
        m = F.least(x["n"], F.floor(acc["gap"] / x["size"]).cast("long"))
        one = F.struct(x["size"].alias("size"), x["n"].alias("n"), m.alias("m"))
        return F.struct((acc["gap"] - (m * x["size"]).cast("double")).alias("gap"), F.array_append(acc["all"], one).alias("all"))

    found = gaps.join(sizes, "src").withColumn("done", F.aggregate("sizes", F.struct(F.col("gap").cast("double").alias("gap"), none.alias("all")), take))
    over = F.filter("done.all", lambda x: x["m"] < x["n"])
    least = F.get(over, F.size(over) - 1)["size"]
    more = lambda x: F.when((x["size"] == least) & (least < 2 * F.col("done.gap")), x["m"] + 1).otherwise(x["m"])
    taken = found.select("src", F.explode(F.transform("done.all", lambda x: F.struct(x["size"].alias("size"), x["n"].alias("n"), more(x).alias("m")))).alias("x")).select("src", "x.*").filter("m > 0")
    taken = materialize(taken, "mix-taken")

    part = later.join(taken.filter("m < n").drop("n"), ["src", "size"])
    slices = part.groupBy("src", "size", "slice").agg(F.count("*").alias("c"))
    base = F.sum("c").over(W.partitionBy("src", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    slices = slices.select("src", "size", "slice", F.coalesce(base, F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("src", "size", "slice").orderBy("key", "before"))
    ends = part.withColumn("inside", inside).join(slices, ["src", "size", "slice"]).filter(F.col("base") + F.col("inside") == F.col("m")).select("src", "size", "key", "before")
    whole = taken.filter("m = n").select("src", "size", F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("before"))
    return ends.unionByName(whole).groupBy("src").agg(F.collect_list(F.struct("size", "key", "before")).alias("picks"))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    max_repeat: int = 3,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """One row per document: ``row`` (struct of the columns in ``keep``, by default all),
    size, source_size, target, taken, and ``positions`` (training times of its copies).

    Null or empty text: size 0, never taken.  Null source: a source of its own, last.
    Null or repeated ids, repeated rows: each row counts; the order is that of an MD5 of
    id and size, so reruns agree.  Empty table: empty result.  Other columns, whatever
    their names, stay inside ``row``.
    """
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), word_count(F.col(text_col)).cast("string")))
    sized = docs.select(
        F.struct(*[F.col(c) for c in (keep or docs.columns)]).alias("row"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")).alias("src"),
        word_count(F.col(text_col)).alias("size"),
        key.alias("key"),
    ).withColumn("slice", F.substring("key", 1, HEX))
    lean = materialize(sized.drop("row"), "mix-sized")  # texts are not written once more; what they are measured by is

    slices = lean.groupBy("src", "slice").agg(F.sum("size").alias("slice_size"))
    slices = slices.withColumn("base", F.coalesce(F.sum("slice_size").over(W.partitionBy("src").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    totals = lean.groupBy("src").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, max_repeat)
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("left", F.col("target") - (F.col("passes") * F.col("source_size")).cast("double"))
    slices = materialize(slices.join(targets, "src").drop("slice_size"), "mix-slices")

    inside = W.partitionBy("src", "slice").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)

    def placed(rows: DataFrame, about: DataFrame) -> DataFrame:
        """Rows with the words before them in their source, and what is known of it."""
        out = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        return out.join(about, ["src", "slice"]).withColumn("before", F.col("before") + F.col("base"))

    picks = fill_border(placed(lean, slices).select("src", "slice", "key", "size", "before", "left"))
    out = placed(sized, slices.join(picks, "src", "left"))

    # Copy k of a document lies at k * source_size + before.
    start = [F.col("before") + F.col("source_size") * k for k in range(max_repeat)]
    share = [F.when(F.col("target") > 0, F.least(s / F.col("target"), F.lit(1.0))) for s in start]
    here = F.struct("key", "before")
    picked = F.exists("picks", lambda x: (x["size"] == F.col("size")) & (x["key"].isNull() | (here <= F.struct(x["key"].alias("key"), x["before"].alias("before")))))
    border = (F.col("before") + F.col("size") <= F.col("left")) | F.coalesce(picked, F.lit(False))
    taken = [(F.col("size") > 0) & ((F.col("passes") > k) | ((F.col("passes") == k) & border)) for k in range(max_repeat)]
    place = []
    for q in share:
        cases = None
        for i, s in enumerate(schedules):
            cond = F.col("src_no") % len(schedules) == i
            cases = F.when(cond, invert_schedule(s, q)) if cases is None else cases.when(cond, invert_schedule(s, q))
        place.append(cases)
    positions = F.filter(F.array(*[F.when(t, p) for t, p in zip(taken, place)]), lambda x: x.isNotNull())
    return out.select("row", "size", "source_size", "target", positions.alias("positions"), "key").withColumn("taken", F.size("positions") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per copy, range-sorted by training position."""
    plan = plan_mix(docs, **options)
    out = plan.select("row", "key", F.explode("positions").alias("position"))
    return out.orderBy("position", "key").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = plan_mix(docs, keep=["doc_id"])
    out = plan.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.round(F.get("positions", F.lit(0)), 9).alias("position"), "key")
    return out.orderBy(F.col("position").asc_nulls_last(), "key").drop("key")
