"""Cross-site boilerplate lines by distinct-site spread.

Each line hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by
aggregation, so a line on a third of all rows is one row per task in the shuffle.  Lines
whose estimate is clearly above ``min_sites`` are boilerplate; those near it get an exact
distinct count.  Boilerplate stays where it occurs first and goes everywhere else.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

MIN_SITES = 5
LG_K = 12  #: sketches of 4096 registers: 1.6 % standard error
NEAR = 0.1  #: estimates within this share of the threshold (one site at least) are counted exactly
SALT = 16  #: a line on many rows meets its verdict in as many parts
BLANKS = " \t\n\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _without(parts: Column, gone: Column) -> Column:
    """``parts`` without the places ``gone`` (ascending, from 0): the runs between them, in linear time."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(parts)))
    run = lambda i: F.slice(parts, F.get(ends, i) + 2, F.get(ends, i + 1) - F.get(ends, i) - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), run))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(k1, k2, first): line keys on at least ``min_sites`` sites, and their first occurrence.

    ``lines`` has k1, k2, site and ``at``, a struct that orders occurrences.
    """
    slack = max(1.0, NEAR * min_sites)
    seen = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("n"), F.min("at").alias("first"))
    seen = seen.filter(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch"))
    seen = materialize(seen.filter(F.col("sites") >= min_sites - slack).drop("sketch"), "line-spread")
    sure = seen.filter(F.col("sites") > min_sites + slack)
    near = seen.filter(F.col("sites") <= min_sites + slack)
    counted = lines.join(near.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2", "site").agg(F.lit(1).alias("one"))
    exact = counted.groupBy("k1", "k2").agg(F.count("*").alias("exact")).filter(F.col("exact") >= min_sites)
    return sure.select("k1", "k2", "first").union(near.join(exact, ["k1", "k2"]).select("k1", "k2", "first"))


def strip_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(row, text, n_lines, n_removed): ``row`` holds all columns of ``docs``, ``text`` what stays.

    Lines are split at newlines and compared without white space at their ends; lines of
    white space alone never count.  A null source is a site of its own.  The first
    occurrence is that of the least (id, text hash, line number), null ids last; rows equal
    in id and text are one document and keep the same lines.  Null and empty texts stay.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("site"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    line = F.btrim(F.col("line"), F.lit(BLANKS))
    lines = rows.select("id", "h", "site", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).withColumn("line", line).filter(F.col("line") != "")
    lines = lines.select("site", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"), F.struct(F.col("id").isNull().alias("none"), "id", "h", "pos").alias("at"))
    lines = materialize(lines, "lines")
    verdicts = boilerplate(lines, min_sites).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = lines.withColumn("salt", F.pmod(F.hash("at.h"), F.lit(SALT)))
    gone = salted.join(verdicts, ["k1", "k2", "salt"]).filter(F.col("at") != F.col("first"))
    gone = gone.groupBy(F.col("at.id").alias("gone_id"), F.col("at.h").alias("gone_h")).agg(F.array_sort(F.collect_set("at.pos")).alias("gone"))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("h") == F.col("gone_h")), "left")
    parts = _lines(F.col("text"))
    left = F.array_join(_without(parts, F.col("gone")), "\n")
    return out.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_boilerplate(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with cleaned texts; documents whose every word was boilerplate are dropped."""
    out = strip_lines(docs, text_col=text_col, **options)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_line_spread(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return strip_lines(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")
