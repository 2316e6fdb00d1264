"""Ranking and discriminability metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _against_positive(scored: DataFrame) -> DataFrame:
    """(qid, pos, gt, eq, n): negatives above, equal to and beside each query's positive."""
    pos = scored.filter("is_pos = 1").select("qid", F.col("score").alias("pos"))
    neg = scored.filter("is_pos = 0").join(pos, "qid")
    counted = neg.groupBy("qid", "pos").agg(F.count_if(F.col("score") > F.col("pos")).alias("gt"), F.count_if(F.col("score") == F.col("pos")).alias("eq"), F.count("*").alias("n"))
    return pos.join(counted.drop("pos"), "qid", "left").na.fill(0, ["gt", "eq", "n"])


def mrr_hits(scored: DataFrame, k: int = 10) -> DataFrame:
    """Mean reciprocal rank and hits@k; a tie counts half a place."""
    rank = 0.5 * (F.col("gt") + F.col("gt") + F.col("eq")) + 1.0
    return _against_positive(scored).agg(F.avg(1.0 / rank).alias("mrr"), F.avg((rank <= k).cast("double")).alias("hits"))


def reciprocal_rank(scored: DataFrame) -> DataFrame:
    """Per query: 1 / (above + floor(equal / 2) + 1)."""
    return _against_positive(scored).select("qid", (1.0 / (F.col("gt") + F.floor(F.col("eq") / 2) + 1)).alias("rr"))


def query_auc(scored: DataFrame) -> DataFrame:
    """Mean over queries of the share of negatives below the positive, ties half."""
    r = _against_positive(scored)
    below = F.col("n") - F.col("gt") - F.col("eq") + 0.5 * F.col("eq")
    return r.agg(F.avg(below / F.greatest("n", F.lit(1))).alias("auc"), F.avg(1.0 / (F.col("gt") + 0.5 * F.col("eq") + 1)).alias("mrr1"))


def cohen_d(scored: DataFrame) -> DataFrame:
    """Distance of the means over the pooled deviation (population deviations, n - 1 weights)."""
    s = scored.groupBy().agg(
        *[f(F.when(F.col("is_pos") == p, F.col("score"))).alias(f"{n}{p}") for p in (1, 0) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("c", F.count))]
    )
    pooled = F.sqrt(((F.col("c1") - 1) * F.pow("s1", F.lit(2)) + (F.col("c0") - 1) * F.pow("s0", F.lit(2))) / F.greatest(F.col("c1") + F.col("c0") - 2, F.lit(1)))
    return s.select(F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0).alias("cohen_d"))


def disc_auc(pairs: DataFrame, features: list[str]) -> DataFrame:
    """(feature, auc, disc_auc) from columns ``pos_<f>`` and ``neg_<f>``, one negative a row."""
    win = [F.avg(F.when(F.col(f"pos_{f}") > F.col(f"neg_{f}"), 1.0).when(F.col(f"pos_{f}") == F.col(f"neg_{f}"), 0.5).otherwise(0.0)).alias(f) for f in features]
    wide = pairs.agg(*win)
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("auc")) for f in features])).alias("x")).select("x.*")
    return long.withColumn("disc_auc", F.greatest(F.col("auc"), 1 - F.col("auc")))


def _ranks(scored: DataFrame) -> DataFrame:
    """(grp, score, p, n, above_p, above_n): counts per distinct score and above it.

    Rows are counted per score first; the running sums run over distinct scores of a group.
    """
    level = scored.groupBy("grp", "score").agg(F.sum("is_pos").alias("p"), F.sum(1 - F.col("is_pos")).alias("n"))
    above = W.partitionBy("grp").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    return level.withColumn("above_p", F.coalesce(F.sum("p").over(above), F.lit(0))).withColumn("above_n", F.coalesce(F.sum("n").over(above), F.lit(0)))


def average_precision(scored: DataFrame) -> DataFrame:
    """(grp, ap): precision at each threshold weighted by the recall it adds."""
    r = _ranks(scored)
    hit, seen = F.col("above_p") + F.col("p"), F.col("above_p") + F.col("p") + F.col("above_n") + F.col("n")
    return r.groupBy("grp").agg((F.sum(F.col("p") * hit / seen) / F.greatest(F.sum("p"), F.lit(1))).alias("ap"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """(grp, auc): share of (positive, negative) pairs in order, ties half; null without both kinds."""
    r = _ranks(scored)
    good = F.sum(F.col("n") * (F.col("above_p") + 0.5 * F.col("p")))
    return r.groupBy("grp").agg(F.try_divide(good, (F.sum("p") * F.sum("n")).cast("double")).alias("auc"))


def ndcg(rows: DataFrame, k: int = 10) -> DataFrame:
    """(slot, ndcg) of predicted against true gains at the first ``k`` places; 0 without gains."""
    by = lambda c: F.row_number().over(W.partitionBy("slot").orderBy(F.desc(c), "item"))
    r = rows.withColumn("a", by("pred")).withColumn("b", by("gain"))
    part = lambda c: F.sum(F.when(F.col(c) <= k, F.col("gain") / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    return r.groupBy("slot").agg(part("a").alias("dcg"), part("b").alias("best")).select("slot", F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))
