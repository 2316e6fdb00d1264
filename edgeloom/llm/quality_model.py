"""Quality by hierarchical empirical Bayes.

1. A logistic regression over text measurements, fitted on at most ``SAMPLE`` labelled
   rows, gives each document's evidence.
2. Hosts and paths below them collect that evidence (the label itself where there is
   one) in grouped sums.  A host's Beta posterior shrinks to the global prior and a
   path's to its host's; the prior strengths come from the spread between sites by the
   method of moments, so sparse sites move least.
3. A document's log odds are its evidence plus how far its path is from the global mean.
   The means that it is scored by leave out what it brought itself, so that its evidence
   counts once.

The table of documents has no paths; there the language stands in for the level below a host.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .quality_rules import measure

SAMPLE = 20_000  #: most labelled rows that the classifier is fitted on
SALT = 16  #: rows of a large site meet its sums in as many parts
CERTAIN = 0.999  #: evidence is kept off 0 and 1 by as much
FEATURES = (
    "ln(1 + m.n_words)",
    "m.n_repeat_words / greatest(m.n_words, 1)",
    "least(m.n_symbols / greatest(m.n_words, 1), 2)",
    "m.n_dup_lines / greatest(m.n_lines, 1)",
    "least(m.word_chars / greatest(m.n_words, 1), 30) / 10",
    "m.n_capitals / greatest(m.n_letters, 1)",
    "least(m.n_exclaims / greatest(m.n_words, 1), 2)",
)


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1 - CERTAIN), F.least(F.lit(CERTAIN), p))
    return F.log(p / (1 - p))


def with_evidence(rows: DataFrame) -> DataFrame:
    """Adds ``evidence``, the probability of quality, to rows with ``x`` (features) and ``label`` or null.

    Without labels of both kinds there is nothing to learn and the evidence is one half.
    """
    labelled = rows.filter("label is not null").select("x", F.col("label").cast("double").alias("label"), F.xxhash64("id", F.lit(5)).alias("h"))
    n, kinds = labelled.agg(F.count("*"), F.count_distinct(F.col("label") >= 0.5)).first()
    if kinds < 2:
        return rows.withColumn("evidence", F.lit(0.5))
    share = min(1.0, SAMPLE / n)
    sample = labelled.filter(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * share)) if share < 1 else labelled
    sample = sample.select(array_to_vector("x").alias("features"), (F.col("label") >= 0.5).cast("double").alias("label"))
    model = LogisticRegression(regParam=1e-4, maxIter=60).fit(materialize(sample, "labelled"))
    z = F.lit(float(model.intercept))
    for i, w in enumerate(model.coefficients):
        z = z + F.lit(float(w)) * F.get("x", F.lit(i))
    return rows.withColumn("evidence", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength (pseudo-documents) from the spread of group rates around ``mean``.

    var(rate) = m (1 - m) / (s + 1) between groups, after taking off what sampling adds.
    """
    rate = F.col("good") / F.col("n")
    between = F.avg((rate - mean) * (rate - mean) - rate * (1 - rate) / F.greatest(F.col("n") - 1, F.lit(1.0)))
    within = F.avg(mean * (1 - mean))
    got = groups.filter("n >= 2").agg(between.alias("b"), within.alias("w")).first()
    if got is None or got["b"] is None or not got["w"] or got["b"] <= 0:
        return 1000.0
    return float(min(1000.0, max(2.0, got["w"] / got["b"] - 1)))


def _posterior(good: Column, n: Column, strength: Column, prior: Column) -> Column:
    return (good + strength * prior) / (n + strength)


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", cutoff: float = 0.5) -> DataFrame:
    """(id, evidence, host_mean, path_mean, score, kept) for each row of ``docs``.

    Both means leave out the row itself: a site of one row has its prior's mean.
    Null hosts and paths are sites of their own; null labels and labels of null ids are
    left out and several labels of an id are averaged.  A null or empty text has no words
    and gets the evidence of that.  Repeated rows are rows; other columns are ignored.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(host_col).cast("string")), F.lit("n")).alias("host"), F.coalesce(F.concat(F.lit("s"), F.col(path_col).cast("string")), F.lit("n")).alias("path"), measure(F.col(text_col).cast("string")).alias("m"))
    rows = rows.select("id", "host", "path", F.array(*[F.expr(f).cast("double") for f in FEATURES]).alias("x"))
    rows = materialize(rows, "features").join(marks, "id", "left")
    rows = materialize(with_evidence(rows), "evidence")

    soft = F.coalesce("label", "evidence")
    paths = materialize(rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(soft).alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = paths.agg(F.sum("good") / F.sum("n")).first()[0]
    mean = F.lit(0.5 if total is None else float(total))
    s_host = F.lit(_strength(hosts, mean))
    shrunk = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), _posterior(F.col("good"), F.col("n"), s_host, mean).alias("host_mean"))
    paths = paths.join(shrunk, "host")
    s_path = F.lit(_strength(paths, F.col("host_mean")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "evidence"), F.lit(SALT)).cast("int"))
    out = salted.join(paths.withColumn("salt", salts), ["host", "path", "salt"])
    out = out.withColumn("host_mean", _posterior(F.col("host_good") - soft, F.col("host_n") - 1, s_host, mean))
    out = out.withColumn("path_mean", _posterior(F.col("good") - soft, F.col("n") - 1, s_path, F.col("host_mean")))
    odds = logit(F.col("evidence")) + logit(F.col("path_mean")) - logit(mean)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    return out.select("id", "evidence", "host_mean", "path_mean", score.alias("score"), (score >= cutoff).alias("kept"))


def op8_hierarchical_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return grade(docs.select("doc_id", "text", "source", "lang"), labels).withColumnRenamed("id", "doc_id")
