"""Readers of raw interaction files, label tables and node tables, and sinks of what is derived.

Files are read as lines, so headers with fewer names than columns and ragged rows do no harm.
``pos`` counts the rows of all files from 1, in the order of the files' names and of their lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import one_hot, pad_code
from ..operators.splits import first_seen_ids
from .order import numbered

# Names with commas in a public flight table, and what they are written as.
COMMA_NAMES = {
    "China, Taiwan Province of": "Taiwan Province of China",
    "China, mainland": "China mainland",
    "China, Hong Kong SAR": "China Hong Kong SAR",
    "China, Macao SAR": "China Macao SAR",
    "Saint Helena, Ascension and Tristan da Cunha": "Saint Helena Ascension and Tristan da Cunha",
}


MOST_KINDS = 1_000  #: values that get a place of their own in a one-hot array


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, fields): the comma-separated fields of every line but each file's first."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), "value")
    heads = raw.groupBy("file").agg(F.min("pos").alias("head"))
    rows = raw.join(F.broadcast(heads), "file").filter("pos > head and btrim(value) <> ''").drop("head")  # one head a file
    # Spark's number of a row rises along a file's blocks, but files are dealt out by size.
    return numbered(rows.withColumnRenamed("pos", "_row"), ["file", "_row"], "pos").select("pos", F.split(F.btrim("value"), ",").alias("fields"))


def _field(i: int, kind: str) -> Column:
    return F.get("fields", F.lit(i)).try_cast(kind)


def read_interactions(spark: SparkSession, path: str, order: tuple[int, int, int] = (0, 1, 2), label: int | None = 3, malformed: str = "drop") -> DataFrame:
    """(seq, u, v, t, label, msg, w): a CSV of source, destination, time, label and any number of features.

    ``order`` names the places of source, destination and time.  Rows without them are left out, or an error
    for ``malformed`` of ``fail``.  ``seq`` counts from 1 in order of time and, in ties, of the file.
    """
    if malformed not in ("drop", "fail"):
        raise ValueError(f"unknown way with malformed rows {malformed}")
    s, d, at = order
    first = max(*order, -1 if label is None else label) + 1
    own = F.lit(None).cast("double") if label is None else _field(label, "double")
    rows = lines(spark, path).select("pos", _field(s, "double").cast("long").alias("u"), _field(d, "double").cast("long").alias("v"), _field(at, "double").alias("t"), own.alias("label"), F.transform(F.slice("fields", first + 1, F.greatest(F.size("fields") - first, F.lit(0))), lambda x: x.try_cast("double")).alias("msg"), F.lit(1.0).alias("w"))
    good = F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("t").isNotNull()
    if malformed == "fail":
        rows = rows.withColumn("t", F.when(good, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("malformed row "), F.col("pos").cast("string"))).cast("double")))
    else:
        rows = rows.filter(good)
    return numbered(rows, ["t", "pos"]).drop("pos").select("seq", "u", "v", "t", "label", "msg", "w")


def bipartite(rows: DataFrame) -> DataFrame:
    """Destinations move behind the largest source, so that the two id spaces do not meet."""
    top = rows.agg(F.max("u").alias("_top"))
    return rows.join(F.broadcast(top)).withColumn("v", F.col("v") + F.col("_top") + 1).drop("_top")


def check_ascending(rows: DataFrame, order: str, value: str) -> int:
    """How many rows have a lower ``value`` than the one before them; ``order`` counts rows from 1 without gaps."""
    before = rows.select((F.col(order) + 1).alias(order), F.col(value).alias("_before"))
    return rows.join(before, order).filter(F.col(value) < F.col("_before")).count()


def check_contiguous(rows: DataFrame, columns: list[str]) -> None:
    """Raises ValueError unless the ids in ``columns`` together are 0 .. n - 1 or 1 .. n."""
    ids = rows.select(F.explode(F.array(*columns)).alias("x"))
    low, high, n = ids.agg(F.min("x"), F.max("x"), F.count_distinct("x")).first()
    if n and (low not in (0, 1) or high - low + 1 != n):
        raise ValueError(f"{n} ids from {low} to {high} in {columns}")


def encode_names(rows: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """``rows`` with the names in ``columns`` replaced by dense ids by first appearance, in one id space."""
    ids = first_seen_ids(rows, position, columns)
    for c in columns:
        rows = rows.withColumn("raw", F.col(c).cast("string")).join(ids, "raw", "left").drop("raw", c).withColumnRenamed("id", c)
    return rows


def label_vectors(rows: DataFrame) -> DataFrame:
    """(t, u, labels): map from v to w of the rows (pos, t, u, v, w) of each (t, u); the last of equal v wins."""
    last = rows.groupBy("t", "u", "v").agg(F.max_by("w", "pos").alias("w"))
    return last.groupBy("t", "u").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "w")))).alias("labels"))


def coded_label_vectors(rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """As ``label_vectors``, for names: ``nodes`` and ``labels`` are (raw, id); rows without an id are left out."""
    coded = rows.join(nodes.select(F.col("raw").alias("u"), F.col("id").alias("_u")), "u").join(labels.select(F.col("raw").alias("v"), F.col("id").alias("_v")), "v")
    return label_vectors(coded.select("pos", "t", F.col("_u").alias("u"), F.col("_v").alias("v"), "w"))


def running_count(rows: DataFrame, order: str, flag: Column, name: str, size: int = 8192) -> DataFrame:
    """``name``: how many rows up to and with this one have ``flag``, by slices of ``order``."""
    from pyspark.sql import Window as W

    marked = rows.withColumn("_f", flag.cast("long")).withColumn("_b", F.floor(F.col(order) / F.lit(size)))
    sums = marked.groupBy("_b").agg(F.sum("_f").alias("_n"))
    base = sums.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_base"))
    inside = F.sum("_f").over(W.partitionBy("_b").orderBy(order))
    return marked.join(base, "_b").withColumn(name, F.col("_base") + inside).drop("_f", "_b", "_base")


def run_length_labels(rows: DataFrame) -> DataFrame:
    """(run, t, node, labels) of a stream (seq, t, node, label, w), seq from 1 without gaps.

    A run ends where the day or the node changes.  The row that changes the day is recorded nowhere, and one
    that changes the node alone goes to the run that it ends; the last run is still open and left out.
    """
    before = rows.select((F.col("seq") + 1).alias("seq"), F.col("t").alias("pt"), F.col("node").alias("pn"))
    rows = rows.join(before, "seq", "left")
    day, node = F.coalesce(F.col("t") != F.col("pt"), F.lit(False)), F.coalesce(F.col("node") != F.col("pn"), F.lit(False))
    rows = running_count(rows.withColumn("day", day).withColumn("ends", day | node), "seq", F.col("ends"), "run")
    heads = rows.filter("ends or seq = 1").select("run", "t", "node")
    closed = rows.agg(F.max("run").alias("_last"))
    held = rows.filter("not day").withColumn("run", F.col("run") - F.when(F.col("ends"), 1).otherwise(0))
    found = held.groupBy("run", "label").agg(F.max_by("w", "seq").alias("w")).groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "w")))).alias("labels"))
    none = F.create_map().cast(found.schema["labels"].dataType)
    out = heads.join(F.broadcast(closed)).filter("run < _last").join(found, "run", "left")
    return out.select("run", "t", "node", F.coalesce("labels", none).alias("labels"))


def clean_names(text: Column, most: int = 4) -> Column:
    """A line with known names freed of their commas; an error if it has more than ``most`` fields then."""
    for name, plain in COMMA_NAMES.items():
        text = F.replace(text, F.lit(name), F.lit(plain))
    return F.when(F.size(F.split(text, ",")) <= most, text).otherwise(F.raise_error(F.concat(F.lit("too many fields: "), text)))


def node_features(nodes: DataFrame, position: str) -> DataFrame:
    """(node, features) of (position, node, kind, continent, region, lon, lat): one-hot kind and continent, by
    first appearance, codes of the region's letters, and the coordinates as they are."""
    places = {}
    for c in ("kind", "continent"):
        seen = first_seen_ids(nodes, position, [c]).orderBy("id").limit(MOST_KINDS + 1).collect()
        if len(seen) > MOST_KINDS:
            raise ValueError(f"{c} has more than {MOST_KINDS} values, too many for a place each")
        places[c] = [r.raw for r in seen]
    parts = [one_hot(F.col(c), values) for c, values in places.items()]
    codes = F.transform(pad_code(F.col("region")), lambda x: x.cast("double"))
    return nodes.select("node", F.concat(*parts, codes, F.array(F.col("lon").cast("double"), F.col("lat").cast("double"))).alias("features"))


def genre_ids(names: DataFrame, position: str, column: str) -> DataFrame:
    """(raw, id) of a list in its order; a name that comes twice is an error."""
    twice = names.groupBy(column).count().filter("count > 1").select(column).first()
    if twice:
        raise ValueError(f"{twice[0]} comes twice")
    return first_seen_ids(names, position, [column])


def word_scores(rows: DataFrame, most: float = 5000.0) -> DataFrame:
    """(position, user, topic, num_words, score): both features are the share of ``most`` words, the weight is the score."""
    share = F.col("num_words") / F.lit(most)
    return rows.withColumn("msg", F.array(share, share)).withColumn("w", F.col("score").cast("double"))


def prefix(split: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` edges of a split stream; their split stays that of the whole stream, and ids count from 1."""
    rows = split if most is None else split.filter(F.col("seq") <= most)
    return rows.withColumn("u", F.col("u") + 1).withColumn("v", F.col("v") + 1)


# -- sinks --------------------------------------------------------------------------------


def with_zero_row(features: DataFrame, id_col: str, vec_col: str, width: int) -> DataFrame:
    """A row of id 0 and zeros before the others, for padding."""
    zero = features.sparkSession.range(1).select(F.lit(0).cast(features.schema[id_col].dataType).alias(id_col), F.array_repeat(F.lit(0.0), width).alias(vec_col))
    return zero.unionByName(features.select(id_col, vec_col))


def write_processed(edges: DataFrame, edge_features: DataFrame, node_features_: DataFrame, path: str, width: int) -> None:
    """Edges and both feature tables (id, x), each with its zero row, as Parquet below ``path``."""
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    with_zero_row(edge_features, "id", "x", width).write.mode("overwrite").parquet(f"{path}/edge_features")
    with_zero_row(node_features_, "id", "x", width).write.mode("overwrite").parquet(f"{path}/node_features")


def differences(got: DataFrame, want: DataFrame) -> int:
    """Rows that only one of two tables has, repeats counted; columns must agree."""
    if sorted(got.columns) != sorted(want.columns):
        raise ValueError(f"columns {got.columns} and {want.columns}")
    want = want.select(got.columns)
    return got.exceptAll(want).count() + want.exceptAll(got).count()


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "interactions": read_interactions,
    "bipartite": lambda spark, path: bipartite(read_interactions(spark, path)),
}


def load(spark: SparkSession, kind: str, path: str, cache: str | None = None) -> DataFrame:
    """A raw file by the reader of its kind; with ``cache``, a processed Parquet copy that is read if it is there."""
    if kind not in READERS:
        raise ValueError(f"unknown kind {kind}: one of {sorted(READERS)}")
    if cache is None:
        return READERS[kind](spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        READERS[kind](spark, path).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def save_negatives(sets: DataFrame, path: str) -> None:
    """Negatives of each query, sorted by key in every file."""
    sets.repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(path)


def append_record(spark: SparkSession, record: dict, path: str) -> None:
    """One more line of a folder of JSON lines."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in record])
    spark.createDataFrame([tuple(str(v) for v in record.values())], schema).write.mode("append").json(path)


def write_summary(table: DataFrame, path: str) -> None:
    """A small table as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
