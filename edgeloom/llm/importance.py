"""Importance resampling of documents toward a target distribution of hashed n-grams.

Two passes over the texts, both in Arrow batches.  The first adds up, per partition, one vector of
``BUCKETS`` feature counts; a tree reduction merges the vectors of documents and of target texts.
From both the driver derives one gain per bucket.  The second pass looks every feature's gain up in
the broadcast vector and sums them per document.  Vectors have ``BUCKETS`` numbers whatever the input.

A document's draw is a Gumbel variable of its id, so the highest sums of weight and draw are a
weighted sample without replacement; they are found in one global order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.order import numbered
from .common import give_back, materialize, table, text_blocks

BUCKETS = 10_000
LEAST_WORDS = 20  #: of a document that may be drawn
PERCENT = 25  #: of those that may be drawn
SEED = 7
SHORT = 64  #: bytes of words whose step is a table look-up; longer ones are hashed as they are


def _byte_table() -> np.ndarray:
    """Lower case for A-Z, a blank for the other ASCII characters that are no word characters."""
    to = np.arange(256, dtype=np.uint8)
    to[:128] = 32
    to[48:58], to[97:123] = np.arange(48, 58), np.arange(97, 123)
    to[65:91] = np.arange(97, 123)
    return to


def _shift_tables() -> np.ndarray:
    """[n, i, b]: what byte i = b of a CRC-32 turns into when n zero bytes follow; the parts are combined by xor."""
    step = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
    out = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
    for n in range(SHORT):
        out[n + 1] = step[out[n] & 255] ^ (out[n] >> np.uint32(8))
    return out


TO, SHIFT = _byte_table(), _shift_tables()


def words_of(texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts in order, and the place of each one's text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(TO[raw]))
    parts = pc.ascii_split_whitespace(clean)
    flat = parts.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), owner[some.to_numpy(zero_copy_only=False)]


def feature_buckets(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every word and every two consecutive words, and the words of each text.

    The CRC-32 of two words is put together from those of both, so only different words are hashed.
    """
    words, owner = words_of(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    coded = words.dictionary_encode()
    codes, different = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()
    crc = np.array([zlib.crc32(w) for w in different], np.uint32)
    spaced = np.array([zlib.crc32(b" ", c) for c in crc.tolist()], np.uint32)
    length = np.array([len(w) for w in different])
    both = np.flatnonzero(owner[1:] == owner[:-1])
    left, right = spaced[codes[both]], codes[both + 1]
    n = np.minimum(length[right], SHORT)
    pair = crc[right].copy()
    for i in range(4):
        pair ^= SHIFT[n, i, (left >> np.uint32(8 * i)) & np.uint32(255)]
    for at in np.flatnonzero(length[right] > SHORT).tolist():
        pair[at] = zlib.crc32(different[right[at]], int(left[at]))
    return np.concatenate([crc[codes], pair]) % BUCKETS, np.concatenate([owner, owner[both]]), n_words


def bucket_counts(texts: DataFrame, text_col: str) -> np.ndarray:
    """Features per bucket over all texts; null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, part in text_blocks(b.column(0)):
                total += np.bincount(feature_buckets(part)[0], minlength=BUCKETS)
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(BUCKETS, np.int64)], 1)
    every = vectors.union(none)
    depth = 2 if every.getNumPartitions() <= 10_000 else 3
    return every.treeReduce(lambda a, b: a + b, depth)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of a bucket's smoothed share in the target over that in the source, rounded down."""
    many, wanted = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * many / ((s + 1) * wanted))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of each row of ``docs``; those drawn have a rank.

    A null or empty text has no features and weight 0; a null id is hashed as the empty text, and
    comes last among ties.  Repeated rows are rows and may all be drawn.  An empty target or an empty table
    makes all shares equal or the result empty.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    gain = spark.sparkContext.broadcast(gains(bucket_counts(rows, "text"), bucket_counts(target, text_col)).astype(np.float64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in text_blocks(b.column(1)):
                bucket, owner, n_words = feature_buckets(part)
                n = np.bincount(owner, minlength=len(part))
                total = np.bincount(owner, weights=gain.value[bucket], minlength=len(part)).astype(np.int64)
                columns = [b.column(0)[at], *map(pa.array, (n_words, n, total // np.maximum(n, 1)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight"])
        give_back()

    weighed = rows.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(head, 16, 10).cast("double")
    draw = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialize(weighed.withColumn("score", (F.col("weight") + draw).cast("long")), "scored")
    may = F.col("n_words") >= LEAST_WORDS
    drawn = scored.filter(may).count() * percent // 100
    ranked = numbered(scored.filter(may), [F.desc("score"), F.asc_nulls_last("id")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~may).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")
