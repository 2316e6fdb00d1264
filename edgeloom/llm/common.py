"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes apart at a time (one text at least).
TEXT_BYTES = 4_000_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share, which the cluster names in
    ``spark.checkpoint.dir``; without it only a local session gets one."""
    return shared_folder(spark, name)


def materialize(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and
    a lost executor costs no recomputation of what is before.  ``folders`` are columns by which it is parted."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete the files of what ``materialize`` gave, which nothing reads any more."""
    spark = written.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory of this Python worker, which Spark keeps for later tasks, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def text_blocks(texts: pa.Array, most: int = TEXT_BYTES) -> Iterator[tuple[slice, pa.LargeStringArray]]:
    """Runs of texts of about ``most`` bytes with where they are; null texts are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    first = 0
    while first < len(texts):
        begin = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + most, side="right")))
        yield slice(first, last), texts[first:last]
        first = last
