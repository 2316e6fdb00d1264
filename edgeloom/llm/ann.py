"""Approximate nearest neighbours with an inverted multi-index.

Each half of a vector is quantised on its own, so ``K`` centroids per half make ``K * K``
cells.  A query walks the centroid pairs by rising summed distance with a heap until the
cells seen hold enough entries; these entries are then scored exactly.

The inner product is turned into a distance by one more coordinate in the second half,
``sqrt(M^2 - |x|^2)`` for entries and 0 for queries, so vectors need not be normalised.
The index works on vectors divided by the largest norm, so that M is 1 and nothing
overflows; scores are of the vectors as they are.

The codebooks are fitted on at most ``SAMPLE`` rows.  On the same rows the share of the
table that a query has to visit for a recall of ``TARGET`` is measured; in a sample the
neighbours are farther away than in the table, so the share is on the safe side.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table

CELLS = 64  #: centroids per half at least; there are more for tables of more than CELLS ** 2 * PER_CELL rows
MOST_CELLS = 1_024  #: centroids per half at most
PER_CELL = 12  #: entries of a cell aimed at
SAMPLE = 16_384  #: most rows that codebooks and the visited share are fitted on
PROBES = 256  #: sample rows that serve as queries there
TARGET = 0.95  #: recall aimed at
LEAST = 2_000  #: entries that a query visits at least
SHARD_ROWS = 8_192  #: most entries that one task scores at a time
QUERY_ROWS = 8_192  #: most queries that one task scores at a time


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        nearest = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Codebooks:
    """Centroids of both halves; ``radius`` is M of the module's text."""

    def __init__(self, sample: np.ndarray, radius: float, cells: int = CELLS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.radius, self.half = radius, sample.shape[1] // 2
        first, second = self.halves(sample, query=False)
        self.first, self.second = k_means(first, cells, rng), k_means(second, cells, rng)
        self.k = cells

    def halves(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.radius**2 - (x * x).sum(1), 0))
        return x[:, : self.half], np.column_stack([x[:, self.half :], more])

    def distances(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """To every centroid, less what is the same for all of them."""
        a, b = self.halves(x, query)
        return (self.first**2).sum(1) - 2 * a @ self.first.T, (self.second**2).sum(1) - 2 * b @ self.second.T

    def cell(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x, query=False)
        return a.argmin(1) * self.k + b.argmin(1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
    """Cells by rising summed distance until they hold ``enough`` entries (multi-sequence search)."""
    i1, i2, k = np.argsort(first, kind="stable"), np.argsort(second, kind="stable"), len(second)
    d1, d2, l1, l2 = first[i1].tolist(), second[i2].tolist(), i1.tolist(), i2.tolist()
    heap, out, held = [(d1[0] + d2[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = l1[i] * k + l2[j]
        if sizes[cell]:
            out.append(cell)
            held += sizes[cell]
        if j + 1 < k:
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(l1):
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return np.array(out, np.int32)


def measured_share(books: Codebooks, sample: np.ndarray, k: int, target: float, probes: int = PROBES) -> float:
    """Share of the entries to visit so that ``target`` of the true neighbours are seen."""
    n = len(sample)
    if n <= k + 1:
        return 1.0
    q = sample[np.linspace(0, n - 1, min(probes, n)).astype(int)]
    own = np.linspace(0, n - 1, min(probes, n)).astype(int)
    scores = q @ sample.T
    scores[np.arange(len(q)), own] = -np.inf
    best = np.argpartition(-scores, k, axis=1)[:, :k]
    cells = books.cell(sample)
    sizes = np.bincount(cells, minlength=books.k**2)
    a, b = books.distances(q, query=True)
    need = []
    for i in range(len(q)):
        order = np.argsort((a[i][:, None] + b[i][None, :]).ravel(), kind="stable")
        seen = np.empty(len(order), np.int64)
        seen[order] = np.cumsum(sizes[order])
        need.append(seen[cells[best[i]]])
    return min(1.0, float(np.quantile(np.concatenate(need), target)) / n)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null or zero and holds neither null nor non-finite components."""
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(F.col(vec_col), lambda x: x != 0)
    return vectors.filter(F.col(vec_col).isNotNull() & ~bad).filter(some)


def norm(v: Column) -> Column:
    """Length of a vector; no square of a large component overflows."""
    top = F.array_max(F.transform(v, F.abs))
    return top * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / top) * (x / top)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found by inner product.

    ``queries`` has the columns of ``vectors``; a row with the query's id is not its own
    neighbour.  Unusable vectors, null ids and vectors of another width than most take no
    part; ties go to the smaller id; identical rows count once, different vectors of one id
    each; of several queries with one id the smallest vector asks; fewer candidates than ``k``
    give fewer rows, and an empty table none.  A product that overflows to both infinities
    is NaN and comes last.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    pick = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")]
    rows = usable(vectors.select(*pick).filter("id is not null"), "v").distinct()
    asked = usable(queries.select(*pick).filter("id is not null"), "v")
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = materialize(rows, "ann-rows")
    n, width, longest = rows.agg(F.count("*"), F.mode(F.size("v")), F.max(norm(F.col("v")))).first()
    if not n or not width:
        return spark.createDataFrame([], result)
    rows, asked = rows.filter(F.size("v") == width), asked.filter(F.size("v") == width)

    hashed = F.xxhash64("id")
    share = min(1.0, 1.5 * SAMPLE / n)
    near = rows if share >= 1 else rows.filter(F.pmod(hashed, F.lit(1_000_000)) < int(share * 1_000_000))
    sample = np.array([r[0] for r in near.orderBy(hashed, "id").limit(SAMPLE).select("v").collect()], np.float64)
    scale = min(longest, 1e308)
    sample = sample.reshape(len(sample), -1) / scale
    cells = cells or min(MOST_CELLS, max(CELLS, math.isqrt(n // PER_CELL)))
    books = Codebooks(sample, 1.0, min(cells, max(1, len(sample) // 4)))
    enough = max(LEAST, math.ceil(measured_share(books, sample, k, target) * n))
    n_cells = books.k**2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0  # numbers the rows of a task, to deal hot cells out evenly
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(books.cell(x / scale).astype(np.int32)), pa.array(np.arange(turn, turn + len(x), dtype=np.int64))], ["id", "v", "cell", "turn"])
                turn += len(x)

    entries = materialize(rows.mapInArrow(assign, "id long, v array<double>, cell int, turn long"), "ann-entries")
    sizes = np.zeros(n_cells, np.int64)
    for cell, count in entries.groupBy("cell").count().collect():  # at most cells * cells rows
        sizes[cell] = count
    # Cells fill shards of at most SHARD_ROWS entries; a larger cell is split over shards of its own.
    shard_of, parts, shard, held = np.zeros(n_cells, np.int32), np.ones(n_cells, np.int32), 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if size > SHARD_ROWS:
            shard += held > 0
            shard_of[cell], parts[cell] = shard, -(-size // SHARD_ROWS)
            shard, held = shard + int(parts[cell]), 0
        elif size:
            if held + size > SHARD_ROWS:
                shard, held = shard + 1, 0
            shard_of[cell], held = shard, held + size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("cell").to_numpy()
            to = shard_of[cell] + b.column("turn").to_numpy() % parts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), b.column("id"), b.column("v"), b.column("cell")], ["shard", "id", "v", "cell"])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)
            a, b = books.distances(x / scale, query=True)
            out = []
            for i, key in enumerate(pdf["id"]):
                seen = walk(a[i], b[i], sizes, enough)
                split = seen[parts[seen] > 1]
                for s in np.unique(shard_of[seen]):
                    out.append((int(s), key, pdf["v"].iat[i], seen[shard_of[seen] == s]))
                for cell in split:
                    for p in range(1, int(parts[cell])):
                        out.append((int(shard_of[cell]) + p, key, pdf["v"].iat[i], np.array([cell], np.int32)))
            yield pd.DataFrame(out, columns=["shard", "id", "v", "cells"])

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "scores": pd.Series(dtype=object)})
        if not len(left) or not len(right):
            return empty
        left = left.sort_values("cell", kind="stable")
        x, ids, cell = np.array(left["v"].tolist(), np.float64), left["id"].to_numpy(), left["cell"].to_numpy()
        q, keys = np.array(right["v"].tolist(), np.float64), right["id"].to_numpy()
        xs, qs = x / scale, q / scale
        blur = 4 * q.shape[1] * np.finfo(float).eps * np.sqrt((qs * qs).sum(1))  # of a product in another order of summing
        here = np.unique(cell)
        begin, end = np.searchsorted(cell, here), np.searchsorted(cell, here, side="right")
        visits = np.zeros((len(q), len(here)), bool)
        for i, cells_ in enumerate(right["cells"]):
            visits[i] = np.isin(here, cells_)
        out = []
        for lo in range(0, len(q), 256):
            s = np.full((len(q[lo : lo + 256]), len(x)), -np.inf)
            for c in range(len(here)):
                on = np.flatnonzero(visits[lo : lo + 256, c])
                if len(on):
                    s[on, begin[c] : end[c]] = qs[lo + on] @ xs[begin[c] : end[c]].T
            s[ids[None, :] == keys[lo : lo + 256, None]] = -np.inf
            for i in range(len(s)):
                line = s[i]
                least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else -np.inf
                on = np.flatnonzero((line >= least - blur[lo + i]) & (line > -np.inf))
                if len(on):
                    with np.errstate(over="ignore", invalid="ignore"):
                        exact = (x[on] * q[lo + i]).sum(1)  # the same sum for equal vectors, wherever they stand
                    first = np.lexsort((ids[on], -np.where(np.isnan(exact), -np.inf, exact)))[:k]
                    out.append((keys[lo + i], ids[on][first], exact[first]))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"]) if out else empty

    # A shard's queries are cut into blocks of at most about QUERY_ROWS, and its entries go to each of them.
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    routed = materialize(asked.repartition(F.col("id")).mapInPandas(route, "shard int, id long, v array<double>, cells array<int>"), "ann-routed")
    visits = routed.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("blocks"))
    placed = entries.mapInArrow(place, "shard int, id long, v array<double>, cell int").join(visits, "shard")
    dealt = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    routed = routed.join(visits, "shard").withColumn("block", F.pmod(hashed, "blocks").cast("int")).drop("blocks")
    found = dealt.groupBy("shard", "block").cogroup(routed.groupBy("shard", "block")).applyInPandas(score, "query_id long, ids array<long>, scores array<double>")
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
