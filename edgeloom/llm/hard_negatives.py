"""Hard negatives by distributed radix selection over integer scores.

Anchors and candidates meet in a grid of blocks of anchors and parts of the table; a task scores one
cell of the grid at a time and keeps no scores.  What it hands on are histograms: for each anchor's window
of admissible scores, how many rows fall into each value of the current digit.  Spark adds the
histograms up, the bucket that holds the k-th best row becomes the next round's range, and so on digit
by digit, over the score first and over the row's id where scores tie.  A window whose range holds few rows
is settled at once.  Then one more pass gathers the rows of the settled ranges, and only those.

Positives are selected first (one window per anchor: rows of its label), and give the windows of the
negatives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, materialize, table

DIGIT = 9  #: bits of a digit
ANCHOR_ROWS = 2_048  #: anchors of a block
PART_ROWS = 16_384  #: candidates of a part, on average
LEAST_PARTS = 32  #: small tables are cut into so many parts
CELLS = 1 << 21  #: scores that a task holds at a time, about
SETTLED = 4  #: a range of at most so many times k rows is not split any further
FAR = 1 << 61  #: scores farther from 0 count as that
STEPS = 256  #: a component of one is so much


def quantised(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * STEPS).cast("long"))


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id, a label and a vector of finite components."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(~bad)


def _numbers(table_: pa.Table, name: str) -> np.ndarray:
    return table_.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _matrix(table_: pa.Table, name: str) -> np.ndarray:
    flat = table_.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table_.num_rows, -1)


def _scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, in doubles where these are exact."""
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)), np.int64)
    most = int(max(-int(a.min()), int(a.max()))) * int(max(-int(c.min()), int(c.max()))) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ c.astype(object).T
    return np.clip(whole, -FAR, FAR).astype(np.int64)


class Cell:
    """Windows of a block's anchors against one part of the table.

    A window admits rows of its anchor's label (``same``) or of others, other than the anchor, with scores in
    low .. high.  Its key is (high - score, id - least id), least first.
    """

    def __init__(self, left: pa.Table, right: pa.Table, same: bool, least_id: int):
        self.same, self.least_id = same, least_id
        self.ids, self.labels, self.x = _numbers(left, "id"), _numbers(left, "label"), _matrix(left, "q")
        self.windows = right
        self.anchor = _numbers(right, "id")
        # Windows of one anchor share its scores.
        different, first, self.of = np.unique(self.anchor, return_index=True, return_inverse=True)
        self.q = _matrix(right, "q")[first]
        self.own, self.own_label = different, _numbers(right, "label")[first]
        self.no, self.low, self.high = (_numbers(right, c) for c in ("no", "low", "high"))

    def chunks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Candidates, and the distances from the top (-1: not admitted) and ids of each window's."""
        many = max(16, CELLS // max(1, len(self.no)))
        for at in range(0, len(self.ids), many):
            run = slice(at, at + many)
            score = _scores(self.q, self.x[run])
            fits = self.labels[run][None, :] == self.own_label[:, None]
            fits = (fits if self.same else ~fits) & (self.ids[run][None, :] != self.own[:, None])
            s = score[self.of]
            inside = fits[self.of] & (s >= self.low[:, None]) & (s <= self.high[:, None])
            yield run, np.where(inside, self.high[:, None] - s, -1), self.ids[run] - self.least_id


def _histograms(left: pa.Table, right: pa.Table, same: bool, by_id: bool, shift: int, least_id: int) -> pa.Table:
    """(id, no, digit, n): rows of a cell per window and value of the digit, in the windows' ranges."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "no": pa.array([], pa.int32()), "digit": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
    cell = Cell(left, right, same, least_id)
    from_s, from_id = _numbers(right, "from_s"), _numbers(right, "from_id")
    width = 1 << DIGIT
    n = np.zeros(len(cell.no) * width, np.int64)
    for _, s, ids in cell.chunks():
        if by_id:
            on = s == from_s[:, None]
            digit = np.where(on, (ids[None, :] - from_id[:, None]) >> shift, -1)
        else:
            digit = np.where(s >= 0, (s - from_s[:, None]) >> shift, -1)
        row, column = np.nonzero((digit >= 0) & (digit < width))
        place, often = np.unique(row * width + digit[row, column], return_counts=True)
        n[place] += often
    some = np.flatnonzero(n)
    of, digit = some // width, some % width
    give_back()
    return pa.table({"id": cell.anchor[of], "no": cell.no[of], "digit": digit.astype(np.int32), "n": n[some]})


def _rows(left: pa.Table, right: pa.Table, same: bool, k: int, least_id: int) -> pa.Table:
    """(id, no, other, score): rows of a cell in the windows' settled ranges; of one id at most ``k`` vectors."""
    if not left.num_rows or not right.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "no": pa.array([], pa.int32()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    cell = Cell(left, right, same, least_id)
    last_s, last_id = _numbers(right, "from_s"), _numbers(right, "from_id")
    found = []
    for run, s, ids in cell.chunks():
        take = (s >= 0) & ((s < last_s[:, None]) | ((s == last_s[:, None]) & (ids[None, :] <= last_id[:, None])))
        w, c = np.nonzero(take)
        found.append(np.stack([w, cell.ids[run][c], cell.high[w] - s[w, c]]))
    w, other, score = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((other, -score, w))
    w, other, score = w[order], other[order], score[order]
    again = np.zeros(len(w), np.int64)  # how many equal rows stand directly before
    same_as_before = np.concatenate([[False], (w[1:] == w[:-1]) & (other[1:] == other[:-1]) & (score[1:] == score[:-1])])[: len(w)]
    at = np.arange(len(w))
    again = at - np.maximum.accumulate(np.where(same_as_before, 0, at))
    keep = again < k
    give_back()
    return pa.table({"id": cell.anchor[w[keep]], "no": cell.no[w[keep]], "other": other[keep], "score": score[keep]})


def _counter(same: bool, by_id: bool, shift: int, least_id: int):
    return lambda left, right: _histograms(left, right, same, by_id, shift, least_id)


class Selection:
    """The table in parts, and what all selections over it share."""

    def __init__(self, rows: DataFrame, anchors: Column):
        """``rows`` has id, label and q; ``anchors`` tells which rows are anchors (of one id the least vector)."""
        self.spark = rows.sparkSession
        self.rows = materialize(rows.withColumn("deal", F.monotonically_increasing_id()), "candidates")
        self.anchors = materialize(self.rows.filter(anchors).groupBy("id").agg(F.min(F.struct("label", "q")).alias("x")).select("id", "x.*"), "anchors")
        n, low, high, most = self.rows.agg(F.count("*"), F.min("id"), F.max("id"), F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
        self.n, self.least_id, self.id_bits = n, low or 0, ((high or 0) - (low or 0)).bit_length()
        #: No score is farther from 0 than the square of the longest vector.
        self.bound = min(FAR, math.ceil((most or 0.0) * (1 + 1e-9)))
        self.parts = max(LEAST_PARTS, -(-n // PART_ROWS))
        self.blocks = max(1, -(-self.anchors.count() // ANCHOR_ROWS))
        block = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block")
        part = F.pmod(F.col("deal") + F.shiftright("deal", 33), F.lit(self.parts)).cast("int").alias("part")
        self.dealt = self.rows.select("id", "label", "q", part, block)

    def grid(self, windows: DataFrame, find, schema: str) -> DataFrame:
        """``find`` (two Arrow tables) for every cell: its candidates, and the windows of its anchors with their vectors."""
        asked = windows.join(self.anchors, "id")
        asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        return self.dealt.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(find, schema)

    def best(self, windows: DataFrame, same: bool, k: int, span: int) -> DataFrame:
        """(id, no, rank, other, score): the first ``k`` rows that each window (id, no, low, high) admits, best first.

        ``span`` is no less than high - low of any window.
        """
        least_id, bits = self.least_id, max(1, span.bit_length())
        levels = [(False, s) for s in range(DIGIT * (-(-bits // DIGIT) - 1), -1, -DIGIT)]
        levels += [(True, s) for s in range(DIGIT * (-(-max(1, self.id_bits) // DIGIT) - 1), -1, -DIGIT)]
        zero = F.lit(0).cast("long")
        open_ = materialize(windows.select("id", "no", "low", "high", zero.alias("from_s"), zero.alias("from_id"), zero.alias("before")), "windows")
        settled: list[DataFrame] = []
        width, every_id = 1 << DIGIT, (1 << 63) - 1
        for by_id, shift in levels:
            bins = self.grid(open_, _counter(same, by_id, shift, least_id), "id long, no int, digit int, n long").groupBy("id", "no", "digit").agg(F.sum("n").alias("n"))
            run = F.sum("n").over(W.partitionBy("id", "no").orderBy("digit"))  # at most 2 ** DIGIT rows
            upto = bins.withColumn("upto", run)
            hit = open_.select("id", "no", "before").join(upto, ["id", "no"]).filter(F.col("before") + F.col("upto") >= k)
            hit = hit.groupBy("id", "no").agg(F.min(F.struct("digit", "n", "upto")).alias("h"))
            found = open_.join(hit, ["id", "no"], "left")
            # No bucket reaches k: the window has fewer rows and all that it admits are taken.
            here = F.coalesce(F.col("h.digit"), F.lit(width)).cast("long")
            # A shift of 64 bits and more would wrap around; the last digit may end beyond what there is.
            step = (here * F.lit(1 << shift)) if shift < 54 else F.shiftleft(here, shift)
            all_of_it = F.col("h").isNull()
            before = F.col("before") + F.coalesce(F.col("h.upto") - F.col("h.n"), F.lit(0))
            done = all_of_it | (before + F.col("h.n") <= SETTLED * k) | F.lit((by_id, shift) == levels[-1])
            end = F.lit((1 << shift) - 1)
            if by_id:
                from_s, from_id = F.col("from_s"), F.col("from_id") + step
                last_s, last_id = from_s, F.when(all_of_it, F.lit(every_id)).otherwise(from_id + end)
            else:
                from_s, from_id = F.col("from_s") + step, zero
                last_s, last_id = F.when(all_of_it, F.lit(every_id)).otherwise(from_s + end), F.lit(every_id)
            now = materialize(found.select("id", "no", "low", "high", done.alias("done"), F.when(done, last_s).otherwise(from_s).alias("from_s"), F.when(done, last_id).otherwise(from_id).alias("from_id"), before.alias("before")), "windows")
            settled.append(now.filter("done").drop("done", "before"))
            open_ = now.filter(~F.col("done")).drop("done")
            if open_.isEmpty():
                break
        ranges = settled[0]
        for more in settled[1:]:
            ranges = ranges.unionByName(more)

        def gather(left: pa.Table, right: pa.Table) -> pa.Table:
            return _rows(left, right, same, k, least_id)

        rows = self.grid(ranges, gather, "id long, no int, other long, score long")
        order = W.partitionBy("id", "no").orderBy(F.desc("score"), "other")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "no", F.col("rank").cast("int").alias("rank"), "other", "score")


def mine(vectors: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first ``positives`` other rows of its label by score, ties by smaller id; for each,
    the first ``negatives`` rows of other labels with a score of ``least_percent`` to 100 per cent of the positive's.

    ``anchors`` and ``label`` are conditions on the columns of ``vectors``.  Rows without an id or a label and vectors
    that are null or hold null or non-finite components take no part, nor do vectors of another width than most.
    Identical rows count once; different vectors of one id are rows of their own, and of an anchor's the least
    (label, vector) asks.  Fewer rows than asked for give fewer; an empty table none.  Other columns are ignored.
    """
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("v"), anchors.alias("is_anchor")))
    width = rows.agg(F.mode(F.size("v"), True)).first()[0]
    rows = rows.filter(F.size("v") == F.lit(width)).select("id", "label", quantised(F.col("v")).alias("q"), "is_anchor").distinct()
    table_ = Selection(rows, F.col("is_anchor"))
    bound = table_.bound
    whole = table_.anchors.select("id", F.lit(0).alias("no"), F.lit(-bound).alias("low"), F.lit(bound).alias("high"))
    near = materialize(table_.best(whole, True, positives, 2 * bound), "positives")
    low = F.ceil(F.col("score").cast("decimal(20,0)") * F.lit(least_percent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")).cast("long")
    asked = near.filter("score >= 0").select("id", F.col("rank").alias("no"), low.alias("low"), F.col("score").alias("high"))
    span = asked.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0
    far = table_.best(asked, False, negatives, span)
    found = far.withColumnsRenamed({"other": "negative_id", "score": "negative_score"}).join(near.select("id", F.col("rank").alias("no"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), ["id", "no"])
    return found.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_radix_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
