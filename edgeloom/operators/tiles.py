"""Sums over what pairs that are no edge have within two steps, met in memory instead of joined as rows.

A pair (u, v) asks for all words of v, and u reaches nearly every word in two steps, so rows of words grow with pairs times words.
Here a task takes a tile: a block of first ends u, and a stripe of ids.  It holds the words of the stripe that the block's neighbours
and its second ends have, unites them for one u at a time, and adds up for each pair what both have.  What is shuffled is the words once
for each block that needs them, and one row for each pair and stripe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import graph as G
from .truss import _runs

STRIPE = 12  #: 4,096 words, that is 262,144 ids, are a stripe
BLOCK = 8_192  #: so many first ends are a block
MOST_ROWS = 20_000_000  #: so many rows of words are joined (``blocks.pair_words``), more are met in tiles
DENSE = 4  #: a node with at least one in so many of a stripe's words has a row of all of them
VALUE, NEAR, OWN, PAIR = range(4)
PARTS = ("cn", "met", "br")


def sums(pairs: DataFrame, ab: DataFrame, values: DataFrame, used: dict[str, list[str]], largest: tuple[str, ...] = ()) -> DataFrame:
    """(u, v, <part>_<name>) of different pairs (u, v) that are no edge: totals of ``values`` (node, names) over v's neighbours.

    Part ``cn`` are those that are u's neighbours, too, ``br`` those two steps from u, ``met`` those that are both.  ``used`` has the names of
    each part; those in ``largest`` are the largest values, at least 0, and must be of ``cn``.
    """
    own = G.cut(B.words(G.adjacency(ab)))
    firsts = pairs.select("u").distinct()
    count = max(1, -(-firsts.count() // BLOCK))
    block = F.pmod(F.xxhash64("u"), F.lit(count))
    at = own.select("n", "blk", "bits", F.shiftright("blk", STRIPE).alias("s"))
    asked = G.cut(pairs.select("u", "v", block.alias("i")).join(at.select(F.col("n").alias("v"), "s").distinct(), "v"))
    stripes = G.cut(asked.select("i", "s").distinct())
    near = firsts.join(own.select(F.col("n").alias("u"), "blk", "bits"), "u").select("u", "blk", "bits", block.alias("i"))
    ends = B.members(near.groupBy("i", "blk").agg(F.bit_or("bits").alias("bits")), F.col("bits"), "n").select("i", "n")
    needed = ends.union(asked.select("i", F.col("v").alias("n"))).distinct().join(at, "n").join(stripes, ["i", "s"])
    names = [c for c in values.columns if c != "node"]
    none = [F.lit(0).cast(values.schema[c].dataType).alias(c) for c in names]
    zero = F.lit(0).cast("long")

    def rows(df: DataFrame, kind: int, x, y, bits, vals=none) -> DataFrame:
        tile = F.col("s") * count + F.col("i")
        return df.select(tile.cast("long").alias("tile"), F.lit(kind).alias("kind"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y") if y else zero.alias("y"), F.col(bits).alias("bits") if bits else zero.alias("bits"), *vals)

    held = values.withColumn("s", F.shiftright("node", STRIPE + B.SHIFT)).join(stripes, "s")
    all_ = rows(held, VALUE, "node", None, None, names).union(rows(needed, NEAR, "n", "blk", "bits"))
    all_ = all_.union(rows(near.join(stripes, "i"), OWN, "u", "blk", "bits")).union(rows(asked, PAIR, "u", "v", None))
    tiles = stripes.count()
    outs = [(p, f) for p in PARTS for f in used[p]]
    schema = ", ".join(["u long", "v long", *[f"{p}_{f} {values.schema[f].dataType.simpleString()}" for p, f in outs]])
    run = _summed(names, outs, count, largest)
    found = all_.repartition(max(1, min(tiles, 4_096)), "tile").sortWithinPartitions("tile", "kind", "x", "y").mapInArrow(run, schema)
    if stripes.select("s").distinct().count() <= 1:
        return found
    return found.groupBy("u", "v").agg(*[(F.max if f in largest else F.sum)(f"{p}_{f}").alias(f"{p}_{f}") for p, f in outs])


def word_rows(pairs: DataFrame, ab: DataFrame) -> int:
    """How many rows of words ``blocks.pair_words`` joins: for each pair those of v, for each u those of all its neighbours."""
    adj = G.adjacency(ab)
    held = G.cut(B.words(adj).groupBy("n").agg(F.count("*").alias("c")))
    seconds = pairs.groupBy(F.col("v").alias("n")).agg(F.count("*").alias("times"))
    steps = pairs.select(F.col("u").alias("m")).distinct().join(adj, "m").groupBy("n").agg(F.count("*").alias("times"))
    return seconds.union(steps).join(held, "n").agg(F.sum(F.col("times") * F.col("c"))).first()[0] or 0


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, then those of the next, in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _places(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every set bit."""
    return np.nonzero(np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))


def _count(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits.view(np.uint64)).sum())


class _Words:
    """Words of nodes in a stripe: full rows for those that have many, lists for the others."""

    def __init__(self, n: np.ndarray, col: np.ndarray, bits: np.ndarray, width: int, dense: int):
        """``n`` is sorted."""
        self.nodes, self.starts, self.sizes = np.unique(n, return_index=True, return_counts=True)
        self.col, self.bits, self.width = col, bits, width
        many = np.flatnonzero(self.sizes * dense >= width)
        self.row = np.full(len(self.nodes), -1)
        self.row[many] = np.arange(len(many))
        self.full = np.zeros((len(many), width), np.int64)
        at = _ranges(self.starts[many], self.sizes[many])
        self.full[np.repeat(np.arange(len(many)), self.sizes[many]), col[at]] = bits[at]

    def find(self, nodes: np.ndarray) -> np.ndarray:
        """Places of those of ``nodes`` that have words here."""
        at = np.minimum(np.searchsorted(self.nodes, nodes), len(self.nodes) - 1)
        return at[self.nodes[at] == nodes]

    def united(self, at: np.ndarray) -> np.ndarray:
        row = self.row[at]
        out = np.bitwise_or.reduce(self.full[row[row >= 0]], axis=0)
        few = at[row < 0]
        if len(few):
            i = _ranges(self.starts[few], self.sizes[few])
            np.bitwise_or.at(out, self.col[i], self.bits[i])
        return out

    def met(self, at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, column, bits) of what the nodes at ``at[i]`` have of ``mask``, where they have some."""
        row = self.row[at]
        many, few = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        cols = np.flatnonzero(mask)
        both = self.full[row[many][:, None], cols] & mask[cols]
        r, c = np.nonzero(both)
        i, col, bits = many[r], cols[c], both[r, c]
        if len(few):
            sizes = self.sizes[at[few]]
            j = _ranges(self.starts[at[few]], sizes)
            have = self.bits[j] & mask[self.col[j]]
            some = have != 0
            i, col, bits = np.concatenate([i, np.repeat(few, sizes)[some]]), np.concatenate([col, self.col[j][some]]), np.concatenate([bits, have[some]])
        return i, col, bits


def _summed(names: list[str], outs: list[tuple[str, str]], count: int, largest: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    named = {p: [f for q, f in outs if q == p] for p in PARTS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, columns in _runs(batches):
            found = one_tile(tile // count << STRIPE, *columns)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["u", "v", *[f"{p}_{f}" for p, f in outs]])

    def one_tile(first: int, kind, x, y, bits, *vals) -> list[np.ndarray]:
        cuts = np.searchsorted(kind, [VALUE, NEAR, OWN, PAIR, PAIR + 1])
        value, near, own, pair = (slice(a, b) for a, b in zip(cuts, cuts[1:]))
        width = int(y[near].max()) - first + 1
        words = _Words(x[near], y[near] - first, bits[near], width, DENSE)
        ids = x[value] - (first << B.SHIFT)
        some = ids < width << B.SHIFT
        held = {f: np.zeros(width << B.SHIFT, v.dtype) for f, v in zip(names, vals)}
        for f, v in zip(names, vals):
            held[f][ids[some]] = v[value][some]
        u, v = x[pair], y[pair]
        out = {(p, f): np.zeros(len(u), held[f].dtype) for p, f in outs}
        at_v = np.searchsorted(words.nodes, v)
        users, begins, sizes = np.unique(u, return_index=True, return_counts=True)
        own_u, own_blk, own_bits = x[own], y[own], bits[own]
        own_cuts = np.searchsorted(own_u, np.stack([users, users + 1], axis=1))
        whole, none = {}, np.zeros(width, np.int64)
        known = words.united(np.arange(len(words.nodes)))
        most = _count(known)

        def totals(i: int) -> list:
            """Of all words of a node."""
            if i not in whole:
                _, col, have = words.met(np.array([i]), ~none)
                r, p = _places(have)
                ids = (col[r] << B.SHIFT) + p
                whole[i] = [held[f][ids].sum() for f in named["br"]]
            return whole[i]

        def add(part: str, rows: slice, mask: np.ndarray, sign: int = 1) -> None:
            i, col, have = words.met(at_v[rows], mask)
            if not len(i):
                return
            r, p = _places(have)
            ids, i = (col[r] << B.SHIFT) + p, i[r]
            for f in named[part]:
                if f in largest:
                    np.maximum.at(out[part, f][rows], i, held[f][ids])
                elif sign > 0:
                    np.add.at(out[part, f][rows], i, held[f][ids])
                else:
                    np.subtract.at(out[part, f][rows], i, held[f][ids])

        for j, (b, n) in enumerate(zip(begins.tolist(), sizes.tolist())):
            rows, mine, one = slice(b, b + n), slice(own_cuts[j, 0], own_cuts[j, 1]), none.copy()
            w, place = _places(own_bits[mine])
            two = words.united(words.find((own_blk[mine][w] << B.SHIFT) + place))
            here = (own_blk[mine] >= first) & (own_blk[mine] < first + width)
            one[own_blk[mine][here] - first] = own_bits[mine][here]
            if here.any():
                add("cn", rows, one)
                add("met", rows, one & two)
            # Where u reaches most ids, what it does not reach is taken from all.  Pairs are no edges, so u itself is in neither.
            if 2 * _count(two) <= most:
                add("br", rows, two)
            else:
                for f, column in zip(named["br"], zip(*[totals(int(i)) for i in at_v[rows]])):
                    out["br", f][rows] = column
                add("br", rows, known & ~two, -1)
        return [u, v, *[out[k] for k in outs]]

    return run
