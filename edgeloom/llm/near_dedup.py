"""Near-duplicate documents by ProbMinHash, banding and verification.

Texts are compared by the probability Jaccard similarity of their 5-word shingles,
weighted by how often each occurs:  J_P(a, b) is the sum over shared shingles i of
1 / (sum over all shingles j of max(a_j / a_i, b_j / b_i)).

ProbMinHash lets each shingle send arrivals of a Poisson process with its weight as the
rate to random registers; a register keeps its earliest arrival, and a shingle stops as
soon as its next arrival is later than all registers.  Two registers agree with
probability J_P.

1. Equal texts are one *content* with one sketch.  Shingles are of words in lower case.
2. Contents whose registers agree in a band meet in a bucket.  Members of a small bucket
   are all compared.  In a large one each member is compared with the most central member
   (the one with most companions over all bands).  Where that leaves several components,
   members of blocks of the bucket are compared, and then all members outside the bucket's
   largest component with all others, block by block.  Only pairs that are of one component
   by then are passed over, so no link is missed; a group that hangs together costs its size.
3. Pairs whose sketches agree well below the threshold (``MARGIN``) are left out, the others
   are verified with exact similarities of the whole texts.
4. Classes are the connected components of verified pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, table
from .graphs import components

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS, ROWS = 128, 4  #: 32 bands of 4: a pair at 0.8 meets with probability 1 - 5e-8
MARGIN = 0.2  #: five to six standard deviations of the sketch's estimate at the threshold
BYTES = 2  #: of a register that a sketch keeps
BLOCK = 1024  #: about so many members of a bucket, or so many characters, are compared in one task
BLOCK_CHARS = 4_000_000
TEXT_CHARS = 4_000_000
SMALL = 8  #: all members of so small a bucket are leaders at once
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def content_key(text: Column) -> Column:
    """128-bit key of a text, as letters; null for a text without words."""
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.base64(F.unhex(F.md5(text))))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * ODD[4]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of every different shingle, ordered by text.

    A text of one to four words is a single shingle.
    """
    words = [t.lower().encode("utf-8", "replace").split() for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(lens.sum()), object)
    flat[:] = [w for ws in words for w in ws]
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(flat):
        return none
    codes, different = pd.factorize(flat)
    h = pd.util.hash_array(np.asarray(different, dtype=object), categorize=False).astype(np.uint64)[codes]
    owner = np.repeat(np.arange(len(texts)), lens)
    # A word beyond the text's end counts as nothing, so short texts give one shingle of what they have.
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    starts = np.flatnonzero((place == 0) | (place + SHINGLE <= np.repeat(lens, lens)))
    out = np.zeros(len(starts), np.uint64)
    for k in range(SHINGLE):
        at = np.minimum(starts + k, len(flat) - 1)
        inside = (starts + k < len(flat)) & (owner[at] == owner[starts])
        out = mix(out * ODD[0] + np.where(inside, h[at], np.uint64(0)) + np.uint64(k + 1))
    of = owner[starts]
    group, _ = pd.factorize(mix(out + of.astype(np.uint64) * ODD[2]))
    first = np.zeros(int(group.max()) + 1, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    return of[first], out[first], np.bincount(group)


def sketch(owner: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of ``n`` weighted sets: registers hold 32 bits of their earliest item, of which BYTES are kept."""
    earliest = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint32)
    time = np.zeros(len(items))
    latest = np.full(n, np.inf)
    turn = np.zeros(1, np.uint64)  # an array, so that it wraps without a warning
    while len(items):
        turn += ODD[3]
        r = mix(items + turn)
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(u) / weights
        at = owner * registers + (mix(r + ODD[1]) % np.uint64(registers)).astype(np.int64)
        on = time < latest[owner]
        owner, items, weights, time, at = owner[on], items[on], weights[on], time[on], at[on]
        if not len(items):
            break
        np.minimum.at(earliest, at, time)
        won = earliest[at] == time
        held[at[won]] = (items[won] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        alive = np.unique(owner)
        latest[alive] = earliest.reshape(n, registers)[alive].max(1)
        on = time < latest[owner]
        owner, items, weights, time = owner[on], items[on], weights[on], time[on]
    return held.reshape(n, registers)


def sketch_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, first, held = pdf["text"].tolist(), 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= TEXT_CHARS or i == len(texts) - 1:
                part = pdf.iloc[first : i + 1]
                found = sketch(*shingles(texts[first : i + 1]), i + 1 - first)
                yield pd.DataFrame({"id": part["id"], "key": part["key"], "sig": [s.tobytes() for s in found.astype("<u2")]})
                first, held = i + 1, 0
                give_back()


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets, each as different hashes and their counts."""
    items = np.concatenate([a[0], b[0]])
    group, different = pd.factorize(items)
    x, y = np.zeros(len(different)), np.zeros(len(different))
    x[group[: len(a[0])]] = a[1]
    y[group[len(a[0]) :]] = b[1]
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.maximum(y, 1), np.inf)
    order = np.argsort(-ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # max(x_j / x_i, y_j / y_i) is x_j / x_i where the ratio of j is at least that of i.
    until = np.searchsorted(-ratio, -ratio, side="right")
    sum_x, sum_y = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    both = (x > 0) & (y > 0)
    total = sum_x[until[both]] / x[both] + (sum_y[-1] - sum_y[until[both]]) / y[both]
    return float((1 / total).sum())


def _similar(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, tuple] = {}
        for pdf in batches:
            keep = np.zeros(len(pdf), bool)
            for i, (a, b, ta, tb) in enumerate(zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"])):
                if len(known) > 500:
                    known.clear()
                for node, text in ((a, ta), (b, tb)):
                    if node not in known:
                        known[node] = shingles([text])[1:]
                keep[i] = probability_jaccard(known[a], known[b]) >= threshold - 1e-12
            yield pdf.loc[keep, ["a", "b"]]

    return run


def verify(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of contents whose similarity reaches the threshold."""
    sig = sketches.select("node", "sig")
    agree = F.expr(f"size(filter(sequence(0, {REGISTERS - 1}), i -> substring(sig_a, {BYTES} * i + 1, {BYTES}) = substring(sig_b, {BYTES} * i + 1, {BYTES})))")
    close = (
        pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a")
        .join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
        .filter(agree >= F.lit((threshold - MARGIN) * REGISTERS))
        .select("a", "b")
    )
    full = close.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return full.select("a", "b", "text_a", "text_b").mapInPandas(_similar(threshold), "a long, b long")


def link(members: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of all contents in ``members`` (bucket, band, node, size) that have a link."""
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    lead = members.join(central, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).getField("node").alias("leader"))
    star = members.join(lead, "bucket").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    small = members.filter(F.col("size") <= SMALL).select("bucket", "node")
    inside = small.alias("x").join(small.alias("y"), "bucket").filter("x.node < y.node").select(F.col("x.node"), F.col("y.node"))
    edges = materialize(verify(ordered(star.union(inside)), sketches, texts, threshold), "links")
    labels = components(edges)
    lengths = texts.select("node", F.length("text").alias("chars"))
    large = materialize(members.filter(F.col("size") > SMALL).join(lengths, "node"), "large")
    for whole in (False, True):
        pairs = blocked(large, labels, whole).join(sketches.select("node", "sig"), "node").join(texts, "node")
        found = materialize(pairs.groupBy("bucket", "p", "q").applyInPandas(_across(threshold), "a long, b long"), "links")
        if found.limit(1).count() > 0:
            edges = edges.union(found)
            labels = components(edges)
    return labels


def blocked(large: DataFrame, labels: DataFrame, whole: bool) -> DataFrame:
    """(bucket, band, node, component, block, p, q): members of block p are to be compared with those of block q.

    Only buckets of several components are cut into blocks.  First each block is its own
    partner (p = q); with ``whole`` a bucket of more than one block is cut anew, the largest
    component apart, and each block outside of it meets all blocks.
    """
    rows = large.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kinds = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    most = kinds.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_n"), F.sum("chars").alias("all_chars"), F.max(F.struct("n", "chars", "component")).alias("top"))
    rows = rows.join(most.filter("kinds > 1"), "bucket")
    number = lambda n, chars: F.ceil(F.greatest(n / F.lit(BLOCK), chars / F.lit(BLOCK_CHARS)))
    hashed = F.xxhash64("node", "bucket")
    blocks = number(F.col("all_n"), F.col("all_chars"))
    if not whole:
        rows = rows.withColumn("block", F.pmod(hashed, blocks))
        return rows.select("bucket", "band", "node", "component", "block", F.col("block").alias("p"), F.col("block").alias("q"))
    rows = rows.filter(blocks > 1).withColumn("inside", F.col("component") == F.col("top.component"))
    rows = rows.withColumn("outer", number(F.col("all_n") - F.col("top.n"), F.col("all_chars") - F.col("top.chars"))).withColumn("inner", number(F.col("top.n"), F.col("top.chars")))
    rows = rows.withColumn("block", F.when(F.col("inside"), F.col("outer") + F.pmod(hashed, "inner")).otherwise(F.pmod(hashed, "outer")))
    partners = F.sequence(F.lit(0).cast("long"), F.col("outer") + F.when(F.col("inside"), 0).otherwise(F.col("inner")) - 1)
    rows = rows.select("bucket", "band", "node", "component", "block", F.explode(partners).alias("partner"))
    return rows.select("bucket", "band", "node", "component", "block", F.least("block", "partner").alias("p"), F.greatest("block", "partner").alias("q"))


def _across(threshold: float):
    """Links between the components of two blocks, enough to connect all that belong together."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, block, band = pdf["node"].to_numpy(), pdf["block"].to_numpy(), int(pdf["band"].iat[0])
        component = pd.factorize(pdf["component"])[0]
        found: list[tuple[int, int]] = []
        if component.max() > 0:
            sigs = np.frombuffer(b"".join(pdf["sig"]), "<u2").reshape(len(pdf), REGISTERS)
            earlier = np.ascontiguousarray(sigs[:, : band * ROWS]).reshape(len(pdf), band, ROWS)
            sets = Sets(pdf["text"].tolist())
            right = np.flatnonzero(block == key[2])
            for i, x in enumerate(np.flatnonzero(block == key[1])):
                ys = right[i + 1 :] if key[1] == key[2] else right
                ys = ys[component[ys] != component[x]]
                ys = ys[(sigs[ys] == sigs[x]).sum(1) >= (threshold - MARGIN) * REGISTERS]
                # A pair that meets in an earlier band too is compared there.
                ys = ys[~(earlier[ys] == earlier[x]).all(2).any(1)]
                if not len(ys):
                    continue
                low, high = sets.bounds(x, ys)
                for sure, y in sorted(zip(low < threshold + 1e-9, ys)):
                    if component[y] == component[x] or high[ys == y][0] < threshold - 1e-9:
                        continue
                    if not sure or probability_jaccard(sets.of(x), sets.of(y)) >= threshold - 1e-12:
                        component[component == component[y]] = component[x]
                        found.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


class Sets:
    """Shingles of many texts, and bounds of one's similarity to others.

    With weights x and y of sum 1, the sum over j of max(x_j / x_i, y_j / y_i) is at least
    1 / min(x_i, y_i) and at most sum(max(x, y)) / min(x_i, y_i).  So J_P lies between
    s / (2 - s) and s, the sum of min(x, y); without repeated shingles it is the plain Jaccard.
    """

    def __init__(self, texts: list[str]):
        owner, self.items, self.counts = shingles(texts)
        self.codes, different = pd.factorize(self.items)
        self.starts = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.sizes = np.diff(self.starts)
        self.sums = np.bincount(owner, weights=self.counts, minlength=len(texts))
        self.own = np.zeros(len(different))

    def of(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[x], self.starts[x + 1])
        return self.items[at], self.counts[at]

    def bounds(self, x: int, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = slice(self.starts[x], self.starts[x + 1])
        self.own[self.codes[mine]] = self.counts[mine]
        sizes = self.sizes[ys]
        owner = np.repeat(np.arange(len(ys)), sizes)
        at = np.arange(len(owner)) + np.repeat(self.starts[ys] - np.cumsum(sizes) + sizes, sizes)
        shared = self.own[self.codes[at]]
        self.own[self.codes[mine]] = 0
        s = np.bincount(owner, weights=np.minimum(shared / self.sums[x], self.counts[at] / self.sums[ys][owner]), minlength=len(ys))
        both = np.bincount(owner, weights=shared > 0, minlength=len(ys))
        plain = (self.sums[x] == self.sizes[x]) & (self.sums[ys] == sizes)
        jaccard = both / (self.sizes[x] + sizes - both)
        return np.where(plain, jaccard, s / (2 - s)), np.where(plain, jaccard, s)


def ordered(pairs: DataFrame) -> DataFrame:
    """The different pairs (a, b) with a < b, written down."""
    return materialize(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, class_id) for each row of ``docs``; class_id is the least id of its class.

    Equal texts share a class whatever their number.  A null
    text or one without words has a null key and links to nothing: its class is its own id.
    A class whose ids are all null has a null class_id.  Repeated rows are rows.  Ids may be
    of any orderable type; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("key", content_key(F.col("text")))
    texts = own.filter("key is not null")
    kind = docs.schema[id_col].dataType.simpleString()
    every = materialize(texts.mapInPandas(sketch_texts, f"id {kind}, key string, sig binary"), "sketches")
    # Contents are numbered as they are written, so that what follows joins longs.
    contents = materialize(every.groupBy("key").agg(F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()), "contents")
    bands = F.expr(f"transform(sequence(0, {REGISTERS // ROWS - 1}), i -> xxhash64(substring(sig, {BYTES * ROWS} * i + 1, {BYTES * ROWS}), i))")
    met = materialize(contents.select("node", F.posexplode(bands).alias("band", "bucket")), "bands")
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialize(met.join(sizes, "bucket"), "members")
    some = materialize(contents.join(members.select("node").distinct(), "node", "left_semi"), "member-sketches")
    wanted = texts.select("key", "text").join(some.select("key", "node"), "key").groupBy("node").agg(F.first("text").alias("text"))
    labels = link(members, some.select("node", "sig"), materialize(wanted, "member-texts"), threshold)
    keyed = contents.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    rows = materialize(every.select("id", "key").join(keyed, "key"), "rows")
    first = rows.groupBy("component").agg(F.min("id").alias("class_id"))
    single = own.filter("key is null").select("id", F.lit(None).cast("string").alias("key"), F.col("id").alias("class_id"))
    return rows.join(first, "component").select("id", "key", "class_id").union(single)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document per class: the one with the least id (null ids last).

    Rows without words all stay.  Columns are those of ``docs``.
    """
    found = classes(docs, id_col, text_col, threshold).filter("key is not null")
    chosen = found.groupBy("class_id", "key").agg(F.min("id").alias("id"))
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("id"), content_key(F.col(text_col).cast("string")).alias("key"), whole.alias("row"))
    # One row per content and then, by the class, the content that holds the least id.
    rank = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.xxhash64("row").alias("h"))
    contents = rows.filter("key is not null").groupBy("key").agg(F.min_by("row", rank).alias("row"))
    best = chosen.groupBy("class_id").agg(F.min_by("key", F.struct(F.col("id").isNull().alias("n"), "id", "key")).alias("key"))
    best = best.filter("class_id is not null").union(_all_null(found)).select("key")
    kept = contents.join(best, "key", "left_semi").select("row").union(rows.filter("key is null").select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def _all_null(found: DataFrame) -> DataFrame:
    """Contents of classes without any id; each stays."""
    return found.filter("class_id is null").select("class_id", "key").distinct()


def op2_probminhash_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")
