"""Best-fit packing of tokenised documents with a grouping genetic algorithm.

Documents are tokenised and cut into pieces once.  Pieces are dealt evenly into blocks
of about ``BLOCK`` pieces, whatever their keys.  Each block is solved by several islands
that differ in their seed.  An individual is a grouping of pieces into sequences; a
crossover injects whole well-filled sequences of one parent into the other, dissolves
the sequences that then hold duplicates, and best-fits the displaced pieces.  Between
epochs each island's elite migrates to the next island of its block, which is a join.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize, table

CAPACITY = 2048
BLOCK = 4096
ISLANDS, POPULATION, GENERATIONS, EPOCHS = 3, 4, 5, 2
TEXT_CHARS = 4_000_000  #: characters tokenised at a time
CACHE_BYTES = 96 << 20  #: of words and their tokens that a task remembers; then it starts anew
JOINED = 200  #: words encoded as one text
NEAR = 0x1100  #: below, no letter joins the one before it in NFC, so a word's letters can be judged one by one

PIECE = [T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each value and the bytes of all."""
    _, ends, data = texts.buffers()
    bounds = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if ends else np.zeros(1, np.int64)
    return bounds - bounds[0], np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)


def of_sizes(sizes: np.ndarray, data: bytes, kind: pa.DataType) -> pa.Array:
    """Arrow array of values that stand in a row in ``data`` and have ``sizes`` bytes each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


class Memo:
    """Texts and their token ids (as bytes) in Arrow arrays, so that an entry costs no Python object."""

    def __init__(self):
        self.texts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    @property
    def nbytes(self) -> int:
        return self.texts.nbytes + self.ids.nbytes

    def places(self, texts: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> np.ndarray:
        """Place of each of the different ``texts`` in ``ids``; the ids of new ones are learned."""
        at = pc.index_in(texts, value_set=self.texts).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            at[missing] = len(self.texts) + np.arange(len(missing))
            new = texts.take(pa.array(missing))
            self.ids = pa.concat_arrays([self.ids, learn(new)])
            self.texts = pa.concat_arrays([self.texts, new])
        return at

    def of(self, texts: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        coded = texts.dictionary_encode()
        at = self.places(coded.dictionary, learn)
        return self.ids.take(pa.array(at[coded.indices.to_numpy()]))


class Encoder:
    """Token ids of whole texts, word by word.

    The tokenizer splits at white space and treats the parts apart, so a text's ids are
    those of its words in a row; each distinct word is encoded once.  A word of letters
    with trailing punctuation is looked up by its letters.  What is remembered is bounded by
    ``CACHE_BYTES`` and goes with the task.
    """

    def __init__(self, path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends_word[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.lower_of = np.full(NEAR, -1)  # code point of a near letter -> that of its lower case, 0 if it isn't plain, -1 if unknown
        self.lowers: dict[str, bool] = {}  # letter -> is it one letter in lower case for the tokenizer too?
        self._clear()

    def _clear(self) -> None:
        self.words, self.parts = Memo(), Memo()

    def _is_plain(self, letter: str) -> bool:
        """Does the tokenizer make one letter of it, and part it from punctuation?"""
        if letter not in self.lowers:
            low = self.tokenizer.normalizer.normalize_str(letter) if self.tokenizer.normalizer else letter
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"{low}.") if self.tokenizer.pre_tokenizer else []
            self.lowers[letter] = letter != "Σ" and len(low) == 1 and low == letter.lower() and [end - start for _, (start, end) in cut] == [1, 1]
        return self.lowers[letter]

    def _split(self, text: str) -> tuple[str, str]:
        """Letters and trailing punctuation, or the word and nothing where that isn't safe."""
        letters = text.rstrip(".,!?;:")
        if letters.isalpha() and unicodedata.is_normalized("NFC", letters) and all(map(self._is_plain, letters)):
            return letters.lower(), text[len(letters) :]
        return text, ""

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, new: pa.Array) -> pa.Array:
        """Words of letters have one end each, so many are encoded as one text and cut at the ends."""
        parts = new.to_numpy(zero_copy_only=False).tolist()
        alpha = np.fromiter(map(str.isalpha, parts), bool, len(parts))
        filled = np.fromiter(map(len, parts), np.int64, len(parts)) > 0
        letters = np.flatnonzero(alpha)
        words = [parts[i] for i in letters.tolist()]
        firsts = range(0, len(words), JOINED)
        places, sizes, held, other = [], [], [], np.flatnonzero(~alpha & filled).tolist()
        for some in (firsts[i : i + 100] for i in range(0, len(firsts), 100)):
            for first, ids in zip(some, self._ids([" ".join(words[first : first + JOINED]) for first in some])):
                line = letters[first : first + JOINED]
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(line):
                    places.append(line)
                    sizes.append(np.diff(ends, prepend=0))
                    held.append(ids[: ends[-1]])
                else:
                    other += line.tolist()
        for some in (other[i : i + 20_000] for i in range(0, len(other), 20_000)):
            ids = self._ids([parts[i] for i in some])
            places.append(np.array(some))
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            held += ids
        places.append(np.flatnonzero(~filled))
        sizes.append(np.zeros(len(places[-1]), np.int64))
        found = of_sizes(4 * np.concatenate(sizes), np.concatenate([np.zeros(0, "<u4"), *held]).tobytes(), pa.large_binary())
        return found.take(pa.array(np.argsort(np.concatenate(places))))

    def _lower_codes(self, codes: np.ndarray) -> np.ndarray:
        """Lower case of each code point that is plain and near, else 0."""
        near = codes < NEAR
        new = np.flatnonzero((np.bincount(codes[near], minlength=NEAR) > 0) & (self.lower_of < 0))
        for code in new.tolist():
            letter = chr(code)
            plain = letter.isalpha() and unicodedata.is_normalized("NFC", letter) and self._is_plain(letter)
            self.lower_of[code] = ord(letter.lower()) if plain else 0
        return np.where(near, self.lower_of[np.minimum(codes, NEAR - 1)], 0)

    def _split_all(self, new: pa.Array) -> tuple[pa.Array, pa.Array]:
        """``_split`` of all words at once; one by one only where a letter isn't near."""
        letters = pc.ascii_rtrim(new, ".,!?;:")
        codes = np.frombuffer(raw(letters)[1].tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(pc.utf8_length(letters).to_numpy())])
        low = self._lower_codes(codes)
        rough = np.concatenate([[0], np.cumsum(low == 0)])[cuts]
        plain = (np.diff(rough) == 0) & (np.diff(cuts) > 0)
        lowered = np.where(low > 0, low, codes)
        at = np.concatenate([[0], np.cumsum(1 + (lowered >= 0x80) + (lowered >= 0x800) + (lowered >= 0x10000))])[cuts]
        lower = of_sizes(np.diff(at), lowered.astype("<u4").tobytes().decode("utf-32-le").encode(), pa.large_string())
        ends, data = raw(new)
        over = np.where(plain, np.diff(ends) - np.diff(raw(letters)[0]), 0)
        from_ = np.repeat(ends[1:] - np.cumsum(over), over)
        tails = of_sizes(over, data[from_ + np.arange(len(from_))].tobytes(), pa.large_string())
        heads = pc.if_else(pa.array(plain), lower, new)
        far = np.diff(np.concatenate([[0], np.cumsum(codes >= NEAR)])[cuts]) > 0
        if far.any():
            mask = pa.array(far)
            split = [self._split(w) for w in new.filter(mask).to_pylist()]
            heads, tails = (pc.replace_with_mask(x, mask, pa.array(side, pa.large_string())) for x, side in zip((heads, tails), zip(*split)))
        return heads, tails

    def _learn(self, new: pa.Array) -> pa.Array:
        both = [self.parts.of(side, self._learn_parts) for side in self._split_all(new)]
        return pc.binary_join_element_wise(*both, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.words.nbytes + self.parts.nbytes > CACHE_BYTES:
            self._clear()
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        found = self.words.of(words.values, self._learn)
        ends, data = raw(found)
        ids, bounds = data.view("<u4"), ends[words.offsets.to_numpy()] // 4
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _runs(texts: list[str]) -> Iterator[slice]:
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= TEXT_CHARS:
            yield slice(first, i + 1)
            first, held = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32 and, if asked for, the ids.

    A document is its ids and then ``separator``; a null or empty text is the separator
    alone.  Only documents above ``capacity`` are cut.  Repeated rows give repeated pieces.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for pdf in batches:
            keys, texts = pdf["id"].tolist(), [t or "" for t in pdf["text"]]
            for run in _runs(texts):
                rows = []
                for key, ids in zip(keys[run], encoder.encode(texts[run])):
                    ids = np.append(ids, np.uint32(separator)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((key, piece, start, len(part), zlib.crc32(part.tobytes()), *([part.tolist()] if with_ids else [])))
                yield pd.DataFrame(rows, columns=[f.name for f in schema])
                give_back()
        del encoder
        give_back()

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *PIECE, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(pieces, schema)


# -- the genetic algorithm on one block -------------------------------------------------


def best_fit(order: np.ndarray, lengths: np.ndarray, bins: np.ndarray, room: list[int], capacity: int = CAPACITY) -> None:
    """Put the pieces of ``order`` one by one where the least room is left; fills ``bins`` and ``room``."""
    stacks: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r > 0:
            stacks.setdefault(r, []).append(b)
            mask |= 1 << r
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            stack = stacks[r]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        left = room[b] = r - n
        bins[i] = b
        if left:
            stacks.setdefault(left, []).append(b)
            mask |= 1 << left


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[float, float]:
    """Fewer sequences first, then the mean squared fill (fuller full ones, emptier last ones)."""
    loads = np.bincount(bins, weights=lengths)
    return -len(loads), float(np.mean((loads / capacity) ** 2))


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, rng: np.random.Generator, capacity: int = CAPACITY) -> np.ndarray:
    """Whole well-filled groups of ``b`` enter ``a``; groups of ``a`` with duplicates are
    dissolved, and so are its two emptiest; what they leave is best-fitted, longest first."""
    loads = np.bincount(b, weights=lengths)
    good = np.flatnonzero(loads >= np.quantile(loads, 0.5))
    chosen = rng.choice(good, max(1, len(good) // 4), replace=False)
    injected = np.isin(b, chosen)
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True
    hit[np.argsort(np.bincount(a, weights=lengths), kind="stable")[:2]] = True
    displaced = np.flatnonzero(hit[a] & ~injected)
    child = np.full(len(a), -1, np.int64)
    stay = ~hit[a] & ~injected
    child[stay] = compact(a[stay]) if stay.any() else 0
    n = int(child.max()) + 1
    child[injected] = n + compact(b[injected])
    room = (capacity - np.bincount(child[child >= 0], weights=lengths[child >= 0])).astype(int).tolist()
    best_fit(displaced[np.argsort(-lengths[displaced], kind="stable")], lengths, child, room, capacity)
    return compact(child)


def first_individuals(lengths: np.ndarray, rng: np.random.Generator, size: int, capacity: int = CAPACITY) -> list[np.ndarray]:
    out = []
    for k in range(size):
        noise = 1 + 0.15 * k * rng.random(len(lengths))
        bins = np.zeros(len(lengths), np.int64)
        best_fit(np.argsort(-lengths * noise, kind="stable"), lengths, bins, [], capacity)
        out.append(compact(bins))
    return out


def evolve(lengths: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, generations: int, capacity: int = CAPACITY) -> list[np.ndarray]:
    """Best first.  Stops where the number of sequences is the least possible."""
    least = -(-int(lengths.sum()) // capacity)
    ranked = sorted(population, key=lambda x: fitness(x, lengths, capacity), reverse=True)
    for _ in range(generations):
        if len(ranked) < 2 or int(ranked[0].max()) + 1 <= least:
            break
        first = ranked[0] if rng.random() < 0.7 else ranked[int(rng.integers(len(ranked)))]
        second = ranked[int(rng.integers(1, len(ranked)))]
        child = crossover(first, second, lengths, rng, capacity)
        ranked = sorted([*ranked, child], key=lambda x: fitness(x, lengths, capacity), reverse=True)[: len(population)]
    return ranked


# -- the same over all blocks -----------------------------------------------------------

STATE = "block long, island int, lengths array<int>, population array<array<int>>, n_bins int"


def _epoch(epoch: int, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                lengths = np.asarray(row.lengths, np.int64)
                rng = np.random.default_rng([int(row.block), int(row.island), epoch])
                if epoch:
                    population = [np.asarray(p, np.int64) for p in row.population]
                    population[-1] = np.asarray(row.elite, np.int64)
                else:
                    population = first_individuals(lengths, rng, POPULATION, capacity)
                ranked = evolve(lengths, population, rng, GENERATIONS, capacity)
                rows.append((row.block, row.island, lengths.tolist(), [p.tolist() for p in ranked], int(ranked[0].max()) + 1))
            yield pd.DataFrame(rows, columns=["block", "island", "lengths", "population", "n_bins"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``pieces`` (any columns, among them ``length`` from 1 to ``capacity``) with
    sequence_id and offset, as struct ``row`` and two longs.

    Pieces are dealt to blocks in turn, so equal or null ids and one hot id do no harm.
    Ties in fill go to the last opened sequence.  Empty input gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    n_blocks = max(1, math.ceil(pieces.count() / block))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held, n, chunk, task = [], 0, 0, TaskContext.get().partitionId()
        for pdf in batches:
            held, n = [*held, pdf], n + len(pdf)
            while n >= 2 * block:  # rows are dealt in turn, so this is rare
                whole = pd.concat(held, ignore_index=True)
                yield whole.iloc[:block].assign(block=(task << 16) + chunk, place=range(block))
                held, n, chunk = [whole.iloc[block:]], n - block, chunk + 1
        if n:
            whole = pd.concat(held, ignore_index=True)
            yield whole.assign(block=(task << 16) + chunk, place=range(len(whole)))

    kept = T.StructType([*pieces.schema.fields, T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType())])
    dealt = materialize(pieces.repartition(n_blocks).mapInPandas(gather, kept), "blocks")
    lengths = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", F.col("length").cast("int").alias("length")))).getField("length").alias("lengths"))
    state = lengths.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    width = max(1, min(n_blocks * islands, 4 * spark.sparkContext.defaultParallelism + n_blocks // 8))
    state = state.repartition(width, "block", "island").mapInPandas(_epoch(0, capacity), STATE)
    for e in range(1, epochs):
        state = materialize(state, f"epoch{e}")
        elites = state.select("block", ((F.col("island") + 1) % islands).alias("island"), F.element_at("population", 1).alias("elite"))
        state = state.join(elites, ["block", "island"]).repartition(width, "block", "island").mapInPandas(_epoch(e, capacity), STATE)
    best = state.groupBy("block").agg(F.min_by(F.element_at("population", 1), F.struct("n_bins", "island")).alias("bins"))
    best = best.select("block", F.posexplode("bins").alias("place", "bin"))
    placed = dealt.join(best, ["block", "place"])
    before = W.partitionBy("block", "bin").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        F.struct(*[F.col(c) for c in pieces.columns]).alias("row"),
        (F.col("block") * F.lit(1 << 20) + F.col("bin")).alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of the contract: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    packed = pack(tokenize_pieces(docs, **options))
    return packed.select(F.col("row.id").alias("doc_id"), *[F.col(f"row.{c}").alias(c) for c in ("piece", "start", "length", "ids_crc32")], "sequence_id", "offset")


def op4_grouping_ga_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
