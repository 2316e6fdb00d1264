"""A hidden Markov language model of whole texts.

1. Texts are cut into tokens (words and one end) and coded in blocks of text with a dictionary of their own,
   so that a word is one row per block.  Words are counted over all learning documents by grouped sums,
   and each block's words are joined with their counts: no task and no driver holds the vocabulary.
2. A state emits a symbol: the hash bucket of a known word, the end, or the unknown word.  Baum-Welch
   learns start, transition and emission probabilities; tasks hand on expected counts, which Spark adds up per
   symbol.  The parameters have (``BUCKETS`` + 2) * ``STATES`` numbers, whatever the vocabulary.
3. A known word has its share of its bucket's counts; the unknown word keeps the probability that add-one
   smoothing gives it, the same in every state.  So probabilities of known words, end and unknown word sum to one.
4. The likelihood of a text is exact: the scaled forward recursion runs over all of it.  Learning cuts
   texts into pieces of ``PIECE`` tokens; later pieces begin in the stationary distribution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, table, text_blocks

STATES = 8
BUCKETS = 16_384
END, UNKNOWN, SYMBOLS = BUCKETS, BUCKETS + 1, BUCKETS + 2
ROUNDS = 8  #: of Baum-Welch at most
GAIN = 1e-3  #: nats a token that a round must gain for another one
PIECE = 1_024  #: tokens of a piece in learning
PRIOR = 10.0  #: counts that a state gets from the overall distribution
BLOCK_BYTES = 24_000_000  #: text of a block, one text at least
STEP_TOKENS = 500_000  #: tokens whose states a task holds at a time in learning
SCORE_TOKENS = 2_000_000  #: the same in scoring, where only one state per text is held
SEED = 13


def learns(id_: Column) -> Column:
    """Whether the model learns from the document: its id's CRC-32 is not 2 modulo 7; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 7 != 2


def tokens_of(texts: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray]:
    """Words of some texts in order, A-Z in lower case, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    some = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(some), np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


CODED = "kind string, block long, id long, learns boolean, codes array<int>, word string, code int, n long"


def code_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, learns, text): a row per document with the codes of its words, and a row per different word of a block
    with its number in learning documents."""
    kinds = [("kind", pa.string()), ("block", pa.int64()), ("id", pa.int64()), ("learns", pa.bool_()), ("codes", pa.list_(pa.int32())), ("word", pa.string()), ("code", pa.int32()), ("n", pa.int64())]

    def rows(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(size, kind)) for name, kind in kinds], [name for name, _ in kinds])

    block = TaskContext.get().partitionId() << 32
    for b in batches:
        for at, texts in text_blocks(b.column(2), BLOCK_BYTES):
            words, length = tokens_of(texts)
            coded = words.dictionary_encode()
            codes = coded.indices.cast(pa.int32())
            learning = b.column(1)[at]
            n = np.bincount(codes.to_numpy(), weights=np.repeat(learning.to_numpy(zero_copy_only=False), length), minlength=len(coded.dictionary)).astype(np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
            yield rows(len(texts), kind=pa.array(["text"] * len(texts)), block=pa.array(np.full(len(texts), block)), id=b.column(0)[at], learns=learning, codes=pa.ListArray.from_arrays(ends, codes))
            size = len(coded.dictionary)
            if size:
                yield rows(size, kind=pa.array(["word"] * size), block=pa.array(np.full(size, block)), word=coded.dictionary.cast(pa.string()), code=pa.array(np.arange(size, dtype=np.int32)), n=pa.array(n))
            block += 1
    give_back()


@dataclass
class Totals:
    tokens: int  #: N, ends of texts included
    kinds: int  #: V, the end included
    texts: int  #: learning documents
    share: np.ndarray  #: of each symbol among learning tokens

    @property
    def unseen(self) -> float:
        """Probability of the unknown word by add-one smoothing."""
        return 1.0 / (self.tokens + self.kinds + 1)


FACTS = "id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, symbols array<int>"


def _facts(texts: pa.Table, words: pa.Table, totals: Totals, of_bucket: np.ndarray) -> pa.Table:
    """Of a block's documents and words: FACTS, where ``inside`` is the log10 share of the words in their buckets."""
    column = lambda t, c: t.column(c).combine_chunks()
    code = column(words, "code").to_numpy(zero_copy_only=False).astype(np.int64)
    n, bucket = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    n[code], bucket[code] = column(words, "n").to_numpy(zero_copy_only=False), column(words, "bucket").to_numpy(zero_copy_only=False)
    known = n > 0
    denominator = totals.tokens + totals.kinds + 1
    base, symbol = np.log10((n + 1) / denominator), np.where(known, bucket, UNKNOWN)
    inside = np.where(known, np.log10(np.maximum(n, 1) / np.maximum(of_bucket[bucket], 1)), 0.0)
    codes = column(texts, "codes")
    flat, length = codes.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(codes).to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(length)
    owner = np.repeat(np.arange(size), length)
    total = lambda x: np.bincount(owner, weights=x[flat], minlength=size)
    ends = np.concatenate([[0], np.cumsum(length + 1)])
    symbols = np.full(ends[-1], END, np.int32)
    symbols[np.arange(len(flat)) + owner] = symbol[flat]
    return pa.table(
        {
            "id": column(texts, "id"),
            "held_out": pc.invert(column(texts, "learns")),
            "n_tokens": length + 1,
            "n_known": total(known).astype(np.int64) + (totals.texts > 0),
            "base_score": total(base) + math.log10((totals.texts + 1) / denominator),
            "inside": total(inside),
            "symbols": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(symbols)),
        }
    )


def count_tokens(rows: DataFrame) -> tuple[DataFrame, Totals]:
    """FACTS of (id, learns, text), written to the shared folder, and the totals of the learning documents."""
    coded = materialize(rows.mapInArrow(code_words, CODED), "coded", "kind")
    texts, words = coded.filter("kind = 'text'"), coded.filter("kind = 'word'")
    counts = words.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")
    counts = materialize(counts.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")), "vocabulary")
    of_bucket, kinds = np.zeros(BUCKETS, np.int64), 0
    for bucket, n, different in counts.groupBy("bucket").agg(F.sum("n"), F.count("*")).collect():  # at most BUCKETS rows
        of_bucket[bucket], kinds = n, kinds + different
    ends = texts.filter("learns").count()
    all_tokens = int(of_bucket.sum()) + ends
    totals = Totals(all_tokens, kinds + (ends > 0), ends, np.concatenate([of_bucket, [ends, 0]]) / max(all_tokens, 1))
    zero = F.lit(0)
    joined = words.select("block", "code", "word").join(counts, "word", "left").select(F.col("block").alias("of"), "code", F.coalesce("n", zero).alias("n"), F.coalesce("bucket", zero).alias("bucket"))

    def facts(left: pa.Table, right: pa.Table) -> pa.Table:
        return _facts(left, right, totals, of_bucket)

    found = texts.select("block", "id", "learns", "codes").groupBy("block").cogroup(joined.groupBy("of")).applyInArrow(facts, FACTS)
    found = materialize(found, "facts")
    discard(coded)
    discard(counts)
    return found, totals


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray  #: [from, to]
    emit: np.ndarray  #: [symbol, state]

    def stationary(self) -> np.ndarray:
        p = np.full(STATES, 1 / STATES)
        for _ in range(200):
            p = p @ self.move
        return p / p.sum()

    @staticmethod
    def first(totals: Totals) -> Model:
        """States that differ by chance, and mostly stay."""
        rng = np.random.default_rng(SEED)
        move = np.full((STATES, STATES), 0.1 / max(STATES - 1, 1)) + np.eye(STATES) * (0.9 - 0.1 / max(STATES - 1, 1))
        return Model(np.full(STATES, 1 / STATES), move, _emissions(totals.share[:, None] * rng.random((SYMBOLS, STATES)), totals, 0.0))


def _emissions(counts: np.ndarray, totals: Totals, prior: float) -> np.ndarray:
    """Each state's distribution over the symbols from its counts; the unknown word has the same probability in all."""
    e = counts + prior * totals.share[:, None]
    total = e.sum(0)
    e = np.where(total > 0, e / np.where(total > 0, total, 1), totals.share[:, None]) * (1 - totals.unseen)
    e[UNKNOWN] = totals.unseen
    return e


def _by_length(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sequences, longest first, and how many of them have a token at each step."""
    order = np.argsort(-length, kind="stable")
    longest = length[order[0]] if len(order) else 0
    return order, len(length) - np.searchsorted(np.sort(length), np.arange(longest), side="right")


def log_likelihood(symbols: np.ndarray, length: np.ndarray, model: Model) -> np.ndarray:
    """Natural log probability of each sequence of symbols (laid end to end): the scaled forward recursion."""
    order, at_step = _by_length(length)
    begin = (np.cumsum(length) - length)[order]
    out, a = np.zeros(len(length)), None
    for t, n in enumerate(at_step.tolist()):
        a = (model.start if t == 0 else a[:n] @ model.move) * model.emit[symbols[begin[:n] + t]]
        scale = a.sum(1)
        a /= scale[:, None]
        out[:n] += np.log(scale)
    back = np.empty_like(out)
    back[order] = out
    return back


def pieces_of(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the pieces of texts (laid end to end), and which of them begin a text."""
    many = -(-length // PIECE)
    owner = np.repeat(np.arange(len(length)), many)
    no = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return np.minimum(PIECE, length[owner] - no * PIECE), no == 0


def expected_counts(symbols: np.ndarray, length: np.ndarray, opens: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of sequences laid end to end: starts, moves, emissions, and their log likelihood.

    A sequence that ``opens`` a text begins in the start distribution, another in the stationary one.
    """
    order, at_step = _by_length(length)
    begin, opens = (np.cumsum(length) - length)[order], opens[order]
    offset = np.concatenate([[0], np.cumsum(at_step)])
    at = np.concatenate([begin[:n] + t for t, n in enumerate(at_step.tolist())]) if len(at_step) else np.zeros(0, np.int64)
    packed = symbols[at]
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    shown = emit[packed]
    alpha, scale = np.empty_like(shown), np.empty(len(packed), np.float32)
    for t, n in enumerate(at_step.tolist()):
        here = slice(offset[t], offset[t] + n)
        before = np.where(opens[:, None], model.start, model.stationary()).astype(np.float32) if t == 0 else alpha[offset[t - 1] : offset[t - 1] + n] @ move
        a = before * shown[here]
        s = a.sum(1)
        scale[here] = s
        np.divide(a, s[:, None], out=alpha[here])
    moves, back = np.zeros((STATES, STATES)), np.ascontiguousarray(move.T)
    beta = None
    for t in range(len(at_step) - 1, -1, -1):
        n, here = at_step[t], slice(offset[t], offset[t + 1])
        own = np.ones((n, STATES), np.float32)
        if beta is not None:
            own[: len(beta)] = beta @ back
            moves += alpha[offset[t] : offset[t] + len(beta)].T @ beta
        beta = own * shown[here] / scale[here, None]
        alpha[here] *= own  # the states' probabilities now
    emissions = np.stack([np.bincount(packed, weights=alpha[:, k], minlength=SYMBOLS) for k in range(STATES)], 1)
    starts = alpha[: len(opens)][opens].sum(0, dtype=np.float64) if len(packed) else np.zeros(STATES)
    return starts, moves * model.move, emissions, float(np.log(scale.astype(np.float64)).sum())


def _runs(lists: pa.ListArray, most: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of lists of about ``most`` numbers, one list at least: where they are, their numbers and lengths."""
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(length), 0
    while first < len(length):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield slice(first, last), lists[first:last].flatten().to_numpy(zero_copy_only=False), length[first:last]
        first = last


#: Rows of expected counts: symbols from 0 on, moves from state i at -1 - i, then the starts and the likelihood.
STARTS, LIKELIHOOD = -1 - STATES, -2 - STATES


def baum_welch(facts: DataFrame, totals: Totals, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model of the learning documents' symbols, and the nats a token of each round."""
    model, gained = Model.first(totals), []
    symbols = facts.filter("not held_out").select("symbols")
    schema = "symbol int, " + ", ".join(f"w{k} float" for k in range(STATES))
    for _ in range(rounds):
        sent = facts.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            out = np.zeros((SYMBOLS + STATES + 2, STATES))  # from LIKELIHOOD on
            for b in batches:
                for _, flat, length in _runs(b.column(0), STEP_TOKENS):
                    starts, moves, emissions, likelihood = expected_counts(flat, *pieces_of(length), sent.value)
                    out[0, 0] += likelihood
                    out[1] += starts
                    out[2 : 2 + STATES] += moves[::-1]
                    out[2 + STATES :] += emissions
            give_back()
            some = np.flatnonzero(out.any(1))
            yield pa.RecordBatch.from_arrays([pa.array((some + LIKELIHOOD).astype(np.int32)), *[pa.array(out[some, k].astype(np.float32)) for k in range(STATES)]], ["symbol", *[f"w{k}" for k in range(STATES)]])

        found = symbols.mapInArrow(expect, schema).groupBy("symbol").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(STATES)])
        counts = np.zeros((SYMBOLS + STATES + 2, STATES))
        for symbol, *w in found.collect():  # at most SYMBOLS + STATES + 2 rows
            counts[symbol - LIKELIHOOD] = w
        sent.destroy()
        moves, starts = counts[2 : 2 + STATES][::-1] + 0.1, counts[1] + 0.1
        model = Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), _emissions(counts[2 + STATES :], totals, PRIOR))
        gained.append(counts[0, 0] / max(totals.tokens, 1))
        if len(gained) > 1 and gained[-1] - gained[-2] < GAIN:
            break
    return model, gained


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``, in log10.

    A null or empty text is its end alone.  If there is nothing to learn from, every score is that of the one unknown
    word, 0.  Repeated rows are rows; other columns are ignored.
    """
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("id"), learns(id_).alias("learns"), F.col(text_col).cast("string").alias("text"))
    facts, totals = count_tokens(rows)
    out = facts.withColumn("train_tokens", F.lit(totals.tokens).cast("long"))
    columns = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if not totals.tokens:
        return out.withColumn("score", F.col("base_score")).select(columns)
    model = docs.sparkSession.sparkContext.broadcast(baum_welch(facts, totals, rounds)[0])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [log_likelihood(flat, length, model.value) / math.log(10) for _, flat, length in _runs(b.column("symbols"), SCORE_TOKENS)]
            total = np.concatenate(found) if found else np.zeros(0)
            total = total + b.column("inside").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns[:-1]], pa.array(total)], columns)
        give_back()

    return out.mapInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op13_hidden_markov(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
