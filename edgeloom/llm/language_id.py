"""Language identification with interpolated Kneser-Ney character models.

A word is its letters in lower case between boundary marks.  Character n-grams of order
``ORDER`` are counted per language over all learning documents, and all are kept; lower
orders use the number of different left neighbours (continuation counts).  Spark fits the models by
grouped joins of n-grams with their contexts and suffixes.  Up to ``MODEL_CELLS`` numbers a model is broadcast as,
per order, one sorted array of n-gram hashes with a column of log probabilities per language; a larger one stays
in tables, with which blocks of texts join the different n-grams that they ask for.  Both score alike.

A document gets the language with the lowest cross-entropy per character.  It is
rejected if that is farther above the language's usual value than calibration allows.  Calibration
halves the learning documents: a model of each half judges all documents of the other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, table

ORDER = 4
HELD_GRAMS = 250_000  #: different n-grams that a task counts before it hands them on
SLACK = 2.0  #: times the largest usual deviation
UNDETERMINED = "und"
TEXT_CHARS = 1_000_000
MODEL_CELLS = 16_000_000  #: a model of at most so many numbers is broadcast; a larger one stays in tables that texts are joined with
BLOCK_CHARS = 4_000_000  #: characters of the texts that are joined with such tables together
MODELS = ("n", "first", "second")  #: the model of all learning documents, and those of its two halves
#: Verdict of the model of all; ``apart_`` is that of the half that a learning document is not in, null for others.
VERDICT = "lang_pred string, score double, entropy double, chars long, apart_lang string, apart_entropy double"
DIGITS = 4  #: entropies and deviations are rounded to so many digits for their quantiles, so that these are of few different values
SCORED = 100_000  #: n-grams looked up at a time
BEGIN, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of an array of code points."""
    h = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        h = (h + grams[:, k].astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def as_text(grams: np.ndarray) -> list[str]:
    return np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel().tolist()


def letter_runs(word: str) -> Iterator[str]:
    """Runs of Unicode letters; the pattern also takes numerals such as one half, which part runs."""
    for run in LETTERS.findall(word):
        if run.isalpha():
            yield run
        else:
            yield from (text for text in "".join(c if c.isalpha() else " " for c in run).split())


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the words' letter runs as code points, and the index of each one's word."""
    runs, owner = [], []
    for i, w in enumerate(words):
        for run in letter_runs(w.decode("utf-8", "replace").lower()):
            runs.append(BEGIN * (ORDER - 1) + run + END)
            owner.append(i)
    if not runs:
        return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    points = np.frombuffer("".join(runs).encode("utf-32-le", "replace"), np.uint32)
    owners = np.repeat(np.array(owner), [len(r) for r in runs])
    windows = np.lib.stride_tricks.sliding_window_view(points, ORDER)
    real = windows[:, -1] != ord(BEGIN)
    return windows[real], owners[ORDER - 1 :][real]


def blocks(texts: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, list[bytes]]]:
    """Runs of texts with the document and word code of each word, and the different words."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= TEXT_CHARS or i == len(texts) - 1:
            words = [x.encode("utf-8", "replace").split() for x in texts[first : i + 1]]
            docs = np.repeat(np.arange(len(words)), [len(w) for w in words])
            flat = np.empty(len(docs), object)
            flat[:] = [w for ws in words for w in ws]
            codes, different = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), [])
            yield slice(first, i + 1), docs, codes, list(different)
            first, held = i + 1, 0
            give_back()


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, n, aside) of a task's documents, ``aside`` the part of n in documents of the second half; a
    gram comes anew each time that the counters are handed on."""
    counts: dict[tuple[str, bool], Counter] = {}

    def hand_on() -> Iterator[pd.DataFrame]:
        for (lang, aside), own in counts.items():
            if own:
                n = np.array(list(own.values()), np.int64)
                yield pd.DataFrame({"lang": lang, "gram": list(own), "n": n, "aside": n * aside})
        counts.clear()

    for pdf in batches:
        for key, part in pdf.groupby(["lang", "aside"]):
            own = counts.setdefault(key, Counter())
            for _, _, codes, different in blocks(part["text"].tolist()):
                often = np.bincount(codes, minlength=len(different))
                grams, owner = word_grams(different)
                if not len(grams):
                    continue
                group = pd.factorize(gram_hash(grams))[0]
                n = np.bincount(group, weights=often[owner]).astype(np.int64)
                at = np.zeros(len(n), np.int64)
                at[group[::-1]] = np.arange(len(group))[::-1]
                own.update(dict(zip(as_text(grams[at]), n.tolist())))
                if sum(map(len, counts.values())) > HELD_GRAMS:
                    yield from hand_on()
                    own = counts.setdefault(key, Counter())
    yield from hand_on()


@dataclass
class Model:
    """``hashes[m]`` sorted; ``logp[m]`` and ``backoff[m]`` (of contexts) have a column per language of each of ``MODELS``."""

    langs: list[str]
    floor: np.ndarray  #: log probability of what is unseen, per column
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    logp: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backoff: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def unseen(self) -> float:
        return float(self.floor[0])

    @property
    def halves(self) -> bool:
        return len(self.floor) > len(self.langs)

    def whole(self) -> Model:
        """The model of all learning documents alone."""
        n = len(self.langs)
        logp, backoff = ({m: x[:, :n].copy() for m, x in columns.items()} for columns in (self.logp, self.backoff))
        return Model(self.langs, self.floor[:n], self.hashes, logp, self.contexts, backoff)

    @staticmethod
    def _find(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table_, keys), max(len(table_) - 1, 0))
        return at, (table_[at] == keys) if len(table_) else np.zeros(len(keys), bool)

    def score(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each gram's last character in each language of each model."""
        if order == 0:
            return np.full((len(grams), len(self.floor)), self.floor)
        grams = grams[:, grams.shape[1] - order :]
        at, known = self._find(self.hashes[order], gram_hash(grams))
        out = np.empty((len(grams), len(self.floor)), np.float64)
        out[known] = self.logp[order][at[known]]
        if not known.all():
            rest = grams[~known]
            low = self.score(rest, order - 1)
            at, known_context = self._find(self.contexts[order], gram_hash(rest[:, :-1]))
            low[known_context] += self.backoff[order][at[known_context]]
            out[~known] = low
        return out


@dataclass
class Grams:
    """Models as tables that Spark holds, of the counts that ``MODELS`` names: arrays with a value per language.

    ``probabilities[m]`` is (gram, and a column per model) of the n-grams of all; one that a half does not have has the
    probability that the half's lower orders give it.  ``contexts[m]`` is (context, and a column per model), the weights that go
    to the next lower order, 1 where a model does not have the context.
    """

    langs: list[str]
    probabilities: dict[int, DataFrame] = field(default_factory=dict)
    contexts: dict[int, DataFrame] = field(default_factory=dict)
    floor: np.ndarray | None = None
    cells: int = 0  #: the local model has at most so many numbers


def fit(counts: DataFrame) -> Grams | None:
    """Kneser-Ney models of a (lang, gram, and a count per model) table by grouped joins, order by order; none if it is empty.

    An n-gram joins its context and its suffix; either has at most as many partners as there are letters.
    Only the sums that set a language's discounts reach the driver.
    """
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    out, levels = Grams(langs), {ORDER: counts}
    for m in range(ORDER - 1, 0, -1):
        shorter = levels[m + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram"))
        levels[m] = materialize(shorter.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in MODELS]), "grams")
    every = reduce(DataFrame.union, [level.select(F.lit(m).alias("m"), "lang", *MODELS) for m, level in levels.items()])
    often = [F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in MODELS for k in (1, 2)]
    rare = {(r.m, r.lang): r for r in every.groupBy("m", "lang").agg(F.count("*").alias("rows"), *often).collect()}
    out.cells = 2 * len(MODELS) * len(langs) * sum(r.rows for r in rare.values())
    # Each letter is the last of some n-gram, the mark of a word's begin of none; one more for what is unseen.
    letters = levels[1].agg(*[F.count_distinct(F.when(F.col(c) > 0, F.col("gram"))).alias(c) for c in MODELS]).first()
    unseen = {c: -float(np.log(letters[c] + 2)) for c in MODELS}
    out.floor = np.repeat([unseen[c] for c in MODELS], len(langs))

    def discounts(m: int, c: str) -> str:
        pairs = [(rare[m, lang][f"{c}_1"], rare[m, lang][f"{c}_2"]) if (m, lang) in rare else (0, 0) for lang in langs]
        return "array(" + ", ".join(f"{one / (one + 2 * two) if one and two else 0.5!r}D" for one, two in pairs) + ")"

    def by_language(value: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == lang, value)), F.lit(0)).cast("double") for lang in langs])

    def each(value: str) -> str:
        return f"transform(sequence(0, {len(langs) - 1}), j -> {value})"

    for m in range(1, ORDER + 1):
        context = F.expr(f"substring(gram, 1, {m - 1})").alias("context")
        sums = levels[m].groupBy(context).agg(*[by_language(F.col(c)).alias(f"{c}_total") for c in MODELS], *[by_language((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in MODELS])
        weights = [F.expr(each(f"if({c}_total[j] > 0, {discounts(m, c)}[j] * {c}_kinds[j] / {c}_total[j], 1D)")).alias(c) for c in MODELS]
        out.contexts[m] = materialize(sums.select("context", *[f"{c}_total" for c in MODELS], *weights), "contexts")
        rows = levels[m].groupBy("gram").agg(*[by_language(F.col(c)).alias(f"{c}_count") for c in MODELS]).select("*", context).join(out.contexts[m], "context")
        if m > 1:
            lower = out.probabilities[m - 1].select(F.col("gram").alias("suffix"), *[F.col(c).alias(f"{c}_lower") for c in MODELS])
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower, "suffix")
        made = []
        for c in MODELS:
            below = f"{c}_lower[j]" if m > 1 else f"{float(np.exp(unseen[c]))!r}D"
            own = f"if({c}_count[j] > 0, ({c}_count[j] - {discounts(m, c)}[j]) / {c}_total[j], 0D)"
            made.append(F.expr(each(f"{own} + {c}[j] * {below}")).alias(c))
        out.probabilities[m] = materialize(rows.select("gram", *made), "probabilities")
    return out


def local_model(grams: Grams) -> Model:
    """The models as sorted arrays, to be broadcast; only for at most ``MODEL_CELLS`` numbers."""

    def arrays(df: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
        got = df.select(key, F.concat(*MODELS).alias("values")).toArrow()
        points = np.frombuffer("".join(got[key].to_pylist()).encode("utf-32-le"), np.uint32).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, 1), np.uint32)
        values = np.log(got["values"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, len(grams.floor))
        hashes = gram_hash(points)
        order = np.argsort(hashes)
        return hashes[order], values[order]

    model = Model(grams.langs, grams.floor)
    for m in range(1, ORDER + 1):
        model.hashes[m], model.logp[m] = arrays(grams.probabilities[m], "gram")
        model.contexts[m], model.backoff[m] = arrays(grams.contexts[m], "context")
    return model


def look_up(asked: DataFrame, grams: Grams) -> DataFrame:
    """(gram, logp) of different n-grams: log probability of the last character in each language of each model, by joins."""
    asks = {ORDER: asked}
    for m in range(ORDER - 1, 0, -1):
        asks[m] = materialize(asks[m + 1].select(F.expr("substring(gram, 2)").alias("gram")).distinct(), "asked")
    found, none = None, F.array(*[F.lit(float(x)) for x in grams.floor])
    for m in range(1, ORDER + 1):
        own = grams.probabilities[m].select("gram", F.transform(F.concat(*MODELS), lambda x: F.ln(x)).alias("own"))
        weight = grams.contexts[m].select("context", F.transform(F.concat(*MODELS), lambda x: F.ln(x)).alias("weight"))
        rows = asks[m].withColumn("context", F.expr(f"substring(gram, 1, {m - 1})")).join(own, "gram", "left").join(weight, "context", "left")
        if m > 1:
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(found.select(F.col("gram").alias("suffix"), F.col("logp").alias("lower")), "suffix")
        else:
            rows = rows.withColumn("lower", none)
        back = F.when(F.col("weight").isNull(), F.col("lower")).otherwise(F.zip_with("lower", "weight", lambda x, y: x + y))
        found = materialize(rows.select("gram", F.coalesce("own", back).alias("logp")), "found")
    return found


def scored(rows: DataFrame, grams: Grams) -> DataFrame:
    """(nr, and ``VERDICT``) of each of ``rows`` (nr, text, half), without a model in any task: texts meet the n-grams that
    their block asks for."""
    n = rows.agg(F.ceil(F.sum(F.length("text")) / F.lit(BLOCK_CHARS))).first()[0] or 1
    placed = rows.withColumn("block", F.pmod(F.xxhash64("nr"), F.lit(n)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, part in pdf.groupby("block"):
                for _, _, _, different in blocks(part["text"].fillna("").tolist()):
                    points = word_grams(different)[0]
                    if len(points):
                        points = points[np.unique(gram_hash(points), return_index=True)[1]]
                        yield pd.DataFrame({"block": block, "gram": as_text(points)})

    def judge(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        points = np.frombuffer("".join(known["gram"]).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        hashes = gram_hash(points)
        order = np.argsort(hashes)
        logp = np.array(known["logp"].tolist(), np.float64).reshape(-1, len(floor))
        model = Model(langs, floor, hashes={ORDER: hashes[order]}, logp={ORDER: logp[order]})
        out = verdicts(model, texts["text"].fillna("").tolist(), texts["half"].to_numpy())
        out.insert(0, "nr", texts["nr"].to_numpy())
        return out

    langs, floor = grams.langs, grams.floor
    asked = materialize(placed.select("block", "text").mapInPandas(ask, "block long, gram string").distinct(), "asked")
    known = asked.join(look_up(asked.select("gram").distinct(), grams), "gram")
    return placed.groupBy("block").cogroup(known.select("block", "gram", "logp").groupBy("block")).applyInPandas(judge, f"nr long, {VERDICT}")


def measure(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per model and language (nats a character) and number of characters of each text."""
    columns = len(model.floor)
    entropy, chars = np.zeros((len(texts), columns)), np.zeros(len(texts), np.int64)
    for run, docs, codes, different in blocks(texts):
        grams, owner = word_grams(different)
        size = run.stop - run.start
        per_word = np.bincount(owner, minlength=len(different))
        chars[run] = np.bincount(docs, weights=per_word[codes], minlength=size)
        of_word = np.zeros((len(different), columns))
        for at in range(0, len(grams), SCORED):
            logp, own = model.score(grams[at : at + SCORED]), owner[at : at + SCORED]
            for j in range(columns):
                of_word[own[0] : own[-1] + 1, j] += np.bincount(own - own[0], weights=logp[:, j])
        for j in range(columns):
            entropy[run, j] = -np.bincount(docs, weights=of_word[codes, j], minlength=size)
    return entropy / np.maximum(chars, 1)[:, None], chars


def verdicts(model: Model, texts: list[str], half: np.ndarray) -> pd.DataFrame:
    """The columns of ``VERDICT``; ``half`` is 0 or 1 for learning documents, -1 for others."""
    entropy, chars = measure(model, texts)
    every, rows, some = entropy[:, : len(model.langs)], np.arange(len(texts)), chars > 0
    apart = np.where(half[:, None] == 0, entropy[:, -len(model.langs) :], entropy[:, -2 * len(model.langs) : -len(model.langs)] if model.halves else every)
    langs, best, near = np.array(model.langs, object), every.argmin(1), apart.argmin(1)
    low = every[rows, best]
    odds = np.exp((low[:, None] - every) * np.minimum(chars, 60)[:, None]).sum(1)
    judged = some & (half >= 0) & model.halves
    own = {"lang_pred": np.where(some, langs[best], UNDETERMINED), "score": np.where(some, 1 / odds, 0.0), "entropy": np.where(some, low, np.nan), "chars": chars}
    return pd.DataFrame(own | {"apart_lang": np.where(judged, langs[near], None), "apart_entropy": np.where(judged, apart[rows, near], np.nan)})


def learn(docs: DataFrame, learning, id_col: str, text_col: str, lang_col: str) -> Model | Grams | None:
    """Models of the documents for which ``learning`` holds and of their halves; none if they have no letters.

    Up to ``MODEL_CELLS`` numbers it is a local one, beyond that tables.
    """
    rows = docs.filter(learning & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    texts = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), (half(id_col) == 1).alias("aside"))
    found = texts.mapInPandas(count_grams, "lang string, gram string, n long, aside long")
    counts = materialize(found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum(F.col("n") - F.col("aside")).alias("first"), F.sum("aside").alias("second")), "grams")
    grams = fit(counts)
    return grams if grams is None or grams.cells > MODEL_CELLS else local_model(grams)


def half(id_col: str) -> Column:
    """Which half of the learning documents one is in, 0 or 1."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(2)).cast("int")


def deviation(entropy: Column, chars: Column, usual: Column) -> Column:
    """How far above the usual, scaled by what a text of this length can tell."""
    return (entropy - usual) * F.sqrt(F.least(chars, F.lit(400)))


def calibrate(judged: DataFrame, langs: list[str]) -> tuple[Column, Column]:
    """Usual entropy and allowed deviation of ``lang_pred``, by all learning documents under the model of the other half."""

    def of(values: dict[str, float], lang: str) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(lang))

    def quantile(value: Column, share: float) -> dict[str, float]:
        return dict(seen.groupBy("apart_lang").agg(F.percentile(F.round(value, DIGITS), share)).collect())

    seen = judged.filter(F.col("apart_lang").isNotNull())
    usual = quantile(F.col("apart_entropy"), 0.5)
    allowed = {}
    if usual:
        far = quantile(deviation(F.col("apart_entropy"), F.col("chars"), of(usual, "apart_lang")), 0.999)
        allowed = {lang: SLACK * max(value, 5.0) for lang, value in far.items()}
    # A language without calibration documents takes the mildest thresholds of the others.
    mild = (max(usual.values()), max(allowed.values())) if usual else (0.0, float("inf"))
    return of({x: usual.get(x, mild[0]) for x in langs}, "lang_pred"), of({x: allowed.get(x, mild[1]) for x in langs}, "lang_pred")


def _by_local_model(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (.., text, half) with the columns of ``VERDICT``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(VERDICT)
    def verdict(text: pd.Series, half: pd.Series) -> pd.DataFrame:
        return verdicts(sent.value, [t or "" for t in text], half.to_numpy())

    # A filter on the verdict would be pushed below it and score texts once more.
    return rows.withColumn("v", verdict.asNondeterministic()("text", "half")).select(*rows.columns, "v.*")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """(row, held_out, lang_pred, score, entropy, accepted): ``row`` holds all columns of ``docs``, or those of ``keep``.

    Learns from documents with a language whose CRC-32 of the id is not 1 modulo 3.  A null
    text or one without letters is ``und`` with score 0 and not accepted, and so is all if
    nothing can be learned; a null id counts as the empty text.  Repeated rows are rows.
    With ``keep`` each text is scored once, by all models together, and what they say is written with those columns.
    """
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1
    model = learn(docs, ~held_out, id_col, text_col, lang_col)
    side = F.when(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull(), half(id_col)).otherwise(-1)
    row = F.struct(*[F.col(c) for c in keep or docs.columns]).alias("row")
    out = docs.select(row, held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"), side.alias("half"))
    if model is None:
        verdict = (F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("accepted"))
        return out.select("row", "held_out", *verdict)
    if isinstance(model, Grams):
        numbered = materialize(out.withColumn("nr", F.monotonically_increasing_id()), "numbered")
        seen = materialize(scored(numbered.select("nr", "text", "half"), model), "judged")
        judged = numbered.join(seen, "nr")
    elif keep is None:  # rows may be large and are not written; all are scored after the thresholds are known
        seen = materialize(_by_local_model(out.filter("half >= 0").select("text", "half"), model), "judged")
        judged = _by_local_model(out, model.whole())
    else:
        judged = seen = materialize(_by_local_model(out, model).drop("text"), "judged")
    usual, allowed = calibrate(seen, model.langs)
    near = deviation(F.col("entropy"), F.col("chars"), usual) <= allowed
    return judged.select("row", "held_out", "lang_pred", "score", "entropy", ((F.col("chars") > 0) & F.coalesce(near, F.lit(False))).alias("accepted"))


def op7_kneser_ney_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, keep=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "held_out", "lang_pred", "score", "entropy", "accepted")
