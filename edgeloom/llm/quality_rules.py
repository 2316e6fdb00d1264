"""Quality rules kept as a ledger of bitmasks.

Every rule is evaluated once per document.  The ledger is written down with the
measurements and one bit per failed rule, keyed by the version of the rule set; policies
are versioned masks over those bits, so a new policy or an ablation reads the ledger and
never a text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_path, table

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_capitals", "n_exclaims", "max_word_chars")

#: Rule name -> SQL condition of failure over the measurements.  The position is the bit.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 7 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("capitals", "2 * n_capitals > n_letters"),
    ("exclamations", "4 * n_exclaims > n_words"),
    ("no_letters", "n_letters = 0"),
    ("giant_word", "max_word_chars > 1000"),
)
RULE_SET = f"{zlib.crc32(repr(RULES).encode()):08x}"  #: version of the rule set
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document fails if it fails any rule of it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


def mask_of(rules: Sequence[str]) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


POLICIES = {
    "v1": Policy("v1", BASE_RULES),
    "v2": Policy("v2", tuple(n for n, _ in RULES)),
}


def repeated_words(docs: np.ndarray, codes: np.ndarray, n_docs: int) -> np.ndarray:
    """Words per document inside 3-word windows that occur twice or more in it.

    ``docs`` and ``codes`` give the document and the word of each place, in order.
    Windows are numbered exactly (pairs, then triples, then triples of a document).
    """
    out = np.zeros(n_docs, np.int64)
    if len(codes) < 3:
        return out
    size = int(codes.max()) + 1
    pair = pd.factorize(codes[:-2] * size + codes[1:-1])[0]
    triple = pd.factorize(pair * size + codes[2:])[0]
    window = pd.factorize(triple * n_docs + docs[:-2])[0]
    whole = docs[:-2] == docs[2:]
    seen = np.bincount(window[whole], minlength=int(window.max()) + 1)
    again = whole & (seen[window] > 1)
    inside = np.zeros(len(codes), bool)
    for k in range(3):
        inside[k : len(codes) - 2 + k] |= again
    return np.bincount(docs[inside], minlength=n_docs)


def _measure_block(texts: list[str]) -> np.ndarray:
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes.split() takes exactly \x20 and \x09-\x0D
    lens = np.array([len(w) for w in words], np.int64)
    docs = np.repeat(np.arange(len(texts)), lens)
    flat = [x for w in words for x in w]
    codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.empty(0, np.int64)
    rows = np.zeros((len(texts), 10), np.int64)
    rows[:, 0] = lens
    rows[:, 5] = repeated_words(docs, codes, len(texts))
    for i, t in enumerate(texts):
        lines, known = 0, set()
        for line in t.split("\n"):
            if line.strip(SPACES):
                lines += 1
                known.add(line)
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = points[points < 128].astype(np.uint8)
        capitals = np.count_nonzero((low >= 65) & (low <= 90))
        rows[i, 1] = len(t) - sum(map(t.count, SPACES))
        rows[i, 2] = sum(map(t.count, SYMBOLS))
        rows[i, 3], rows[i, 4] = lines, lines - len(known)
        rows[i, 6] = capitals + np.count_nonzero((low >= 97) & (low <= 122)) + np.count_nonzero(points > 0xBF)
        rows[i, 7], rows[i, 8] = capitals, t.count("!")
        for c in SPACES[1:]:
            t = t.replace(c, " ")
        rows[i, 9] = max(map(len, t.split(" ")))
    return rows


def _blocks(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts with about ``most`` characters together: bounds what is held at once."""
    block, held = [], 0
    for t in texts:
        block.append(t)
        held += len(t)
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in MEASURES]))
def measure(text: pd.Series) -> pd.DataFrame:
    parts = [_measure_block(b) for b in _blocks([t or "" for t in text])]
    rows = np.concatenate(parts) if parts else np.zeros((0, 10), np.int64)
    return pd.DataFrame(rows, columns=list(MEASURES))


def build_ledger(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """(row, m, failed): ``row`` holds the columns in ``keep`` (by default all), ``m`` the
    measurements, ``failed`` a long with one bit per failed rule.

    A null or empty text has no words, so it fails ``few_words`` and ``no_letters``.
    Repeated rows and ids stay separate rows; other columns stay inside ``row``.
    """
    out = docs.select(F.struct(*[F.col(c) for c in (keep or docs.columns)]).alias("row"), measure(F.col(text_col)).alias("m"))
    bits = [F.when(F.expr(_over_m(rule)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return out.select("row", "m", failed.alias("failed"))


def write_ledger(docs: DataFrame, path: str, **options) -> DataFrame:
    """Evaluate the rules once and write the ledger below ``path``, in the folder of the rule
    set's version; returns what was written.  A ledger of that version that exists is replaced."""
    build_ledger(docs, **options).write.mode("overwrite").parquet(f"{path}/rules={RULE_SET}")
    return read_ledger(docs.sparkSession, path)


def read_ledger(spark: SparkSession, path: str, rule_set: str = RULE_SET) -> DataFrame:
    """The ledger that was written below ``path`` with a version of the rule set."""
    return spark.read.parquet(f"{path}/rules={rule_set}")


def _over_m(rule: str) -> str:
    return " ".join(f"m.{w}" if "_" in w else w for w in rule.split())


def passes(policy: Policy, failed: Column) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept`` and the policy's version."""
    return ledger.withColumn("kept", passes(policy, F.col("failed"))).withColumn("policy", F.lit(policy.version))


def ablate(ledger: DataFrame, policy: Policy, by: Column | None = None) -> DataFrame:
    """Per rule of a policy (and per value of ``by``): documents that fail it, those that only it
    rejects, and all that the policy rejects; ``any_bits`` and ``all_bits`` are the bitwise sums.

    One pass over the ledger with one row per group in the shuffle.
    """
    own = F.col("failed").bitwiseAND(F.lit(policy.mask))
    group = [by.alias("grp")] if by is not None else [F.lit("all").alias("grp")]
    names = [n for n, _ in RULES]
    counts = []
    for r in policy.rules:
        bit = F.lit(1 << names.index(r))
        counts.append(F.struct(F.lit(r).alias("rule"), F.count_if(own.bitwiseAND(bit) != 0).alias("failing"), F.count_if(own == bit).alias("only_this")).alias(r))
    out = ledger.groupBy(*group).agg(F.count_if(own != 0).alias("rejected"), F.bit_or(own).alias("any_bits"), F.bit_and(own).alias("all_bits"), *counts)
    return out.select("grp", "rejected", "any_bits", "all_bits", F.explode(F.array(*policy.rules)).alias("x")).select("grp", "rejected", "any_bits", "all_bits", "x.*")


def op3_rule_ledger(spark, sf_dir: str) -> DataFrame:
    ledger = write_ledger(table(spark, sf_dir, "documents"), shared_path(spark, "ledger"), keep=["doc_id"])
    ledger = apply_policy(ledger, POLICIES["v2"])
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE_RULES))) != 0
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return ledger.select(F.col("row.doc_id").alias("doc_id"), *[F.col(f"m.{n}").alias(n) for n in names], base.alias("base_failed"), "kept", "failed", "policy")
