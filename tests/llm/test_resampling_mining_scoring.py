"""Importance resampling, hard negatives and the hidden Markov model against brute force and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import hard_negatives, hidden_markov, importance
from edgeloom.llm.common import text_blocks
from edgeloom.llm.queries import queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, id string, rank long"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def resampled(docs, target):
    own, s, t = [features(x) for _, x in docs], Counter(), Counter()
    for _, f in own:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    many, wanted = s.total() + 10_000, t.total() + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * many / ((s[b] + 1) * wanted))) for b in range(10_000)]
    out = []
    for (i, _), (n, f) in zip(docs, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(may[: len(may) * 25 // 100], 1):
        r[5] = rank
    return Counter(map(tuple, out))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdÄéß漢Z9_-|") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["x" * 65, "ü" * 90, "y" * 64]
    text = lambda n: rng.choice(" \n\t,").join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(1, 90)), "en", "s", "i", i) for i in range(60)]
    rows += [(100, None, "en", None, None, None), (101, "", None, "s", "i", 1), (102, " \x0b\x1c\x85  . !", "en", "s", "i", 1), (None, text(40), "en", "s", "i", 1), (None, None, None, None, None, None)]
    rows += [(103, text(30_000), "en", "s", "i", 1), (104, "w" * 300_000 + " a", "en", "s", "i", 1), (5, rows[5][1], "en", "s", "i", 5), (105, rows[6][1], "en", "s", "i", 5)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_resampling_is_that_of_brute_force(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    target = [docs[3][1], None, "", "Ä " * 50, docs[7][1]]
    wanted = spark.createDataFrame([(i, t, 0) for i, t in enumerate(target)], "item_id long, text string, weight int")
    got = Counter(tuple(r) for r in importance.resample(odd, wanted).select("id", "n_words", "n_features", "weight", "score", "rank").collect())
    assert got == resampled(docs, target)


def test_resampling_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = queries()["op11_importance_resampling"](spark, SF)
    assert set(found.dtypes) >= {(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")}
    assert Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == resampled(docs, target)


def test_resampling_of_nothing(spark, odd):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert importance.resample(odd.limit(0), target).count() == 0
    assert importance.resample(odd, target.limit(0)).count() == odd.count()


def mined(rows, label=lambda i, x: x, anchor=lambda i: i % 100 == 0, positives=5, negatives=5):
    whole = {(i, label(i, x), tuple(math.floor(float(c) * 256) for c in v)) for i, x, v in rows if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    asking = {}
    for i, x, v in whole:
        if anchor(i):
            asking[i] = min(asking.get(i, (x, v)), (x, v))
    out = []
    for a, (la, va) in asking.items():
        ranked = sorted(((-sum(p * q for p, q in zip(va, v)), i, x, v) for i, x, v in whole), key=lambda r: r[:2])
        same = [(i, -s) for s, i, x, _ in ranked if x == la and i != a][:positives]
        for p, ps in same:
            hard = [(i, -s) for s, i, x, _ in ranked if x != la and 80 * ps <= -100 * s <= 100 * ps][:negatives]
            out += [(a, p, k, n, ps, ns) for k, (n, ns) in enumerate(hard, 1)]
    return Counter(out)


def op12_label(i, x):
    return (x + 1) % 10 if i % 7 == 0 else x


def test_hard_negatives_query(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = queries()["op12_radix_hard_negatives"](spark, SF)
    assert [t for _, t in found.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    want = mined(rows, op12_label)
    assert Counter(tuple(r) for r in found.collect()) == want and want


def test_hard_negatives_of_a_hot_vector_ties_and_odd_rows(spark):
    """A third of the rows share one vector, so windows are settled by ids, digit by digit."""
    rng = np.random.default_rng(9)
    rows = [(int(i), int(rng.integers(0, 3)), [1.0, 0.5, 0.25]) for i in rng.permutation(90_000)[:150]]
    rows += [(100_000 + i * 50, i % 3, rng.normal(size=3).round(2).tolist()) for i in range(250)]
    rows += [(0, None, [1.0, 1.0, 1.0]), (200, 1, None), (300, 1, [float("nan"), 1.0, 0.0]), (400, 1, [None, 1.0, 0.0]), (500, 1, [float("inf"), 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0]), (600, 1, [1.0, 0.0]), (700, 0, [0.0, 0.0, 0.0]), (-800, 2, [1.0, 0.5, 0.25])]
    rows += rows[:40] + [(100_000, 2, [0.3, 0.3, 0.3])]
    v = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, label int, embedding array<double>, score double, q string").repartition(5)
    got = Counter(tuple(r) for r in hard_negatives.mine(v, F.col("vec_id") % 100 == 0, F.col("label")).collect())
    assert got == mined([r for r in rows if not r[2] or len(r[2]) == 3])
    assert hard_negatives.mine(v.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_hard_negatives_of_huge_components(spark):
    rows = [(i, i % 2, [float(i) * 1e5, -3e6]) for i in range(40)] + [(100, 0, [2e6, 1e6]), (101, 1, [1e30, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {(r.positive_id, r.negative_id): (r.positive_score, r.negative_score) for r in hard_negatives.mine(v.filter("vec_id <> 101"), F.col("vec_id") == 100, F.col("label")).collect()}
    assert got and got == {(p, n): (ps, ns) for _, p, _, n, ps, ns in mined([r for r in rows if r[0] != 101], anchor=lambda i: i == 100)}
    assert hard_negatives.mine(v, F.col("vec_id") == 100, F.col("label")).count() >= 0


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text or "")), None]


def learning(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2


def test_token_facts_are_those_of_brute_force(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    seen = Counter(w for i, t in docs if learning(i) for w in tokens(t))
    n, kinds = seen.total(), len(seen)
    want = Counter((i, not learning(i), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, round(sum(math.log10((seen[w] + 1) / (n + kinds + 1)) for w in tokens(t)), 5)) for i, t in docs)
    found = hidden_markov.score_texts(odd, rounds=2).collect()
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_scores_beat_the_base_on_held_out_texts(spark):
    found = queries()["op13_hidden_markov"](spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert found[0] - found[1] > 0.2 * found[2]


def small_model(rng):
    totals = hidden_markov.Totals(50, 9, 5, np.concatenate([rng.dirichlet(np.ones(8)) * 0.9, np.zeros(hidden_markov.BUCKETS - 8), [0.1, 0.0]]))
    move = rng.dirichlet(np.ones(hidden_markov.STATES), hidden_markov.STATES)
    return hidden_markov.Model(rng.dirichlet(np.ones(hidden_markov.STATES)), move, hidden_markov._emissions(totals.share[:, None] * rng.random((hidden_markov.SYMBOLS, hidden_markov.STATES)), totals, 1.0)), totals


def test_forward_recursion_is_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    model, _ = small_model(rng)
    length = np.array([3, 1, 4])
    symbols = np.array([0, 5, hidden_markov.END, hidden_markov.END, 2, hidden_markov.UNKNOWN, 7, hidden_markov.END])

    def probability(s):
        a = model.start * model.emit[s[0]]
        for x in s[1:]:
            a = np.array([sum(a[i] * model.move[i, j] for i in range(len(a))) * model.emit[x, j] for j in range(len(a))])
        return a.sum()

    parts = np.split(symbols, np.cumsum(length)[:-1])
    assert np.allclose(hidden_markov.log_likelihood(symbols, length, model), [math.log(probability(p)) for p in parts])
    assert np.allclose(model.emit.sum(0), 1)


def test_expected_counts_are_those_of_plain_forward_and_backward():
    rng = np.random.default_rng(4)
    model, _ = small_model(rng)
    length, opens = np.array([5, 2, 9, 1]), np.array([True, False, True, True])
    symbols = rng.integers(0, 8, length.sum())
    k = hidden_markov.STATES
    starts, moves, emissions, total = np.zeros(k), np.zeros((k, k)), np.zeros((hidden_markov.SYMBOLS, k)), 0.0
    for s, first in zip(np.split(symbols, np.cumsum(length)[:-1]), opens):
        a = [(model.start if first else model.stationary()) * model.emit[s[0]]]
        for x in s[1:]:
            a.append(a[-1] @ model.move * model.emit[x])
        b = [np.ones(k)]
        for x in s[:0:-1]:
            b.insert(0, model.move @ (model.emit[x] * b[0]))
        p = a[-1].sum()
        total += math.log(p)
        for t, x in enumerate(s):
            emissions[x] += a[t] * b[t] / p
            if t:
                moves += np.outer(a[t - 1], model.emit[x] * b[t]) * model.move / p
        starts += a[0] * b[0] / p if first else 0
    got = hidden_markov.expected_counts(symbols, length, opens, model)
    for mine, plain in zip(got, (starts, moves, emissions, total)):
        assert np.allclose(mine, plain, rtol=1e-4, atol=1e-5)


def test_learning_never_lowers_the_likelihood(spark, odd):
    facts, totals = hidden_markov.count_tokens(odd.select(F.col("doc_id").alias("id"), hidden_markov.learns(F.col("doc_id")).alias("learns"), "text"))
    _, gained = hidden_markov.baum_welch(facts, totals, rounds=4)
    assert all(b >= a - 1e-3 for a, b in zip(gained, gained[1:]))


def test_scores_where_nothing_can_be_learned(spark, odd):
    assert hidden_markov.score_texts(odd.limit(0)).count() == 0
    held = [i for i in range(200) if not learning(i)][:3]
    rows = hidden_markov.score_texts(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0.0, 0.0)] * 3


def test_blocks_of_text_are_bounded_and_whole():
    import pyarrow as pa

    texts = pa.array(["a" * n if n else None for n in (5, 0, 30, 4, 4, 4)])
    parts = list(text_blocks(texts, 10))
    assert [x for _, p in parts for x in p.to_pylist()] == [x or "" for x in texts.to_pylist()]
    assert [(s.start, s.stop) for s, _ in parts] == [(0, 2), (2, 3), (3, 5), (5, 6)]
