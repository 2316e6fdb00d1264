"""Quotes, borders of mixes, words of other alphabets and both forms of language models, on tables made for them."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edgeloom.llm import language_id, mixing, queries

from ..compare import check

ORACLES = queries.oracle_sql()


def test_a_quote_rich_table_is_that_of_sql(spark, tmp_path):
    """Conversations whose messages quote earlier ones, nested, reworded in case and space, partly and wrongly."""
    draw = random.Random(21)
    words = ["alpha", "Beta", "gamma", "delta", "common", "line"]
    rows = []
    for conv in range(40):
        said = []
        for turn in range(draw.randint(1, 25)):
            lines = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(0, 3))]
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                if said:
                    quoted = draw.choice(said)
                    level = draw.randint(1, 4)
                    for x in quoted.split("\n")[: draw.randint(1, 3)]:
                        lines.append(draw.choice([">" * level, "> " * level, " >" * level]) + draw.choice([x, x.upper(), x.replace(" ", "  "), x + " not said"]))
            draw.shuffle(lines)
            text = "\n".join(lines) if turn % 11 else draw.choice(["", None, ">", "> \n>> "])
            rows.append((conv, turn, draw.choice("ab"), text))
            if text:
                said.append(text)
        if conv % 7 == 0 and rows[-1][3]:
            rows.append(rows[-1])  # a repeated turn
    rows.append((999, 0, "a", "\n".join(">" * (i % 90) + f" depth {i}" for i in range(400))))
    rows += [(None, 1, "a", "> alpha"), (1, None, "a", "> alpha"), (500, 1, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    found = queries.queries()["op10_quotation_threads"](spark, str(tmp_path))
    assert found.filter("parent_turn is not null").count() > 150
    assert check(spark, queries.queries()["op10_quotation_threads"], ORACLES["op10_quotation_threads"], str(tmp_path)) == len(rows)


def test_rules_count_code_points_as_their_sql(spark, tmp_path):
    texts = ["ä" * 600 + " word " * 60, "é" * 999, "漢" * 1001 + " and words" * 80, "x" * 600 + " word" * 60, "ü " * 70, None, ""]
    rows = [(i, t, "de", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert check(spark, queries.queries()["op3_rule_ledger"], ORACLES["op3_rule_ledger"], str(tmp_path)) == len(rows)


@pytest.fixture(scope="module")
def heavy(spark, tmp_path_factory):
    """Documents of very unequal sizes, in sources of one to three hundred of them; one has a third of all."""
    draw = random.Random(5)
    rows, i = [], 0
    for s, n in enumerate([300, 1, 2, 40, 60, 80, 120, 150, 30, 90]):
        for _ in range(n):
            rows.append((i, "w " * min(4_000, int(draw.paretovariate(0.9) * 5)), "en", f"s{s:02}" if s else None))
            i += 1
    folder = tmp_path_factory.mktemp("heavy")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{folder}/documents.parquet")
    return folder


def test_each_source_is_near_its_target(spark, heavy):
    plan = mixing.plan_mix(spark.read.parquet(f"file://{heavy}/documents.parquet")).collect()
    by = {}
    for r in plan:
        by.setdefault(r.row.source, []).append(r)
    assert len(by) == 10
    for rows in by.values():
        target, taken = rows[0].target, sum(r.taken for r in rows)
        passes = min(len(r.positions) for r in rows if r["size"])
        left = [r["size"] for r in rows if r["size"] and len(r.positions) == passes]
        assert all(r.taken <= 3 * r["size"] for r in rows)
        assert abs(taken - target) <= max(0.01 * target, min(left, default=0)), (rows[0].row.source, taken, target)


def test_a_mix_of_unequal_documents_is_that_of_sql(spark, heavy):
    assert check(spark, queries.queries()["op9_curriculum_mix"], ORACLES["op9_curriculum_mix"], str(heavy)) == 873


def test_language_by_joins_equals_the_local_model(spark, monkeypatch):
    """A model too large to broadcast: the same verdicts on odd, repeated and very long rows, and on foreign columns."""
    rng = random.Random(9)
    text = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(1, 9))) for _ in range(n))
    rows = [(i, text("aeiouß" if i % 2 else "bcdfgжя", 40), "v" if i % 2 else "c", "x") for i in range(60)]
    rows += [(100, None, "v", "x"), (101, "", "c", "x"), (102, "12 +", None, "x"), (None, text("aeiou", 9), None, None), (103, text("ÆØÅþ", 30), None, "x")]
    rows += [(104, text("bcdfg", 60_000), None, "x")] + [(105, "aeiou iou", None, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, nr string")
    columns = ("row", "held_out", "lang_pred", "score", "entropy", "accepted")

    def found(cells, df=docs):
        monkeypatch.setattr(language_id, "MODEL_CELLS", cells)
        got = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in language_id.identify(df).select(*columns).collect()]
        return sorted(got, key=repr)

    local, joined = found(16_000_000), found(0)
    assert len(local) == len(rows) and [repr(r) for r in joined] == [repr(r) for r in local]
    assert {r[2] for r in local} == {"v", "c", "und"}
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 2_000)
    assert [repr(r) for r in found(0)] == [repr(r) for r in local]
    assert found(0, docs.limit(0)) == []


def test_language_counts_are_handed_on_within_a_batch(monkeypatch):
    """Few n-grams may be held: the sums of what is handed on are those of one hand-over."""
    pdf = pd.DataFrame({"lang": ["a", "b"] * 40, "text": [" ".join(f"w{chr(97 + (i * j) % 26)}{chr(97 + j % 23)}" for j in range(50)) for i in range(80)], "aside": [i % 5 == 0 for i in range(80)]})
    whole = pd.concat(language_id.count_grams(iter([pdf]))).groupby(["lang", "gram"]).sum()
    monkeypatch.setattr(language_id, "HELD_GRAMS", 20)
    monkeypatch.setattr(language_id, "TEXT_CHARS", 300)
    parts = list(language_id.count_grams(iter([pdf])))
    assert len(parts) > 10 and pd.concat(parts).groupby(["lang", "gram"]).sum().equals(whole)


def test_language_thresholds_come_from_all_learning_documents(spark, monkeypatch):
    """Each learning document is judged by the model of the half that it is not in, and thresholds are of all of them."""
    rng = random.Random(4)
    text = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(i, text("aeiou" if i % 2 else "bcdfg", 5 + i % 60), "v" if i % 2 else "c") for i in range(300)] + [(300, "12", "c"), (301, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = {}

    def spy(judged, langs):
        taken["rows"], taken["thresholds"] = judged, calibrate(judged, langs)
        return taken["thresholds"]

    calibrate = language_id.calibrate
    monkeypatch.setattr(language_id, "calibrate", spy)
    language_id.identify(docs, keep=["doc_id"])
    learning = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    n = docs.filter(learning & (F.col("doc_id") < 300)).count()
    judged = taken["rows"].filter("apart_lang is not null").toPandas()
    assert len(judged) == n > 150
    for side in (0, 1):
        of_half = docs.withColumn("half", language_id.half("doc_id")).filter(learning)
        other = language_id.learn(of_half.filter(F.col("half") != side), F.lit(True), "doc_id", "text", "lang")
        own = of_half.filter((F.col("half") == side) & (F.col("doc_id") < 300)).toPandas()
        want = language_id.measure(other, own["text"].tolist())[0][:, :2].min(1)
        got = judged.set_index(judged["row"].map(lambda r: r["doc_id"]))["apart_entropy"]
        assert len(own) and got[own["doc_id"]].to_numpy() == pytest.approx(want, abs=1e-9)
    usual, allowed = taken["thresholds"]
    shown = spark.createDataFrame([("c",), ("v",)], "lang_pred string").select("lang_pred", usual.alias("usual"), allowed.alias("allowed")).collect()
    for r in shown:
        part = judged[judged["apart_lang"] == r.lang_pred]
        far = (part["apart_entropy"] - r.usual) * np.sqrt(np.minimum(part["chars"], 400))
        assert r.usual == pytest.approx(part["apart_entropy"].median(), abs=1e-4)
        assert r.allowed == pytest.approx(language_id.SLACK * max(far.quantile(0.999), 5.0), abs=1e-2)


def test_the_pipeline_scores_a_text_once(spark, sf_dir):
    """No text is scored again for the filter on the verdict or for its columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert found.columns == docs.columns
    small = language_id.identify(docs, keep=["doc_id"]).filter("accepted").select("row.doc_id", "lang_pred")
    assert sorted(map(tuple, found.select("doc_id", "lang").collect()), key=repr) == sorted(map(tuple, small.collect()), key=repr)
    assert 0 < small.count() <= docs.count()
