"""The dealt operators against SQL, brute force, round trips, held-out labels and odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import ann, language_id, line_dedup, mixing, near_dedup, packing, quality_model, quality_rules, queries, quotations, sharding
from edgeloom.llm.common import shared_path

from ..compare import check

ORACLES = queries.oracle_sql()
DOCS = "doc_id long, text string, lang string, source string, size long, row string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, same = text(30_000), text(80)
    rows = [(i, text(60) + "\ncommon line of many sites", "en", f"s{i % 6}", i, "x") for i in range(40)]
    rows += [(100, None, "en", "s1", 1, None), (101, "", "en", None, 1, "y"), (102, " \n\t ", None, "s2", None, "y"), (None, text(70), "de", "s1", 2, "z"), (None, None, None, None, None, None)]
    rows += [(103, long, "en", "s1", 3, "z"), (104, same, "en", "s1", 4, "z"), (105, same, "de", "s2", 4, "z"), (104, same, "en", "s1", 4, "z"), (106, "kurz", "de", "s1", 5, "z")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    check(spark, queries.queries()[name], ORACLES[name], sf_dir)


def test_search_finds_the_nearest(spark, sf_dir):
    got = {}
    for r in queries.queries()["op1_inverted_multi_index"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        best = [ids[i] for i in np.lexsort((ids, -score)) if i != q][:20]
        found = sorted(got[ids[q]])
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1)) and len(found) == 20
        for _, v, s in found:
            assert s == pytest.approx(float(x[ids == v][0] @ x[q]), abs=1e-9)
        hits, total = hits + len({v for _, v, _ in found} & set(best)), total + 20
    assert hits / total >= 0.9


def test_search_leaves_out_what_has_no_direction(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(v, v.filter("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 6)]
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def test_search_counts_repeated_rows_once_and_keeps_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), "x") for i in range(60)] * 3 + [(100 + i, [1.0] * 6, "y") for i in range(50)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)
    got = {}
    for r in ann.search(v, v.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x = {i: e for i, e, _ in rows}
    for q, found in got.items():
        score = {i: sum(np.array(e) * np.array(x[q])) for i, e in x.items() if i != q}
        assert found == sorted(score, key=lambda i: (-round(score[i], 12), i))[:20]
    assert sorted(got) == [0, 20, 40, 100, 120, 140]


def test_search_of_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [3e200, 0.0]), (2, [-1e200, 5e199]), (3, [1e-200, 1e-200]), (4, [1e308, -1e308])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.search(v, v.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [1, 3, 2, 4]


def test_recall_where_the_index_prunes(spark, monkeypatch):
    """20,000 vectors about 200 centres, one of which has a third of them; queries visit a part only."""
    monkeypatch.setattr(ann, "LEAST", 100)
    rng = np.random.default_rng(4)
    centre = np.where(rng.random(20_000) < 0.33, 0, rng.integers(0, 200, 20_000))
    x = (rng.normal(size=(200, 16))[centre] + 0.3 * rng.normal(size=(20_000, 16))).round(6)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(v, v.filter("vec_id % 200 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 20_000, 200):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 100 and hits / 2_000 >= 0.9
    books = ann.Codebooks(x[:8_000], float(np.sqrt((x * x).sum(1)).max()))
    assert ann.measured_share(books, x[:8_000], 20, 0.95) < 0.9


def test_near_duplicates_are_those_of_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in near_dedup.op2_probminhash_dedup(spark, sf_dir).collect()}
    sets = {i: near_dedup.shingles([t])[1:] for i, t in docs if t and t.split()}
    parent = {i: i for i, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and near_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-12:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: top(i) for i, _ in docs}


def test_links_far_apart_in_a_large_bucket_are_found(spark):
    """Two similar members that register 4, the first to order by, puts at the ends of a bucket of 61."""
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 16, (61, near_dedup.REGISTERS))
    sig[59] = sig[0]
    sig[:, :4], sig[:, 4] = 7, [*range(60), 30]
    words = [[f"w{i}x{k}" for k in range(60)] for i in range(61)]
    words[59] = [*words[0][:-1], "other"]
    members = spark.createDataFrame([(9, 0, i, 61) for i in range(61)], "bucket long, band int, node long, size long")
    sketches = spark.createDataFrame([(i, bytearray(x.astype("<u2").tobytes())) for i, x in enumerate(sig)], "node long, sig binary")
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "node long, text string")
    assert {r.node: r.component for r in near_dedup.link(members, sketches, texts, 0.8).collect()} == {0: 0, 59: 0}


@pytest.mark.parametrize("block", [16, 1024])
def test_classes_of_a_large_group_around_the_threshold(spark, monkeypatch, block):
    """Versions of one text, some with repeated words, about as many pairs above the threshold as below."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(150)] = f"v{rng.randrange(10**9)}"
        docs.append((i, " ".join(words + (base[:30] if i % 3 == 0 else []))))
    sets = [near_dedup.shingles([t])[1:] for _, t in docs]
    top = list(range(len(docs)))
    for j in range(len(docs)):
        for i in range(j):
            if near_dedup.probability_jaccard(sets[i], sets[j]) >= 0.8 - 1e-12 and top[i] != top[j]:
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    got = {r.id: r.class_id for r in near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(top)) and len(set(top)) > 1


def test_keep_one_and_odd_rows(spark, odd):
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sum(r.doc_id in (104, 105) for r in rows) == 1
    assert sum(not (r.text or "").split() for r in rows) == 4  # texts without words all stay
    assert near_dedup.classes(odd.limit(0)).count() == 0


def test_sketch_estimates_probability_jaccard():
    a, b = (near_dedup.shingles([" ".join(f"w{i}" for i in range(lo, lo + 300))]) for lo in (0, 60))
    owner = np.concatenate([np.zeros(len(a[0]), int), np.ones(len(b[0]), int)])
    s = near_dedup.sketch(owner, np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]]), 2, 4096)
    exact = near_dedup.probability_jaccard(a[1:], b[1:])
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.04)


def test_language_model_keeps_rare_grams_of_a_large_alphabet(spark):
    """More than 300,000 n-grams of a language, against plain Kneser-Ney."""
    rng = random.Random(11)
    word = lambda: "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(5))
    words = [word() for _ in range(60_000)]
    words += words[:3_000] + words[:500]
    docs = [(i, " ".join(words[i::40]), "zh") for i in range(40)] + [(40, "ein kurzer satz", "de")]
    model = language_id.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"), F.lit(True), "doc_id", "text", "lang")
    levels, level = {}, {}
    for w in words:
        w = "\x02\x02\x02" + w + "\x03"
        for i in range(len(w) - 3):
            level[w[i : i + 4]] = level.get(w[i : i + 4], 0) + 1
    for m in (4, 3, 2, 1):
        of, total, kinds, levels[m] = list(level.values()), {}, {}, level
        for g, n in level.items():
            total[g[:-1]], kinds[g[:-1]] = total.get(g[:-1], 0) + n, kinds.get(g[:-1], 0) + 1
        levels[m] = level, of.count(1) / (of.count(1) + 2 * of.count(2)) if of.count(1) and of.count(2) else 0.5, total, kinds
        below = {}
        for g in level:
            below[g[1:]] = below.get(g[1:], 0) + 1
        level = below

    def p(g):
        if not g:
            return np.exp(model.unseen)
        level, d, total, kinds = levels[len(g)]
        h = g[:-1]
        return (max(level.get(g, 0) - d, 0) + d * kinds[h] * p(g[1:])) / total[h] if h in total else p(g[1:])

    assert len(levels[4][0]) > 300_000
    grams = rng.sample(sorted(levels[4][0]), 300) + [word()[:4] for _ in range(50)]
    points = np.array([[ord(c) for c in g] for g in grams], np.uint32)
    assert model.score(points)[:, model.langs.index("zh")] == pytest.approx([np.log(p(g)) for g in grams], abs=1e-9)


def test_rules_on_odd_rows(spark, odd):
    ledger = quality_rules.build_ledger(odd)
    assert ledger.count() == odd.count()
    none = ledger.filter("row.text is null").first()
    assert none.m.n_words == 0 and none.failed & quality_rules.mask_of(["few_words", "no_letters"])
    policy = quality_rules.POLICIES["v2"]
    table = {r.rule: r for r in quality_rules.ablate(ledger, policy).collect()}
    assert table["few_words"].failing == ledger.filter("m.n_words < 50").count()
    assert quality_rules.build_ledger(odd.limit(0)).count() == 0


def test_a_written_ledger_answers_without_texts(spark):
    from edgeloom.llm.common import shared_path

    docs = spark.createDataFrame([(1, "ÄÖÜ ß wörter"), (2, "a\tbcd\x0befg")], "doc_id long, text string")
    path = shared_path(spark, "ledger")
    ledger = quality_rules.write_ledger(docs, path, keep=["doc_id"])
    assert {r.row.doc_id: r.m.max_word_chars for r in ledger.collect()} == {1: 6, 2: 3}
    again = quality_rules.read_ledger(spark, path)
    assert again.columns == ledger.columns and quality_rules.apply_policy(again, quality_rules.POLICIES["v1"]).filter("not kept").count() == 2


def test_packing_round_trip(spark, sf_dir):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = packing.op4_grouping_ga_packing(spark, sf_dir).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.start for p in parts] == list(range(0, len(ids), 2048))
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        assert sum(p.length for p in parts) == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(by_sequence) <= least + max(2, least // 50)


def test_ids_are_those_of_the_tokenizer():
    """Words that lower case, composition, special tokens or rare letters make awkward."""
    encoder = packing.Encoder(None)
    rng = random.Random(3)
    letters = list("abcdefgXYZ") + list("İıſßΣσςéÉñÑüÜąŻ½²①Ⅷ中文日本語ªºʰ.,!?;:'\"- \n\t\u00a0\u0301\u0307\u0327ﬁẞǅ각\u1100\u1161\u11a8اאक\u094dⒶ𝐀𐐀😀\u200d\u212b\u2126\x00\x1c\x85") + ["<|endoftext|>", "<|startoftext|>", "'s", "'re"]
    some = lambda: rng.choice(letters) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0xE000, 0x1F000)]))
    texts = ["".join(some() for _ in range(rng.randint(0, 14))) for _ in range(50_000)]
    texts += ["İ?", "a İ? b", "<|endoftext|>", "x<|endoftext|>.", "", "ΣΑΣ. ΣΑΣ"]
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for first in range(0, len(texts), 10_000):
        for t, got, w in zip(texts[first:], encoder.encode(texts[first : first + 10_000]), want[first:]):
            assert got.tolist() == w.ids, ascii(t)


def test_encoder_forgets_at_its_bound(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 20_000)
    encoder = packing.Encoder(None)
    for i in range(20):
        texts = [" ".join(f"w{i}x{k}." for k in range(100))]
        assert encoder.encode(texts)[0].tolist() == encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids
        assert encoder.words.nbytes + encoder.parts.nbytes < 40_000


def test_packing_odd_rows(spark, odd):
    out = packing.pack_documents(odd)
    assert out.filter("piece = 0").count() == odd.count()
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_lines_on_odd_rows(spark, odd):
    out = line_dedup.strip_lines(odd).collect()
    assert sum("common line of many sites" in (r.text or "") for r in out) == 1
    assert sum(r.n_removed for r in out) == 39
    assert line_dedup.without_boilerplate(odd).count() == odd.count()
    assert line_dedup.strip_lines(odd.limit(0)).count() == 0


def test_shards_keep_all_rows_and_versions(spark, odd):
    path = shared_path(spark, "store")
    store = sharding.ShardStore(spark, path, fanout=3)
    for _ in range(5):
        store.append(odd)
    before = store.versions()[-1]
    assert store.compact() >= 1 and len(store.runs()) < 5
    assert store.read().count() == 5 * odd.count() == store.read(before).count()
    with pytest.raises(sharding.Conflict):
        store.commit(store.versions()[-1], store.runs(), store.schema())
    store.vacuum(keep=1)
    assert len(store.versions()) == 1 and store.read().exceptAll(odd).count() == 4 * odd.count()


def test_shards_keep_columns_of_changed_arrivals(spark):
    store = sharding.ShardStore(spark, shared_path(spark, "store"), fanout=2)
    store.append(spark.createDataFrame([(1, "a", 0.5)], "id long, t string, more double"))
    store.append(spark.createDataFrame([(2, "b")], "id long, t string"))
    store.append(spark.createDataFrame([(3, "c")], "other long, t string"))
    want = {(1, "a", 0.5, None), (2, "b", None, None), (None, "c", None, 3)}
    assert {tuple(r) for r in store.read().collect()} == want
    assert store.compact() >= 1 and {tuple(r) for r in store.read().collect()} == want
    for clash in ("id string", "ID long"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], clash))


def test_of_racing_writers_one_wins(spark):
    from concurrent.futures import ThreadPoolExecutor

    stores = [sharding.ShardStore(spark, shared_path(spark, "race"))]
    stores += [sharding.ShardStore(spark, stores[0].path) for _ in range(7)]
    schema = sharding.union_schema(None, spark.range(1).schema)

    def commit(i):
        try:
            stores[i].commit(1, [sharding.Run(f"run{i}", (), 0, 0)], schema)
            return i
        except sharding.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i in pool.map(commit, range(8)) if i is not None]
    assert len(won) == 1 and [r.path for r in stores[0].runs(1)] == [f"run{won[0]}"]


def test_vacuum_removes_old_orphans_only(spark):
    import os
    import time

    store = sharding.ShardStore(spark, shared_path(spark, "store"))
    store.append(spark.range(5).toDF("id"))
    for _ in range(2):
        store._write(spark.range(3).toDF("id"))  # writers that died before their commit
    folder = store.path.removeprefix("file://") + "/runs"
    dead = [f for f in os.listdir(folder) if f not in store.runs()[0].path]
    os.utime(f"{folder}/{dead[0]}", (time.time() - 90_000,) * 2)
    store.vacuum()
    assert set(os.listdir(folder)) == {dead[1], store.runs()[0].path.rsplit("/", 1)[1]} and store.read().count() == 5


def test_tiered_query_keeps_every_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "source", F.xxhash64("text").alias("text_hash"))
    got = sharding.op6_tiered_shards(spark, sf_dir)
    assert got.select(docs.columns).exceptAll(docs).count() == 0 == docs.exceptAll(got.select(docs.columns)).count()
    assert got.filter("run_id = '' or shard is null").count() == 0 and got.select("run_id").distinct().count() < 8


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op7_kneser_ney_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.95


def test_language_rejects_what_is_none(spark):
    rng = random.Random(5)
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(80))
    rows = [(i, text("aeiou" if i % 2 else "bcdfg"), "v" if i % 2 else "c") for i in range(60)]
    rows += [(90, text("ÆØÅþð"), None), (91, None, "v"), (92, "12 34", "c"), (93, "½ ² ① Ⅷ", "c"), (None, text("aeiou"), None)]
    out = {r.row.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].lang_pred == ("v" if i % 2 else "c") and out[i].accepted for i in range(60))
    assert not out[90].accepted and out[None].lang_pred == "v"
    assert out[91].lang_pred == out[92].lang_pred == out[93].lang_pred == "und" and out[91].score == 0
    nothing = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_quality_shrinks_sparse_sites(spark):
    rows = [(i, "word " * 60, "en", "big" if i < 200 else "tiny") for i in range(202)]
    labels = [(i, 1 if i % 2 else 0) for i in range(200)] + [(200, 1), (201, 1), (None, 1), (5, None)]
    got = quality_model.grade(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    means = {r.id: r.host_mean for r in got.collect()}
    assert abs(means[0] - 0.5) < 0.05 and 0.5 < means[200] < 1.0
    assert got.count() == 202


def _graded(evidence, label, host, path):
    """Scores by plain sums, with the strengths by the method of moments."""
    soft = [e if y is None else y for e, y in zip(evidence, label)]

    def sums(keys):
        out = {}
        for k, x in zip(keys, soft):
            n, good = out.get(k, (0, 0.0))
            out[k] = n + 1, good + x
        return out

    def strength(groups, mean_of):
        b, w = [], []
        for k, (n, good) in groups.items():
            if n >= 2:
                rate, m = good / n, mean_of(k)
                b.append((rate - m) ** 2 - rate * (1 - rate) / max(n - 1, 1))
                w.append(m * (1 - m))
        if not b or sum(b) <= 0:
            return 1000.0
        return min(1000.0, max(2.0, sum(w) / sum(b) - 1))

    mean, hosts, paths = sum(soft) / len(soft), sums(host), sums(list(zip(host, path)))
    sh = strength(hosts, lambda k: mean)
    shrunk = {k: (good + sh * mean) / (n + sh) for k, (n, good) in hosts.items()}
    sp = strength(paths, lambda k: shrunk[k[0]])
    logit = lambda p: np.log(min(max(p, 0.001), 0.999) / (1 - min(max(p, 0.001), 0.999)))
    out = []
    for e, x, h, p in zip(evidence, soft, host, path):
        (n, good), (pn, pgood) = hosts[h], paths[h, p]
        hm = (good - x + sh * mean) / (n - 1 + sh)
        pm = (pgood - x + sp * hm) / (pn - 1 + sp)
        out.append((hm, pm, 1 / (1 + np.exp(-(logit(e) + logit(pm) - logit(mean))))))
    return out


def test_quality_posteriors_are_those_of_plain_sums(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "", "!! ## " * rng.randint(1, 60), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 90)))]), rng.choice(["a", "b", None]), rng.choice(["x", "x", "x", "y", None, f"s{i}"]), "p", 0.5) for i in range(300)]
    labels = [(i, float(rng.random() < 0.6)) for i in range(0, 300, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, path string, score double")
    got = sorted(quality_model.grade(docs, spark.createDataFrame(labels, "doc_id long, quality double")).collect(), key=lambda r: r.id)
    known = dict(labels)
    want = _graded([r.evidence for r in got], [known.get(r.id) for r in got], [r[3] for r in rows], [r[2] for r in rows])
    assert [(r.host_mean, r.path_mean, r.score) for r in got] == [pytest.approx(w, abs=1e-9) for w in want]
    twice = quality_model.grade(docs.union(docs.filter("doc_id < 5")), spark.createDataFrame(labels, "doc_id long, quality double"))
    assert twice.count() == 305
    assert quality_model.grade(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality double")).count() == 0
    none = quality_model.grade(docs, spark.createDataFrame([], "doc_id long, quality double")).collect()
    assert {r.evidence for r in none} == {0.5}


def test_quality_tells_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality is not null")
    mine = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality_model.grade(docs, labels.filter(~mine)).withColumnRenamed("id", "doc_id").join(labels.filter(mine), "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in got if (r.quality >= 0.5) == y] for y in (True, False))
    wins = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print("held-out AUC", wins, len(good), len(bad))
    assert wins > 0.5


def test_mix_meets_its_targets(spark, odd):
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == odd.count() and all(r.taken <= 3 * r.size for r in plan)
    by = {}
    for r in plan:
        t = by.setdefault((r.row.source), [r.target, 0, r.source_size])
        t[1] += r.taken
    assert sum(t[0] for t in by.values()) == pytest.approx(sum(t[2] for t in by.values())) or any(t[0] == 3 * t[2] for t in by.values())
    assert mixing.plan_mix(odd.limit(0)).count() == 0
    order = [r for r in mixing.mixed_documents(odd).collect()]
    assert len(order) == sum(len(r.positions) for r in plan)


def test_quotes_link_to_their_originals(spark):
    rows = [(1, 0, "a", "Hello there\nHow are you?"), (1, 1, "b", "> How are  YOU?\nFine"), (1, 2, "a", "> > How are you?\n> Fine\nGood"), (1, 3, "b", None), (1, 4, "b", "> never said\nok"), (None, 0, "a", "> Fine\nx"), (2, 1, "a", "Fine"), (2, 0, "a", "> Fine\nbefore it")]
    out = {(r.conv, r.turn): r for r in quotations.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1, 1].parent_turn == 0 and out[1, 1].text == "Fine"
    assert (out[1, 2].parent_turn, out[1, 2].thread, out[1, 2].depth) == (1, 0, 2)
    assert out[1, 3].text is None and out[1, 4].parent_turn is None
    assert out[None, 0].parent_turn is None and out[2, 0].parent_turn is None


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as c

    docs = odd
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd.columns, name
    assert c.STAGES[-1][1](spark, docs, "").count() > 0
    empty = odd.limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, empty, "").count() == 0
