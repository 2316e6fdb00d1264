"""What mixing writes on its way has no texts in it."""

from edgeloom.llm import mixing


def test_mix_writes_no_rows_of_documents(spark, monkeypatch):
    written = []
    plain = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name, *more: written.append((name, df.columns)) or plain(df, name, *more))
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), f"s{i % 3}") for i in range(60)] + [(1, "w w", "s1"), (1, "w w", "s1"), (99, None, None)], "doc_id long, text string, source string")
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == 63 and {r.row.doc_id for r in plan} == {*range(60), 99}
    by_source = {}
    for r in plan:
        by_source.setdefault(r.row.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 7 for taken, target in by_source.values())
    assert written and not [name for name, columns in written if "row" in columns or "text" in columns]
