"""The decoder finds common neighbours by words, not by a row for each step from each end of a pair."""

from edgeloom.operators import decoder as D


def test_common_neighbours_take_no_step_rows(spark):
    """A hub's neighbours are no rows of the plan: the only explode is that of the words that both ends have."""
    edges = [(0, i) for i in range(10, 60)] + [(1, i) for i in range(40, 80)] + [(0, 1)]
    ab = spark.createDataFrame(edges, "a long, b long")
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = [(0, 1), (1, 0), (0, 45), (45, 1), (12, 13), (7, 0), (0, 0)]
    queries = spark.createDataFrame(asked, "u long, v long")
    for mode in (0, 1):
        found = D.near_pairs(queries, ab, mode)
        want = {(u, v, w, "11") for u, v in asked for w in near.get(u, set()) & near.get(v, set())}
        if mode == 0:
            want |= {(u, v, x, k) for u, v in asked if v in near.get(u, set()) for x, k in ((u, "01"), (v, "10"))}
        assert {tuple(r) for r in found.collect()} == want
        assert "LeftSemi" not in found.filter("kind = '11'")._jdf.queryExecution().optimizedPlan().toString()
