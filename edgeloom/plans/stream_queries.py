"""Structured Streaming jobs, run over the whole event table, and the learned link predictor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import predictor
from ..operators.kept import KeptGraph
from ..session import shared_folder
from ..sources import edges as E
from ..streaming import jobs as J
from .graph_queries import DAY, TICKS, _window_sql
from .registry import EVENTS, FIRST, query, with_


@query(f"""with {EVENTS}, g as (select u node, count(*) n, list(w order by t, eid) xs from ev group by u)
select node, n, round(list_reduce(xs, lambda a, x: 0.95::double * a + (1 - 0.95::double) * x), 6) ema from g""")
def stream_rolling(spark, sf_dir: str) -> DataFrame:
    """Decayed mean of each user's event values after the whole stream."""
    found = J.drain(J.rolling_state(J.read_events(spark, sf_dir)), ["node"])
    return found.select("node", "n", F.round("ema", 6).alias("ema"))


@query(f"with {EVENTS} select u, k, count(*) n, max(t) last_t from ev group by u, k")
def stream_edgebank(spark, sf_dir: str) -> DataFrame:
    """The edge memory after the whole stream."""
    return J.drain(J.edge_memory(J.read_events(spark, sf_dir)), ["u", "k"])


@query(f"with {EVENTS} select (t // 86400000000) * 86400000000 \"start\", u, count(*) n from ev group by 1, 2")
def stream_daily_counts(spark, sf_dir: str) -> DataFrame:
    """Events of each user per day, with a watermark of ten years so that none of the table is late."""
    return J.drain(J.windowed_counts(J.read_events(spark, sf_dir), late="3650 days"), ["start", "u"])


@query(with_("uni", FIRST, TICKS) + "select node, n0, degree, triangles, round(case when degree < 2 then 0 else 2.0 * triangles / (degree * (degree - 1)) end, 6) clustering from tk")
def kept_graph_ticks(spark, sf_dir: str) -> DataFrame:
    """Ticks of a graph that a stream advances by fixed batches of 200 events."""
    kept = KeptGraph(spark, shared_folder(spark, "kept"))
    m = J.advance(J.read_events(spark, sf_dir), kept, last=True)
    return kept.moves(m).select("node", "n0", "degree", "triangles", F.round("clustering", 6).alias("clustering"))


@query(with_("uni", recursive=True) + _window_sql(2000))
def stream_window_graph(spark, sf_dir: str) -> DataFrame:
    """Stays of edges in a window of seven days of a graph that a stream advances by batches of 2,000 events."""
    kept = KeptGraph(spark, shared_folder(spark, "kept"), size=2000, width=7 * DAY, rolled=None)
    return kept.stays(J.advance(J.read_events(spark, sf_dir), kept, last=True))


@query()
def link_predictor(spark, sf_dir: str) -> DataFrame:
    """Probabilities of test edges and of as many drawn ones, from features of the training graph."""
    return predictor.link_scores(E.bip(spark, sf_dir))


@query()
def link_perceptron(spark, sf_dir: str) -> DataFrame:
    """Mean reciprocal rank and hits at ten of test edges among twenty drawn ones, by a perceptron with either fusion."""
    e, out = E.bip(spark, sf_dir), None
    asked = predictor.asked_pairs(e)
    for fusion in predictor.FUSIONS:
        scored = predictor.perceptron_scores(e, fusion, asked=asked)
        one = M.mrr_hits(scored.select("qid", "is_pos", "score")).withColumn("fusion", F.lit(fusion))
        out = one if out is None else out.union(one)
    return out
