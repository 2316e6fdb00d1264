"""Metrics, studies, statistics, set algebra and label alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import decoder as D
from ..operators import graph as G
from ..operators import indicators as I
from ..operators import metrics as M
from ..operators import negatives as N
from ..operators import rolling as R
from ..operators import splits as S
from ..operators import stats as T
from ..sources import edges as E
from .graph_queries import CORE, PAIRS, SPLIT
from .registry import ADJ, DEG, FIRST, SNAP, query, with_

# -- discriminability study -------------------------------------------------------------

STUDY = f"""{SPLIT}, nodes as (select x neg, row_number() over (order by x) - 1 place from (select distinct v x from e)),
val as (select seq, u, v, neg from sp join nodes on place = (seq * 7919) % (select count(*) from nodes) where split = 'val'),
e2 as (select * from sp where split = 'train'), {SNAP.replace('from e', 'from e2')}, {ADJ}, {DEG}, {CORE},
ask as (select distinct u, v from (select u, v from val union all select u, neg from val)), near as (select u, v, m w from ask join adj on n = v where m <> u),
cnw as (select u, v, w from near join adj on n = u and m = w),
tw as (select distinct q.u, y.m w from (select distinct u from ask) q join adj x on x.n = q.u join adj y on y.n = x.m where y.m <> q.u),
brw as (select near.u, near.v, near.w from near join tw on tw.u = near.u and tw.w = near.w),
ft as (select ask.u, ask.v, coalesce(c, 0) cn, coalesce(b, 0) bridge, coalesce(bc, 0) bridge_core from ask left join (select u, v, count(*) c from cnw group by u, v) using (u, v)
  left join (select u, v, count(*) b, sum(core) bc from brw join core on node = w group by u, v) using (u, v)),
pn as (select p.cn pcn, n.cn ncn, p.bridge pb, n.bridge nb, p.bridge_core pc, n.bridge_core nc from val join ft p on p.u = val.u and p.v = val.v join ft n on n.u = val.u and n.v = val.neg)"""


def _win(a: str, b: str) -> str:
    return f"avg(case when {a} > {b} then 1.0::double when {a} = {b} then 0.5 else 0 end)"


@query(with_("bip", STUDY, recursive=True) + "select feature, round(auc, 6) auc, round(greatest(auc, 1 - auc), 6) disc_auc from (" + " union all ".join(f"select '{f}' feature, {_win('p' + c, 'n' + c)} auc from pn" for f, c in (("cn", "cn"), ("bridge", "b"), ("bridge_core", "c"))) + ")")
def discauc(spark, sf_dir: str) -> DataFrame:
    """Flagship: how well common neighbours, the two-hop bridge and the core-weighted bridge of the
    training graph tell validation edges from one negative each."""
    e = S.quantile_split(E.bip(spark, sf_dir))
    values = N.pool(e.select(F.col("v").alias("value")))
    val = N.draw(e.filter("split = 'val'").select("seq", "u", "v"), values, F.col("seq"), 1)
    ab = G.cut(G.pairs(e.filter("split = 'train'")))
    asked = G.cut(val.select("u", "v").union(val.select("u", "neg")).distinct())
    names = ["cn", "bridge", "bridge_core"]
    feats = B.pair_counts(asked, ab, G.k_core(ab).withColumnRenamed("core", "value")).withColumnRenamed("bridge_value", "bridge_core")
    pos = feats.select("u", "v", *[F.col(n).alias(f"pos_{n}") for n in names])
    neg = feats.select("u", F.col("v").alias("neg"), *[F.col(n).alias(f"neg_{n}") for n in names])
    out = M.disc_auc(val.join(pos, ["u", "v"]).join(neg, ["u", "neg"]), names)
    return out.select("feature", F.round("auc", 6).alias("auc"), F.round("disc_auc", 6).alias("disc_auc"))


TRAINED = f"""{SPLIT}, nodes as (select x neg, row_number() over (order by x) - 1 place from (select distinct v x from e)),
val as (select seq, u, v, neg from sp join nodes on place = (seq * 7919) % (select count(*) from nodes) where split = 'val'), e2 as (select * from sp where split = 'train'), {FIRST.replace(" from e where", " from e2 where")},
tk as (select node, n0 n, row_number() over (partition by node order by n0) i, row_number() over (partition by node order by n0)::double x from (select unnest([a, b]) node, n0 from fe)),
f as (select node, n, i, x, x ema, 0::double dl, 0::double mc from tk where i = 1 union all
  select t.node, t.n, t.i, t.x, 0.95::double * ema + (1 - 0.95::double) * t.x, t.x - f.x, greatest(0.95::double * mc, abs(t.x - f.x)) from f join tk t on t.node = f.node and t.i = f.i + 1),
st as (select node, arg_max(x, n) x, arg_max(ema, n) ema, arg_max(mc, n) mc from f group by node),
pn as (select coalesce(p.x, 0) px, coalesce(n.x, 0) nx, coalesce(p.ema, 0) pe, coalesce(n.ema, 0) ne, coalesce(p.mc, 0) pm, coalesce(n.mc, 0) nm from val left join st p on p.node = val.v left join st n on n.node = val.neg),
r as (select 'static' kind, {_win("px", "nx")} auc from pn union all select 'dynamic', {_win("pe", "ne")} from pn union all select 'dynamic', {_win("pm", "nm")} from pn)"""


@query(with_("bip", TRAINED, recursive=True) + " select 'degree' \"indicator\", kind, round(avg(greatest(auc, 1 - auc)), 6) \"mean\", round(max(greatest(auc, 1 - auc)), 6) best from r group by kind")
def indicator_study(spark, sf_dir: str) -> DataFrame:
    """How well the destination's degree, as it is and over time, tells validation edges from drawn ones."""
    e = S.quantile_split(E.bip(spark, sf_dir))
    val = N.draw(e.filter("split = 'val'").select("seq", "u", "v"), N.pool(e.select(F.col("v").alias("value"))), F.col("seq"), 1)
    stats = R.rolling(I.REGISTRY["degree"].trace(G.first_edges(e.filter("split = 'train'"))))
    names = ["degree_current", "degree_ema", "degree_max_change"]
    last = stats.groupBy("node").agg(F.max_by(F.struct(*[F.col(n.removeprefix("degree_")).alias(n) for n in names]), "n").alias("s"))
    for side, key in (("pos", "v"), ("neg", "neg")):
        val = val.join(last.select(F.col("node").alias(key), *[F.col(f"s.{n}").alias(f"{side}_{n}") for n in names]), key, "left")
    found = T.study(M.disc_auc(val.fillna(0.0), names))
    return found.select("indicator", "kind", F.round("mean", 6).alias("mean"), F.round("best", 6).alias("best"))


# -- metrics over scored candidates ------------------------------------------------------
# A query is a test edge with its true item and 20 drawn ones; the score is how often training had the pair.

SCORED = f"""{SPLIT}, pool as (select v neg, row_number() over (order by v) - 1 place from (select distinct v from e)),
fq as (select u, v, count(*) n from sp where split = 'train' group by u, v),
cd as (select seq qid, u, v, 1 is_pos from sp where split = 'test' union all
  select seq, u, neg, 0 from sp, range(20) r(j) join pool on place = (seq * 7919 + j * 104729) % (select count(*) from pool) where split = 'test'),
sc as (select qid, is_pos, coalesce(n, 0) score from cd left join fq on fq.u = cd.u and fq.v = cd.v)"""
AGAINST = "ag as (select p.qid, count(*) filter (where n.score > p.score) gt, count(*) filter (where n.score = p.score) eq, count(*) n from sc p join sc n on n.qid = p.qid and n.is_pos = 0 where p.is_pos = 1 group by p.qid)"


def _scored(spark, sf_dir: str) -> DataFrame:
    e = S.quantile_split(E.bip(spark, sf_dir))
    values = N.pool(e.select(F.col("v").alias("value")))
    test = e.filter("split = 'test'").select("seq", "u", "v")
    neg = N.draw(test, values, F.col("seq"), 20).select(F.col("seq").alias("qid"), "u", F.col("neg").alias("v"), F.lit(0).alias("is_pos"))
    cand = test.select(F.col("seq").alias("qid"), "u", "v", F.lit(1).alias("is_pos")).union(neg)
    often = e.filter("split = 'train'").groupBy("u", "v").agg(F.count("*").alias("n"))
    return cand.join(often, ["u", "v"], "left").select("qid", "is_pos", F.coalesce("n", F.lit(0)).alias("score"))


@query(with_("bip", SCORED, AGAINST) + "select round(avg(1 / (0.5 * (gt + gt + eq) + 1)), 6) mrr, round(avg((0.5 * (gt + gt + eq) + 1 <= 10)::int), 6) hits from ag")
def mrr_hits(spark, sf_dir: str) -> DataFrame:
    return M.mrr_hits(_scored(spark, sf_dir)).select(F.round("mrr", 6).alias("mrr"), F.round("hits", 6).alias("hits"))


@query(with_("bip", SCORED, AGAINST) + "select qid, round(1.0::double / (gt + eq // 2 + 1), 6) rr from ag")
def reciprocal_rank(spark, sf_dir: str) -> DataFrame:
    return M.reciprocal_rank(_scored(spark, sf_dir)).select("qid", F.round("rr", 6).alias("rr"))


@query(with_("bip", SCORED, AGAINST) + """, c as (select avg(score) filter (where is_pos = 1) m1, avg(score) filter (where is_pos = 0) m0, stddev_pop(score) filter (where is_pos = 1) s1, stddev_pop(score) filter (where is_pos = 0) s0,
count(*) filter (where is_pos = 1) c1, count(*) filter (where is_pos = 0) c0 from sc) select round(avg((n - gt - eq + 0.5 * eq) / n), 6) auc, round(avg(1 / (gt + 0.5 * eq + 1)), 6) mrr1,
(select round((m1 - m0) / sqrt(((c1 - 1) * s1 * s1 + (c0 - 1) * s0 * s0) / (c1 + c0 - 2)), 6) from c) cohen_d from ag""")
def auc_cohen_mrr1(spark, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    out = M.query_auc(s).join(F.broadcast(M.cohen_d(s)))
    return out.select(*[F.round(c, 6).alias(c) for c in ("auc", "mrr1", "cohen_d")])


RANKED = """lv as (select qid // 200 grp, score, sum(is_pos) p, sum(1 - is_pos) n from sc group by all),
rk as (select *, coalesce(sum(p) over w, 0) ap, coalesce(sum(n) over w, 0) an from lv window w as (partition by grp order by score desc rows between unbounded preceding and 1 preceding))"""


@query(with_("bip", SCORED, RANKED) + "select grp, round((sum(p * (ap + p)::double / (ap + p + an + n)) / greatest(sum(p), 1))::double, 6) ap from rk group by grp")
def average_precision(spark, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("grp", F.floor(F.col("qid") / F.lit(200)))
    return M.average_precision(s).select("grp", F.round("ap", 6).alias("ap"))


@query(with_("bip", SCORED, RANKED) + "select grp, round((sum(n * (ap + 0.5 * p)) / (sum(p) * sum(n)))::double, 6) auc from rk group by grp")
def roc_auc(spark, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("grp", F.floor(F.col("qid") / F.lit(200)))
    return M.roc_auc(s).select("grp", F.round("auc", 6).alias("auc"))


GAINS = "gn as (select t // 604800000000 slot, v item, count(*) gain from e group by all), pr as (select *, coalesce(lag(gain) over (partition by item order by slot), 0) pred from gn), rr as (select *, row_number() over (partition by slot order by pred desc, item) a, row_number() over (partition by slot order by gain desc, item) b from pr)"


@query(with_("bip", GAINS) + "select slot, round(sum(case when a <= 10 then gain / log2(a + 1) else 0 end) / sum(case when b <= 10 then gain / log2(b + 1) else 0 end), 6) ndcg from rr group by slot")
def ndcg_by_slot(spark, sf_dir: str) -> DataFrame:
    """Last week's counts as a forecast of this week's, per week."""
    week = F.floor(F.col("t") / F.lit(604_800_000_000))
    gains = E.bip(spark, sf_dir).groupBy(week.alias("slot"), F.col("v").alias("item")).agg(F.count("*").alias("gain"))
    pred = gains.withColumn("pred", F.coalesce(F.lag("gain").over(W.partitionBy("item").orderBy("slot")), F.lit(0)))
    return M.ndcg(pred).select("slot", F.round("ndcg", 6).alias("ndcg"))


@query("select event_type, round(avg(m), 5) mean, round(stddev_samp(m), 5) std from (select event_type, user_id % 5 run, avg(value) m from events group by all) group by event_type")
def mean_std_runs(spark, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", (F.col("user_id") % 5).alias("run")).agg(F.avg("value").alias("m"))
    return runs.groupBy("event_type").agg(F.round(F.avg("m"), 5).alias("mean"), F.round(F.stddev_samp("m"), 5).alias("std"))


@query("select grp, run, best from (select event_type grp, user_id % 5 run, round(avg(value), 5) best, row_number() over (partition by event_type order by avg(value) desc, user_id % 5) r from events group by event_type, user_id % 5) where r = 1")
def best_per_key(spark, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("grp"), (F.col("user_id") % 5).alias("run")).agg(F.avg("value").alias("m"))
    first = W.partitionBy("grp").orderBy(F.desc("m"), "run")
    return runs.withColumn("r", F.row_number().over(first)).filter("r = 1").select("grp", "run", F.round("m", 5).alias("best"))


@query("select o_orderstatus status, " + ", ".join(f"(count(*) filter (where o_orderpriority like '{i}-%'))::bigint p{i}" for i in range(1, 6)) + " from orders group by 1")
def pivot_grid(spark, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("p"))
    grid = o.groupBy("status").pivot("p", ["1", "2", "3", "4", "5"]).agg(F.count(F.lit(1))).na.fill(0)
    return grid.select("status", *[F.col(str(i)).alias(f"p{i}") for i in range(1, 6)])


# -- statistics --------------------------------------------------------------------------


@query(with_("uni") + "select count(*) edges, count(distinct (u, v)) unique_edges, (select count(distinct x) from (select u x from e union all select v from e)) nodes, count(distinct t) stamps, round(count(*) / count(distinct t), 6) edges_per_stamp from e")
def dataset_stats(spark, sf_dir: str) -> DataFrame:
    out = T.dataset_stats(E.uni(spark, sf_dir))
    return out.withColumn("edges_per_stamp", F.round("edges_per_stamp", 6))


@query(with_("trade") + ", x as (select t, u x from e union all select t, v from e) select round(avg(d), 6) degree_per_stamp from (select t, count(*)::double / count(distinct x) d from x group by t)")
def degree_per_ts(spark, sf_dir: str) -> DataFrame:
    return T.degree_per_stamp(E.trade(spark, sf_dir)).select(F.round("degree_per_stamp", 6).alias("degree_per_stamp"))


@query(with_("bip", SPLIT) + """, p as (select distinct u, v from sp where split <> 'test'), te as (select distinct u, v from sp where split = 'test')
select round((select count(*) from (from te except from p))::double / (select count(*) from sp where split = 'test'), 6) surprise, round((select count(*) from (from te intersect from p))::double / (select count(*) from sp where split <> 'test'), 6) reoccurrence""")
def surprise_reoccurrence(spark, sf_dir: str) -> DataFrame:
    return T.surprise(S.quantile_split(E.bip(spark, sf_dir))).select(F.round("surprise", 6).alias("surprise"), F.round("reoccurrence", 6).alias("reoccurrence"))


@query(with_("trade", SPLIT) + ", x as (select distinct split, n from (select split, u n from sp union all select split, v from sp)) select split, round(avg((n not in (select n from x where split = 'train'))::int), 6) ratio from x where split <> 'train' group by split")
def new_node_ratio(spark, sf_dir: str) -> DataFrame:
    return T.new_node_ratio(S.quantile_split(E.trade(spark, sf_dir))).select("split", F.round("ratio", 6).alias("ratio"))


@query(with_("bip") + ", c as (select x, count(*) c from (select u x from e union all select v from e) group by x) select count(*) nodes, count(*) filter (where c >= 10) at_least_10, count(*) filter (where c >= 100) at_least_100, count(*) filter (where c >= 1000) at_least_1000 from c")
def node_activity(spark, sf_dir: str) -> DataFrame:
    return T.activity(E.bip(spark, sf_dir))


# -- set algebra and common-neighbour decoding ----------------------------------------------

SETS = with_("uni", SPLIT) + ", x as (select distinct u, v from sp where split = 'train'), y as (select distinct u, v from sp where split <> 'train')"


def _sets(spark, sf_dir: str):
    e = S.quantile_split(E.uni(spark, sf_dir))
    return e.filter("split = 'train'").select("u", "v"), e.filter("split <> 'train'").select("u", "v")


@query(SETS + " from x intersect from y")
def set_overlap(spark, sf_dir: str) -> DataFrame:
    x, y = _sets(spark, sf_dir)
    return x.intersect(y)


@query(SETS + " from x except from y")
def set_difference(spark, sf_dir: str) -> DataFrame:
    x, y = _sets(spark, sf_dir)
    return x.distinct().join(y, ["u", "v"], "left_anti").select("u", "v")


@query(SETS + " select coalesce(x.u, y.u) u, coalesce(x.v, y.v) v, case when x.u is null then 'right' when y.u is null then 'left' else 'both' end part from x full join y on x.u = y.u and x.v = y.v")
def set_three_way(spark, sf_dir: str) -> DataFrame:
    return T.three_way(*_sets(spark, sf_dir), ["u", "v"])


LASTT = "lt as (select node, max(t) t from (select u node, t from e union all select v, t from e) group by node), mx as (select max(t) t from e)"


@query(with_("uni", PAIRS, LASTT) + "select u, v, round(sum(exp(-(mx.t - lt.t) / 1e10::double)), 6) decayed from cnw join lt on node = w, mx group by u, v")
def cn_time_decay(spark, sf_dir: str) -> DataFrame:
    """Common neighbours weighted by how long ago each was last active (10,000 s scale)."""
    from .graph_queries import _asked

    e = E.uni(spark, sf_dir)
    last = e.select(F.explode(F.array("u", "v")).alias("w"), "t").groupBy("w").agg(F.max("t").alias("lt"))
    found = G.common_neighbors(_asked(e), G.pairs(e)).join(last, "w").join(F.broadcast(e.agg(F.max("t").alias("mx"))))
    return found.groupBy("u", "v").agg(F.round(F.sum(F.exp(-(F.col("mx") - F.col("lt")) / F.lit(1e10))), 6).alias("decayed"))


@query(with_("uni") + "select u node, max(seq) seq, arg_max(w, seq) message from e group by u")
def last_message(spark, sf_dir: str) -> DataFrame:
    return E.uni(spark, sf_dir).groupBy(F.col("u").alias("node")).agg(F.max("seq").alias("seq"), F.max_by("w", "seq").alias("message"))


@query(with_("uni") + "select u node, round(avg(w), 6) message from e group by u")
def mean_message(spark, sf_dir: str) -> DataFrame:
    return E.uni(spark, sf_dir).groupBy(F.col("u").alias("node")).agg(F.round(F.avg("w"), 6).alias("message"))


@query(with_("uni", PAIRS) + """, nv as (select vec_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 i from embeddings)
select u, v, i::int i, round(sum(x), 5) s from cnw join nv on vec_id = w group by u, v, i""")
def ncn_vector_sum(spark, sf_dir: str) -> DataFrame:
    """Sum of the common neighbours' whole node vectors, a row per component."""
    from .graph_queries import _asked

    e = E.uni(spark, sf_dir)
    vec = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("w"), "embedding")
    sums = D.vector_sums(G.common_neighbors(_asked(e), G.pairs(e)), vec, "w", "embedding", ["u", "v"])
    return sums.select("u", "v", F.posexplode("sums").alias("i", "s")).select("u", "v", "i", F.round("s", 5).alias("s"))


# -- as-of alignment ------------------------------------------------------------------------


@query(with_("uni", SPLIT) + """, lb as (select node, ts, row_number() over (order by ts, node) id from (select distinct u node, (t // 86400000000 + 1) * 86400000000 ts from e)),
m as (select id, node, ts, (select max(seq) from e where e.u = lb.node and e.t <= lb.ts) seq from lb)
select node, ts, coalesce(m.seq, 0) seq, case when sp.split is null then 'just_update' else sp.split end split from m left join sp on sp.seq = m.seq""")
def label_alignment_asof(spark, sf_dir: str) -> DataFrame:
    """Each daily label of a node takes the node's latest interaction as source up to then."""
    e = S.quantile_split(E.uni(spark, sf_dir))
    day = F.lit(86_400_000_000)
    labels = e.select(F.col("u").alias("node"), ((F.floor(F.col("t") / day) + 1) * day).alias("ts")).distinct()
    out = R.as_of(labels, e.select(F.col("u").alias("node"), "t", "seq", "split"), ["node"], "ts", "t", ["seq", "split"], strict=False)
    return out.select("node", "ts", F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("split", F.lit("just_update")).alias("split"))


@query(with_("uni", PAIRS) + """, f as (select ask.u, ask.v, coalesce(c, 0) c, coalesce(b, 0) b from ask left join (select u, v, count(*) c from cnw group by u, v) using (u, v) left join (select u, v, count(*) b from brw group by u, v) using (u, v))
select u, v, round(0.7 * ln(1 + c) + 0.3 * (1 / (1 + exp(-b / 10.0))), 6) score from f""")
def score_ensemble(spark, sf_dir: str) -> DataFrame:
    """Weighted sum of two scorers."""
    from ..functions import sigmoid
    from .graph_queries import _asked

    e = E.uni(spark, sf_dir)
    ab = G.cut(G.pairs(e))
    f = B.pair_counts(_asked(e), ab, G.degree(ab).withColumnRenamed("degree", "value"))
    return f.select("u", "v", F.round(0.7 * F.log1p(F.col("cn").cast("double")) + 0.3 * sigmoid(F.col("bridge") / 10.0), 6).alias("score"))
