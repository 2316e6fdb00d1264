"""Edges, splits, the evolving graph, its indicators, rolling statistics and pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import cadence as C
from ..operators import graph as G
from ..operators import indicators as I
from ..operators import pairwise as P
from ..operators import rolling as R
from ..operators import splits as S
from ..sources import edges as E
from .registry import ADJ, DEG, FIRST, SNAP, query, with_


@query(with_("bip") + "select seq, eid, u, v, t, w from e")
def edges_bip(spark, sf_dir: str) -> DataFrame:
    return E.bip(spark, sf_dir)


@query(with_("trade") + "select seq, u, v, t from e")
def edges_trade(spark, sf_dir: str) -> DataFrame:
    return E.trade(spark, sf_dir).select("seq", "u", "v", "t")


@query(with_("uni", FIRST) + "select a, b, seq0, t0, batch0, n0 from fe")
def first_edges_uni(spark, sf_dir: str) -> DataFrame:
    return G.first_edges(E.uni(spark, sf_dir))


@query("select user_id + 1 u, (select max(user_id) from events) + 2 + regexp_extract(props, '\"k\": *([0-9]+)', 1)::bigint v, event_id + 1 idx from events")
def reindex_bipartite(spark, sf_dir: str) -> DataFrame:
    return S.reindex_bipartite(E.events(spark, sf_dir).select("u", F.col("k").alias("v"), F.col("eid").alias("idx")))


@query("""with o as (select o_orderkey k, 's' || o_custkey s, 'c' || o_orderstatus || o_orderpriority d from orders),
x as (select k * 2 p, s x from o union all select k * 2 + 1, d from o)
select x as raw, row_number() over (order by min(p)) - 1 id from x group by x""")
def id_encode_first_seen(spark, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(F.lit("s"), "o_custkey").alias("s"), F.concat(F.lit("c"), "o_orderstatus", "o_orderpriority").alias("d"))
    return S.first_seen_ids(o, "o_orderkey", ["s", "d"])


@query(with_("bip") + "select (seq - 1) // 200 batch, min(seq) lo, max(seq) hi, count(*) n from e group by 1")
def chrono_batches(spark, sf_dir: str) -> DataFrame:
    return G.batches(E.bip(spark, sf_dir)).groupBy("batch").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n"))


SPLIT = "q as (select quantile_cont(t::double, 0.70) a, quantile_cont(t::double, 0.85) b from e), sp as (select e.*, case when t <= a then 'train' when t <= b then 'val' else 'test' end split from e, q)"


@query(with_("bip", SPLIT) + "select split, count(*) n, min(seq) first_seq, max(seq) last_seq from sp group by split")
def split_quantile(spark, sf_dir: str) -> DataFrame:
    return S.quantile_split(E.bip(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(with_("bip") + "select split, count(*) n, sum(w) total from (select w, case when seq <= (0.70 * n)::int then 'train' when seq <= (0.85 * n)::int then 'val' else 'test' end split from (select *, count(*) over () n from e)) group by split".replace("(0.70 * n)::int", "floor(0.70::double * n)").replace("(0.85 * n)::int", "floor(0.85::double * n)").replace("sum(w) total", "round(sum(w), 3) total"))
def split_positional(spark, sf_dir: str) -> DataFrame:
    return S.positional_split(E.bip(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("w"), 3).alias("total"))


@query(with_("bip", SPLIT) + """, n as (select distinct x from (select u x from sp where split <> 'train' union all select v from sp where split <> 'train')),
allx as (select distinct x from (select u x from e union all select v from e)),
c as (select x from n order by (x * 7919) % 100003, x limit (select count(*) // 10 from allx)),
tr as (select * from sp where split = 'train' and u not in (select x from c) and v not in (select x from c)),
known as (select u x from tr union select v from tr),
f as (select *, u not in (select x from known) or v not in (select x from known) touches from sp)
select 'train' part, count(*) n from tr union all select split, count(*) from sp where split <> 'train' group by split
union all select 'new_' || split, count(*) from f where split <> 'train' and touches group by split""")
def split_inductive(spark, sf_dir: str) -> DataFrame:
    return S.inductive_split(S.quantile_split(E.bip(spark, sf_dir)))


@query(with_("bip", SPLIT) + """, n as (select distinct x from (select u x from sp where split <> 'train' union all select v from sp where split <> 'train')),
allx as (select distinct x from (select u x from e union all select v from e)),
c as (select x from n order by (x * 7919) % 100003, x limit (select count(*) // 10 from allx)),
h as (select *, u in (select x from c) or v in (select x from c) held from sp), known as (select u x from h where split = 'train' and not held union select v from h where split = 'train' and not held)
select seq, split, case when split = 'train' then case when held then 'left_out' else 'kept' end when u not in (select x from known) or v not in (select x from known) then 'new' else 'known' end as \"role\" from h""")
def split_inductive_rows(spark, sf_dir: str) -> DataFrame:
    """Every edge with its role when a tenth of the nodes are held out of training."""
    return S.inductive_rows(S.quantile_split(E.bip(spark, sf_dir))).select("seq", "split", "role")


@query(with_("bip", SPLIT) + "select seq, u, v from sp where split <> 'train' and not exists (select 1 from sp s where s.split = 'train' and s.u = sp.u and s.v = sp.v)")
def new_edges_split(spark, sf_dir: str) -> DataFrame:
    rows = S.quantile_split(E.bip(spark, sf_dir))
    return rows.filter("split <> 'train'").join(rows.filter("split = 'train'"), ["u", "v"], "left_anti").select("seq", "u", "v")


@query(with_("bip") + ", p as (select floor(i * n / 500.0)::bigint + 1 seq from (select count(*) n from e), range(500) r(i)) select distinct e.seq, u, v from e join p using (seq)")
def strided_subsample(spark, sf_dir: str) -> DataFrame:
    return S.strided(E.bip(spark, sf_dir), 500).select("seq", "u", "v")


# -- graph and indicators ---------------------------------------------------------------


@query(with_("uni", SNAP, ADJ, DEG) + "select node, d degree from deg")
def degree(spark, sf_dir: str) -> DataFrame:
    return G.degree(G.pairs(E.uni(spark, sf_dir)))


def _asked(edges: DataFrame) -> DataFrame:
    """Every distinct pair of the stream."""
    return edges.filter("u <> v").select("u", "v").distinct()


ASKED = "ask as (select distinct u, v from e where u <> v)"


@query(with_("uni", SNAP, ADJ, ASKED) + "select u, v, count(*) common from ask join adj x on x.n = u join adj y on y.n = v and y.m = x.m group by u, v")
def common_neighbors(spark, sf_dir: str) -> DataFrame:
    e = E.uni(spark, sf_dir)
    return B.shared_words(_asked(e), G.pairs(e)).groupBy("u", "v").agg(F.sum(F.bit_count("both")).alias("common"))


TRI = "tri as (select x.a x, x.b y, y.b z from ab x join ab y on y.a = x.b join ab z on z.a = x.a and z.b = y.b)"
TRIN = "tn as (select node, coalesce(c, 0) tri from deg left join (select node, count(*) c from (select unnest([x, y, z]) node from tri) group by 1) using (node))"


@query(with_("uni", SNAP, ADJ, DEG, TRI, TRIN) + "select node, tri triangles from tn")
def triangle_count(spark, sf_dir: str) -> DataFrame:
    return G.triangle_count(G.pairs(E.uni(spark, sf_dir)))


@query(with_("uni", SNAP, ADJ, DEG, TRI, TRIN) + "select node, round(case when d < 2 then 0 else 2.0 * tri / (d * (d - 1)) end, 6) clustering from tn join deg using (node)")
def clustering(spark, sf_dir: str) -> DataFrame:
    return G.clustering(G.pairs(E.uni(spark, sf_dir))).withColumn("clustering", F.round("clustering", 6))


CORE = """kc as (select 0 r, node n, d::bigint c from deg union all
  select r + 1, n, max(least(c, rn)) from (select r, n, c, row_number() over (partition by n order by c desc) rn from (select k.r, adj.n, k.c from kc k join adj on adj.m = k.n)) where r < 40 group by r, n),
core as (select n node, c core from kc where r = 40)"""


@query(with_("uni", SNAP, ADJ, DEG, CORE, recursive=True) + "select node, core from core")
def kcore(spark, sf_dir: str) -> DataFrame:
    return G.k_core(G.pairs(E.uni(spark, sf_dir)))


TRUSS = """wing as (select x a, y b, x a1, z b1, y a2, z b2 from tri union all select x, z, x, y, y, z from tri union all select y, z, x, y, x, z from tri),
kt as (select 0 r, a, b, count(*) s from wing group by a, b union all
  select r + 1, a, b, max(least(l, rn)) from (select r, a, b, l, row_number() over (partition by a, b order by l desc) rn
    from (select k1.r, w.a, w.b, least(k1.s, k2.s) l from wing w join kt k1 on k1.a = w.a1 and k1.b = w.b1 join kt k2 on k2.a = w.a2 and k2.b = w.b2)) where r < 40 group by r, a, b),
te as (select ab.a, ab.b, coalesce(s, 0) + 2 truss from ab left join (select * from kt where r = 40) k on k.a = ab.a and k.b = ab.b)"""


@query(with_("uni", SNAP, TRI, TRUSS, recursive=True) + "select a, b, truss::bigint truss from te")
def truss_edge(spark, sf_dir: str) -> DataFrame:
    return G.k_truss(G.pairs(E.uni(spark, sf_dir)))


@query(with_("uni", SNAP, TRI, TRUSS, recursive=True) + "select node, max(truss)::bigint truss from (select unnest([a, b]) node, truss from te) group by node")
def truss_node(spark, sf_dir: str) -> DataFrame:
    return G.node_truss(G.pairs(E.uni(spark, sf_dir)))


DTRACE = "dt as (select node, n0, row_number() over (partition by node order by n0) degree from (select unnest([a, b]) node, n0 from fe))"


@query(with_("uni", FIRST, DTRACE) + "select node, n0, degree from dt")
def degree_trace(spark, sf_dir: str) -> DataFrame:
    return G.degree_trace(G.first_edges(E.uni(spark, sf_dir)))


@query(with_("uni", FIRST) + """, t as (select x.a x, x.b y, y.b z, greatest(x.n0, y.n0, z.n0) n0 from fe x join fe y on y.a = x.b join fe z on z.a = x.a and z.b = y.b),
h as (select node, n0, count(*) c from (select unnest([x, y, z]) node, n0 from t) group by all)
select node, n0, (sum(c) over (partition by node order by n0))::bigint triangles from h""")
def triangle_trace(spark, sf_dir: str) -> DataFrame:
    return G.triangle_trace(G.first_edges(E.uni(spark, sf_dir)))


@query(with_("uni", FIRST, DTRACE) + """, q as (select seq, u, (seq - 1) // 200 batch from e),
nb as (select batch0, max(n0) upto from fe group by 1),
lim as (select q.seq, q.u, coalesce((select max(upto) from nb where nb.batch0 < q.batch), 0) upto from (select min(seq) seq, u, batch from q group by u, batch) q)
select lim.seq, u node, coalesce(max(degree), 0)::bigint degree from lim left join dt on dt.node = u and dt.n0 <= upto group by all""")
def degree_asof_batch(spark, sf_dir: str) -> DataFrame:
    """Predict then advance: every query sees the state after the batch before its own."""
    edges = G.batches(E.uni(spark, sf_dir))
    first = G.first_edges(E.uni(spark, sf_dir))
    trace = G.degree_trace(first).join(first.select("n0", "batch0"), "n0").groupBy("node", "batch0").agg(F.max("degree").alias("degree"))
    asked = edges.groupBy(F.col("u").alias("node"), "batch").agg(F.min("seq").alias("seq"))
    return R.as_of(asked, trace, ["node"], "batch", "batch0", ["degree"]).select("seq", "node", F.coalesce("degree", F.lit(0)).alias("degree"))


CADENCE = """mk as (select n0 // 64 s, batch0 ready from fe where n0 % 64 = 0),
sn as (select a, b, s from fe join mk on s * 64 >= n0), sa as (select s, a n, b m from sn union all select s, b, a from sn),
ck as (select 0 r, s, n, count(*) c from sa group by s, n union all
  select r + 1, s, n, max(least(c, rn)) from (select r, s, n, c, row_number() over (partition by s, n order by c desc) rn from (select k.r, sa.s, sa.n, k.c from ck k join sa on sa.s = k.s and sa.m = k.n)) where r < 24 group by r, s, n),
tc as (select n node, ready, arg_max(c, s) core from ck join mk using (s) where r = 24 group by n, ready)"""


@query(with_("uni", FIRST, CADENCE, recursive=True) + """, q as (select min(seq) seq, u node, (seq - 1) // 200 batch from e group by u, (seq - 1) // 200)
select q.seq, q.node, coalesce(arg_max(core, ready), 0)::bigint core from q left join tc on tc.node = q.node and tc.ready < q.batch group by q.seq, q.node""")
def core_cadence_asof(spark, sf_dir: str) -> DataFrame:
    """Core numbers recomputed every 64 new edges, read as of each batch of 200."""
    return C.trace_as_of(E.uni(spark, sf_dir), C.core_trace, "core")


@query()
def truss_cadence_asof(spark, sf_dir: str) -> DataFrame:
    """Node truss numbers recomputed every 64 new edges, read as of each batch of 200."""
    return C.trace_as_of(E.uni(spark, sf_dir), C.truss_trace, "truss")


DAY = 86_400_000_000


def _window_sql(size: int) -> str:
    return f""", b as (select (seq - 1) // {size} batch, max(t) - {7 * DAY} fl from e group by 1),
o as (select least(u, v) a, greatest(u, v) b, t, (seq - 1) // {size} batch, row_number() over (partition by least(u, v), greatest(u, v) order by seq) i from e where u <> v),
d as (select t, min(b.batch) p0 from (select distinct t from o) join b on b.fl > t group by t),
g as (select o.*, case when p0 is not null and greatest(p0, batch + 1) <= (select max(batch) from b) then greatest(p0, batch + 1) end p from o left join d using (t)),
s as (select a, b, i, t t_in, batch batch_in, p, true began from g where i = 1 union all
  select g.a, g.b, g.i, case when n then g.t else t_in end, case when n then g.batch else batch_in end, case when n then g.p else s.p end, n
  from s join (select * from g) g on g.a = s.a and g.b = s.b and g.i = s.i + 1, lateral (select coalesce(s.p <= g.batch, false) n))
select a, b, t_in, batch_in, p batch_out from s where began"""


@query(with_("uni", recursive=True) + _window_sql(200))
def window_graph(spark, sf_dir: str) -> DataFrame:
    """Stays of edges in a window of seven days."""
    return G.window_validity(E.uni(spark, sf_dir), 7 * DAY)


PRUNES = """, bt as (select (seq - 1) // 200 batch, u, v from e), kn as (select node, min(batch) since from (select batch, unnest([u, v]) node from bt where u <> v) group by node)
select p.batch, node from (select distinct batch_out batch from st where batch_out is not null) p join kn on since < p.batch"""


@query(with_("uni", recursive=True) + _window_sql(200).replace("select a, b, t_in, batch_in, p batch_out from s where began", "st as (select a, b, t_in, batch_in, p batch_out from s where began)").replace("coalesce(s.p <= g.batch, false) n))", "coalesce(s.p <= g.batch, false) n)),") + PRUNES)
def pruned_ticks(spark, sf_dir: str) -> DataFrame:
    """Who ticks when a batch prunes edges out of a window of seven days."""
    return I.pruned_ticks(E.uni(spark, sf_dir), 7 * DAY)


# -- rolling statistics -----------------------------------------------------------------


def _degree_ticks(spark, sf_dir: str) -> DataFrame:
    return G.degree_trace(G.first_edges(E.uni(spark, sf_dir))).select("node", F.col("n0").alias("n"), F.col("degree").alias("value"))


def _last_stats(edges: DataFrame) -> DataFrame:
    """Each user's statistics after the stream."""
    return R.rolling(_ticks(edges)).groupBy("node").agg(F.max_by(F.struct("ema", "delta", "std", "max_change"), "n").alias("s")).select("node", "s.*")


def _activity(spark, sf_dir: str) -> DataFrame:
    return _ticks(E.uni(spark, sf_dir))


def _ticks(edges: DataFrame) -> DataFrame:
    """Ticks of a value that goes up and down: each user's rounded event values."""
    return edges.select(F.col("u").alias("node"), F.col("seq").alias("n"), F.floor(F.col("w") / 10).cast("double").alias("value"))


ACT = "act as (select u node, seq n, floor(w / 10)::double x, row_number() over (partition by u order by seq) i from e)"
FOLD = f"""{ACT}, f as (select node, n, i, x, x ema, x * x sq, 0::double mc, x slow from act where i = 1 union all
  select a.node, a.n, a.i, a.x, 0.95::double * ema + (1 - 0.95::double) * a.x, 0.95::double * sq + (1 - 0.95::double) * a.x * a.x, greatest(0.95::double * mc, abs(a.x - f.x)), 0.99::double * slow + (1 - 0.99::double) * a.x
  from f join act a on a.node = f.node and a.i = f.i + 1)"""


@query(with_("uni", ACT) + """, d as (select *, x - lag(x) over (partition by node order by i) dl from act),
c as (select *, max(case when i = 1 or dl <> 0 then i end) over (partition by node order by i) l from d)
select node, n, x "current", coalesce(dl, 0) delta, round(ln(1 + (i - l)::double), 6) recency from c""")
def roll_current_delta(spark, sf_dir: str) -> DataFrame:
    return R.plain(_activity(spark, sf_dir)).withColumn("recency", F.round("recency", 6))


@query(with_("uni", ACT) + """, d as (select *, x - lag(x) over (partition by node order by i) dl from act),
c as (select *, max(case when i = 1 or dl <> 0 then i end) over (partition by node order by i) l from d)
select node, n, round(ln(1 + (i - l)::double), 6) recency from c""")
def roll_recency(spark, sf_dir: str) -> DataFrame:
    """Recency out of the fold, against windows in SQL."""
    return R.rolling(_activity(spark, sf_dir)).select("node", "n", F.round("recency", 6).alias("recency"))


@query(with_("uni", FOLD, recursive=True) + "select node, n, ema, sqrt(greatest(sq - ema * ema, 0)) std from f")
def roll_ema_std(spark, sf_dir: str) -> DataFrame:
    return R.rolling(_activity(spark, sf_dir)).select("node", "n", "ema", "std")


@query(with_("uni", FOLD, recursive=True) + "select node, n, mc max_change from f")
def roll_max_change(spark, sf_dir: str) -> DataFrame:
    return R.rolling(_activity(spark, sf_dir)).select("node", "n", "max_change")


@query(with_("uni", FOLD, recursive=True) + "select node, n, ema - slow trend from f")
def roll_trend(spark, sf_dir: str) -> DataFrame:
    return R.rolling(_activity(spark, sf_dir)).select("node", "n", "trend")


@query(with_("uni", FOLD, recursive=True) + """, q as (select seq, v from e)
select q.seq, v node, coalesce(arg_max(ema, n), 0) ema, coalesce(arg_max(mc, n), 0) max_change from q left join f on f.node = v and f.n < q.seq group by all""")
def node_features_asof(spark, sf_dir: str) -> DataFrame:
    stats = R.rolling(_activity(spark, sf_dir))
    asked = E.uni(spark, sf_dir).select("seq", F.col("v").alias("node"))
    out = R.as_of(asked, stats, ["node"], "seq", "n", ["ema", "max_change"])
    return out.select("seq", "node", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ema", "max_change")])


TICKS = """tg as (select x.a x, x.b y, y.b z, greatest(x.n0, y.n0, z.n0) n0 from fe x join fe y on y.a = x.b join fe z on z.a = x.a and z.b = y.b),
mv as (select node, n0, sum(d) d, sum(t) t from (select unnest([a, b]) node, n0, 1 d, 0 t from fe union all select unnest([x, y, z]), n0, 0, 1 from tg) group by node, n0),
tk as (select node, n0, (sum(d) over w)::bigint degree, (sum(t) over w)::bigint triangles from mv window w as (partition by node order by n0))"""


@query(with_("uni", FIRST, TICKS) + "select node, n0, degree, triangles, round(case when degree < 2 then 0 else 2.0 * triangles / (degree * (degree - 1)) end, 6) clustering from tk")
def update_ticks(spark, sf_dir: str) -> DataFrame:
    """One tick of each node that a new edge affects, with all its indicators."""
    return I.ticks(G.first_edges(E.uni(spark, sf_dir))).withColumn("clustering", F.round("clustering", 6))


@query(with_("uni", FIRST, TICKS, recursive=True) + """, o as (select node, n0 n, triangles::double x, row_number() over (partition by node order by n0) i from tk),
r as (select node, n, i, x, x ema, 0::double mc, x slow, 0::double dl from o where i = 1 union all
  select o.node, o.n, o.i, o.x, 0.95::double * ema + (1 - 0.95::double) * o.x, greatest(0.95::double * mc, abs(o.x - r.x)), 0.99::double * slow + (1 - 0.99::double) * o.x, o.x - r.x from r join o on o.node = r.node and o.i = r.i + 1)
select node, n, x "current", ema, dl delta, mc max_change, ema - slow trend from r""")
def roll_triangle_ticks(spark, sf_dir: str) -> DataFrame:
    """Rolling statistics of the triangle count over the update's ticks."""
    ticks = I.ticks(G.first_edges(E.uni(spark, sf_dir))).select("node", F.col("n0").alias("n"), F.col("triangles").alias("value"))
    return R.select_stats(R.rolling(ticks), ["current", "ema", "delta", "max_change", "trend"])


@query(with_("uni", FIRST, TICKS) + "select batch0 batch, count(distinct node) nodes from tk join fe using (n0) group by batch0")
def affected_nodes(spark, sf_dir: str) -> DataFrame:
    """How many nodes each batch affects."""
    return I.affected(G.first_edges(E.uni(spark, sf_dir))).groupBy("batch").agg(F.count("*").alias("nodes"))


@query(with_("uni", SNAP, ADJ, DEG, TRI, TRIN, CORE, recursive=True) + "select deg.node, d::double degree, core::double core, tri::double triangle from deg join core using (node) join tn using (node)")
def indicator_snapshot(spark, sf_dir: str) -> DataFrame:
    """The indicators of a large graph, side by side."""
    return I.snapshot(G.cut(G.pairs(E.uni(spark, sf_dir))), I.for_size(5_000_000)[:3])


NAMES = ("degree", "triangle", "clustering")
CC = "case when degree < 2 then 0 else 2.0 * triangles / (degree * (degree - 1)) end"


@query(with_("uni", FIRST, TICKS) + f""", dg as (select node, n0, row_number() over (partition by node order by n0) x from (select unnest([a, b]) node, n0 from fe)),
h as (select node, n0, count(*) c from (select unnest([x, y, z]) node, n0 from tg) group by all)
select 'degree' "indicator", node, n0 n, x::double "value" from dg union all select 'triangle', node, n0, (sum(c) over (partition by node order by n0))::double from h
union all select 'clustering', node, n0, round({CC}, 6) from tk""")
def indicator_traces(spark, sf_dir: str) -> DataFrame:
    """Traces of three indicators by name, in one table."""
    return I.traces(G.first_edges(E.uni(spark, sf_dir)), list(NAMES)).withColumn("value", F.round("value", 6))


@query(with_("uni", FIRST, recursive=True) + """, tk as (select node, n0 n, row_number() over (partition by node order by n0)::double x, row_number() over (partition by node order by n0) i from (select unnest([a, b]) node, n0 from fe)),
f as (select node, n, i, x, x ema, 0::double mc from tk where i = 1 union all select t.node, t.n, t.i, t.x, 0.95::double * ema + (1 - 0.95::double) * t.x, greatest(0.95::double * mc, abs(t.x - f.x)) from f join tk t on t.node = f.node and t.i = f.i + 1)
select q.n0 n, q.node, round(coalesce(ema, 0), 6) degree_ema, round(coalesce(mc, 0), 6) degree_max_change from (select unnest([a, b]) node, n0 from fe) q asof left join f on f.node = q.node and q.n0 > f.n""")
def indicator_features_asof(spark, sf_dir: str) -> DataFrame:
    """Rolling statistics of an indicator's trace before each new edge, for both of its ends."""
    first = G.first_edges(E.uni(spark, sf_dir))
    asked = first.select(F.explode(F.array("a", "b")).alias("node"), F.col("n0").alias("n"))
    out = I.features_as_of(asked, first, ["degree"], ["ema", "max_change"])
    return out.select("n", "node", *[F.round(f"degree_{c}", 6).alias(f"degree_{c}") for c in ("ema", "max_change")])


# -- pair features ----------------------------------------------------------------------

PAIRS = f"""{SNAP}, {ADJ}, {DEG}, {ASKED}, near as (select u, v, m w from ask join adj on n = v where m <> u),
cnw as (select u, v, w from near join adj on n = u and m = w),
tw as (select distinct q.u, y.m w from (select distinct u from ask) q join adj x on x.n = q.u join adj y on y.n = x.m where y.m <> q.u),
brw as (select near.u, near.v, near.w from near join tw on tw.u = near.u and tw.w = near.w),
c2w as (select * from brw where not exists (select 1 from adj where n = u and m = w))"""


def _sums(name: str, table: str) -> str:
    return f"{name} as (select u, v, count(*)::double n, sum(case when d > 1 then 1 / ln(d) else 0 end) aa, sum(1.0::double / d) ra, sum(d)::double xs, max(d)::double xm from {table} join deg on node = w group by u, v)"


GENERIC = with_("uni", PAIRS, _sums("c1", "cnw"), _sums("c2", "c2w"), _sums("c3", "brw")) + """, f as (select ask.u, ask.v, coalesce(c1.n, 0) n, coalesce(c1.aa, 0) aa, coalesce(c1.ra, 0) ra, coalesce(c1.xs, 0) xs, coalesce(c1.xm, 0) xm,
coalesce(c2.n, 0) n2, coalesce(c2.aa, 0) aa2, coalesce(c2.xs, 0) xs2, coalesce(c3.n, 0) bn, coalesce(c3.xs, 0) bx, coalesce(du.d, 0)::double du, coalesce(dv.d, 0)::double dv
from ask left join c1 using (u, v) left join c2 using (u, v) left join c3 using (u, v) left join deg du on du.node = ask.u left join deg dv on dv.node = ask.v)
"""


@query(GENERIC + "select u, v, round(ln(1 + n), 6) cn, round(aa, 6) aa, round(ra, 6) ra, round(case when du + dv - n > 0 then n / (du + dv - n) else 0 end, 6) jaccard, round(ln(1 + du * dv), 6) pa, round(ln(1 + n2), 6) cn2, round(aa2, 6) aa2 from f")
def pair_generic(spark, sf_dir: str) -> DataFrame:
    e = E.uni(spark, sf_dir)
    ab = G.cut(G.pairs(e))
    out = P.pair_features(_asked(e), ab, G.degree(ab).withColumnRenamed("degree", "x"))
    return out.select("u", "v", *[F.round(c, 6).alias(c) for c in ("cn", "aa", "ra", "jaccard", "pa", "cn2", "aa2")])


@query(GENERIC + """select u, v, round(ln(1 + xs), 6) cn_x_sum, xm cn_x_max, round(case when n > 0 then xs / n else 0 end, 6) cn_x_mean, round(ln(1 + xs2), 6) cn2_x_sum,
round(case when n2 > 0 then xs2 / n2 else 0 end, 6) cn2_x_mean, du x_u, dv x_v, least(du, dv) x_min, abs(du - dv) x_gap from f""")
def pair_cohesion(spark, sf_dir: str) -> DataFrame:
    e = E.uni(spark, sf_dir)
    ab = G.cut(G.pairs(e))
    out = P.pair_features(_asked(e), ab, G.degree(ab).withColumnRenamed("degree", "x"))
    names = ("cn_x_sum", "cn_x_max", "cn_x_mean", "cn2_x_sum", "cn2_x_mean", "x_u", "x_v", "x_min", "x_gap")
    return out.select("u", "v", *[F.round(c, 6).alias(c) for c in names])


@query(with_("uni", FOLD, PAIRS, recursive=True) + """, st as (select node, arg_max(ema, n) ema, arg_max(x - px, n) dl, arg_max(sd, n) sd, arg_max(mc, n) mc
  from (select *, coalesce(lag(x) over (partition by node order by i), x) px, sqrt(greatest(sq - ema * ema, 0)) sd from f) group by node),
a as (select u, v, sum(round(ema, 6)::decimal(28, 6))::double e1, sum(round(dl, 6)::decimal(28, 6))::double d1, count(*) filter (where dl > 0) p1, count(*) filter (where dl < 0) m1, sum(round(sd, 6)::decimal(28, 6))::double s1, sum(round(mc, 6)::decimal(28, 6))::double x1 from cnw join st on node = w group by u, v),
b as (select u, v, sum(round(ema, 6)::decimal(28, 6))::double e2, sum(round(dl, 6)::decimal(28, 6))::double d2, count(*) filter (where dl > 0) p2 from c2w join st on node = w group by u, v)
select ask.u, ask.v, coalesce(e1, 0) cn_x_ema_sum, coalesce(d1, 0) cn_x_delta_sum, round(ln(1 + coalesce(p1, 0)), 6) cn_x_dpos, round(ln(1 + coalesce(m1, 0)), 6) cn_x_dneg,
coalesce(s1, 0) cn_x_std_sum, coalesce(x1, 0) cn_x_mxch_sum, coalesce(e2, 0) cn2_x_ema_sum, coalesce(d2, 0) cn2_x_delta_sum, round(ln(1 + coalesce(p2, 0)), 6) cn2_x_dpos,
round(coalesce(su.ema, 0), 6) u_x_ema, round(coalesce(su.dl, 0), 6) u_x_delta, round(coalesce(sv.ema, 0), 6) v_x_ema, round(coalesce(sv.dl, 0), 6) v_x_delta
from ask left join a using (u, v) left join b using (u, v) left join st su on su.node = ask.u left join st sv on sv.node = ask.v""")
def pair_dynamic(spark, sf_dir: str) -> DataFrame:
    e = E.uni(spark, sf_dir)
    last = _last_stats(e)
    out = P.neighbor_dynamics(_asked(e), G.cut(G.pairs(e)), last)
    return out.select("u", "v", *[(F.col(c) if c.endswith("_sum") else F.round(c, 6) + 0.0).alias(c) for c in P.DYNAMIC])


#: All 30 features of the pairs in ``ask``, as table ``pf``; x is the degree.
ALL = f"""{ACT}, {FOLD.removeprefix(ACT + ", ")}, {SNAP}, {ADJ}, {DEG}, {TRI}, {TRUSS}, nt as (select node, max(truss) tr from (select unnest([a, b]) node, truss from te) group by node),
st as (select node, arg_max(ema, n) ema, arg_max(x - px, n) dl, arg_max(sd, n) sd, arg_max(mc, n) mc from (select *, coalesce(lag(x) over (partition by node order by i), x) px, sqrt(greatest(sq - ema * ema, 0)) sd from f) group by node),
ASK, near as (select u, v, m w from ask join adj on n = v where m <> u), tw as (select distinct q.u, y.m w from (select distinct u from ask) q join adj x on x.n = q.u join adj y on y.n = x.m where y.m <> q.u),
fl as (select near.*, a.n is not null dr, tw.u is not null tt, d, tr, ema, dl, sd, mc from near left join adj a on a.n = near.u and a.m = near.w left join tw on tw.u = near.u and tw.w = near.w
  join deg on deg.node = near.w left join nt on nt.node = near.w left join st on st.node = near.w),
ag as (select u, v, count(*) filter (dr) n, sum(case when dr and d > 1 then 1 / ln(d) else 0 end) aa, sum(case when dr then 1.0::double / d else 0 end) ra, sum(case when dr then d else 0 end)::double xs, max(case when dr then d else 0 end)::double xm,
  sum(case when dr then coalesce(tr, 0) else 0 end)::double ts, count(*) filter (tt and not dr) n2, sum(case when tt and not dr and d > 1 then 1 / ln(d) else 0 end) aa2, sum(case when tt and not dr then d else 0 end)::double xs2,
  sum(case when dr then round(coalesce(ema, 0), 6) else 0 end::decimal(28, 6))::double e1, sum(case when dr then round(coalesce(dl, 0), 6) else 0 end::decimal(28, 6))::double d1, count(*) filter (dr and dl > 0) p1, count(*) filter (dr and dl < 0) m1,
  sum(case when dr then round(coalesce(sd, 0), 6) else 0 end::decimal(28, 6))::double s1, sum(case when dr then round(coalesce(mc, 0), 6) else 0 end::decimal(28, 6))::double x1,
  sum(case when tt and not dr then round(coalesce(ema, 0), 6) else 0 end::decimal(28, 6))::double e2, sum(case when tt and not dr then round(coalesce(dl, 0), 6) else 0 end::decimal(28, 6))::double d2, count(*) filter (tt and not dr and dl > 0) p2 from fl group by u, v),
pf as (select ask.u, ask.v, round(ln(1 + coalesce(n, 0)), 6) cn, round(coalesce(aa, 0), 6) aa, round(coalesce(ra, 0), 6) ra, round(coalesce(n / nullif(coalesce(du.d, 0) + coalesce(dv.d, 0) - n, 0)::double, 0), 6) jaccard,
  round(ln(1 + (coalesce(du.d, 0) * coalesce(dv.d, 0))::double), 6) pa, round(ln(1 + coalesce(n2, 0)), 6) cn2, round(coalesce(aa2, 0), 6) aa2, round(ln(1 + coalesce(xs, 0)), 6) cn_x_sum, coalesce(xm, 0) cn_x_max, round(coalesce(xs / nullif(n, 0), 0), 6) cn_x_mean,
  round(ln(1 + coalesce(ts, 0)), 6) cn_truss_sum, round(ln(1 + coalesce(xs2, 0)), 6) cn2_x_sum, round(coalesce(xs2 / nullif(n2, 0), 0), 6) cn2_x_mean, coalesce(du.d, 0)::double x_u, coalesce(dv.d, 0)::double x_v, least(coalesce(du.d, 0), coalesce(dv.d, 0))::double x_min, abs(coalesce(du.d, 0) - coalesce(dv.d, 0))::double x_gap,
  coalesce(e1, 0) cn_x_ema_sum, coalesce(d1, 0) cn_x_delta_sum, round(ln(1 + coalesce(p1, 0)), 6) cn_x_dpos, round(ln(1 + coalesce(m1, 0)), 6) cn_x_dneg, coalesce(s1, 0) cn_x_std_sum, coalesce(x1, 0) cn_x_mxch_sum, coalesce(e2, 0) cn2_x_ema_sum, coalesce(d2, 0) cn2_x_delta_sum, round(ln(1 + coalesce(p2, 0)), 6) cn2_x_dpos,
  round(coalesce(su.ema, 0), 6) u_x_ema, round(coalesce(su.dl, 0), 6) u_x_delta, round(coalesce(sv.ema, 0), 6) v_x_ema, round(coalesce(sv.dl, 0), 6) v_x_delta
  from ask left join ag using (u, v) left join deg du on du.node = ask.u left join deg dv on dv.node = ask.v left join st su on su.node = ask.u left join st sv on sv.node = ask.v)"""


def all_features(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, v) and all 30 features of the asked pairs, rounded; x is the degree."""
    ab = G.cut(G.pairs(edges))
    out = P.pair_features(asked, ab, G.degree(ab).withColumnRenamed("degree", "x"), truss=G.node_truss(ab), stats=_last_stats(edges))
    exact = [c for c in P.DYNAMIC if c.endswith("_sum")]
    return P.project(out, "all").select("u", "v", *[(F.col(c) if c in exact else F.round(c, 6) + 0.0).alias(c) for c in P.columns_of("all")])


@query(with_("uni", ALL.replace("ASK,", ASKED + ","), recursive=True) + "select * from pf")
def pair_all(spark, sf_dir: str) -> DataFrame:
    """The 30 features of every distinct pair."""
    e = E.uni(spark, sf_dir)
    return all_features(_asked(e), e)


@query(GENERIC + "select u, v, bn bridge, bx bridge_x from f")
def bridge_2hop(spark, sf_dir: str) -> DataFrame:
    e = E.uni(spark, sf_dir)
    ab = G.cut(G.pairs(e))
    out = B.pair_counts(_asked(e), ab, G.degree(ab).withColumnRenamed("degree", "value"))
    return out.select("u", "v", F.col("bridge").cast("double").alias("bridge"), F.col("bridge_value").cast("double").alias("bridge_x"))


@query(with_("uni", PAIRS, CORE, recursive=True) + "select ask.u, ask.v, coalesce(s, 0)::double bridge_core from ask left join (select u, v, sum(core) s from brw join core on node = w group by u, v) using (u, v)")
def bridge_core(spark, sf_dir: str) -> DataFrame:
    e = E.uni(spark, sf_dir)
    ab = G.cut(G.pairs(e))
    out = B.pair_counts(_asked(e), ab, G.k_core(ab).withColumnRenamed("core", "value"))
    return out.select("u", "v", F.col("bridge_value").cast("double").alias("bridge_core"))


@query("select event_id, round(sign(value - 50) * ln(1 + abs(value - 50) / 10.0) * 10.0, 6) clipped from events")
def feature_clip(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(P.clip(F.col("value") - 50, 10.0), 6).alias("clipped"))
