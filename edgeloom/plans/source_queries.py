"""Raw files of every layout, written from the event table and read back, label and node tables, sinks and samplers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.tables import register_tables
from ..operators import decoder as D
from ..operators import graph as G
from ..operators import history as H
from ..operators import indicators as I
from ..operators import negatives as N
from ..operators import pairwise as P
from ..operators import rolling as R
from ..operators import splits as S
from ..operators import stats as T
from ..session import shared_folder
from ..sources import edges as E
from ..sources import files as L
from ..sources import layouts as Y
from ..streaming import jobs as J
from .graph_queries import ACT, DAY, FOLD, SPLIT, _activity, _window_sql
from .history_queries import LAST, POOL, TREE, _list, _text
from .registry import EVENTS, INTER, SNAP, query, with_


def _raw(spark: SparkSession, rows: DataFrame, *columns: str) -> str:
    """A folder of CSV files with a header each: expressions over a stream, in its order."""
    path = shared_folder(spark, "raw")
    rows.orderBy("seq").select(*[F.expr(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]).write.option("header", True).csv(path)
    return path


def _firsts(name: str, column: str, table: str = "e") -> str:
    """A table of dense ids by first appearance."""
    return f"{name} as (select {column} raw, row_number() over (order by min(seq)) - 1 id from {table} group by {column})"


JOINT = "ends as (select seq * 2 seq, 'n' || u x from e union all select seq * 2 + 1, 'n' || v from e), " + _firsts("ids", "x", "ends")
APART = _firsts("us", "u") + ", " + _firsts("vs", "v")


def _apart(offset: int, more: str) -> str:
    return with_("uni", APART) + f"select e.seq, us.id + {offset} u, vs.id v, (t // 1000000)::double t, {more} from e join us on us.raw = e.u join vs on vs.raw = e.v"


def _joint(more: str, t: str = "(t // 1000000)::double") -> str:
    return with_("uni", JOINT) + f"select e.seq, a.id u, b.id v, {t} t, {more} from e join ids a on a.raw = 'n' || e.u join ids b on b.raw = 'n' || e.v"


SECONDS = "t div 1000000"


def _messages(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("seq", "u", "v", "t", "w", *[F.get("msg", F.lit(i)).alias(f"m{i}") for i in range(n)])


@query(with_("uni") + "select seq, u, v + (select max(u) from e) + 1 v, t::double t, (eid % 2)::double as \"label\", w m0, 1.0::double w from e")
def load_interactions(spark, sf_dir: str) -> DataFrame:
    """Source, destination, time, label and features; destinations behind the sources."""
    path = _raw(spark, E.uni(spark, sf_dir), "u", "v", "t", "eid % 2", "w")
    return L.load(spark, "bipartite", path).select("seq", "u", "v", "t", "label", F.get("msg", F.lit(0)).alias("m0"), "w")


@query(with_("uni") + "select row_number() over (order by seq) seq, u, v, t::double t from e where eid % 10 <> 3")
def load_malformed(spark, sf_dir: str) -> DataFrame:
    """Rows that have no number where one must be are left out."""
    path = _raw(spark, E.uni(spark, sf_dir), "if(eid % 10 = 3, 'x', cast(u as string))", "v", "t")
    return L.read_interactions(spark, path, label=None).select("seq", "u", "v", "t")


@query(_joint("w, w m0"))
def load_trade(spark, sf_dir: str) -> DataFrame:
    return _messages(L.load(spark, "trade", _raw(spark, E.uni(spark, sf_dir), SECONDS, "concat('n', u)", "concat('n', v)", "w")), 1)


@query(_apart(1001, "w, w m0, (eid % 2)::double m1"))
def load_token(spark, sf_dir: str) -> DataFrame:
    return _messages(L.load(spark, "token", _raw(spark, E.uni(spark, sf_dir), SECONDS, "concat('u', u)", "concat('k', v)", "w", "eid % 2")), 2)


@query(_apart(2221, "(eid % 50)::double w, (eid % 50)::double m0"))
def load_subreddit(spark, sf_dir: str) -> DataFrame:
    return _messages(L.load(spark, "subreddit", _raw(spark, E.uni(spark, sf_dir), SECONDS, "concat('u', u)", "concat('k', v)", "eid", "eid % 50")), 1)


@query(_apart(514, "w, w m0"))
def load_datetime(spark, sf_dir: str) -> DataFrame:
    return _messages(L.load(spark, "datetime", _raw(spark, E.uni(spark, sf_dir), SECONDS, "concat('u', u)", "concat('k', v)", "w")), 1)


@query(_joint("(eid % 7)::double w, (eid % 900) / 5000.0::double m0, (eid % 900) / 5000.0::double m1"))
def load_comment(spark, sf_dir: str) -> DataFrame:
    return _messages(L.load(spark, "comment", _raw(spark, E.uni(spark, sf_dir), SECONDS, "concat('n', u)", "concat('n', v)", "eid % 900", "eid % 7")), 2)


@query(_joint("round(log2(case when eid % 5 = 0 then 1 else w end), 9) w, 0::double m0"))
def load_coin(spark, sf_dir: str) -> DataFrame:
    rows = _messages(L.load(spark, "coin", _raw(spark, E.uni(spark, sf_dir), SECONDS, "concat('n', u)", "concat('n', v)", "if(eid % 5 = 0, 0, w)")), 1)
    # The reader takes a weight of 0 for none and counts it 1, as is right for every fifth event; an event's own 0 has the logarithm that the SQL gives it.
    own = E.uni(spark, sf_dir).filter("eid % 5 <> 0 and w = 0").select("seq", F.lit(float("-inf")).alias("_w"))
    # Digits are rounded as in SQL, by whole billionths: F.round goes by decimals and may differ where the tenth digit is a 5.
    return rows.join(own, "seq", "left").withColumn("w", F.coalesce("_w", F.round(F.col("w") * 1e9) / 1e9)).drop("_w")


CODE = "case when c between '0' and '9' then c::int when c = '!' then -1 else ascii(upper(c)) - 35 end"


@query(_joint(f"1.0::double w, array_to_string(list_transform(string_split(rpad('ab' || (eid % 1000), 8, '!') || rpad(case when eid % 3 = 0 then '' else 'B7' || (eid % 9) end, 8, '!'), ''), lambda c: {CODE}), ',') codes", "(t // 86400000000 * 86400)::double"))
def load_flight(spark, sf_dir: str) -> DataFrame:
    """Dates for times, and the letters of call sign and type as codes."""
    path = _raw(spark, E.uni(spark, sf_dir), "date_from_unix_date(cast(t div 86400000000 as int))", "concat('n', u)", "concat('n', v)", "concat('ab', eid % 1000)", "if(eid % 3 = 0, '', concat('B7', eid % 9))")
    rows = L.load(spark, "flight", path)
    return rows.select("seq", "u", "v", "t", "w", F.array_join(F.transform("msg", lambda x: x.cast("int").cast("string")), ",").alias("codes"))


# -- label and node tables ----------------------------------------------------------------

LABELS = "select day, u, unnest(v) v, w"


def _daily(spark, sf_dir: str) -> DataFrame:
    return E.uni(spark, sf_dir).withColumn("day", F.floor(F.col("t") / DAY).cast("long"))


@query(with_("uni") + f"select t // {DAY} \"day\", u, v, arg_max(w, seq) w from e group by all")
def label_vectors(spark, sf_dir: str) -> DataFrame:
    """Each user's weights of the day by item; the last of equal items wins."""
    rows = _daily(spark, sf_dir).select(F.col("seq").alias("pos"), F.col("day").alias("t"), "u", "v", "w")
    return L.label_vectors(rows).select(F.col("t").alias("day"), "u", F.explode("labels").alias("v", "w"))


@query(with_("uni", _firsts("us", "u", "(select * from e where u % 3 <> 0)"), _firsts("vs", "v")) + f"select t // {DAY} \"day\", us.id u, vs.id v, arg_max(w, seq) w from e join us on us.raw = u join vs on vs.raw = v group by all")
def label_vectors_coded(spark, sf_dir: str) -> DataFrame:
    """The same for names with ids; a third of the users have none and are left out."""
    rows = _daily(spark, sf_dir).select(F.col("seq").alias("pos"), F.col("day").alias("t"), F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v"), "w")
    users, items = S.first_seen_ids(rows.filter(F.col("u").cast("long") % 3 != 0), "pos", ["u"]), S.first_seen_ids(rows, "pos", ["v"])
    return L.coded_label_vectors(rows, users, items).select(F.col("t").alias("day"), "u", F.explode("labels").alias("v", "w"))


@query(with_("uni") + f""", r as (select seq, t // {DAY} d, u, v, w, lag(t // {DAY}) over (order by seq) pd, lag(u) over (order by seq) pn from e),
f as (select *, coalesce(d <> pd, false) dc, coalesce(d <> pd, false) or coalesce(u <> pn, false) ends from r), g as (select *, (sum(ends::int) over (order by seq))::bigint run from f),
h as (select run - ends::int run, v, arg_max(w, seq) w from g where not dc group by all), n as (select run, count(*) n, round(sum(w), 4) total from h group by run)
select g.run, d as "day", u, coalesce(n, 0) n, coalesce(total, 0) total from g left join n using (run) where (ends or seq = 1) and g.run < (select max(run) from g)""")
def label_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of a day and user with their items' weights."""
    rows = _daily(spark, sf_dir).select("seq", F.col("day").alias("t"), F.col("u").alias("node"), F.col("v").alias("label"), "w")
    total = F.aggregate(F.map_values("labels"), F.lit(0.0), lambda a, x: a + x)
    return L.run_length_labels(rows).select("run", F.col("t").alias("day"), F.col("node").alias("u"), F.size("labels").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query(f"""with c as (select c_custkey k, c_mktsegment a, 'c' || (c_nationkey % 5) b, substr(c_name, 9, 5) r, c_acctbal x, c_nationkey y from customer),
ka as (select a, row_number() over (order by min(k)) - 1 i from c group by a), kb as (select b, row_number() over (order by min(k)) - 1 i from c group by b),
f as (select k node, list_concat(list_concat(list_transform(range((select count(*) from ka)), lambda j: (j = ka.i)::int::double), list_transform(range((select count(*) from kb)), lambda j: (j = kb.i)::int::double)),
  list_concat(list_transform(string_split(rpad(r, 8, '!'), ''), lambda c: ({CODE})::double), [x::double, y::double])) fs from c join ka using (a) join kb using (b))
select node, unnest(fs) x, generate_subscripts(fs, 1) - 1 i from f""")
def node_features(spark, sf_dir: str) -> DataFrame:
    """One-hot kinds, letters of the region and coordinates of every customer."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nodes = c.select(F.col("c_custkey").alias("p"), F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit("c"), F.col("c_nationkey") % 5).alias("continent"), F.substring("c_name", 9, 5).alias("region"), F.col("c_acctbal").alias("lon"), F.col("c_nationkey").alias("lat"))
    return L.node_features(nodes, "p").select("node", F.posexplode("features").alias("i", "x"))


COMMAS = "case c_nationkey % 3 when 0 then 'China, mainland' when 1 then 'Saint Helena, Ascension and Tristan da Cunha' else c_name end"


@query(f"select c_custkey, c_custkey || ',' || replace(replace({COMMAS}, 'China, mainland', 'China mainland'), 'Helena, Ascension', 'Helena Ascension') || ',' || c_nationkey line from customer")
def clean_rows(spark, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", L.clean_names(F.concat_ws(",", "c_custkey", F.expr(COMMAS), "c_nationkey")).alias("line"))


@query("select c_name raw, row_number() over (order by c_custkey) - 1 id from customer")
def genre_ids(spark, sf_dir: str) -> DataFrame:
    return L.genre_ids(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", "c_name")


# -- sinks --------------------------------------------------------------------------------


@query(with_("bip") + "select seq id, w x from e union all select 0, 0")
def processed_features(spark, sf_dir: str) -> DataFrame:
    """Edge features as they were written, with the row of zeros; an error unless the edges come back as they are."""
    e, path = E.bip(spark, sf_dir), shared_folder(spark, "processed")
    x = e.select(F.col("seq").alias("id"), F.array("w").alias("x"))
    L.write_processed(e, x, x.limit(0), path, 1)
    if L.differences(spark.read.parquet(f"{path}/edges"), e):
        raise ValueError("what was written is not what was read")
    return spark.read.parquet(f"{path}/edge_features").select("id", F.get("x", F.lit(0)).alias("x"))


@query(with_("bip") + "select seq, u + 1 u, v + 1 v, case when seq <= floor(0.70::double * n) then 'train' when seq <= floor(0.85::double * n) then 'val' else 'test' end split from (select *, count(*) over () n from e) where seq <= n - 100")
def prefix_load(spark, sf_dir: str) -> DataFrame:
    """All but the last hundred edges, in the splits of the whole stream."""
    e = S.positional_split(E.bip(spark, sf_dir))
    return L.prefix(e, max(0, e.count() - 100)).select("seq", "u", "v", "split")


@query(with_("bip", SPLIT, POOL) + "select seq, neg from sp, range(4) r(j) join pool on place = (seq * 7919 + j * 104729) % (select count(*) from pool) where split = 'test'")
def negatives_looked_up(spark, sf_dir: str) -> DataFrame:
    """Negatives of test edges, saved and looked up again; a test edge without any would be an error."""
    e = S.quantile_split(E.bip(spark, sf_dir))
    test = e.filter("split = 'test'").select("seq")
    path = shared_folder(spark, "negatives")
    L.save_negatives(N.draw(test, N.pool(e.select(F.col("v").alias("value"))), F.col("seq"), 4).select("seq", "neg"), path)
    return N.look_up(test, spark.read.parquet(path), ["seq"]).select("seq", "neg")


@query("select count(*)::varchar events, count(distinct user_id)::varchar users from events")
def run_record(spark, sf_dir: str) -> DataFrame:
    """The figures of a run as a line of JSON."""
    path = shared_folder(spark, "runs")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users")).first()
    L.append_record(spark, e.asDict(), path)
    return spark.read.schema("events string, users string").json(path)


# -- nodes, edges and statistics --------------------------------------------------------------


@query(with_("bip") + "select node, ((node * 7919) % 100003 % 2)::int \"half\" from (select u node from e union select v from e)")
def node_halves(spark, sf_dir: str) -> DataFrame:
    e = E.bip(spark, sf_dir)
    return S.halves(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())


@query(with_("uni", SNAP) + ", g as (select distinct least(u, v) a, greatest(u, v) b from (select user_id u, regexp_extract(props, '\"k\": *([0-9]+)', 1)::bigint v from events where event_type = 'error')) select ab.a, ab.b, g.a is not null removed from ab left join g on g.a = ab.a and g.b = ab.b")
def remove_edges(spark, sf_dir: str) -> DataFrame:
    """Which edges of the graph the errors name."""
    gone = E.events(spark, sf_dir).filter("event_type = 'error'").select("u", F.col("k").alias("v"))
    return G.remove_edges(G.pairs(E.uni(spark, sf_dir)), gone)


@query(with_("uni", ACT) + "select (count(distinct node) * 28)::bigint bytes from act")
def state_bytes(spark, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(R.state_bytes(R.rolling(_activity(spark, sf_dir)))).cast("long").alias("bytes"))


def _clip_sql(x: str) -> str:
    return f"round(sign({x}) * ln(1 + abs({x}) / 2.0) * 2.0, 6)"


@query(with_("uni", FOLD, recursive=True) + """, d as (select *, x - lag(x) over (partition by node order by i) dl from f), c as (select *, max(case when i = 1 or dl <> 0 then i end) over (partition by node order by i) l from d),
s as (select node, n, x "current", ema, sqrt(greatest(sq - ema * ema, 0)) std, coalesce(dl, 0) delta, mc max_change, ema - slow trend, ln(1 + (i - l)::double) recency from c), q as (select seq, v node from e),
j as (select q.seq, q.node, s.n, "current", ema, std, delta, max_change, trend, recency from q asof left join s on s.node = q.node and q.seq > s.n)
select seq, node, """ + ", ".join(f"{_clip_sql(f'coalesce({c}, 0)')} {c}" for c in ('"current"', "ema", "std", "delta", "max_change", "trend", "recency")) + " from j")
def node_features_all(spark, sf_dir: str) -> DataFrame:
    """All seven statistics of each interaction's destination before it, clipped; a node never seen has zeros."""
    asked = E.uni(spark, sf_dir).select("seq", F.col("v").alias("node"))
    out = R.as_of(asked, R.rolling(_activity(spark, sf_dir)), ["node"], "seq", "n", list(R.STATS))
    return out.select("seq", "node", *[F.round(P.clip(F.coalesce(c, F.lit(0.0)), 2.0), 6).alias(c) for c in R.STATS])


@query(with_("uni", recursive=True) + _window_sql(200).replace(f"max(t) - {7 * DAY} fl", "max(t) - (select floor(0.05::double * (max(t) - min(t)))::bigint from e) fl"))
def window_fraction(spark, sf_dir: str) -> DataFrame:
    """Stays of edges in a window of a twentieth of the whole time."""
    e = E.uni(spark, sf_dir)
    width = e.agg(F.floor(F.lit(0.05) * (F.max("t") - F.min("t"))).cast("long")).first()[0] or 0
    return G.window_validity(e, width)


@query("with o as (select o_orderkey k, o_orderdate d from orders) select k, case when k % 2 = 0 then epoch(d)::bigint else k end epoch from o")
def parse_epoch(spark, sf_dir: str) -> DataFrame:
    """Seconds from dates and from numbers."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate").cast("string")).otherwise(F.col("o_orderkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("k"), scalar.parse_epoch(text).alias("epoch"))


KINDS = ("click", "error", "purchase", "view")


@query("select event_id, " + ", ".join(f"(event_type = '{k}')::int::double {k}" for k in KINDS) + " from events")
def one_hot(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", *[F.get(scalar.one_hot(F.col("event_type"), list(KINDS)), F.lit(i)).alias(k) for i, k in enumerate(KINDS)])


SHAPES = """select '{0}' as name, count(*) edges, (select count(*) from (select u x from {0} union select v from {0})) nodes from {0}"""


@query(f"with {EVENTS}, bip as (select u, 1000000 + k v from ev), uni as (select u, k v from ev), trade as (select o_custkey u, 10000000 + l_partkey v from orders join lineitem on o_orderkey = l_orderkey) " + " union all ".join(SHAPES.format(n) for n in ("bip", "uni", "trade")))
def table_shapes(spark, sf_dir: str) -> DataFrame:
    return T.table_shapes({f.__name__: f(spark, sf_dir) for f in (E.bip, E.uni, E.trade)})


@query(with_("bip") + "select count(*) edges, min(u) least_u, max(u) most_u, min(v) least_v, max(v) most_v from e")
def count_assertions(spark, sf_dir: str) -> DataFrame:
    """Figures of the stream, checked against those of the table it comes from; a difference is an error."""
    raw = E.events(spark, sf_dir).agg(F.count("*").alias("n"), F.min("u").alias("a"), F.max("u").alias("b"), (F.min("k") + E.ITEM_BASE).alias("c"), (F.max("k") + E.ITEM_BASE).alias("d")).first()
    e = E.bip(spark, sf_dir)
    T.expect(e, edges=raw.n, min_u=raw.a, max_u=raw.b, min_v=raw.c, max_v=raw.d)
    return e.agg(F.count("*").alias("edges"), *[f(c).alias(f"{n}_{c}") for c in ("u", "v") for n, f in (("least", F.min), ("most", F.max))])


# -- histories and samplers -----------------------------------------------------------------

PADDED = "list_concat(list_resize(null::bigint[], 0), list_transform(range(5 - coalesce(len(nb), 0)), lambda i: 0::bigint), coalesce(nb, []))"


@query(with_("bip", INTER, LAST.format(k=5)) + """, p as (select node, seq, list_concat(list_transform(range(5 - coalesce(len(nb), 0)), lambda i: 0::bigint), coalesce(nb, [])) ids from h)
select node, seq, array_to_string(list_transform(ids, lambda i: case when i = 0 then 0 else i + 7 end), ',') masked from p""")
def masked_history(spark, sf_dir: str) -> DataFrame:
    """Values beside padding are 0."""
    h = H.last_k(E.bip(spark, sf_dir), 5).withColumn("ids", H.pad_left(F.col("hist.nbr"), 5))
    values = F.transform("ids", lambda i: (i + 7).cast("double"))
    return h.select("node", "seq", _text(F.transform(H.mask_padding(values, F.col("ids")), lambda x: x.cast("long"))).alias("masked"))


@query(with_("bip", INTER) + """, l as (select node, nbr, seq from (select distinct node, nbr, seq from it) qualify row_number() over (partition by node order by seq desc, nbr) <= 10),
d as (select x, row_number() over (order by x) - 1 id from (select node x from l union select nbr from l)) select l.*, id as "local" from l join d on d.x = l.node""")
def last_edges_local(spark, sf_dir: str) -> DataFrame:
    """Last interactions, an edge once, with nodes numbered among those that occur."""
    return H.last_edges(E.bip(spark, sf_dir), 10)


@query(with_("bip") + """, nodes as (select distinct v node from e where seq > (select count(*) - 50 from e)), s as (select * from e where v in (select node from nodes)),
z as (select (select count(*) from nodes) * 100 / (select count(*) from s)::double share) select seq, u, v from s, z where (seq * 7919) % 1000003 < share * 1000003""")
def biased_loader(spark, sf_dir: str) -> DataFrame:
    """Edges at the latest items, about a hundred times as many as there are such items."""
    e = E.bip(spark, sf_dir)
    top = e.agg(F.max("seq").alias("n"))
    nodes = e.join(F.broadcast(top)).filter(F.col("seq") > F.col("n") - 50).select(F.col("v").alias("node")).distinct()
    return H.biased_sample(e, nodes, 100).select("seq", "u", "v")


@query(with_("bip", INTER, TREE) + """ select root, seq, node::varchar walk from c1
union all select c2.root, c2.seq, c1.node || '-' || c2.node from c2 join c1 on c1.root = c2.root and c1.seq = c2.seq and c1.slot = c2.slot // 3""")
def tree_walks(spark, sf_dir: str) -> DataFrame:
    """The walks of the two-hop tree."""
    walks = H.multi_hop(E.bip(spark, sf_dir), 3, 2)
    return walks.select("root", "seq", F.array_join(F.transform("walk", lambda x: x["nbr"].cast("string")), "-").alias("walk"))


@query(with_("bip", INTER, LAST.format(k=8)) + """, x as (select u node, avg(w) x from e group by u union all select v, avg(w) from e group by v), o as (select node, seq, unnest(nb) nbr from h),
p as (select o.node, seq, sum(coalesce(x, 0)) / count(*) / 8 pool from o left join x on x.node = nbr group by o.node, seq)
select h.node, h.seq, round(coalesce(pool, 0) + coalesce(x, 0), 5) pooled from h left join p using (node, seq) left join x on x.node = h.node""")
def time_gap_pool(spark, sf_dir: str) -> DataFrame:
    """Mean features of the last eight neighbours over eight, and the node's own."""
    e = E.bip(spark, sf_dir)
    x = e.groupBy(F.col("u").alias("node")).agg(F.avg("w").alias("x")).union(e.groupBy("v").agg(F.avg("w")))
    return H.recent_pool(e, x, 8).withColumn("pooled", F.round("pooled", 5))


# -- adjacency entries ------------------------------------------------------------------------

ENTRIES = "en as (select a as \"row\", b as \"col\" from ab union all select b, a from ab)"


def _entries(spark, sf_dir: str) -> DataFrame:
    return G.adjacency(G.pairs(E.uni(spark, sf_dir))).withColumnsRenamed({"n": "row", "m": "col"})


@query(with_("uni", SNAP, ENTRIES) + "select \"row\", \"col\", (\"row\" << 32) + \"col\" packed from en")
def packed_entries(spark, sf_dir: str) -> DataFrame:
    """Entries as one number each, and back."""
    row, col = D.unpack(F.col("packed"))
    return _entries(spark, sf_dir).select(D.pack(F.col("row"), F.col("col")).alias("packed")).select(row.alias("row"), col.alias("col"), "packed")


@query(with_("uni", SNAP, ENTRIES) + """, pl as (select *, row_number() over (partition by "row" order by "col") - 1 place from en), sz as (select "row", count(*) size from en group by 1),
dr as (select "row", size, ("row" * 7919 + j * 104729) % size place from sz, range(6) r(j) where size > 6)
select "row", "col", round(count(*) * size / 6.0, 6) weight from dr join pl using ("row", place) group by "row", "col", size union all select "row", "col", 1.0 from pl join sz using ("row") where size <= 6""")
def sampled_entries(spark, sf_dir: str) -> DataFrame:
    """Six draws from each long row, weighed by how often they came; short rows whole."""
    return D.sample_rows(_entries(spark, sf_dir), 6, keep_short=True).withColumn("weight", F.round("weight", 6))


@query(with_("uni", SNAP, ENTRIES) + "select \"row\", \"col\", round(1 / (1 - 0.3::double), 6) weight from en where (\"row\" * 7919 + \"col\" * 104729) % 1000003 >= 300000")
def dropped_entries(spark, sf_dir: str) -> DataFrame:
    return D.drop_edges(_entries(spark, sf_dir), 0.3).withColumn("weight", F.round("weight", 6))


@query(with_("uni", SNAP) + """, adj as (select a n, b m from ab union all select b, a from ab), ask as (select distinct u, v from e where u <> v),
k as (select u, v, '11' kind, count(*) n from ask join adj x on x.n = u join adj y on y.n = v and y.m = x.m group by u, v)
select * from k union all select u, v, '01', 1 from ask union all select u, v, '10', 1 from ask""")
def decoder_ends(spark, sf_dir: str) -> DataFrame:
    """How many nodes a decoder sums for each pair: common neighbours, and the ends of linked pairs."""
    e = E.uni(spark, sf_dir)
    asked = e.filter("u <> v").select("u", "v").distinct()
    return D.near_pairs(asked, G.pairs(e), 0).groupBy("u", "v", "kind").agg(F.count("*").alias("n"))


# -- SQL and state ----------------------------------------------------------------------------


@query(with_("uni", FOLD, recursive=True) + "select node, n, ema, sqrt(greatest(sq - ema * ema, 0)) std, mc max_change from f")
def sql_rolling_stats(spark, sf_dir: str) -> DataFrame:
    """Statistics by a table function in SQL."""
    register_tables(spark)
    _activity(spark, sf_dir).createOrReplaceTempView("activity_ticks")
    return spark.sql("SELECT node, n, ema, std, max_change FROM rolling_stats(TABLE(activity_ticks) PARTITION BY node ORDER BY n)")


@query(with_("bip", INTER, LAST.format(k=5)) + "select node, seq, unnest(nb) nbr, generate_subscripts(nb, 1) slot from h")
def sql_history_slots(spark, sf_dir: str) -> DataFrame:
    """The last five neighbours before each interaction by a table function in SQL."""
    register_tables(spark)
    H.interactions(E.bip(spark, sf_dir)).createOrReplaceTempView("interaction_rows")
    return spark.sql("SELECT node, seq, slot, nbr FROM history_slots(5, TABLE(SELECT node, seq, nbr FROM interaction_rows) PARTITION BY node ORDER BY seq)")


@query(with_("uni", FOLD, recursive=True) + "select node, arg_max(ema, n) ema, arg_max(mc, n) max_change from f group by node")
def sql_array_folds(spark, sf_dir: str) -> DataFrame:
    """Each node's last statistics by SQL functions over its values in order."""
    register_tables(spark)
    _activity(spark, sf_dir).createOrReplaceTempView("activity_ticks")
    return spark.sql("""SELECT node, ema_of(xs, 0.95D) ema, max_change_of(xs, 0.95D) max_change FROM
      (SELECT node, transform(array_sort(collect_list(struct(n, value))), x -> x.value) xs FROM activity_ticks GROUP BY node)""")


@query(f"with {EVENTS} select u, k, count(*) n, max(t) last_t from ev group by u, k")
def stream_state(spark, sf_dir: str) -> DataFrame:
    """The edge memory as Spark's state store holds it after the stream."""
    folder = shared_folder(spark, "stream")
    J.drain(J.edge_memory(J.read_events(spark, sf_dir)), ["u", "k"], folder)
    state = J.read_state(spark, folder)
    return state.select("key.u", "key.k", F.col("value.count").alias("n"), F.col("value.max").alias("last_t"))
