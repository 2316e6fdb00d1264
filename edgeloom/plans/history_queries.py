"""Histories, slots, negatives and memory scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import log2_weight, pad_code
from ..operators import blocks as B
from ..operators import graph as G
from ..operators import history as H
from ..operators import memory as M
from ..operators import pairwise as P
from ..operators import negatives as N
from ..operators import splits as S
from ..sources import edges as E
from .graph_queries import ALL, CORE, SPLIT, all_features
from .registry import ADJ, DEG, INTER, SNAP, query, with_


def _text(values):
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


LAST = "h as (select node, nbr, seq, t, list(nbr) over w nb, list(t) over w ts, list(seq) over w sq from it window w as (partition by node order by seq rows between {k} preceding and 1 preceding))"


def _list(x: str) -> str:
    return f"coalesce(array_to_string({x}, ','), '')"


@query(with_("bip", INTER, LAST.format(k=10)) + f"select node, seq, {_list('nb')} nbrs, {_list('sq')} seqs from h")
def hist_last_k(spark, sf_dir: str) -> DataFrame:
    h = H.last_k(E.bip(spark, sf_dir), 10)
    return h.select("node", "seq", _text(F.col("hist.nbr")).alias("nbrs"), _text(F.col("hist.seq")).alias("seqs"))


@query(with_("uni", INTER, LAST.format(k="unbounded")) + "select node, seq, coalesce(len(nb), 0)::bigint n, coalesce(list_sum(nb), 0)::bigint total, nb[1] oldest from h")
def hist_all(spark, sf_dir: str) -> DataFrame:
    return H.whole_past(E.uni(spark, sf_dir)).select("node", "seq", "n", "total", "oldest")


@query(with_("bip", INTER, LAST.format(k=3)) + """, one as (select node, seq, unnest(nb) n1, unnest(sq) s1 from h),
two as (select one.node, one.seq, n1, s1, h.nb n2 from one join h on h.node = one.n1 and h.seq = one.s1)
select node, seq, n1, s1, coalesce(array_to_string(n2, ','), '') n2 from two""")
def hist_multihop(spark, sf_dir: str) -> DataFrame:
    """The last three neighbours, and each one's last three before that interaction."""
    h = H.last_k(E.bip(spark, sf_dir), 3)
    one = h.select("node", "seq", F.explode("hist").alias("x")).select("node", "seq", F.col("x.nbr").alias("n1"), F.col("x.seq").alias("s1"))
    two = h.select(F.col("node").alias("n1"), F.col("seq").alias("s1"), _text(F.col("hist.nbr")).alias("n2"))
    return one.join(two, ["n1", "s1"]).select("node", "seq", "n1", "s1", "n2")


@query(with_("bip", INTER, LAST.format(k=7)) + """, p as (select node, seq, list_concat([node], coalesce(nb, [])) a from h)
select node, seq, array_to_string(list_concat(a, list_transform(range((-len(a)) % 4 + case when len(a) % 4 = 0 then 0 else 4 end), lambda i: 0)), ',') padded from p""")
def hist_padded(spark, sf_dir: str) -> DataFrame:
    h = H.last_k(E.bip(spark, sf_dir), 7)
    return h.select("node", "seq", _text(H.pad_sequence(F.col("node"), F.col("hist.nbr"), 8, 4)).alias("padded"))


COOC = LAST.format(k=10) + ", s as (select e.seq, a.nb x, b.nb y from e join h a on a.node = u and a.seq = e.seq join h b on b.node = v and b.seq = e.seq where u <> v)"


def _two_sides(edges: DataFrame, k: int) -> DataFrame:
    """(seq, x, y): both ends' neighbour histories at each interaction."""
    h = H.last_k(edges.filter("u <> v"), k)
    own = h.select("seq", "node", F.col("hist.nbr").alias("nb"))
    e = edges.filter("u <> v").select("seq", "u", "v")
    return e.join(own.withColumnsRenamed({"node": "u", "nb": "x"}), ["seq", "u"]).join(own.withColumnsRenamed({"node": "v", "nb": "y"}), ["seq", "v"])


@query(with_("uni", INTER.replace("from e", "from e where u <> v"), COOC) + """select seq, coalesce(array_to_string(list_transform(x, lambda i: case when i = 0 then 0 else len(list_filter(x, lambda j: j = i)) end), ','), '') own,
coalesce(array_to_string(list_transform(x, lambda i: case when i = 0 then 0 else len(list_filter(coalesce(y, []), lambda j: j = i)) end), ','), '') peer from s""")
def cooccurrence(spark, sf_dir: str) -> DataFrame:
    s = _two_sides(E.uni(spark, sf_dir), 10)
    return s.select("seq", _text(H.counts_in(F.col("x"), F.col("x"))).alias("own"), _text(H.counts_in(F.col("x"), F.col("y"))).alias("peer")).select("seq", "own", "peer")


@query(with_("bip", INTER, LAST.format(k=5)) + f"select node, seq, {_list('list_transform(ts, lambda x: t - x)')} deltas from h")
def time_delta(spark, sf_dir: str) -> DataFrame:
    h = H.last_k(E.bip(spark, sf_dir), 5)
    return h.select("node", "seq", _text(F.transform("hist.t", lambda x: F.col("t") - x)).alias("deltas"))


@query(with_("bip") + """, g as (select 'src' side, (t - coalesce(lag(t) over (partition by u order by seq), 0)) / 1000000.0 gap from e union all
select 'dst', (t - coalesce(lag(t) over (partition by v order by seq), 0)) / 1000000.0 from e) select side, round(avg(gap), 2) mean, round(stddev_pop(gap), 2) std from g group by side""")
def time_shift_stats(spark, sf_dir: str) -> DataFrame:
    e = E.bip(spark, sf_dir)
    gap = lambda c: ((F.col("t") - F.coalesce(F.lag("t").over(W.partitionBy(c).orderBy("seq")), F.lit(0))) / 1_000_000.0).alias("gap")
    both = e.select(F.lit("src").alias("side"), gap("u")).union(e.select(F.lit("dst").alias("side"), gap("v")))
    return both.groupBy("side").agg(F.round(F.avg("gap"), 2).alias("mean"), F.round(F.stddev_pop("gap"), 2).alias("std"))


@query(with_("bip") + ", m as (select seq, (t - min(t) over ()) / 1000000.0 s from e) select seq, " + ", ".join(f"round(cos(s * pow(10.0, -9.0 * {i} / 3)), 6) c{i}" for i in range(4)) + " from m")
def time_encoding(spark, sf_dir: str) -> DataFrame:
    e = E.bip(spark, sf_dir)
    e = e.join(F.broadcast(e.agg(F.min("t").alias("t0")))).withColumn("enc", H.time_encoding((F.col("t") - F.col("t0")) / 1_000_000.0, 4))
    return e.select("seq", *[F.round(F.get("enc", F.lit(i)), 6).alias(f"c{i}") for i in range(4)])


@query(with_("bip", INTER, LAST.format(k="unbounded")) + "select node, seq, array_to_string(list_transform(range(5), lambda j: nb[((seq * 7919 + j * 104729) % len(nb))::int + 1]), ',') drawn from h where nb is not null")
def hist_uniform(spark, sf_dir: str) -> DataFrame:
    """Five draws with replacement from the whole history, by arithmetic on the position."""
    drawn = H.uniform_draws(E.bip(spark, sf_dir), 5).groupBy("node", "seq").agg(F.array_sort(F.collect_list(F.struct("j", "nbr"))).alias("d"))
    return drawn.select("node", "seq", _text(F.col("d.nbr")).alias("drawn"))


@query(with_("uni", INTER) + ", m as (select *, exp(1e-12::double * (t - max(t) over ())) x from it) select node, nbr, seq, round(x / sum(x) over (partition by node order by seq rows between unbounded preceding and current row), 6) p from m where nbr <> node")
def hist_time_aware_weights(spark, sf_dir: str) -> DataFrame:
    """Unnormalised sampling weight of each interaction: its decay over that of the prefix."""
    it = H.interactions(E.uni(spark, sf_dir)).filter("nbr <> node")
    top = H.interactions(E.uni(spark, sf_dir)).agg(F.max("t").alias("top"))
    x = F.exp(F.lit(1e-12) * (F.col("t") - F.col("top")))
    it = it.join(F.broadcast(top)).withColumn("x", x)
    run = F.sum("x").over(W.partitionBy("node").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    return it.select("node", "nbr", "seq", F.round(F.col("x") / run, 6).alias("p"))


@query(with_("uni", INTER.replace("from e", "from e where u <> v"), COOC) + """, o as (select seq, unnest(x) node, 'u' side, len(x) n from s union all select seq, unnest(y), 'v', len(y) from s)
select seq, node, round(sum(case when side = 'u' then 1.0::double / n else 0 end), 6) p_u, round(sum(case when side = 'v' then 1.0::double / n else 0 end), 6) p_v from o group by seq, node""")
def walk_landing(spark, sf_dir: str) -> DataFrame:
    """Chance of landing on each first-hop node from either end of an interaction."""
    s = _two_sides(E.uni(spark, sf_dir), 10)
    side = lambda c, name: s.select("seq", F.explode(c).alias("node"), F.lit(name).alias("side"), (F.lit(1.0) / F.size(c)).alias("p"))
    both = side("x", "u").union(side("y", "v"))
    part = lambda name: F.round(F.sum(F.when(F.col("side") == name, F.col("p")).otherwise(0.0)), 6)
    return both.groupBy("seq", "node").agg(part("u").alias("p_u"), part("v").alias("p_v"))


@query(with_("uni", INTER.replace("from e", "from e where u <> v"), COOC) + "select seq, coalesce(array_to_string(list_transform(x, lambda i: case when i = 0 then 0 else list_contains(coalesce(y, []), i)::int end), ','), '') flags from s")
def cooccurrence_flag(spark, sf_dir: str) -> DataFrame:
    """Is each entry of the source's history in the destination's?"""
    s = _two_sides(E.uni(spark, sf_dir), 10)
    return s.select("seq", _text(H.peer_flags(F.col("x"), F.col("y"))).alias("flags"))


@query(with_("bip", INTER) + "select node, nbr, seq from it qualify row_number() over (partition by node order by seq desc, nbr) <= 10")
def last_neighbor_loader(spark, sf_dir: str) -> DataFrame:
    return H.last_edges(E.bip(spark, sf_dir), 10).select("node", "nbr", "seq")


@query(with_("bip", INTER) + "select node, nbr, seq from it qualify row_number() over (partition by node order by (seq * 7919) % 1000003, seq, nbr) <= 10")
def random_neighbor_loader(spark, sf_dir: str) -> DataFrame:
    return H.hashed_sample(E.bip(spark, sf_dir), 10)


@query(with_("bip", INTER, recursive=True) + """, o as (select *, row_number() over (partition by node order by seq, nbr) i from it),
s as (select node, nbr, seq, t, i, 1::double near, 0::double "begin" from o where i = 1 union all
  select o.node, o.nbr, o.seq, o.t, o.i, 1 + s.near * exp(1e-11::double * (s.t - o.t)), s."begin" + exp(1 / s.near) from s join o on o.node = s.node and o.i = s.i + 1),
q as (select node, seq, j, ((seq * 7919 + j * 104729) % 1000003)::double / 1000003 * "begin" at_ from s, range(3) r(j) where "begin" > 0)
select q.node, q.seq, q.j::int j, s.nbr from q asof join s on s.node = q.node and q.at_ >= s."begin\"""")
def hist_time_aware_draws(spark, sf_dir: str) -> DataFrame:
    """Three draws from each interaction's past, by weights of recency."""
    return H.time_aware_draws(E.bip(spark, sf_dir), 3, 1e-11)


TREE = LAST.format(k=3) + """, c1 as (select node root, seq, 1 hop, unnest(generate_series(0, len(nb) - 1)) slot, unnest(nb) node, unnest(sq) at_ from h where nb is not null),
c2 as (select root, c1.seq, 2 hop, slot * 3 + unnest(generate_series(0, len(nb) - 1)) slot, unnest(nb) node, unnest(sq) at_ from c1 join h on h.node = c1.node and h.seq = c1.at_ where nb is not null)"""


@query(with_("bip", INTER, TREE) + """, w as (select node root, seq, 0 hop, node from it union all select root, seq, hop, node from c1 union all select root, seq, hop, node from c2)
select seq, w.node, """ + ", ".join(f"round(sum(case when root = {s} and hop = {h} then 1 / pow(3.0, {h}) else 0 end), 6) {s}{h}" for s in "uv" for h in range(3)) + " from w join e using (seq) group by seq, w.node")
def walk_landing_tree(spark, sf_dir: str) -> DataFrame:
    """Landing probabilities of walks of up to two steps from both ends of each interaction."""
    found = H.landing(E.bip(spark, sf_dir), 3, 2)
    return found.select("seq", "node", *[F.round(F.get(s, F.lit(h)), 6).alias(f"{s}{h}") for s in "uv" for h in range(3)])


@query(with_("bip", INTER, TREE) + "select root, seq, hop::int hop, slot::bigint slot, node, at_ as \"at\" from c1 union all select root, seq, hop, slot, node, at_ from c2")
def history_tree(spark, sf_dir: str) -> DataFrame:
    """Every slot of the two-hop tree of each interaction's ends."""
    return H.trees(E.bip(spark, sf_dir), 3, 2)


# -- slots ------------------------------------------------------------------------------

SLOTS = f"{SNAP}, {ADJ}, {DEG}, {CORE}, {INTER}, {LAST.format(k=5)}, sl as (select e.seq, v peer, unnest(nb) n, generate_subscripts(nb, 1) slot from e join h on h.node = u and h.seq = e.seq)"


@query(with_("uni", SLOTS, recursive=True) + """, pr as (select distinct peer, n from sl),
c as (select peer, pr.n, count(*) cn, sum(core) cs from pr join adj a on a.n = peer join adj b on b.n = pr.n and b.m = a.m join core on core.node = a.m group by peer, pr.n)
select seq, slot::int slot, round(ln(1 + coalesce(cn, 0)), 6) cn, round(ln(1 + coalesce(cs, 0)), 6) cn_core, (exists (select 1 from adj where adj.n = sl.peer and adj.m = sl.n))::int direct,
case when p.node is null then 0 else round(ln(1 + coalesce(deg.d, 0)), 6) end deg, case when p.node is null then 0 else round(ln(1 + coalesce(core, 0)), 6) end core, round(ln(1 + coalesce(cn, 0)), 6) cn2_proxy
from sl left join c using (peer, n) left join deg on deg.node = sl.n left join core on core.node = sl.n left join deg p on p.node = sl.peer""")
def slot_fast(spark, sf_dir: str) -> DataFrame:
    """Six cheap features of every history slot against the interaction's peer; the last repeats the first.

    A slot whose node or peer has no neighbours is all zero.
    """
    e = E.uni(spark, sf_dir)
    ab = G.pairs(e)
    core, deg = G.k_core(ab), G.degree(ab)
    h = H.last_k(e, 5).select(F.col("node").alias("u"), "seq", F.col("hist.nbr").alias("nb")).distinct()
    slots = e.select("seq", "u", F.col("v").alias("peer")).join(h, ["u", "seq"]).select("seq", "peer", F.posexplode("nb").alias("slot", "n"))
    asked = slots.select(F.col("peer").alias("u"), F.col("n").alias("v")).distinct()
    planes, shared = B.Planes(core.withColumnRenamed("core", "value")), F.col("both")
    words = planes.join(B.shared_words(asked, ab)).groupBy(F.col("u").alias("peer"), F.col("v").alias("n"))
    cn = words.agg(F.sum(F.bit_count(shared)).alias("cn"), F.sum(planes.total(shared)).alias("cs"))
    direct = G.adjacency(ab).select(F.col("n").alias("peer"), F.col("m").alias("n"), F.lit(1).alias("direct"))
    out = slots.join(cn, ["peer", "n"], "left").join(direct, ["peer", "n"], "left").join(deg.withColumnRenamed("node", "n"), "n", "left").join(core.withColumnRenamed("node", "n"), "n", "left")
    out = out.join(deg.select(F.col("node").alias("peer"), F.lit(True).alias("known")), "peer", "left")
    log = lambda c: F.round(F.log1p(F.coalesce(c, F.lit(0)).cast("double")), 6)
    return out.select("seq", (F.col("slot") + 1).alias("slot"), log("cn").alias("cn"), log("cs").alias("cn_core"), F.coalesce("direct", F.lit(0)).alias("direct"), *[F.when(F.col("known"), log(c)).otherwise(0.0).alias(n) for c, n in (("degree", "deg"), ("core", "core"))], log("cn").alias("cn2_proxy"))


@query(with_("uni", SNAP, ADJ, DEG, INTER, LAST.format(k=5)) + """, sl as (select e.seq, v u, unnest(nb) v, generate_subscripts(nb, 1) slot from e join h on h.node = e.u and h.seq = e.seq),
pr as (select distinct u, v from sl), c as (select pr.u, pr.v, count(*) common from pr join adj a on a.n = pr.u join adj b on b.n = pr.v and b.m = a.m group by pr.u, pr.v)
select seq, slot::int slot, common from sl left join c using (u, v)""")
def slot_provider(spark, sf_dir: str) -> DataFrame:
    """A feature of every slot's pair by a function given from outside: common neighbours, null for none."""
    e = E.uni(spark, sf_dir)
    ab = G.cut(G.pairs(e))

    def common(pairs: DataFrame) -> DataFrame:
        return B.shared_words(pairs, ab).groupBy("u", "v").agg(F.sum(F.bit_count("both")).alias("common"))

    return H.slot_features(e, 5, common)


SLOTTED = f"{INTER}, {LAST.format(k=5)}, sl as (select e.seq, v peer, unnest(nb) n, generate_subscripts(nb, 1) slot from e join h on h.node = u and h.seq = e.seq), ask as (select distinct peer u, n v from sl)"


@query(with_("uni", ALL.replace("ASK,", SLOTTED + ","), recursive=True) + "select seq, slot::int slot, pf.* exclude (u, v) from sl join pf on pf.u = sl.peer and pf.v = sl.n")
def slot_full(spark, sf_dir: str) -> DataFrame:
    """All 30 features of every history slot with the interaction's peer as the source."""
    e = E.uni(spark, sf_dir)
    h = H.last_k(e, 5).select(F.col("node").alias("u"), "seq", F.col("hist.nbr").alias("nb")).distinct()
    slots = G.cut(e.select("seq", "u", F.col("v").alias("peer")).join(h, ["u", "seq"]).select("seq", F.col("peer").alias("u"), F.posexplode("nb").alias("slot", "v")))
    feats = all_features(slots.select("u", "v"), e)
    return slots.join(feats, ["u", "v"]).withColumn("slot", F.col("slot") + 1).drop("u", "v")


# -- negatives --------------------------------------------------------------------------

POOL = "pool as (select v neg, row_number() over (order by v) - 1 place from (select distinct v from e))"


@query(with_("bip", SPLIT, POOL) + "select seq, j::int j, neg from sp, range(5) r(j) join pool on place = (seq * 7919 + j * 104729) % (select count(*) from pool) where split = 'train'")
def neg_train(spark, sf_dir: str) -> DataFrame:
    e = S.quantile_split(E.bip(spark, sf_dir))
    values = N.pool(e.select(F.col("v").alias("value")))
    return N.draw(e.filter("split = 'train'").select("seq"), values, F.col("seq"), 5).select("seq", "j", "neg")


def _known_sql(observed: str) -> str:
    """kn: edges first seen after ``observed``, numbered; bn: how many of them a batch knows; ow: those that it has itself."""
    return f"""b as (select seq, u, v, split, (seq - 1) // 200 batch from sp), fs as (select u, v, min(seq) at_ from e group by u, v having min(seq) > {observed}),
kn as (select *, row_number() over (order by at_) - 1 n0 from fs), bn as (select b0.batch, count(kn.n0) known from (select distinct batch from b) b0 left join kn on (kn.at_ - 1) // 200 < b0.batch group by b0.batch),
ow as (select distinct batch, n0 from b join kn using (u, v) join bn using (batch) where n0 < known),
pl as (select batch, known, coalesce(c, 0) own, known - coalesce(c, 0) "free" from bn left join (select batch, count(*) c from ow group by batch) using (batch))"""


TRAINED = "(select max(seq) from sp where split = 'train')"


@query(with_("bip", SPLIT, _known_sql("0")) + 'select batch, known, own, "free" from pl')
def neg_historical_pool(spark, sf_dir: str) -> DataFrame:
    """What each batch may draw: edges seen before it, without its own."""
    return N.past_of(S.quantile_split(E.bip(spark, sf_dir)), 200)[1]


@query(with_("bip", SPLIT, _known_sql(TRAINED)) + 'select batch, known, own, "free" from pl')
def neg_inductive_pool(spark, sf_dir: str) -> DataFrame:
    """As neg_historical_pool, among edges that training never saw."""
    e = S.quantile_split(E.bip(spark, sf_dir))
    return N.past_of(e, 200, _trained(e))[1]


def _trained(edges: DataFrame) -> int:
    return edges.filter("split = 'train'").agg(F.max("seq")).first()[0] or 0


TRIES = """tr as (select sp.seq, sp.t, sp.u, j, neg from sp, lateral (select unnest(range((select count(*) from pool))) j), pool
  where split = 'test' and place = (sp.seq * 7919 + j * 104729) % (select count(*) from pool) and not exists (select 1 from e x where x.t = sp.t and x.u = sp.u and x.v = neg))"""


@query(with_("bip", SPLIT, POOL, TRIES) + "select seq, neg from tr qualify row_number() over (partition by seq order by j) <= 20")
def neg_rnd(spark, sf_dir: str) -> DataFrame:
    """Up to 20 destinations per test edge, none of them true at the same time and source."""
    e = S.quantile_split(E.bip(spark, sf_dir))
    asked = e.filter("split = 'test'").select("seq", "t", "u", F.col("seq").alias("salt"), F.lit(20).alias("need"))
    true = e.select("t", "u", F.col("v").alias("neg"))
    return N.draw_free(asked, N.pool(e.select(F.col("v").alias("value"))), [(true, ["t", "u"])], ["seq"]).select("seq", "neg")


HIST = """th as (select *, row_number() over (partition by u order by neg) - 1 place from (select distinct u, v neg from sp where split = 'train')), ts as (select u, count(*) size from th group by u),
hq as (select sp.seq, sp.t, sp.u, size, coalesce(lost, 0) lost from sp join ts using (u) left join (select t, u, count(distinct v) lost from e group by t, u) l on l.t = sp.t and l.u = sp.u where split = 'test'),
hj as (select *, (seq * 7919 + j * case when size % 104729 <> 0 then 104729 when size % 7919 <> 0 then 7919 else 1 end) % size place from (select *, unnest(range(least(size, 5 + lost))) j from hq)),
hc as (select seq, neg, row_number() over (partition by seq order by j) r from hj join th using (u, place) where not exists (select 1 from e x where x.t = hj.t and x.u = hj.u and x.v = neg))"""


@query(with_("bip", SPLIT, POOL, TRIES, HIST) + """, hs as (select seq, count(*) n from hc where r <= 5 group by seq),
rs as (select tr.seq, neg, row_number() over (partition by tr.seq order by j) r from tr where not exists (select 1 from th where th.u = tr.u and th.neg = tr.neg))
select seq, neg, 'hist' kind from hc where r <= 5 union all select rs.seq, neg, 'rnd' from rs left join hs using (seq) where r <= 10 - coalesce(n, 0)""")
def neg_hist_rnd(spark, sf_dir: str) -> DataFrame:
    """Ten negatives per test edge: up to five of the source's training destinations, the rest drawn
    among destinations that the source never had in training."""
    e = S.quantile_split(E.bip(spark, sf_dir))
    past = e.filter("split = 'train'").select("u", F.col("v").alias("neg")).distinct()
    true = e.select("t", "u", F.col("v").alias("neg"))
    test = e.filter("split = 'test'").select("seq", "t", "u", F.col("seq").alias("salt"))
    hist = G.cut(N.own_past(test, past, true, 5))
    have = hist.groupBy("seq").agg(F.count("*").alias("have"))
    asked = test.join(have, "seq", "left").withColumn("need", (F.lit(10) - F.coalesce("have", F.lit(0))).cast("int")).drop("have")
    rest = N.draw_free(asked, N.pool(e.select(F.col("v").alias("value"))), [(true, ["t", "u"]), (past, ["u"])], ["seq"])
    return hist.withColumn("kind", F.lit("hist")).union(rest.select("seq", "neg", F.lit("rnd").alias("kind")))


SIDES = "su as (select value, row_number() over (order by value) - 1 place from (select distinct u as value from e)), tv as (select value, row_number() over (order by value) - 1 place from (select distinct v as value from e))"


@query(with_("bip", SPLIT, SIDES) + "select seq, su.value neg_u, tv.value neg_v from sp join su on su.place = seq * 7919 % (select count(*) from su) join tv on tv.place = seq * 104729 % (select count(*) from tv) where split = 'test'")
def neg_random_pair(spark, sf_dir: str) -> DataFrame:
    """A source and a destination for each test edge, drawn independently."""
    e = S.quantile_split(E.bip(spark, sf_dir))
    sides = [N.pool(e.select(F.col(c).alias("value"))) for c in ("u", "v")]
    return N.random_pairs(e.filter("split = 'test'").select("seq"), *sides, F.col("seq"))


@query(with_("bip", SPLIT, SIDES) + """, hd as (select distinct u, tv.place p from e join tv on tv.value = e.v), fu as (select u, count(*) c from hd group by u),
ab as (select *, row_number() over (order by u) - 1 place from (select su.value u, (select count(*) from tv) - coalesce(c, 0) "free" from su left join fu on fu.u = su.value) where "free" > 0),
qq as (select seq, ab.u, (seq * 104729 + seq // (select count(*) from ab) * 7919) % "free" nth from sp join ab on ab.place = seq * 7919 % (select count(*) from ab) where split = 'test'),
st as (select u, p - row_number() over (partition by u order by p) + 1 f from hd)
select x.seq, x.u neg_u, tv.value neg_v from (select qq.seq, qq.u, nth + count(f) place from qq left join st on st.u = qq.u and f <= nth group by qq.seq, qq.u, nth) x join tv using (place)""")
def neg_collision_free(spark, sf_dir: str) -> DataFrame:
    """A pair that is no edge at all for each test edge."""
    e = S.quantile_split(E.bip(spark, sf_dir))
    sides = [N.pool(e.select(F.col(c).alias("value"))) for c in ("u", "v")]
    return N.free_pairs(e.filter("split = 'test'").select("seq"), *sides, F.col("seq"), e.select("u", "v"))


def _past_sql(observed: str) -> str:
    return with_("bip", SPLIT, SIDES, _known_sql(observed)) + """, qq as (select b.seq, b.u, b.v, b.batch, "free" from b join pl using (batch) where split = 'test'),
st as (select batch, n0 - row_number() over (partition by batch order by n0) + 1 f from ow),
hp as (select qq.seq, qq.u, qq.v, seq * 7919 % "free" + count(f) n0 from qq left join st on st.batch = qq.batch and f <= seq * 7919 % "free" where "free" > 0 group by qq.seq, qq.u, qq.v, "free"),
z as (select (select count(*) from su) s, (select count(*) from tv) t), hd as (select distinct batch, su.place * t + tv.place pair from b join su on su.value = b.u join tv on tv.value = b.v, z),
hs as (select batch, pair - row_number() over (partition by batch order by pair) + 1 f from hd),
fq as (select qq.*, ((seq * 7919 % s) * t + seq * 104729 % t) % (s * t - c) nth from qq join (select batch, count(*) c from hd group by batch) using (batch), z where "free" = 0 and s * t > c),
fp as (select fq.seq, fq.u, fq.v, nth + count(f) pair from fq left join hs on hs.batch = fq.batch and f <= nth group by fq.seq, fq.u, fq.v, nth)
select hp.seq, hp.u, hp.v, kn.u neg_u, kn.v neg_v, 'historical' kind from hp join kn using (n0)
union all select fp.seq, fp.u, fp.v, su.value, tv.value, 'random' from fp, z, su, tv where su.place = pair // t and tv.place = pair % t"""


@query(_past_sql("0"))
def neg_historical(spark, sf_dir: str) -> DataFrame:
    """An edge of the past for each test edge, none of its own batch; random pairs fill up."""
    e = S.quantile_split(E.bip(spark, sf_dir))
    return N.past_pairs(e, e.filter("split = 'test'"), 200)


@query(_past_sql(TRAINED))
def neg_inductive(spark, sf_dir: str) -> DataFrame:
    """As neg_historical, among edges that training never saw."""
    e = S.quantile_split(E.bip(spark, sf_dir))
    return N.past_pairs(e, e.filter("split = 'test'"), 200, _trained(e))


# -- memory scorers ---------------------------------------------------------------------

BANK = with_("bip", SPLIT)


def _bank(spark, sf_dir: str):
    e = S.quantile_split(E.bip(spark, sf_dir))
    return e.filter("split = 'train'"), e.filter("split = 'test'").select("seq", "u", "v")


def _bank_sql(memory: str) -> str:
    return f"{BANK}, tr as (select * from sp where split = 'train'){memory} select seq, u, v, (exists (select 1 from mem where mem.u = sp.u and mem.v = sp.v))::int score from sp where split = 'test'"


@query(_bank_sql(", mem as (select u, v from tr)"))
def edgebank_unlimited(spark, sf_dir: str) -> DataFrame:
    train, asked = _bank(spark, sf_dir)
    return M.seen_flag(asked, train, ["u", "v"]).select("seq", "u", "v", "score")


@query(_bank_sql(", mem as (select u, v from tr where t >= (select quantile_cont(t::double, 0.85) from tr))"))
def edgebank_window(spark, sf_dir: str) -> DataFrame:
    train, asked = _bank(spark, sf_dir)
    return M.seen_flag(asked, M.recent_window(train, 0.15), ["u", "v"]).select("seq", "u", "v", "score")


@query(_bank_sql(", gp as (select u, v, t - lag(t) over (partition by u, v order by seq) g from tr), ga as (select u, v, avg(g) g from gp group by u, v), mem as (select u, v from tr where t >= (select max(t) from tr) - (select coalesce(sum(g), 0) / count(*) from ga))"))
def edgebank_repeat_interval(spark, sf_dir: str) -> DataFrame:
    train, asked = _bank(spark, sf_dir)
    top = train.agg(F.max("t").alias("top"))
    recent = train.join(F.broadcast(M.repeat_interval(train))).join(F.broadcast(top)).filter(F.col("t") >= F.col("top") - F.col("width"))
    return M.seen_flag(asked, recent, ["u", "v"]).select("seq", "u", "v", "score")


@query(_bank_sql(", fq as (select u, v, count(*) n from tr group by u, v), mem as (select u, v from fq where n >= (select avg(n) from fq))"))
def edgebank_threshold(spark, sf_dir: str) -> DataFrame:
    train, asked = _bank(spark, sf_dir)
    return M.seen_flag(asked, M.frequent(train), ["u", "v"]).select("seq", "u", "v", "score")


@query(with_("bip") + """, b as (select *, (seq - 1) // 200 batch from e), z as (select batch + 1 batch, max(t) upto from b group by 1), wd as (select (max(t) - min(t)) * 0.15::double span from e),
l as (select x.seq, max(y.t) last from b x join b y on y.u = x.u and y.v = x.v and y.batch < x.batch group by x.seq)
select b.seq, u, v, coalesce((last >= upto - span)::int, 0) score from b left join l using (seq) left join z using (batch), wd""")
def edgebank_sliding(spark, sf_dir: str) -> DataFrame:
    return M.sliding_bank(E.bip(spark, sf_dir), 200, 0.15)


@query(f"{BANK}, m as (select u x from sp where split = 'train' union select v from sp where split = 'train') select seq, (u in (select x from m))::int src_seen, (v in (select x from m))::int dst_seen from sp where split = 'test'")
def nodebank(spark, sf_dir: str) -> DataFrame:
    train, asked = _bank(spark, sf_dir)
    nodes = train.select(F.explode(F.array("u", "v")).alias("x"))
    out = M.seen_flag(asked, nodes.withColumnRenamed("x", "u"), ["u"], "src_seen")
    return M.seen_flag(out, nodes.withColumnRenamed("x", "v"), ["v"], "dst_seen").select("seq", "src_seen", "dst_seen")


LABELS = "lab as (select u node, t // 86400000000 slot, sum(w) x from e group by all)"


def _labels(spark, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("t") / F.lit(86_400_000_000))
    return E.uni(spark, sf_dir).groupBy(F.col("u").alias("node"), day.alias("slot")).agg(F.sum("w").alias("x"))


@query(with_("uni", LABELS) + "select node, slot, round(coalesce(lag(x) over (partition by node order by slot), 0), 5) forecast from lab")
def persistent_forecast(spark, sf_dir: str) -> DataFrame:
    last = F.lag("x").over(W.partitionBy("node").orderBy("slot"))
    return _labels(spark, sf_dir).select("node", "slot", F.round(F.coalesce(last, F.lit(0.0)), 5).alias("forecast"))


@query(with_("uni", LABELS, recursive=True) + """, o as (select *, row_number() over (partition by node order by slot) i from lab),
m as (select node, slot, i, x m from o where i = 1 union all select o.node, o.slot, o.i, (m * 6 + o.x) / 7 from m join o on o.node = m.node and o.i = m.i + 1)
select node, slot, round(m, 5) average from m""")
def moving_average(spark, sf_dir: str) -> DataFrame:
    """(m * (w - 1) + x) / w over seven: the decayed fold with decay 6 / 7."""
    from ..operators.rolling import rolling

    ticks = _labels(spark, sf_dir).select("node", F.col("slot").alias("n"), F.col("x").alias("value"))
    return rolling(ticks, decay=6 / 7).select("node", F.col("n").alias("slot"), F.round("ema", 5).alias("average"))


# -- parsing ----------------------------------------------------------------------------


@query("""with p as (select p_partkey, rpad(case when length(p_brand) > 8 then '!!!!!!!!' else p_brand end, 8, '!') s from part)
select p_partkey, """ + ", ".join(f"case when substr(s, {i}, 1) between '0' and '9' then substr(s, {i}, 1)::int when substr(s, {i}, 1) = '!' then -1 else ascii(upper(substr(s, {i}, 1))) - 35 end c{i}" for i in range(1, 9)).replace("substr(s, 1, 1)::int", "try_cast(substr(s, 1, 1) as int)") + " from p")
def parse_flight_features(spark, sf_dir: str) -> DataFrame:
    codes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", pad_code(F.col("p_brand")).alias("c"))
    return codes.select("p_partkey", *[F.get("c", F.lit(i)).cast("int").alias(f"c{i + 1}") for i in range(8)])


@query("select event_id, round(log2(case when w = 0 then 1 else w end), 6) weight from (select event_id, floor(value) w from events)")
def log2_weights(spark, sf_dir: str) -> DataFrame:
    w = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.floor("value").cast("double").alias("w"))
    return w.select("event_id", F.round(log2_weight(F.col("w")), 6).alias("weight"))


