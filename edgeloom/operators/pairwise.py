"""Features of candidate pairs (u, v) on a snapshot graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import graph as G
from . import tiles
from .graph import degree


def _zero(name: str):
    return F.coalesce(F.col(name), F.lit(0.0)).alias(name)


# Names of the features, in the order in which they are returned.
GENERIC = ("cn", "aa", "ra", "jaccard", "pa", "cn2", "aa2")
COHESION = ("cn_x_sum", "cn_x_max", "cn_x_mean", "cn_truss_sum", "cn2_x_sum", "cn2_x_mean", "x_u", "x_v", "x_min", "x_gap")
DYNAMIC = ("cn_x_ema_sum", "cn_x_delta_sum", "cn_x_dpos", "cn_x_dneg", "cn_x_std_sum", "cn_x_mxch_sum", "cn2_x_ema_sum", "cn2_x_delta_sum", "cn2_x_dpos", "u_x_ema", "u_x_delta", "v_x_ema", "v_x_delta")
#: Columns of each mode: none, 7, 23 or all 30.
MODES = {"none": (), "generic": GENERIC, "cohesion": COHESION + DYNAMIC, "all": GENERIC + COHESION + DYNAMIC}


def columns_of(mode: str) -> tuple[str, ...]:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}: one of {sorted(MODES)}")
    return MODES[mode]


def _exact(value) -> Column:
    """Decimals of six digits, whose sum no order of rows changes."""
    return F.round(value, 6).cast("decimal(28,6)")


def pair_features(queries: DataFrame, ab: DataFrame, x: DataFrame, truss: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """All training-free pair features for the distinct (u, v) of ``queries``, and ``bridge`` and ``bridge_x``.

    ``x`` is (node, x), the tightest indicator in use, ``truss`` (node, truss) and ``stats`` (node,
    ema, delta, std, max_change) of x's rolling statistics; without one of the latter its columns are
    left out.  ``cn`` and friends sum over common neighbours, ``cn2`` over v's neighbours two steps
    from u that are not u's neighbours, ``bridge`` over those that may be.  Unknown nodes count 0.
    Sums are found for each pair of classes of twins (``blocks.Twins``).  All neighbours of v are two steps from u where
    (u, v) is an edge: there only common neighbours are told apart, and the others are v's sums less theirs and u's.
    Other pairs join words, or meet them in tiles (``tiles``) where they are many; ``stats``, whose sums are decimals, always join.
    """
    asked = queries.select("u", "v").distinct()
    twins = B.Twins(ab)
    found = twins.asked(asked)
    deg = degree(ab)
    about = deg.select("node", F.col("degree").cast("double").alias("d")).join(x.select("node", F.col("x").cast("double").alias("x")), "node", "left")
    if truss is not None:
        about = about.join(truss.select("node", F.col("truss").cast("double").alias("truss")), "node", "left")
    if stats is not None:
        about = about.join(stats, "node", "left")
    d, zero = F.col("d"), F.lit(0.0)
    # What a neighbour adds to each sum; ``xm`` is the largest.
    adds = {"n": F.lit(1).cast("long"), "aa": F.when(d > 1, 1.0 / F.log(d)).otherwise(zero), "ra": 1.0 / d, "xs": F.coalesce("x", zero), "xm": F.coalesce("x", zero)}
    used = {"cn": ["n", "aa", "ra", "xs", "xm"], "cn2": ["n", "aa", "xs"], "br": ["n", "xs"]}
    if truss is not None:
        adds["ts"] = F.coalesce("truss", zero)
        used["cn"].append("ts")
    if stats is not None:
        adds |= {f"x_{'mxch' if c == 'max_change' else c}_sum": _exact(F.coalesce(c, zero)) for c in ("ema", "delta", "std", "max_change")}
        adds |= {f"x_{c}": F.coalesce(sign, F.lit(False)).cast("long") for c, sign in (("dpos", F.col("delta") > 0), ("dneg", F.col("delta") < 0))}
        used["cn"] += ["x_ema_sum", "x_delta_sum", "x_std_sum", "x_mxch_sum", "x_dpos", "x_dneg"]
        used["cn2"] += ["x_ema_sum", "x_delta_sum", "x_dpos"]
    one = G.cut(about.select("node", *[c.alias(f) for f, c in adds.items()]))
    merge = lambda f, c: (F.max if f == "xm" else F.sum)(c)
    whole = G.cut(twins.totals(one, [merge(f, F.col(f)).alias(f) for f in adds]))
    of = [F.col("u").alias("ru"), F.col("v").alias("rv")]

    met = B.members(B.shared_words(twins.pairs(found, True), twins.ab), F.col("both")).join(whole.withColumnRenamed("node", "w"), "w")
    met = met.groupBy(*of).agg(*[merge(f, F.col(f)).alias(f"cn_{f}") for f in used["cn"]])
    near = found.filter("linked").join(twins.around(whole, used["cn2"]), "rv").join(one.select(F.col("node").alias("u"), *[F.col(f).alias(f"own_{f}") for f in used["cn2"]]), "u").join(met, ["ru", "rv"], "left")
    held = lambda f: F.coalesce(f"cn_{f}", F.lit(0).cast(whole.schema[f].dataType))
    less = {f: F.col(f) - F.col(f"own_{f}") for f in used["cn2"]}
    rest = F.col("n") - F.col("own_n") - held("n")

    def others(f: str) -> Column:
        """What is left without the common neighbours: nothing if there are none, and no rounding below 0 where it is a sum of doubles."""
        left = less[f] - held(f)
        return F.when(rest > 0, F.greatest(left, zero)).otherwise(zero) if f == "aa" or f == "xs" else left

    near = near.select("u", "v", *[held(f).alias(f"cn_{f}") for f in used["cn"]], *[others(f).alias(f"cn2_{f}") for f in used["cn2"]], *[less[f].alias(f"br_{f}") for f in used["br"]])

    strangers = G.cut(twins.pairs(found, False))
    if stats is None and tiles.word_rows(strangers, twins.ab) > tiles.MOST_ROWS:
        far = tiles.sums(strangers, twins.ab, whole, {"cn": used["cn"], "met": used["cn2"], "br": used["cn2"]}, ("xm",))
        apart = F.col("br_n") - F.col("met_n")

        def second(f: str) -> Column:
            left = F.col(f"br_{f}") - F.col(f"met_{f}")
            return left if f == "n" else F.when(apart > 0, F.greatest(left, zero)).otherwise(zero)

        far = far.select(*of, *[f"cn_{f}" for f in used["cn"]], *[second(f).alias(f"cn2_{f}") for f in used["cn2"]], *[f"br_{f}" for f in used["br"]])
    else:
        flagged = B.members(B.pair_words(strangers, twins.ab), F.col("near"))
        has = lambda c: F.getbit(F.col(c), F.col("w").bitwiseAND(F.lit(63)).cast("int")) == 1
        parts = {"cn": has("one"), "cn2": has("two") & ~has("one"), "br": has("two")}
        aggs = [merge(f, F.when(parts[p], F.col(f)).otherwise(F.lit(0).cast(whole.schema[f].dataType))).alias(f"{p}_{f}") for p in parts for f in used[p]]
        far = flagged.filter(has("one") | has("two")).join(whole.withColumnRenamed("node", "w"), "w").groupBy(*of).agg(*aggs)
    far = found.filter(~F.col("linked")).join(far, ["ru", "rv"]).select(*near.columns)

    def plain(name: str) -> Column:
        return F.log1p(F.col(name).cast("double")) if name.endswith(("_dpos", "_dneg")) else F.col(name).cast("double")

    sums = near.unionByName(far)
    out = asked.join(sums.select("u", "v", *[plain(c).alias(c) for c in sums.columns[2:]]), ["u", "v"], "left")
    for side in ("u", "v"):
        own = deg.select(F.col("node").alias(side), F.col("degree").cast("double").alias(f"d{side}"))
        out = out.join(own, side, "left").join(x.select(F.col("node").alias(side), F.col("x").cast("double").alias(f"x_{side}")), side, "left")
        if stats is not None:
            out = out.join(stats.select(F.col("node").alias(side), F.col("ema").alias(f"{side}_x_ema"), F.col("delta").alias(f"{side}_x_delta")), side, "left")
    out = out.select("u", "v", *[_zero(c) for c in out.columns if c not in ("u", "v")])
    n, n2 = F.col("cn_n"), F.col("cn2_n")
    return out.select(
        "u",
        "v",
        F.log1p(n).alias("cn"),
        F.col("cn_aa").alias("aa"),
        F.col("cn_ra").alias("ra"),
        F.coalesce(F.try_divide(n, F.col("du") + F.col("dv") - n), zero).alias("jaccard"),
        F.log1p(F.col("du") * F.col("dv")).alias("pa"),
        F.log1p(n2).alias("cn2"),
        F.col("cn2_aa").alias("aa2"),
        F.log1p("cn_xs").alias("cn_x_sum"),
        F.col("cn_xm").alias("cn_x_max"),
        F.coalesce(F.try_divide("cn_xs", n), zero).alias("cn_x_mean"),
        *([F.log1p("cn_ts").alias("cn_truss_sum")] if truss is not None else []),
        F.log1p("cn2_xs").alias("cn2_x_sum"),
        F.coalesce(F.try_divide("cn2_xs", n2), zero).alias("cn2_x_mean"),
        "x_u",
        "x_v",
        F.least("x_u", "x_v").alias("x_min"),
        F.abs(F.col("x_u") - F.col("x_v")).alias("x_gap"),
        *(DYNAMIC if stats is not None else ()),
        F.col("br_n").alias("bridge"),
        F.col("br_xs").alias("bridge_x"),
    )


def project(features: DataFrame, mode: str) -> DataFrame:
    """The columns of a mode of ``pair_features``' result, without nulls."""
    return features.select("u", "v", *[F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns_of(mode)])


def neighbor_dynamics(queries: DataFrame, ab: DataFrame, stats: DataFrame) -> DataFrame:
    """Sums of rolling statistics over common and second-hop neighbours, and the pair's own."""
    x = degree(ab).select("node", F.col("degree").alias("x"))
    return pair_features(queries, ab, x, stats=stats).select("u", "v", *DYNAMIC)


def clip(value, c: float):
    """sign(x) * log1p(|x| / c) * c for every x; the value itself without a positive c."""
    return F.signum(value) * F.log1p(F.abs(value) / F.lit(c)) * F.lit(c) if c > 0 else value
