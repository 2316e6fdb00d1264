"""Registration of queries with the DuckDB SQL that they are compared with."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EVENTS = """ev as (select event_id eid, user_id u, regexp_extract(props, '"k": *([0-9]+)', 1)::bigint k, epoch_us(ts) t, value w, event_type from events)"""
ORDERED = "row_number() over (order by t, eid) seq"
GRAPHS = {
    "bip": f"{EVENTS}, e as (select {ORDERED}, eid, u, 1000000 + k v, t, w from ev)",
    "uni": f"{EVENTS}, e as (select {ORDERED}, eid, u, k v, t, w from ev)",
    "trade": """tr as (select epoch_us(o_orderdate) t, * from orders join lineitem on o_orderkey = l_orderkey),
e as (select row_number() over (order by t, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) seq,
  l_orderkey eid, o_custkey u, 10000000 + l_partkey v, t, l_extendedprice w from tr)""",
}
#: Further tables over ``e``: first edges, snapshot edges, both directions, degrees, interactions.
FIRST = """fe as (select *, (seq0 - 1) // 200 batch0, row_number() over (order by seq0) n0 from
  (select least(u, v) a, greatest(u, v) b, min(seq) seq0, arg_min(t, seq) t0 from e where u <> v group by all))"""
SNAP = "ab as (select distinct least(u, v) a, greatest(u, v) b from e where u <> v)"
ADJ = "adj as (select a n, b m from ab union all select b, a from ab)"
DEG = "deg as (select n node, count(*) d from adj group by n)"
INTER = "it as (select u node, v nbr, seq, t from e union all select v, u, seq, t from e)"


def with_(graph: str, *parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{', '.join([GRAPHS[graph], *parts])}\n"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
