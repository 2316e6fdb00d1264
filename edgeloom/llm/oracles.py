"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from .mixing import SCHEDULES

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint"


def _inverse(weights, share: str) -> str:
    n = len(weights) - 1
    areas = [(weights[i] + weights[i + 1]) / 2 / n for i in range(n)]
    total, before, out = sum(areas), 0.0, "case"
    for i, area in enumerate(areas):
        a, slope = weights[i], (weights[i + 1] - weights[i]) * n
        need = f"({share} * {total!r}::double - {before!r}::double)"
        inside = f"{need} / {a!r}::double" if slope == 0 else f"(sqrt(greatest({a * a!r}::double + {2 * slope!r}::double * {need}, 0::double)) - {a!r}::double) / {slope!r}::double"
        before += area
        head = " else " if i == n - 1 else f" when {share} * {total!r}::double <= {before!r}::double then "
        out += f"{head}{i / n!r}::double + {inside}"
    return f"greatest(0::double, least(1::double, {out} end))"


def op9_sql() -> str:
    copies = ", ".join(f"case when size > 0 and (passes > {k} or (passes = {k} and (before + size <= lft or pk is not null))) then {k} end" for k in range(3))
    share = "(least(before / target, 1::double))"
    place = " ".join(f"when src_no % {len(SCHEDULES)} = {i} then {_inverse(s, share)}" for i, s in enumerate(SCHEDULES))
    return f"""
with recursive d as (select doc_id, coalesce('s' || source, 't') src, {WORDS} size from documents),
k as (select *, md5(concat_ws('|', doc_id::varchar, size::varchar)) "key" from d),
s as (select src, sum(size)::bigint source_size, row_number() over (order by src) - 1 src_no from k group by src),
w as (select *, case src_no % 3 when 0 then 1 when 1 then 2 else 3 end weight, source_size * 3 cap from s),
l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, src rows between unbounded preceding and 1 preceding), 0))::double
  / sum(weight) over (order by cap / weight, src rows between current row and unbounded following) lv from w),
t0 as (select *, least(cap::double, max(lv) over () * weight) target from l),
t as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end passes, target - (case when source_size > 0 then floor(target / source_size)::bigint else 0 end * source_size)::double lft from t0),
b as (select k.*, coalesce(sum(size) over (partition by src order by "key", size rows between unbounded preceding and 1 preceding), 0)::bigint before from k),
j as (select b.*, t.source_size, t.target, t.src_no, t.passes, t.lft from b join t using (src)),
g0 as (select src, max(lft) - coalesce(max(case when before + size <= lft then before + size end), 0) gap from j group by src),
zr as (select src, size, before, row_number() over (partition by src, size order by "key", before) r from j where before + size > lft and size > 0),
zi as (select src, size, max(r) n, row_number() over (partition by src order by size desc) i from zr group by src, size),
g as (select src, 0::bigint i, gap::double gap, 0::bigint size, 0::bigint n, 0::bigint m from g0 union all
  select g.src, zi.i, gap - (least(zi.n, floor(gap / zi.size)::bigint) * zi.size)::double, zi.size, zi.n, least(zi.n, floor(gap / zi.size)::bigint) from g join zi on zi.src = g.src and zi.i = g.i + 1),
ge as (select src, arg_max(gap, i) gap, min(case when m < n then size end) least from g group by src),
tk as (select g.src, g.size, m + (g.size = least and least < 2 * ge.gap)::int m from g join ge using (src) where g.i > 0),
pk as (select zr.src, before pk from zr join tk on tk.src = zr.src and tk.size = zr.size where r <= coalesce(m, 0)),
q as (select j.*, pk.pk from j left join pk on pk.src = j.src and pk.pk = j.before and j.size > 0),
p as (select q.*, len(list_filter([{copies}], lambda x: x is not null)) n from q)
select doc_id, size, source_size, target, (n * size)::bigint taken,
  case when n > 0 then round(case {place} end, 9) end "position" from p"""


def op3_sql() -> str:
    from .quality_rules import BASE_RULES, RULES, mask_of

    failed = " | ".join(f"(case when {rule} then {1 << i} else 0 end)" for i, (_, rule) in enumerate(RULES))
    points = r"[^\x00-\x{BF}]"
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select rid, unnest(ws) w, generate_subscripts(ws, 1) i from (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d)),
x as (select rid, i, w, lead(w, 1) over o w1, lead(w, 2) over o w2 from w window o as (partition by rid order by i)),
g as (select rid, i, count(*) over (partition by rid, w, w1, w2) c from x where w2 is not null),
r as (select rid, count(distinct i + k)::bigint n from g, (values (0), (1), (2)) o(k) where c > 1 group by rid),
a as (select rid, count(*)::bigint n_words, sum(length(w))::bigint word_chars, max(length(w)) max_word_chars from w group by rid),
l as (select rid, unnest(string_split(t, chr(10))) x from d),
b as (select rid, count(*)::bigint n_lines, (count(*) - count(distinct x))::bigint n_dup_lines from l where regexp_matches(x, '[^\x20\x09-\x0D]') group by rid),
m as (select d.doc_id, coalesce(a.n_words, 0) n_words, coalesce(a.word_chars, 0) word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols, coalesce(b.n_lines, 0) n_lines,
  coalesce(b.n_dup_lines, 0) n_dup_lines, coalesce(r.n, 0) n_repeat_words,
  len(regexp_extract_all(t, '[A-Za-z]|{points}')) n_letters, len(regexp_extract_all(t, '[A-Z]')) n_capitals,
  len(regexp_extract_all(t, '!')) n_exclaims, coalesce(a.max_word_chars, 0) max_word_chars
  from d left join a using (rid) left join b using (rid) left join r using (rid)),
f as (select *, ({failed})::bigint failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed & {mask_of(BASE_RULES)} <> 0 base_failed, failed = 0 kept, failed, 'v2' "policy" from f"""


def op5_sql() -> str:
    from .line_dedup import MIN_SITES

    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with l as (select doc_id, coalesce('s' || source, 'n') site, unnest(xs) raw, generate_subscripts(xs, 1) - 1 pos
  from (select doc_id, source, string_split(text, chr(10)) xs from documents)),
k as (select *, trim(raw, {blanks}) line from l),
b as (select line, min(struct_pack(a := doc_id, b := pos)) "first" from k where line <> '' group by line having count(distinct site) >= {MIN_SITES}),
m as (select k.*, b.line is not null and struct_pack(a := doc_id, b := pos) <> b."first" gone from k left join b using (line))
select doc_id, count(*)::bigint n_lines, count(*) filter (where gone)::bigint n_removed,
  coalesce(string_agg(raw, chr(10) order by pos) filter (where not coalesce(gone, false)), '') "text" from m group by doc_id"""


def op10_sql() -> str:
    norm = r"trim(regexp_replace(lower({}), '[\x20\x09-\x0D]+', ' ', 'g'))".format
    return rf"""
with recursive l as (select rid, conv_id, turn, role, text is null nul, unnest(xs) x, generate_subscripts(xs, 1) pos
  from (select row_number() over () rid, *, string_split(coalesce(text, ''), chr(10)) xs from conversations)),
p as (select *, len(replace(replace(regexp_extract(x, '^(?:[ \t]*>)+'), ' ', ''), chr(9), '')) lv, regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') c from l),
m as (select rid, any_value(conv_id) conv_id, any_value(turn) turn, any_value(role) role,
  case when not any_value(nul) then trim(coalesce(string_agg(c, chr(10) order by pos) filter (where lv = 0), ''), chr(10)) end txt, count(*) filter (where lv > 0) nq from p group by rid),
s as (select conv_id, turn, {norm('c')} u from p where lv = 0 union select conv_id, turn, {norm('txt')} from m),
o as (select conv_id, u, min(turn) origin from s where u <> '' group by all),
q as (select conv_id, turn, lv, {norm('c')} u from p where lv > 0
  union select conv_id, turn, lv, {norm("string_agg(c, ' ' order by pos)")} from p where lv > 0 group by rid, conv_id, turn, lv),
h as (select q.conv_id, turn, origin, min(lv) lv, sum(length(u)) n from q join o using (conv_id, u) where u <> '' and origin < turn group by all),
k as (select conv_id, turn, arg_max(origin, struct_pack(a := -lv, b := n, c := origin)) par from h group by all),
r as (select conv_id, turn, par anc, 1 d from k union all select r.conv_id, r.turn, k.par, d + 1 from r join k on k.conv_id = r.conv_id and k.turn = r.anc),
t as (select conv_id, turn, arg_max(anc, d) thread, max(d) d from r group by all)
select m.conv_id, m.turn::bigint turn, m.role, m.txt "text", m.nq::bigint n_quoted, k.par::bigint parent_turn, coalesce(t.thread, m.turn)::bigint thread, coalesce(t.d, 0)::bigint "depth"
from m left join k on k.conv_id = m.conv_id and k.turn = m.turn left join t on t.conv_id = m.conv_id and t.turn = m.turn"""
