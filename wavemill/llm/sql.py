"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1 = f"""
with d as (select row_number() over () as k, doc_id, {_WORDS} as w from documents),
t as (select k, i, w[i] as word from d, lateral (select unnest(range(1, len(w) + 1)) as i)),
total as (select count(*)::double as n from t),
cu as (select word, count(*)::double as c from t group by word),
pairs as (select b.k, a.word as v, b.word as w from t a join t b on a.k = b.k and b.i = a.i + 1),
cp as (select v, w, count(*) as c from pairs group by v, w),
s as (
  select k, case when cp.c >= 2 then ln(cp.c::double) - ln(cv.c) else ln(0.4) + ln(cw.c / n) end as x
  from pairs join cp using (v, w) join cu cv on cv.word = v join cu cw on cw.word = w, total
  union all select k, ln(c / n) from t join cu using (word), total where i = 1),
sums as (select k, sum(x) as x from s group by k)
select doc_id, len(w)::bigint as n_words, round(coalesce(x, 0.0), 4) as log_score, round(x / nullif(len(w), 0), 6) as per_word
from d left join sums using (k)
"""


def _weight(column: str, weights: dict[str, int]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {w}" for k, w in weights.items()) + " else 1 end"


def _shares(source: str, out: str, family: str) -> str:
    """Common table expressions that give the rows of `source` (family, node, weight, stock, goal) a share."""
    by = f"partition by {family} order by stock::double / weight, node"
    return f"""
{out}_a as (select *, coalesce(sum(stock) over ({by} rows between unbounded preceding and 1 preceding), 0)::hugeint as sb,
    (sum(weight) over (partition by {family}) - coalesce(sum(weight) over ({by} rows between unbounded preceding and 1 preceding), 0))::hugeint as wl from {source}),
{out}_b as (select *, min(case when stock::hugeint * wl <= (goal - sb) * weight then 1 else 0 end) over ({by} rows between unbounded preceding and current row) as f from {out}_a),
{out}_c as (select *, max(case when f = 0 then goal - sb end) over (partition by {family}) as rest, sum(case when f = 0 then weight else 0 end) over (partition by {family}) as ow,
    row_number() over (partition by {family}, f order by stock::double / weight, node) as rn from {out}_b),
{out}_d as (select *, case when f = 1 then stock::hugeint else greatest(0, (rest * weight) // ow) end as sh from {out}_c),
{out} as (select * exclude (sh), (case when f = 0 and rn = 1 then least(stock::hugeint, sh + rest - sum(case when f = 0 then sh else 0 end) over (partition by {family})) else sh end)::hugeint as share from {out}_d)"""


def mix_by_bytes(weights: dict, budget: float, epochs: int, seed: int) -> str:
    """The mixture with tokens of four bytes each, which SQL can count: (doc_id, lang, source, copies, share)."""
    return f"""
with x as (select doc_id, lang, source, coalesce(right(source, 1), '(none)') as d, coalesce(lang, '(none)') as l, coalesce(source, '(none)') as s,
    coalesce((octet_length(encode(text)) + 3) // 4, 0)::bigint as tok from documents),
leaf as (select d, l, s, sum(tok)::hugeint as tokens, {epochs} * sum(tok)::hugeint as stock from x where tok > 0 group by d, l, s),
total as (select floor(sum(tokens)::double * {budget})::hugeint as goal, sum(stock) as most from leaf),
top as (select 0 as root, d as node, {_weight('d', weights['domain'])} as weight, sum(stock)::hugeint as stock, least(any_value(goal), any_value(most))::hugeint as goal from leaf, total group by d),
{_shares('top', 'sa', 'root')},
mid as (select leaf.d, l as node, {_weight('l', weights['lang'])} as weight, sum(leaf.stock)::hugeint as stock, any_value(sa.share)::hugeint as goal from leaf join sa on sa.node = leaf.d group by leaf.d, l),
{_shares('mid', 'sb_', 'd')},
low as (select leaf.d, l, s as node, {_weight('s', weights['source'])} as weight, tokens, leaf.stock, sb_.share as goal from leaf join sb_ on sb_.d = leaf.d and sb_.node = l),
{_shares('low', 'sc', 'd, l')},
plan as (select d, l, node as s, tokens, share, (share // tokens)::bigint as whole, share % tokens as rest from sc),
y as (select x.*, share, whole, rest, md5('{seed}|' || whole || '|' || coalesce(doc_id::varchar, '')) as key from x left join plan using (d, l, s)),
z as (select *, sum(tok) over (partition by d, l, s order by key range between unbounded preceding and current row) - sum(tok) over (partition by d, l, s, key) as before from y)
select doc_id, lang, source, (case when tok > 0 then coalesce(whole, 0) + case when before < rest then 1 else 0 end else 0 end)::int as copies, coalesce(share, 0)::bigint as share from z
"""


ORACLE_SQL: dict[str, str] = {"op1_lm_score": OP1}
