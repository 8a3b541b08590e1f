"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from columbine.llm import host_rules as H
from columbine.llm import license_scan as L
from columbine.llm.decontaminate import WINDOW

_RATES = ", ".join(f"sum(cast({r} as int)) as {r}" for r in H.RULES)
_PRIOR = ", ".join(
    f"sum({r}) / sum(n_docs) as {r}_m, sum({r} * {r} / n_docs) / sum(n_docs) as {r}_q" for r in H.RULES)


def _strength(r: str) -> str:
    v = f"greatest({r}_q - {r}_m * {r}_m, 0.0)"
    return (f"least({H.MAX_PRIOR_DOCS}, greatest(0.0, case when {v} > 0 then {r}_m * (1 - {r}_m) / {v} - 1 "
            f"else {H.MAX_PRIOR_DOCS} end))")


HOST_RULES = f"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
w as (select rid, doc_id, source, t, regexp_extract_all(t, '{H.NOT_SPACE}+') as ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{H.NOT_SPACE}')) as ls from d),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
      from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
r as (select rid, i from (select *, count(*) over (partition by rid, g) as c from g) where c > 1),
c as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from r) group by 1),
m as (select w.rid, doc_id, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
             len(regexp_extract_all(t, '{H.SYMBOLS}')) as n_symbols, len(ls) as n_lines,
             len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words
      from w left join c on c.rid = w.rid),
f as (select *, {', '.join(f'{cond} as {r}' for r, cond in H.RULES.items())} from m),
h as (select source, count(*)::double as n_docs, {_RATES} from f group by 1),
p as (select {_PRIOR} from h),
v as (select source, greatest({', '.join(f'({r} + {r}_m * {_strength(r)}) / (n_docs + {_strength(r)})' for r in H.RULES)})
             < {H.MAX_HOST_RATE} as host_ok from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words or repeats as base_failed,
       not (few_words or repeats) and host_ok as kept
from f left join v on v.source is not distinct from f.source
"""


def _words(c: str) -> str:
    return f"regexp_extract_all(translate(coalesce({c}, ''), '{L.UPPER}', '{L.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


_TEMPLATES = ", ".join(
    [f"({i}, '{label}', {L.PHRASE_GRAM}, '{text}', true)" for i, (text, label) in enumerate(L.PHRASES.items())]
    + [f"({100 + i}, '{label}', {L.NOTICE_GRAM}, '{text}', false)" for i, (label, text) in enumerate(L.NOTICES)])

LICENSE_SCAN = f"""
with t as (select template, label, k, string_split(text, ' ') as ws, base
           from (values {_TEMPLATES}) as z(template, label, k, text, base)),
tg as (select template, label, k, len(ws) as size, base, i - 1 as tpos, array_to_string(ws[i:i + k - 1], ' ') as g
       from (select *, unnest(range(1, len(ws) - k + 2)) as i from t)),
d as (select row_number() over () as rid, doc_id, {_words('text')} as ws from documents),
dg as (select rid, k, i - 1 as pos, array_to_string(ws[i:i + k - 1], ' ') as g
       from (select rid, ws, k, unnest(range(1, len(ws) - k + 2)) as i
             from d, (values ({L.PHRASE_GRAM}), ({L.NOTICE_GRAM})) as y(k) where len(ws) >= k)),
v as (select rid, template, label, tg.k, size, base, pos - tpos as diagonal, list(distinct pos) as pos_at
      from dg join tg on tg.k = dg.k and tg.g = dg.g group by 1, 2, 3, 4, 5, 6, 7),
ph as (select rid, label, base, diagonal as first_at, 1.0 as sim from v where base and len(pos_at) = size - k + 1),
n1 as (select *, case when diagonal - lag(diagonal) over (partition by rid, template order by diagonal) <= {L.MAX_SHIFT}
                 then 0 else 1 end as fresh from v where not base),
n2 as (select *, sum(fresh) over (partition by rid, template order by diagonal) as span from n1),
n3 as (select rid, template, label, size, span, unnest(pos_at) as p, diagonal from n2),
n4 as (select rid, template, label, size, span, p, p - diagonal + unnest(range(0, {L.NOTICE_GRAM})) as tw from n3),
n5 as (select rid, label, min(p) as first_at,
              count(distinct tw) / greatest(any_value(size), max(p) + {L.NOTICE_GRAM} - min(p)) as sim
       from n4 group by rid, template, label, span),
s as (select rid, label, base, first_at, sim from ph
      union all select rid, label, false, first_at, sim from n5 where sim >= {L.MIN_SIMILARITY}),
a as (select rid, count(*) filter (base) as n_base, min(first_at) filter (base) as first_word,
             max(first_at) filter (base) as last_word,
             array_to_string(list_sort(list(distinct label) filter (base)), ',') as base_labels,
             array_to_string(list_sort(list(distinct label)), ',') as labels, max(sim) as score
      from s group by 1)
select d.doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join a on a.rid = d.rid
"""

DECONTAMINATE = f"""
with b as (select item_id, {_words('text')} as ws from benchmark),
bw as (select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as g
       from (select item_id, ws, least(len(ws), {WINDOW}) as n, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) as i
             from b where len(ws) > 0)),
d as (select row_number() over () as rid, doc_id, {_words('text')} as ws from documents),
dw as (select rid, n, i, array_to_string(ws[i:i + n - 1], ' ') as g
       from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as i
             from d, (select distinct n from bw) z where len(ws) >= n)),
h as (select rid, dw.n, i, item_id from dw join bw on bw.n = dw.n and bw.g = dw.g),
hw as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from h) group by 1),
hi as (select rid, count(distinct item_id) as n_items,
              array_to_string(list_sort(list(distinct item_id::varchar) filter (item_id is not null)), ',') as items
       from h group by 1)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw on hw.rid = d.rid left join hi on hi.rid = d.rid
"""


HARD_NEGATIVES = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e,
                  case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
           from embeddings where label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, c.vec_id as id, c.label,
             list_inner_product(a.e, c.e)::bigint as score
      from v a join v c on a.vec_id % 100 = 0 and a.vec_id <> c.vec_id),
p as (select * from s where label = own
      qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.id as positive_id,
       row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id)::int as rank,
       s.id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and s.label <> s.own
  and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
qualify rank <= 5
"""
