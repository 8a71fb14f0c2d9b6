"""DuckDB SQL for the corpus queries that it can express; small tables only."""

from __future__ import annotations

from .ledger import RULES

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5 = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
t as (select r, unnest(range(1, len(w) + 1)) as i, w from d),
k as (select r, i, case when i = 1 then chr(0) else w[i - 1] end as v, w[i] as x from t),
n as (select count(*) as words, (select count(*) from d) as docs from k),
c1 as (select x as g, count(*) as c from k group by 1), o1 as (select r, x as g, count(*) as o from k group by 1, 2),
c2 as (select v, x, count(*) as c from k group by 1, 2), o2 as (select r, v, x, count(*) as o from k group by 1, 2, 3),
s as (
  select o2.r, o2.o as times, c2.c - o2.o as pair, case when o2.v = chr(0) then n.docs - 1 else cv.c - ov.o end as before, cx.c - ox.o as word, greatest(n.words - len(d.w), 1) as rest
  from o2 join c2 using (v, x) join d on d.r = o2.r cross join n left join c1 cv on cv.g = o2.v left join o1 ov on ov.r = o2.r and ov.g = o2.v join c1 cx on cx.g = o2.x join o1 ox on ox.r = o2.r and ox.g = o2.x),
l as (select r, sum(times * ln(case when pair > 0 then pair / before when word > 0 then 0.4 * word / rest else 0.16 / rest end)) as score from s group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, round(coalesce(score, 0), 6) as log_score, round(score / nullif(len(d.w), 0), 6) as per_word from d left join l using (r)
"""


def _kind(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = (f"{pattern[:-1]}{{{least},}}" if kind == "hex" else pattern).replace("'", "''")  # for one class of characters, the same matches
    return f"""
select doc_id, {rank} as rank, '{kind}' as kind, list_transform(range(1, len(f) + 1), lambda i: {{
    'a': cast(coalesce(list_sum(list_transform(g[1:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0) as bigint),
    'n': length(f[i]), 'ok': length(p[i]) >= {least}}}) as m
from (select doc_id, regexp_split_to_array(text, '{p}') as g, regexp_extract_all(text, '{p}') as f, regexp_extract_all(text, '{p}', {group}) as p from t)"""


OP6 = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
k as ({' union all '.join(_kind(i, r.kind, r.pattern, r.group, r.least) for i, r in enumerate(RULES))}),
s as (select doc_id, rank, kind, unnest(m) as m from k),
x as (select doc_id, rank, kind, m.a as a, kind || ':' || m.a || ':' || (m.a + m.n) as span from s where m.ok),
j as (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  string_agg(span, ',' order by a, rank) filter (where rank < 3) as base, string_agg(span, ',' order by a, rank) as spans from x group by 1)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join j using (doc_id)
"""

OP7 = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
ok as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
far as (select a, b from p union select far.a, p.b from far join p on p.a = far.b),
c as (select a, least(a, min(b)) as component_id from far group by a), n as (select a, count(*) as n_links from p group by a)
select v.vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, v.vec_id) as component_id, coalesce(component_id, v.vec_id) = v.vec_id as kept
from v left join n on n.a = v.vec_id left join c on c.a = v.vec_id
"""

OP9 = f"""
with recursive d as (select doc_id, {_WORDS} as w from documents),
s as (
  select distinct doc_id, g from (select doc_id, w[i] || chr(0) || w[i + 1] as g from (select doc_id, w, unnest(range(1, len(w))) as i from d)
  union all select doc_id, w[1] from d where len(w) = 1)),
n as (select doc_id, count(*) as n from s group by 1),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
p as (select a, b from both_ join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
e as (select a, b from p union all select b, a from p),
far as (select a, b from e union select far.a, e.b from far join e on e.a = far.b),
m as (select a, least(a, min(b)) as component_id from far group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id, coalesce(component_id, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join m on m.a = d.doc_id
"""

#: CRC-32 of a text of ASCII characters, bit by bit: every character is followed by seven zeros, and each entry shifts once.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"""

OP11 = f"""
with o as (
  select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first) as turns, {_CRC.format("conv_id::varchar")} % 9 as h from conversations where conv_id is not null group by conv_id),
r as (select a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) as s from o a left join o b on b.conv_id = a.conv_id - a.conv_id % 5),
p as (select conv_id, len(s) as n, d, md5(to_json(s[1:d])::varchar) as k, if(d = 0, null, md5(to_json(s[1:d - 1])::varchar)) as up, if(d = 0, 0, octet_length(encode(s[d].t))) as bytes from r, unnest(range(0, len(s) + 1)) as u(d)),
v as (select k, any_value(up) as up, any_value(d) as d, min(conv_id) as c, count(*) as n, any_value(bytes) as bytes, string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d) as ends from p group by k),
w as (select v.*, (select count(*) from v x where x.up = v.k) as children from v),
t as (select p.k, sum(if(w.children = 0, 1, 0)) as leaves, sum((w.n - 1) * w.bytes) as saved from w join p on p.conv_id = w.c and p.d <= w.d group by p.k)
select w.c as conv_id, w.d as depth, u.c as parent_conv_id, w.n as n_convs, w.children as n_children, t.leaves::bigint as n_leaves, t.saved::bigint as saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
from w join t using (k) left join w u on u.k = w.up
"""
