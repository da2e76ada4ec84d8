"""DuckDB SQL that says, by brute force, what the operators return."""

LINES = r"""
with all_lines as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
numbered as (select doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '[^\x20\x09-\x0D]')) as real from all_lines where text is not null),
win as (select doc_id, unnest(range(1, len(real))) as k, real, ls from numbered),
keyed as (select doc_id, k, real[k] as i, real[k + 1] as j, ls[real[k]] as a, ls[real[k + 1]] as b from win),
late as (select doc_id, i, j, row_number() over (partition by a, b order by doc_id, k) > 1 as again from keyed),
gone as (select distinct doc_id, unnest([i, j]) as i from late where again),
lists as (select doc_id, list(i) as g from gone group by doc_id),
o as (select n.doc_id, n.ls, n.real, coalesce(l.g, []) as g from numbered n left join lists l using (doc_id)),
p as (select doc_id, len(real)::bigint as n_lines, len(g)::bigint as n_removed,
  len(list_filter(range(1, len(real) + 1), lambda k: list_contains(g, real[k]) and (k = 1 or not list_contains(g, real[k - 1]))))::bigint as n_runs,
  sha256(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: not list_contains(g, i)), lambda i: ls[i]), chr(10))) as kept_sha256 from o)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs, coalesce(kept_sha256, sha256('')) as kept_sha256 from (select doc_id from documents) left join p using (doc_id)
"""

SUBSTRINGS = r"""
with w as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 34], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by s) as n from win) where n > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as i from again),
lists as (select doc_id, map_from_entries(list((i, true))) as g, count(*) as n from gone group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(case when n is null then ws else list_transform(list_filter(range(1, len(ws) + 1), lambda i: g[i] is null), lambda i: ws[i]) end, ' ')) as kept_sha256
from w left join lists using (doc_id)
"""

_COMPONENTS = """
edge as (select a as x, b as y from link union all select b, a from link),
walk(id, c) as (select distinct x, x from edge union select e.y, w.c from walk w join edge e on e.x = w.id where w.c < e.y),
comp as (select id, min(c) as c from walk group by id)
"""

VECTORS = f"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select p.vec_id as a, q.vec_id as b from v p join v q on p.label = q.label and p.vec_id < q.vec_id and len(p.e) = len(q.e) where list_cosine_similarity(p.e, q.e) >= 0.98),
n as (select id, count(*) as n from (select a as id from link union all select b from link) group by id),
{_COMPONENTS}
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c, vec_id)::bigint as component_id, coalesce(c, vec_id) = vec_id as kept
from embeddings e left join n on n.id = e.vec_id left join comp on comp.id = e.vec_id
"""

NEAR_DUPLICATES = rf"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) < 2 then ws else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) as s from w),
x as (select doc_id, unnest(s) as t, len(s) as n from s),
link as (select p.doc_id as a, q.doc_id as b from x p join x q on p.t = q.t and p.doc_id < q.doc_id and 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  group by p.doc_id, q.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
{_COMPONENTS}
select doc_id, len(s)::bigint as n_shingles, coalesce(c, doc_id)::bigint as component_id, coalesce(c, doc_id) = doc_id as kept from s left join comp on comp.id = s.doc_id
"""

#: Windows of 50 bytes; late ones that touch or overlap make a run.
SUFFIXES = r"""
with d as (select doc_id, encode(coalesce(text, '')) as h from documents),
k as (select doc_id, i, array_slice(h, i, i + 49) as s from (select doc_id, unnest(range(1, octet_length(h) - 48)) as i, h from d)),
f as (select s, min(doc_id) as least from k group by s having min(doc_id) < max(doc_id)),
late as (select doc_id, i, i > coalesce(lag(i) over w, -99) + 50 as new from k join f using (s) where doc_id > least window w as (partition by doc_id order by i)),
island as (select doc_id, min(i) as a, max(i) + 49 as b from (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as g from late) group by doc_id, g),
part as (select doc_id, h, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from island join d using (doc_id)),
n as (select doc_id, sum(b - a + 1) as n, count(*) as runs, string_agg(case when a > before + 1 then hex(array_slice(h, before + 1, a - 1)) else '' end, '' order by a)
  || case when max(b) < octet_length(any_value(h)) then hex(array_slice(any_value(h), max(b) + 1, octet_length(any_value(h)))) else '' end as kept from part group by doc_id)
select doc_id, octet_length(h)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(runs, 0)::bigint as n_spans, sha256(case when kept is null then h else unhex(kept) end) as kept_sha256 from d left join n using (doc_id)
"""
