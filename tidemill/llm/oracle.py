"""DuckDB SQL of the decontamination and Jaccard queries, written apart: windows and shingles as joined words, plain joins, a recursive
closure of the links."""

from __future__ import annotations

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LO = UP.lower()

DECONTAMINATION = rf"""
with w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LO}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
i as materialized (select item_id, regexp_extract_all(translate(text, '{UP}', '{LO}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark where item_id is not null and text is not null),
iw as materialized (select distinct item_id, least(10, len(words)) as n, array_to_string(words[pos:pos + least(10, len(words)) - 1], ' ') as k
  from (select item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) as pos from i where len(words) > 0)),
dw as (select doc_id, pos, n, array_to_string(words[pos:pos + n - 1], ' ') as k from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as pos from w, (select distinct n from iw))),
h as materialized (select doc_id, pos, dw.n, item_id from dw join iw on dw.n = iw.n and dw.k = iw.k),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as p from h) group by doc_id),
d as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by doc_id)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join c on c.doc_id = w.doc_id left join d on d.doc_id = w.doc_id
"""

JACCARD = rf"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LO}'), '[^\x20\x09-\x0D]+') as words from documents),
s as materialized (select distinct doc_id, hash(array_to_string(words[pos:pos + 3], ' ')) as x from (select doc_id, words, unnest(range(1, greatest(1, len(words) - 3) + 1)) as pos from w where len(words) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all),
l as materialized (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 85 * (na.n + nb.n - shared)),
r as (select doc_id as d, doc_id as c from w union select l.b as d, r.c from r join l on l.a = r.d)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(c) from r where r.d = w.doc_id) as component_id from w left join n on n.doc_id = w.doc_id
"""
