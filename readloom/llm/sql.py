"""DuckDB SQL that gives the same rows as some of the registered queries."""

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), grams as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from bw where len(w) > 0)
), sizes as (select distinct size from grams
), spots as (
  select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') as gram
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, sizes where len(w) >= size)
), hits as (select s.doc_id, s.i, s.size, g.item_id from spots s join grams g on s.size = g.size and s.gram = g.gram
), words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id
), items as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join words using (doc_id) left join items using (doc_id)
"""

ORACLES["op6_warc"] = """
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
         max(page_id) over (partition by coalesce(html, '')) as head from pages
)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> head then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> head then head end as refers_to from p
"""
