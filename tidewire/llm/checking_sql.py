"""DuckDB SQL that gives the rows of the queries SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATION = rf"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), item_starts as (
  select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(1, len(w) - 9) + 1)) as p from item_words where len(w) > 0
), windows as (
  select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as run from item_starts
), lengths as (select distinct n from windows),
doc_starts as (
  select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as p from doc_words, lengths where len(w) >= n
), hits as (
  select doc_id, p, d.n, item_id from (select doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') as run from doc_starts) d join windows using (n, run)
), hit_words as (
  select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hits) group by 1
), hit_items as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id::varchar as item_id from hits) group by 1
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hit_words using (doc_id) left join hit_items using (doc_id)
"""

NEAR_VECTORS = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as l, b.vec_id as r from v a, v b
  where a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95
), reach(l, r) as (
  select vec_id, vec_id from embeddings union select reach.l, links.r from reach join links on reach.r = links.l
), component as (select l as vec_id, min(r) as component_id from reach group by 1),
degree as (select l as vec_id, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join component using (vec_id) left join degree using (vec_id)
"""


def url_verdicts(rules, reputation: str, limit: float) -> str:
    """SQL of the URL filter; the reputation text is the one that Spark runs."""
    listed = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    return rf"""
with parsed as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages)
), held as (
  select host, try_cast(regexp_extract(path, '/([0-9]+)$', 1) as bigint) as doc_id from parsed
), outcomes as (
  select doc_id, min(case when quality = 0 or toxic = 1 then 0 else 1 end) as good from labels
  where doc_id is not null and (quality is not null or toxic is not null) group by 1
), hosts as (
  select host, count(good) as n, coalesce(sum(good), 0) as k from held left join outcomes using (doc_id) group by 1
), known as ({reputation}),
rules(rule, rule_host, rule_path, verdict) as (values {listed}),
fitting as (
  select distinct host, path, rule, verdict, length(rule) as size from (select distinct host, path from parsed) as p, rules
  where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
), winners as (select host, path, arg_max(rule, size) as rule, arg_max(verdict, size) as verdict from fitting group by 1, 2)
select page_id, host, path, rule, coalesce(verdict, case when outcomes = 0 or bound >= {limit} then 'allow' else 'block' end) as verdict
from parsed join known using (host) left join winners using (host, path)
"""

FILL_IN_MIDDLE = """
with cuts as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
), draws as (
  select *, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from cuts
), formed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from draws
), parts as (
  select *, substring(t, 1, a) as prefix, substring(t, a + 1, b - a) as middle, substring(t, b + 1) as suffix from formed
)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then t else prefix || middle || suffix end) as restored_sha256
from parts
"""
