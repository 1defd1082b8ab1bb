"""Nested records (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomqa.operators import nested
from loomqa.plans.registry import query
from loomqa.runtime import table


P4_SQL = """
with raw as (select distinct article_id id, payload p from article_json where payload is not null and json_valid(payload)),
top as (select id, case when json_type(p) = 'VARCHAR' then case when json_valid(json_extract_string(p, '$')) then json_extract_string(p, '$') end else p end j from raw),
sec as (select id, case when json_type(json_extract(j, '$.result.sections')) in ('OBJECT', 'ARRAY') then json_extract(j, '$.result.sections') else json_extract(j, '$.sections') end s from top where json_type(j) = 'OBJECT'),
named as (select id, pos - 1 pos, keys[pos] k, vals[pos] v from (
  select id, unnest(range(1, len(keys) + 1)) pos, keys, vals from (
    select id, json_keys(s) keys, [x for x in json_extract(s, '$.*')] vals from sec where json_type(s) = 'OBJECT'))),
listed as (select id, pos - 1 pos, json_extract_string(v, '$.key') k, v from (
  select id, unnest(range(1, len(vals) + 1)) pos, unnest(vals) v from (select id, [x for x in json_extract(s, '$[*]')] vals from sec where json_type(s) = 'ARRAY'))),
item as (select * from named union all select * from listed),
side as (
  select kind, id, pos, k, case when json_type(x) = 'OBJECT' then json_extract_string(x, '$.text') when json_type(x) <> 'NULL' then json_extract_string(x, '$') end t
  from (select 'summary' kind, id, pos, k, json_extract(v, '$.summary') x from item union all select 'original', id, pos, k, json_extract(v, '$.original') from item) where x is not null),
q as (select id, pos, k, c - 1 c, qs[c] q from (select id, pos, k, qs, unnest(range(1, len(qs) + 1)) c from (
  select id, pos, k, [x for x in json_extract(v, '$.questions[*]')] qs from item where json_type(json_extract(v, '$.questions')) = 'ARRAY'))),
asked as (select * from q where json_type(q) <> 'NULL'),
wrong as (select id, pos, k, c, l - 1 l, ds[l] x from (select id, pos, k, c, ds, unnest(range(1, len(ds) + 1)) l from (
  select id, pos, k, c, [x for x in json_extract(q, '$.distractors[*]')] ds from asked where json_type(json_extract(q, '$.distractors')) = 'ARRAY'))),
rel as (select distinct kb_id, i - 1 i, relations[i] r from (select kb_id, relations, unnest(range(1, len(relations) + 1)) i from kb)),
sp as (select kb_id, i, m.key u, k - 1 k, m.value.spans[k] x from (select kb_id, i, m, unnest(range(1, len(m.value.spans) + 1)) k from (select kb_id, i, unnest(map_entries(r.meta)) m from rel)))
select kind, id record_id, cast(pos as integer) item_pos, k item_key, 0 child_pos, 0 leaf_pos from side where t is not null
union select 'question', id, pos, k, c, 0 from asked
union select 'distractor', id, pos, k, c, l from wrong where json_type(x) = 'VARCHAR'
union select 'span', kb_id, i, u, k, 0 from sp where x is not null"""


@query(f"select kind, record_id, item_pos, item_key, cast(child_pos as integer) child_pos, cast(leaf_pos as integer) leaf_pos from ({P4_SQL})")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_leaves(table(spark, d, "article_json"), table(spark, d, "kb"))


@query()
def p4_sections(spark: SparkSession, d: str) -> DataFrame:
    return nested.article_sections(table(spark, d, "article_json").dropDuplicates(["article_id"]))


@query()
def p4_questions(spark: SparkSession, d: str) -> DataFrame:
    return nested.article_questions(table(spark, d, "article_json").dropDuplicates(["article_id"]))


@query("""
select kb_id record_id, cast(pos - 1 as integer) pos, r.head, r.type, r.tail, coalesce(cast(cardinality(r.meta) as integer), 0) n_urls
from (select kb_id, unnest(relations) r, generate_subscripts(relations, 1) pos from kb) where r is not null""")
def p4_relations(spark: SparkSession, d: str) -> DataFrame:
    return nested.kb_relations(table(spark, d, "kb"))


@query("select kb_id record_id, e.key title, e.value.url url, e.value.summary summary from (select kb_id, unnest(map_entries(entities)) e from kb)")
def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    return nested.kb_entities(table(spark, d, "kb"))
