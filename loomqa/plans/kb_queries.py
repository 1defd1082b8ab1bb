"""Knowledge base and graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomqa.operators import kb as K, nested
from loomqa.plans.registry import query
from loomqa.plans.sqltext import RECORDS, sub
from loomqa.runtime import table

_SPANS = f"select distinct head, type, tail, url, span_start, span_end from {RECORDS} where head is not null and type is not null and tail is not null and url is not null and span_start is not null and span_end is not null"
_KBR = "(select kb_id, unnest(relations) r from kb)"
_W = lambda x: sub(sub(x, r"\s+", " "), "^ +| +$")


@query(f"select head, type, tail, url, span_start, span_end from ({_SPANS})")
def a11_u05_merged_relations(spark: SparkSession, d: str) -> DataFrame:
    return K.merged_spans(K.read_records(table(spark, d, "relation_spans")))


@query("select title, url, summary from (select e.key title, e.value.url url, e.value.summary summary, row_number() over (partition by e.key order by kb_id desc, e.value.url desc nulls last, e.value.summary desc nulls last) k from (select kb_id, unnest(map_entries(entities)) e from kb)) where k = 1")
def a12_last_entities(spark: SparkSession, d: str) -> DataFrame:
    e = nested.kb_entities(table(spark, d, "kb")).withColumn("seq", F.col("record_id"))
    return K.last_entities(e)


@query("select url, article_title, article_publish_date from (select *, row_number() over (partition by url order by registered_at, coalesce(article_title, '')) k from sources) where k = 1")
def a13_first_sources(spark: SparkSession, d: str) -> DataFrame:
    return K.first_sources(table(spark, d, "sources"))


@query(f"with alias as (select distinct e.key candidate from (select unnest(map_entries(entities)) e from kb)) select kb_id record_id, 'entity ' || h.candidate head, r.type, 'entity ' || t.candidate tail from {_KBR} join alias h on r.head = h.candidate join alias t on r.tail = t.candidate")
def j07_resolved_relations(spark: SparkSession, d: str) -> DataFrame:
    kb = table(spark, d, "kb")
    alias = nested.kb_entities(kb).select(F.col("title").alias("candidate")).distinct().withColumn("title", F.concat(F.lit("entity "), "candidate"))
    return K.resolved_relations(nested.kb_relations(kb).select("record_id", "head", "type", "tail"), alias)


@query(f"select head, type, tail, count(distinct url) n_urls from ({_SPANS} union select r.head, r.type, r.tail, m.key, s[1], s[2] from (select r, m, unnest(m.value.spans) s from (select r, unnest(map_entries(r.meta)) m from {_KBR})) where r.head is not null and r.type is not null and r.tail is not null and s[1] is not null and s[2] is not null) group by all")
def j08_union_of_bases(spark: SparkSession, d: str) -> DataFrame:
    names = ["head", "type", "tail", "url", "span_start", "span_end"]
    own = nested.kb_spans(table(spark, d, "kb")).select("head", "type", "tail", F.col("item_key").alias("url"), F.get("span", 0).alias("span_start"), F.get("span", 1).alias("span_end"))
    return K.united_spans(K.read_records(table(spark, d, "relation_spans")).select(*names), own).groupBy("head", "type", "tail").agg(F.count_distinct("url").alias("n_urls"))


_MARKED = "'  ' || replace(" + sub(sub("text", "<s>|<pad>|</s>"), r"\s+", " ") + ", ' ', '  ') || '  '"


@query(f"""
with t as (select doc_id, {_MARKED} t from documents),
p as (select doc_id, i, unnest(string_split(part, ' <subj> ')[2:]) piece, string_split(part, ' <subj> ')[1] h
      from (select doc_id, unnest(string_split(t, ' <triplet> ')[2:]) part, generate_subscripts(string_split(t, ' <triplet> ')[2:], 1) i from t)),
r as (select doc_id, {_W('h')} head, {_W("string_split(piece, ' <obj> ')[-1]")} as type, {_W("case when contains(piece, ' <obj> ') then string_split(piece, ' <obj> ')[1] else '' end")} tail from p)
select doc_id, head, type, tail from r where head <> '' and type <> '' and tail <> ''""")
def g01_triplets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(K.triplets(F.col("text"))))


_WIN = "w as (select doc_id, unnest(range(0, cast(ceil(n_chars / 128.0) as bigint))) i, n_chars t, cast(ceil(n_chars / 128.0) as bigint) n from documents where n_chars > 0), o as (select doc_id, i, n, cast(ceil((n * 128 - t) / greatest(n - 1, 1)) as bigint) v from w)"


@query(f"with {_WIN} select doc_id, cast(i as integer) window_n, cast(i * (128 - v) as integer) \"start\", cast(i * (128 - v) + 128 as integer) \"end\" from o")
def w04_token_windows(spark: SparkSession, d: str) -> DataFrame:
    from loomqa.operators.chunking import token_windows

    return table(spark, d, "documents").where("n_chars > 0").select("doc_id", F.inline(token_windows(F.col("n_chars"))))


_PARSED = f"""with t as (select doc_id, {_MARKED} t from documents),
p as (select doc_id, i, unnest(string_split(part, ' <subj> ')[2:]) piece, generate_subscripts(string_split(part, ' <subj> ')[2:], 1) j, string_split(part, ' <subj> ')[1] h
      from (select doc_id, unnest(string_split(t, ' <triplet> ')[2:]) part, generate_subscripts(string_split(t, ' <triplet> ')[2:], 1) i from t)),
r as (select doc_id, i, j, {_W('h')} head, {_W("string_split(piece, ' <obj> ')[-1]")} as type, {_W("case when contains(piece, ' <obj> ') then string_split(piece, ' <obj> ')[1] else '' end")} tail from p),
predicted as (select doc_id, head, type, tail, row_number() over (partition by doc_id order by i, j) - 1 prediction_n from r where head <> '' and type <> '' and tail <> '')"""


@query(f"{_PARSED}, {_WIN} select doc_id, prediction_n, head, type, tail, cast(i as integer) window_n, cast(i * (128 - v) as integer) \"start\" from predicted join o using (doc_id) where i = prediction_n // 3")
def g02_attributed_predictions(spark: SparkSession, d: str) -> DataFrame:
    """The triplets of a document's text as its predictions in order, each with the window it belongs to."""
    from loomqa.operators.chunking import token_windows

    docs = table(spark, d, "documents")
    windows = docs.where("n_chars > 0").select("doc_id", F.inline(token_windows(F.col("n_chars"))))
    made = docs.select("doc_id", F.posexplode(K.triplets(F.col("text"))).alias("prediction_n", "t")).select("doc_id", F.col("prediction_n").cast("long").alias("prediction_n"), "t.*")
    return K.attributed(made, windows).select("doc_id", "prediction_n", "head", "type", "tail", "window_n", "start")


_EDGES = f"(select distinct head src, tail dst, type label from {RECORDS} where head is not null and tail is not null and type is not null)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return K.read_records(table(spark, d, "relation_spans")).select(F.col("head").alias("src"), F.col("tail").alias("dst"), F.col("type").alias("label")).dropna().distinct()


@query(f"select src, dst, label from {_EDGES}")
def g04_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"select src node from {_EDGES} union select dst from {_EDGES}")
def g04_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select(F.explode(F.array("src", "dst")).alias("node")).distinct()


@query(f"""
with e as (select src a, dst b from {_EDGES}), s as (select a, b from e where a <> b union select b, a from e where a <> b),
x as (select min(src) node from {_EDGES}), one as (select distinct b from s, x where a = node), two as (select distinct s.b from s join one on s.a = one.b, x where s.b <> node)
select b node, 1 distance from one union select b, 2 from two where b not in (select b from one)""")
def g05_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """The neighbourhood of the graph's first source, up to two steps."""
    edges = _edges(spark, d)
    return K.neighbourhood(edges, edges.agg(F.min("src")).first()[0], 2)


_KB_SPANS = f"select r.head, r.type, r.tail, m.key url, s[1] span_start, s[2] span_end from (select r, m, unnest(m.value.spans) s from (select r, unnest(map_entries(r.meta)) m from {_KBR})) where r.head is not null and r.type is not null and r.tail is not null and s[1] is not null and s[2] is not null"


@query(f"{_SPANS} except {_KB_SPANS}")
def u06_new_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans that appending relation_spans to the base adds."""
    own = nested.kb_spans(table(spark, d, "kb")).select("head", "type", "tail", F.col("item_key").alias("url"), F.get("span", 0).alias("span_start"), F.get("span", 1).alias("span_end"))
    return K.new_spans(own, K.read_records(table(spark, d, "relation_spans")))


@query(f"select src node from {_EDGES} where label = 'part of' union select dst from {_EDGES} where label = 'part of'")
def g06_g07_edge_filter(spark: SparkSession, d: str) -> DataFrame:
    return K.edges_with(_edges(spark, d), F.col("label") == "part of")
