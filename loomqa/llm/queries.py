"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomqa.llm import bpe, canonical, defects, leakage, mojibake, neardup, splitting, topn
from loomqa.plans.pipeline import labels
from loomqa.runtime import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions_df")
    chunk = F.when(~F.isnan("section_n_chunk"), F.round(F.col("section_n_chunk") * 10).cast("long"))
    top = topn.top_n(q.select("article_id", chunk.alias("chunk"), "question_id", "rquge", "question_ppl"), "article_id", "chunk", "question_id", "rquge", "question_ppl", 3)
    return top.select(F.col("item").alias("question_id"), "rnk")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.main_defect(defects.defect_labels(table(spark, d, "questions_df")))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    return defects.defect_labels(table(spark, d, "questions_df")).select("question_id", F.explode("labels").alias("l")).select("question_id", "l.defect", "l.posterior")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.similar_pairs(table(spark, d, "questions_df"), "question_id", ["question", "selected_ans"], 0.75)
    return pairs.select(F.col("a").alias("question_id_a"), F.col("b").alias("question_id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.linked_classes(table(spark, d, "questions_df"), "question_id", ["question", "selected_ans"], 0.75).withColumnRenamed("key", "question_id")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    links = neardup.representative_links(table(spark, d, "questions_df"), "question_id", ["question", "selected_ans"], 0.75)
    return links.select(F.col("a").alias("question_id_a"), F.col("b").alias("question_id_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_copies(table(spark, d, "relation_spans"), least_copies=2).where("first_rel_id < rel_id").select("first_rel_id", "rel_id")


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return canonical.canonical_copies(table(spark, d, "relation_spans")).where("first_rel_id = rel_id").select("first_rel_id", "n_copies")


def p5_nested_copies(spark: SparkSession, d: str) -> DataFrame:
    """Each relation of the bases with the first one that equals it but for formatting."""
    r = table(spark, d, "kb").select("kb_id", F.posexplode("relations").alias("pos", "r")).where("r is not null")
    r = r.select(F.concat_ws(":", F.col("kb_id").cast("string"), "pos").alias("relation"), "r.*")
    names = ("head", "type", "tail")
    r = r.withColumn("leaves", canonical.composed(*map(F.col, names))).withColumns({c: F.get("leaves", i) for i, c in enumerate(names)})
    return canonical.record_copies(r, "relation", ["head", "type", "tail"])


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select(F.lit("sections").alias("table_name"), "article_id", "section_n", F.lit(0).alias("chunk_n"), "text")
    chunk = F.round(10 * (F.col("section_n_chunk") - F.col("section_n"))).cast("int")
    q = table(spark, d, "questions_df").where("section_n_chunk is not null and not isnan(section_n_chunk)").select(F.lit("questions_df").alias("table_name"), "article_id", "section_n", chunk.alias("chunk_n"), "text")
    # a chunk's text stands on each of its questions: one copy is kept, combined before the shuffle
    texts = s.unionByName(q).where(F.char_length("text") > 1500).distinct()
    return splitting.split_oversized(texts, ["table_name", "article_id", "section_n", "chunk_n"], "text", 1500, 200)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_n = 0").select("table_name", "article_id", "section_n", "chunk_n").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p7_ids(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text", vocabulary)


def p7_decoded(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.decode_corpus(p7_ids(spark, d, vocabulary), "doc_id", "ids", vocabulary)


def x16_document_labels(spark: SparkSession, d: str, length: int = 512) -> DataFrame:
    """Labels of a fixed length of each document's real token ids. Every id from 0 on is a token, so -1 pads."""
    return p7_ids(spark, d).select("doc_id", labels(F.col("ids"), length, pad=-1).alias("label_ids"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", 12)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_documents(_leaks(spark, d))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", 12)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, d, "documents"), "doc_id", "text").select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_labels, p3_found, p3_classes, p3_links, p5_found, p5_collapsed, p5_nested_copies, p6_found, p6_pieces, p7_ids, p7_decoded, x16_document_labels, p8_found, p8_spans, p8_cleaned, p9_found, p9_restored)}


_NORMAL = r"regexp_replace(regexp_replace(lower(nfc_normalize({c})), '(^|[^\p{{L}}\p{{M}}])\p{{M}}+', '\1', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
_COPIES = r"""
with p as (
  select rel_id, record is not null and ltrim(record)[1] = '{' as js, record,
         head, type, tail from relation_spans),
f as (
  select rel_id,
    case when record is null then head when js then json_extract_string(record, '$.head') else regexp_extract(record, '(?i)(?:^|[\n|;])\s*head\s*[:=]([^\n|;]*)', 1) end h,
    case when record is null then type when js then json_extract_string(record, '$.type') else regexp_extract(record, '(?i)(?:^|[\n|;])\s*type\s*[:=]([^\n|;]*)', 1) end t,
    case when record is null then tail when js then json_extract_string(record, '$.tail') else regexp_extract(record, '(?i)(?:^|[\n|;])\s*tail\s*[:=]([^\n|;]*)', 1) end l
  from p),
n as (
  select distinct rel_id, """ + ", ".join(f"{_NORMAL.format(c=x)} {x}" for x in "htl") + """
  from f),
c as (
  select rel_id, min(rel_id) over (partition by h, t, l) first_rel_id, count(*) over (partition by h, t, l) n_copies
  from n where h <> '' and t <> '' and l <> '')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
with r as (
  select distinct question_id, article_id, cast(round(section_n_chunk * 10) as bigint) chunk, rquge, question_ppl
  from questions_df
  where rquge is not null and not isnan(rquge) and section_n_chunk is not null and not isnan(section_n_chunk))
select question_id, cast(rnk as integer) rnk
from (select question_id, row_number() over (partition by article_id, chunk order by rquge desc, question_ppl asc nulls last, question_id) rnk from r)
where rnk <= 3""",
        "p3_found": r"""
with q as (select distinct question_id, lower(coalesce(question, '')) || ' ' || lower(coalesce(selected_ans, '')) t from questions_df),
w as (select distinct question_id, unnest(regexp_extract_all(t, '[\p{L}\p{N}]+')) word from q),
f as (select word, count(*) df from w group by 1),
r as (select question_id, word, row_number() over (partition by question_id order by df, word) k, count(*) over (partition by question_id) n from w join f using (word)),
p as (select question_id, word, n from r where k <= n - ceil(0.75 * n) + 1),
s as (select question_id, list(word) ws, count(*) n from w group by 1),
c as (select distinct a.question_id a, b.question_id b from p a join p b on a.word = b.word and a.question_id < b.question_id and b.n >= 0.75 * a.n and a.n >= 0.75 * b.n),
x as (select a, b, l.n + r.n n, len(list_intersect(l.ws, r.ws)) common from c join s l on l.question_id = a join s r on r.question_id = b)
select a question_id_a, b question_id_b from x where common >= 0.75 * (n - common)""",
        "p5_found": _COPIES + "select first_rel_id, rel_id from c where first_rel_id < rel_id",
        "p5_collapsed": _COPIES + "select first_rel_id, n_copies from c where first_rel_id = rel_id",
        "p5_nested_copies": f"""
with r as (select kb_id || ':' || (generate_subscripts(relations, 1) - 1) relation, unnest(relations) r from kb),
n as (select relation, {", ".join(f"{_NORMAL.format(c=f'r.{x}')} {x}" for x in ('head', 'type', 'tail'))} from r where r is not null)
select relation, min(relation) over (partition by head, type, tail) first_key, count(*) over (partition by head, type, tail) n_copies from n""",
        "p6_found": """
select distinct 'sections' table_name, article_id, section_n, 0 chunk_n from sections where length(text) > 1500
union all
select distinct 'questions_df', article_id, section_n, cast(round(10 * (section_n_chunk - section_n)) as integer)
from questions_df where length(text) > 1500 and section_n_chunk is not null and not isnan(section_n_chunk)""",
        "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
        "p8_found": r"""
with dw as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where text is not null),
iw as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from eval_items where text is not null),
i12 as (select distinct item_id, array_to_string(w[k : k + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) k from iw where len(w) >= 12)),
d12 as (select distinct doc_id, array_to_string(w[k : k + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) k from dw where len(w) >= 12)),
shorts as (select item_id, ' ' || array_to_string(w, ' ') || ' ' g from iw where len(w) between 1 and 11)
select doc_id, item_id from d12 join i12 using (g)
union
select doc_id, item_id from (select doc_id, ' ' || array_to_string(w, ' ') || ' ' t from dw) d join shorts on contains(d.t, g)""",
    }
