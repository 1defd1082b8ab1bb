"""Operators over annotations, with the tables' own columns as the annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomqa.functions import text as T
from loomqa.operators import annotations as A
from loomqa.operators.kb import read_records
from loomqa.plans.registry import query
from loomqa.plans.sqltext import Q, items, words
from loomqa.plans.text_queries import questions
from loomqa.runtime import table

_WIN = "select rel_id, span_start s, span_end e from relation_spans where span_start is not null and span_end is not null"


@query(f"select rel_id, cast(case when e <= 300 then 0 when s >= 250 and e <= 600 then 1 when s >= 500 then 2 end as integer) sentence_n from ({_WIN})")
def j10_a10_sentence_of_span(spark: SparkSession, d: str) -> DataFrame:
    bounds = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 300), (250, 600), (500, 1 << 30))])
    x = table(spark, d, "relation_spans").where("span_start is not null and span_end is not null")
    return x.select("rel_id", A.sentence_of(bounds, F.col("span_start"), F.col("span_end")).alias("sentence_n"))


@query("select vec_id, round(sqrt(list_sum(list_transform(list_filter(embedding, lambda x: x <= 0), lambda x: power(abs(cast(x as double)) / list_sum(list_transform(embedding, lambda y: abs(cast(y as double)))), 2)))), 6) distance from embeddings")
def a24_sentence_distance(spark: SparkSession, d: str) -> DataFrame:
    ranks = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.round(A.sentence_distance(ranks, F.transform("embedding", lambda x: x > 0)), 6).alias("distance"))





@query(Q + f"select question_id, list_transform(['7', '8'], lambda v: array_to_string(list_transform(regexp_split_to_array(selected_ans, '\\s+'), lambda w: case when w = 'the' then v else w end), ' ')) variants from q where selected_ans is not null")
def x_number_variants(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d, "selected_ans").where("selected_ans is not null").select("question_id", A.number_variants(F.col("selected_ans"), F.lit("the"), F.array(F.lit("7"), F.lit("8"))).alias("variants"))


@query(f"select article_id, section_n, cast(rnk as integer) rnk from (select *, row_number() over (partition by article_id order by r desc, section_n) rnk from (select distinct article_id, section_n, len({words('text')}) t, length(text) r from sections where text is not null) where t between 10 and 200) where rnk <= 3")
def prj16_t10_ranked_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").where("text is not null").select("article_id", F.col("section_n").alias("sentence_n"), T.word_count(F.col("text")).alias("tokens"), F.char_length("text").alias("rank")).distinct()
    return A.relevant_sentences(s, "article_id", 10, 200, 3).select("article_id", F.col("sentence_n").alias("section_n"), "rnk")
