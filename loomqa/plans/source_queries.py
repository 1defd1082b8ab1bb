"""Sources held as text in the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomqa.plans.registry import query
from loomqa.plans.sqltext import Q, strip
from loomqa.plans.text_queries import questions
from loomqa.runtime import table
from loomqa.sources import readers


@query(Q + "select cast(question_id as varchar) qid, text context, question, list_filter(coalesce(answers, []), lambda a: a is not null) golds from q")
def s02_squad_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every question written as an evaluation file's JSON and read again."""
    golds = F.transform(F.filter(F.coalesce("answers", F.array().cast("array<string>")), lambda a: a.isNotNull()), lambda a: F.struct(a.alias("text")))
    qa = F.struct(F.col("question_id").cast("string").alias("id"), "question", golds.alias("answers"))
    one = F.struct(F.array(F.struct(F.array(F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))).alias("paragraphs"))).alias("data"))
    return questions(spark, d, "text", "question", "answers").select(F.inline(readers.squad_rows(F.to_json(one)))).select("qid", "context", "question", "golds")


@query(Q + "select cast(question_id as varchar) qid, selected_ans prediction from q")
def s03_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Every prediction written as a JSON object and read again as a map."""
    j = F.to_json(F.create_map(F.col("question_id").cast("string"), F.col("selected_ans")), {"ignoreNullFields": "false"})
    return questions(spark, d, "selected_ans").select(F.explode(F.from_json(j, "map<string,string>")).alias("qid", "prediction"))


@query(Q + "select question_id, replace(details, ',', ' ') as text, cast(rquge as float) label from q where rquge is not null and not isnan(rquge) and details is not null")
def s07_labelled_lines(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d, "details", "rquge").where("rquge is not null and not isnan(rquge) and details is not null")
    line = F.concat(F.replace("details", F.lit(","), F.lit(" ")), F.lit(","), F.col("rquge").cast("string"))
    return q.select("question_id", readers.labelled_line(line).alias("p")).select("question_id", "p.text", "p.label")


@query(f"with s as (select distinct article_id, section_n, '== Head ' || section_key || ' == ' || text || ' = End = z' t from sections where text is not null and section_key is not null) select article_id, section_n, len(regexp_split_to_array(t, '=+ [A-Z0-9].{{0,100}} =+')) n, {strip('list_last(regexp_split_to_array(t, chr(61) || chr(43) || chr(32) || chr(91) || ' + chr(39) + 'A-Z0-9].{0,100} =+' + chr(39) + '))')} as tail from s")
def s12_wiki_sections(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").where("text is not null and section_key is not null").select("article_id", "section_n", F.concat(F.lit("== Head "), "section_key", F.lit(" == "), "text", F.lit(" = End = z")).alias("t")).distinct()
    return s.select("article_id", "section_n", readers.wiki_sections(F.col("t")).alias("p")).select("article_id", "section_n", F.size("p").cast("long").alias("n"), F.element_at("p", -1).alias("tail"))
