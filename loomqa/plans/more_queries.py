"""Further operators: formats, joins on similarity, and the streaming extension's batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomqa.functions import text as T
from loomqa.operators import dates
from loomqa.plans import pipeline, stand_ins
from loomqa.plans.registry import query
from loomqa.plans.sqltext import Q, dot, items, words
from loomqa.plans.text_queries import questions
from loomqa.runtime import materialize, table
from loomqa.functions.constants import STOP_WORDS



@query(Q + f"select question_id, list_sort(list_distinct(list_intersect({words('lower(question)')}, {words('lower(selected_ans)')}))) shared from q where question is not null and selected_ans is not null")
def u04_shared_words(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d, "question", "selected_ans").where("question is not null and selected_ans is not null")
    return q.select("question_id", F.sort_array(F.array_intersect(T.words(F.lower("question")), T.words(F.lower("selected_ans")))).alias("shared"))


@query(Q + f"select question_id, list_filter({words('lower(question)')}, lambda w: not list_contains({items(STOP_WORDS)}, w)) rest from q where question is not null")
def u08_without_stop_words(spark: SparkSession, d: str) -> DataFrame:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return questions(spark, d, "question").where("question is not null").select("question_id", F.filter(T.words(F.lower("question")), lambda w: ~F.array_contains(stop, w)).alias("rest"))



@query("select vec_id, list_transform(list_concat(list_transform(embedding[1:3], lambda x: cast(round(x * 10) as integer)), [0, 0, 0, 0, 0])[1:5], lambda x: case when x = 0 then -100 else x end) label_ids from embeddings")
def x16_padded_labels(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x * 10).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", pipeline.labels(ids, 5).alias("label_ids"))



@query("select event_type, count(*) n, date_trunc('hour', ts) as \"start\" from events where ts is not null group by all")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from loomqa.streaming.merge import windowed_counts

    return windowed_counts(table(spark, d, "events").where("ts is not null"))


@query(Q + ", r as (select article_id, question_id, rquge, use_question from q where use_question is not null) select use_question, count(*) n, sum(cast(rquge > 2.3 and not isnan(rquge) as integer)) good from r group by 1")
def pipeline_use_counts(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d, "article_id", "rquge", "use_question").where("use_question is not null")
    return q.groupBy("use_question").agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("rquge") > 2.3) & ~F.isnan("rquge")).cast("int")).alias("good"))


@query()
def pipeline_stages(spark: SparkSession, d: str) -> DataFrame:
    """The four stages in a chain, with stand-in models, over the questions generated from all sections and all
    of questions_df. A generated question's answers are stand-ins too: the first sentences of its chunk."""
    sections = table(spark, d, "sections").select("article_id", "section_n", "text").dropDuplicates(["article_id", "section_n"])
    made = pipeline.generated_questions(sections, stand_ins.stand_in_generator)
    sentences = F.slice(F.split("text", r"(?<=[.!?])\s+"), 1, 4)
    made = made.withColumns({"question_id": F.xxhash64("article_id", "section_n", "chunk_n", "question"), "answers": sentences, "short_answers": F.transform(sentences, lambda x: F.substring_index(x, " ", 3))})
    names = ["question_id", "article_id", "section_n", "text", "question", "answers", "short_answers"]
    chosen = pipeline.selected_answers(made.select(*names).unionByName(questions(spark, d, *names[1:])), stand_ins.stand_in_chooser)
    # the last stage reads its input twice: the models before it run once
    asked = materialize(pipeline.regenerated_questions(chosen, stand_ins.stand_in_negation, stand_ins.stand_in_regenerator))
    done = pipeline.diversified(asked, stand_ins.stand_in_encoder, stand_ins.stand_in_scorer)
    return done.select("question_id", "article_id", "section_n", "selected_ans", "details", "new_question", F.round("rquge", 6).alias("rquge"), "use_question")
