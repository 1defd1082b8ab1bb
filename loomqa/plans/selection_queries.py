"""Selections, windows, vectors, chunks, reports and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomqa.functions import similarity as S, text as T
from loomqa.operators import chunking, dates, select
from loomqa.operators.running import numbered
from loomqa.operators.vectors import nearest
from loomqa.plans.registry import query
from loomqa.plans.sqltext import Q, dot, sentences
from loomqa.plans.text_queries import questions
from loomqa.runtime import table
from loomqa.sources import readers, writers


@query(f"with v as (select vec_id, embedding from embeddings), x as (select a.vec_id as query, b.vec_id item, {dot('a.embedding', 'b.embedding')} dot from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0) select query, item, round(dot, 3) dot, cast(rnk as integer) rnk from (select *, row_number() over (partition by query order by round(dot, 9) desc, item) rnk from x) where rnk <= 10")
def j04_a08_m10_nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every row whose id is divisible by 20, against all rows."""
    e = table(spark, d, "embeddings")
    return nearest(e, "vec_id", "embedding", e.where("vec_id % 20 = 0"), 10).withColumn("dot", F.bround("dot", 3))


@query(f"select vec_id, round({dot('embedding', 'embedding')}, 3) as norm from embeddings")
def m10_dot_product(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(S.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))


@query()
def t03_greedy_diverse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("score", F.pmod(F.col("vec_id") * 37, F.lit(101)).cast("double"))
    return select.greedy_diverse(e, "label", "vec_id", "score", ["embedding"], [0.65], 35)


@query()
def t03_greedy_min_score(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("score", F.pmod(F.col("vec_id") * 37, F.lit(101)).cast("double"))
    return select.greedy_diverse(e, "label", "vec_id", "score", ["embedding"], [0.93], 35, least_score=40.0)


@query()
def t03b_greedy_three(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("score", -F.col("vec_id").cast("double"))
    return select.greedy_diverse(e, "label", "vec_id", "score", ["embedding"], [0.65], 3)


@query()
def t04_greedy_distractors(spark: SparkSession, d: str) -> DataFrame:
    return select.accept_in_order(questions(spark, d, "selected_ans", "answers"), "question_id", "selected_ans", "answers", select.unlike_distractors)


@query()
def t05_marginal_relevance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    target = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("target"))
    return select.marginal_relevance(e.join(target, "label"), "label", "vec_id", "embedding", "target")


@query(Q + ", f as (select * from (select article_id, question_id, selected_ans, rquge / 6 sim, row_number() over (partition by article_id, lower(selected_ans) order by question_id) k from q where selected_ans is not null and rquge is not null and not isnan(rquge)) where k = 1) select article_id, question_id, cast(rnk as integer) rnk from (select *, row_number() over (partition by article_id order by sim desc, question_id) rnk from f where sim > 0.3 and sim < 0.9) where rnk <= 20")
def t06_prj24_top_similar(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d, "article_id", "selected_ans", "rquge").where("selected_ans is not null and rquge is not null and not isnan(rquge)").withColumn("sim", F.col("rquge") / 6)
    return select.top_similar(q, "article_id", "selected_ans", "sim", 20, 0.3, 0.9, "question_id").select("article_id", "question_id", "rnk")


_SPANS = """with v as (select vec_id, embedding s, list_reverse(embedding) e from embeddings),
s as (select * from (select vec_id, i, x, row_number() over (partition by vec_id order by x desc, i) k from (select vec_id, unnest(s) x, generate_subscripts(s, 1) - 1 i from v)) where k <= 5),
e as (select * from (select vec_id, i, x, row_number() over (partition by vec_id order by x desc, i) k from (select vec_id, unnest(e) x, generate_subscripts(e, 1) - 1 i from v)) where k <= 5),
p as (select vec_id, s.i a, e.i b, cast(s.x as double) + cast(e.x as double) score, s.k sk, e.k ek from s join e using (vec_id) where e.i >= s.i and not (s.i >= 1 and s.i < 4) and not (e.i >= 1 and e.i < 4))
"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("s"), F.reverse("embedding").alias("e"))
    return e.withColumn("spans", select.best_spans(F.col("s"), F.col("e"), F.lit(4), 5))


@query(_SPANS + "select vec_id, cast(a as integer) \"start\", cast(b as integer) \"end\", round(score, 6) score from p")
def t07_j09_w05_best_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("vec_id", F.inline("spans")).withColumn("score", F.round("score", 6))


@query(_SPANS + ", m as (select vec_id, max(score) top from p where a > 0 group by 1) select v.vec_id, round(cast(s[1] as double) + cast(e[1] as double) - coalesce(top, cast(s[1] as double) + cast(e[1] as double)), 6) margin from v left join m using (vec_id)")
def m11_null_margin(spark: SparkSession, d: str) -> DataFrame:
    x = _spans(spark, d).withColumn("tokens", F.transform("s", lambda x, i: F.concat(F.lit("t"), i.cast("string"))))
    null = F.get("s", 0).cast("double") + F.get("e", 0).cast("double")
    return x.withColumn("answers", select.best_answers(F.col("spans"), F.col("tokens"), null, 5)).select("vec_id", F.round(select.null_margin(F.col("answers")), 6).alias("margin"))


@query("with x as (select vec_id, list_transform(embedding, lambda y: exp(cast(y as double) - cast(list_max(embedding) as double))) e from embeddings) select vec_id, round(e[1] / list_sum(e), 6) p0 from x")
def a22_softmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(select.softmax(F.transform("embedding", lambda x: x.cast("double"))), 0), 6).alias("p0"))


@query(Q + "select question_id, article_id, cast(row_number() over (partition by article_id order by rquge desc, question_id) as integer) rnk from q where rquge is not null and not isnan(rquge)")
def t01_t10_ranked_questions(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d, "article_id", "rquge").where("rquge is not null and not isnan(rquge)").withColumn("neg", -F.col("rquge"))
    return numbered(q, ["article_id"], ["neg", "question_id"]).select("question_id", "article_id", "rnk")


_RANKED = "coalesce(use_question and section_n_chunk is not null and not isnan(section_n_chunk) and rquge is not null and not isnan(rquge), false)"


@query(Q + f", r as (select article_id, section_n, question_id, cast(row_number() over (partition by article_id, section_n order by round(section_n_chunk * 10), rquge desc, question_id) as integer) rnk from q where {_RANKED}), a as (select article_id, unnest(range(0, max(section_n) + 1)) section_n from questions_df group by 1) select * from r union all select article_id, cast(section_n as integer), null, null from a where not exists (select 1 from r where r.article_id = a.article_id and r.section_n = a.section_n)")
def a09_a17_nested_result(spark: SparkSession, d: str) -> DataFrame:
    """The nested result flat, one row a question with its place: a section of any size is never one row.
    A section of 0 to an article's last that has no such question gives one row with null question_id and rnk."""
    q = questions(spark, d, "article_id", "section_n", "section_n_chunk", "rquge", "use_question")
    ranked = F.coalesce(F.expr("use_question and section_n_chunk is not null and not isnan(section_n_chunk) and rquge is not null and not isnan(rquge)"), F.lit(False))
    places = table(spark, d, "questions_df").groupBy("article_id").agg(F.max("section_n").alias("last"), F.collect_set(F.when(ranked, F.col("section_n"))).alias("filled")).where("last >= 0")
    empty = places.select("article_id", F.explode(F.array_except(F.sequence(F.lit(0), "last"), "filled")).alias("section_n"), F.lit(None).cast("long").alias("question_id"), F.lit(None).cast("int").alias("rnk"))
    q = q.where(ranked).withColumns({"chunk": F.round(F.col("section_n_chunk") * 10), "neg": -F.col("rquge")})
    return numbered(q, ["article_id", "section_n"], ["chunk", "neg", "question_id"]).select("article_id", "section_n", "question_id", "rnk").unionByName(empty)


@query(Q + "select distinct article_id, section_n, cast(round(10 * (section_n_chunk - section_n)) as integer) chunk_n from q where section_n_chunk is not null and not isnan(section_n_chunk)")
def a19_u01_distinct_chunks(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions_df").where("section_n_chunk is not null and not isnan(section_n_chunk)")
    return q.select("article_id", "section_n", F.round(10 * (F.col("section_n_chunk") - F.col("section_n"))).cast("int").alias("chunk_n")).distinct()



@query(Q + "select mode_of, selected_ans from (select article_id mode_of, selected_ans, row_number() over (partition by article_id order by count(*) desc, selected_ans) k from q where selected_ans is not null group by 1, 2) where k = 1")
def a06_mode(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d, "article_id", "selected_ans").where("selected_ans is not null")
    counted = q.groupBy("article_id", "selected_ans").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy(F.col("article_id").alias("mode_of")).agg(F.min_by("selected_ans", F.struct((-F.col("c")).alias("c"), "selected_ans")).alias("selected_ans"))


@query("select * from (select distinct on (article_id, section_n) article_id, section_n, text from sections) where section_n < 3")
def prj06_section_head(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").select("article_id", "section_n", "text").where("section_n < 3").dropDuplicates(["article_id", "section_n"])


@query("select distinct article_id, section_n from sections where len(list_filter(regexp_split_to_array(text, '[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+'), lambda w: w <> '')) > 60")
def prj05_section_min_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").where(chunking.enough_words(F.col("text"), 60)).select("article_id", "section_n").distinct()


@query()
def prj01_prj02_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select("article_id", "section_n", "text").dropDuplicates(["article_id", "section_n"])
    return chunking.section_chunks(s, ["article_id", "section_n"], "text", 120)


@query()
def prj03_overlapping_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").select("article_id", "section_n", "text").dropDuplicates(["article_id", "section_n"]).where("text is not null")
    return s.select("article_id", "section_n", F.posexplode(chunking.overlapping_chunks(F.lit("What is it"), F.col("text"), 60)).alias("chunk_n", "chunk"))


_MARKED = "left(text, instr(text, selected_ans) - 1) || '@ANS_BEGIN@' || selected_ans || '@ANS_END@' || substr(text, instr(text, selected_ans) + length(selected_ans))"


@query(Q + f""", m as (select question_id, text, selected_ans a, {sentences(_MARKED)} s from q where text is not null and selected_ans is not null),
i as (select *, list_position(list_transform(s, lambda x: contains(x, '@ANS_BEGIN@')), true) k from m),
j as (select *, list_transform(s, lambda x, n: case when n = k then '@SENT_BEGIN@' || x || '@SENT_END@' else x end)[greatest(k - 2, 1):k + 2] shown from i)
select question_id, case when a <> '' and contains(text, a) and k > 0 then array_to_string(shown, ' ') else text end context from j""")
def w06_f11_answer_context(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d, "text", "selected_ans").where("text is not null and selected_ans is not null").select("question_id", chunking.answer_context(F.col("text"), F.col("selected_ans")).alias("context"))


@query(Q + f", s as (select question_id, length(selected_ans) n, {sentences('text')} x from q), u as (select question_id, n, list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(x[1:i], lambda y: length(y)))) c from s), b as (select question_id, list_transform(c, lambda v: abs(v - n)) d from u) select question_id, cast(coalesce(case when d[1] is null then case when len(d) > 0 then 1 end else list_position(d, list_min(d)) end, 0) as integer) n from b")
def w07_nearest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d, "text", "selected_ans").select("question_id", chunking.nearest_prefix(T.sentences(F.col("text")), F.char_length("selected_ans")).alias("n"))


@query(r"""select article_id, section_n, unnest([question_id]) question_id from (
  select q.question_id, s.article_id, s.section_n, row_number() over (partition by q.question_id order by s.section_n) k
  from (select distinct on (question_id) * from questions_df) q join (select distinct article_id, section_n, text from sections where text is not null) s on q.article_id = s.article_id and contains(s.text, q.text)
  where q.text is not null and q.text <> '') where k = 1""")
def prj23_j11_source_section(spark: SparkSession, d: str) -> DataFrame:
    """The first section of its article that holds a question's text. Articles' sections go by article, hot ones split by AQE; containment never crosses articles."""
    q = questions(spark, d, "article_id", "text").where("text is not null and text <> ''")
    chunk = q.groupBy("article_id", "text").agg(F.count(F.lit(1)).alias("n")).select("article_id", "text")
    s = table(spark, d, "sections").where("text is not null").select("article_id", "section_n", F.col("text").alias("original")).distinct()
    found = chunk.join(s, "article_id").where(F.contains("original", "text")).groupBy("article_id", "text").agg(F.min("section_n").alias("section_n"))
    return q.join(found, ["article_id", "text"]).select("question_id", "article_id", "section_n")


_DASHES = "repeat('-', 50)"


@query(rf"select doc_id, regexp_extract(b, '(?:^|\n)Q:([^\n]*)\nA:', 1) question, regexp_extract(b, '(?:^|\n)Q:[^\n]*\nA:([^\n]*)', 1) answer from (select doc_id, unnest(string_split(text, {_DASHES})) b from documents) where regexp_extract(b, '(?:^|\n)Q:([^\n]*)\nA:', 1) <> ''")
def s15_report_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(readers.report_pairs(F.col("text"))))


@query(r"select doc_id, regexp_extract(b, 'TAKEN\?(True|False)', 1) taken, regexp_extract(b, 'RQUGE:([0-9.]+)', 1) score, regexp_extract(b, 'Q1:([^\n]*)', 1) question, regexp_extract(b, 'Best ans: ([^\n]*)', 1) answer, case when contains(b, chr(10) || 'Text:') then string_split(b, chr(10) || 'Text:')[-1] else '' end as text from (select doc_id, unnest(string_split(text, repeat(chr(10), 4))) b from documents) where regexp_extract(b, 'Q1:([^\n]*)', 1) <> ''")
def s16_full_report_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(readers.full_report_blocks(F.col("text"))))


_SECTIONS = "string_split(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not starts_with(x, 'TEXT:')), chr(10)), chr(10) || 'section')"


@query(rf"select doc_id, array_to_string(list_filter({_SECTIONS}, lambda s: not regexp_matches(s, '(?:^|\n)[ \t\r\f\v]*\[\][ \t\r\f\v]*\n[ \t\r\f\v]*\[\][ \t\r\f\v]*$')), chr(10) || 'section') kept from documents")
def s17_without_text_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", readers.without_text_lines(F.col("text")).alias("kept"))


@query("select url from (select distinct url from sources) order by url limit 50")
def s14_u02_links(spark: SparkSession, d: str) -> DataFrame:
    return readers.links(table(spark, d, "sources"), "url", 50)


@query(r"with s as (select distinct article_id, section_n, text from sections where text is not null) select article_id, section_n, 'generate questions: ' || regexp_replace(text, '^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$', '', 'g') context, 'Why? {sep_token} How? {sep_token}' questions from s")
def s04_d21_training_rows(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sections").where("text is not null").select("article_id", "section_n", "text").distinct()
    return s.select("article_id", "section_n", *readers.training_row(F.col("text"), F.array(F.lit("Why?"), F.lit("How?"))))



@query(Q + "select question_id, array_to_string(list_transform(list_filter([['P', question], ['I', details], ['P', selected_ans]], lambda e: e[1] <> 'I'), lambda e: e[2]), ' ') as text from q where question is not null and selected_ans is not null")
def s10_element_text(spark: SparkSession, d: str) -> DataFrame:
    e = lambda tag, c: F.struct(F.lit(tag).alias("tag"), F.col(c).alias("text"))
    return questions(spark, d, "question", "details", "selected_ans").where("question is not null and selected_ans is not null").select("question_id", T.elements_text(F.array(e("P", "question"), e("I", "details"), e("P", "selected_ans"))).alias("text"))


@query(Q + f"select question_id, 'Q:' || question || chr(10) || 'A:' || selected_ans || chr(10) || {_DASHES} line from q")
def k02_question_lines(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d, "question", "selected_ans").select("question_id", writers.question_lines(F.col("question"), F.col("selected_ans")).alias("line"))



@query(Q + "select question_id, 'section ' || section_n || ' - (' || question_id || ') ' || question || ' --- ' || selected_ans || chr(10) || '[' || array_to_string(list_transform(list_filter(short_answers, lambda x: x is not null), lambda x: '''' || x || ''''), ', ') || ']' line from q")
def k05_distractor_line(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d, "section_n", "question", "selected_ans", "short_answers")
    return q.select("question_id", writers.distractor_line(F.col("section_n"), F.col("question_id"), F.col("question"), F.col("selected_ans"), F.filter("short_answers", lambda x: x.isNotNull())).alias("line"))



@query(Q + "select question_id, case when len(a) > 0 then a when len(s) > 0 then s else [] end chosen from (select question_id, list_filter(answers, lambda x: x is not null and length(x) > 30) a, list_filter(short_answers, lambda x: x is not null) s from q)")
def x_cascade(spark: SparkSession, d: str) -> DataFrame:
    a = F.filter("answers", lambda x: x.isNotNull() & (F.char_length(x) > 30))
    s = F.filter("short_answers", lambda x: x.isNotNull())
    return questions(spark, d, "answers", "short_answers").select("question_id", select.cascade(F.lit(None).cast("array<string>"), a, s).alias("chosen"))



@query("select o_orderkey, regexp_extract_all(strftime(o_orderdate, '%d %B %Y, %H:%M'), '[0-9]+|[A-Za-z]+|[!-/:-@\\[-`{-~]+|\\s+|.') tokens from orders")
def e01_date_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.tokens(F.date_format("o_orderdate", "dd MMMM yyyy, HH:mm")).alias("tokens"))


_FORMATS = (("iso", "yyyy-MM-dd"), ("us", "M/d/yyyy"), ("long", "MMMM d, yyyy"), ("rfc", "d MMM yyyy"), ("german", "d.M.yy"), ("stamp", "yyyy-MM-dd'T'HH:mm:ss"))


@query("select * from (values ('iso', '%Y-%m-%d'), ('us', '%m/%d/%Y'), ('long', '%B %d, %Y'), ('rfc', '%d %b %Y'), ('german', '%d.%m.%y'), ('stamp', '%Y-%m-%dT%H:%M:%S')) t(name, format) where exists (select 1 from orders)")
def e08_inferred_formats(spark: SparkSession, d: str) -> DataFrame:
    """All order dates rendered in each of six formats; the formats are found again."""
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.date_format("o_orderdate", p).alias("example")) for n, p in _FORMATS]))
    x = table(spark, d, "orders").where("o_orderdate is not null").select(made.alias("x")).select("x.*")
    return dates.inferred_formats(x, "name", "example")



@query("select label, vec_id from (select label, vec_id, row_number() over (partition by label order by vec_id) k, count(*) over (partition by label) n from embeddings) where k <= floor(0.3 * n)")
def t13_top_share(spark: SparkSession, d: str) -> DataFrame:
    e = numbered(table(spark, d, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"], "k")
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return e.join(n, "label").where(F.col("k") <= F.floor(0.3 * F.col("n"))).select("label", "vec_id")
