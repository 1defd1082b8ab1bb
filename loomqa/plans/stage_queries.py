"""Formats, options, reports, resolved texts and selections over whole tables, each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomqa.functions import similarity as S, text as T
from loomqa.operators import annotations as A, dates, qa_eval, select
from loomqa.operators.kb import read_records
from loomqa.operators.running import numbered
from loomqa.plans import pipeline, stand_ins
from loomqa.plans.registry import query
from loomqa.plans.sqltext import Q, RECORDS, SP, dot, items, strip, sub, tokens, words
from loomqa.plans.text_queries import questions
from loomqa.runtime import table
from loomqa.sources import readers, writers

_TOKEN = "'[0-9]+|[A-Za-z]+|[!-/:-@\\[-`{-~]+|\\s+|.'"
_STAMP = "strftime(o_orderdate, '%A %-d %B %Y %I:%M %p')"


def _stamp(c: str = "o_orderdate"):
    return F.date_format(c, "EEEE d MMMM yyyy hh:mm a")


def _elements(t: str) -> str:
    """SQL list of the elements that a token can be, in order of restriction."""
    number = f"try_cast(case when regexp_matches({t}, '^[0-9]{{1,9}}$') then {t} end as integer)"
    test = {e: f"{number} between {a} and {b}" for e, (a, b) in dates.NUMBERS.items()}
    test |= {"%Y": f"regexp_matches({t}, '^[0-9]{{4}}$')", "%z": f"regexp_matches({t}, '^[0-9]{{4}}$')", "%Z": f"list_contains({items(dates._zones())}, {t})"}
    test |= {e: f"list_contains({items(w)}, {t})" for e, w in dates.WORDS.items()}
    return "list_filter([" + ", ".join(f"case when {test[e]} then '{e}' end" for e in dates.ORDER) + "], lambda x: x is not null)"


_TOKENS = f"(select o_orderpriority kind, unnest(regexp_extract_all({_STAMP}, {_TOKEN})) token from orders where o_orderdate is not null)"


@query(f"select token, count(*) n, {_elements('token')} elements from {_TOKENS} group by token")
def e02_element_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Every token of all order dates, written out, with the elements it can be."""
    t = table(spark, d, "orders").where("o_orderdate is not null").select(F.explode(dates.tokens(_stamp())).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", "n", dates.elements_of(F.col("token")).alias("elements"))


@query(f"with t as (select kind, {_elements('token')} can from {_TOKENS}), e as (select unnest({items(dates.ORDER)}) element) select kind, element, round(avg(cast(list_contains(can, element) as double)), 6) share from t, e group by all")
def a07_match_share(spark: SparkSession, d: str) -> DataFrame:
    """For each priority the share of its orders' date tokens that each element matches."""
    t = table(spark, d, "orders").where("o_orderdate is not null").select(F.col("o_orderpriority").alias("kind"), F.explode(dates.tokens(_stamp())).alias("token"))
    return dates.match_shares(t, "kind", "token").withColumn("share", F.round("share", 6))


@query("select o_orderkey, case when day(o_orderdate) <= 12 then '%m' when day(o_orderdate) <= 23 then '%H' else '%d' end day_element, case when year(o_orderdate) >= 1000 then '%Y' end year_element from orders where o_orderdate is not null")
def t14_most_restrictive(spark: SparkSession, d: str) -> DataFrame:
    """The most restrictive element that a date's day, and its year, can be."""
    of = lambda c: dates.most_restrictive(F.reverse(dates.elements_of(c.cast("string"))))
    return table(spark, d, "orders").where("o_orderdate is not null").select("o_orderkey", of(F.dayofmonth("o_orderdate")).alias("day_element"), of(F.year("o_orderdate")).alias("year_element"))


_MOVED = "cast(o_orderdate + to_days(i) as date)"


@query(f"""
with c as (select o_orderkey, o_orderkey % 3 = 0 as every, day(o_orderdate) <= 12 low, i, day({_MOVED}) <= 12 low2, strftime({_MOVED}, '%Y-%m-%d') iso, strftime({_MOVED}, '%m/%d/%Y') us
           from orders, (select unnest([0, 7, 15, 40]) i) where o_orderdate is not null),
k as (select o_orderkey, i, 0 j, iso t from c where every or low = low2 union all select o_orderkey, i, 1, us from c where every)
select o.o_orderkey, coalesce(x.kept, []) kept from orders o left join (select o_orderkey, list(t order by i, j) kept from k group by 1) x using (o_orderkey) where o.o_orderdate is not null""")
def e09_same_format(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the format of the order's date; a day up to 12 may be a month, so its text is read as another format."""
    o = table(spark, d, "orders").where("o_orderdate is not null")
    moved = [F.date_add("o_orderdate", i) for i in (0, 7, 15, 40)]
    candidates = F.array(*[F.date_format(m, p) for m in moved for p in ("yyyy-MM-dd", "MM/dd/yyyy")])
    kind = F.when(F.col("o_orderkey") % 3 == 0, "TIME").otherwise("DATE")
    return dates.same_format(o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("answer"), candidates.alias("candidates"), kind.alias("kind")), "o_orderkey", "answer", "candidates", "kind")


@query(Q + "select question_id, list_transform(list_sort(list_filter(list_transform(answers, lambda x, i: {'s': -(length(x) % 7), 'i': i, 't': x}), lambda o: coalesce(" + strip("o.t") + ", '') <> '')), lambda o: o.t) options from q where answers is not null")
def t08_answer_options(spark: SparkSession, d: str) -> DataFrame:
    """Options that are not blank by a score, here the length's rest by seven, so that many are equal."""
    scored = F.transform("answers", lambda x: F.struct(x.alias("text"), (F.char_length(x) % 7).alias("score")))
    return questions(spark, d, "answers").where("answers is not null").select("question_id", select.ranked_options(scored).alias("options"))


_PPL = f"exp(-length(x) / greatest(len({words('x')}), 1))"


@query(Q + f", a as (select question_id, unnest(answers) x, generate_subscripts(answers, 1) - 1 pos from q) select question_id, cast(pos as integer) pos, round({_PPL}, 9) ppl from a where x is not null")
def a21_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """The perplexity of each output, with its length as a stand-in of the log-likelihood."""
    a = questions(spark, d, "answers").select("question_id", F.posexplode("answers").alias("pos", "x")).where("x is not null")
    return a.select("question_id", "pos", F.round(T.perplexity(-F.char_length("x"), F.col("x")), 9).alias("ppl"))


@query(Q + f", a as (select question_id, unnest(answers) x, generate_subscripts(answers, 1) pos from q) select question_id, list(x order by round({_PPL}, 12), pos) outputs from a where x is not null group by 1")
def t02_sorted_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs by perplexity ascending; rows without any output are left out."""
    kept = F.filter("answers", lambda x: x.isNotNull())
    scored = F.transform(kept, lambda x: F.struct(x.alias("text"), F.round(T.perplexity(-F.char_length(x), x), 12).alias("ppl")))
    return questions(spark, d, "answers").where(F.size(kept) > 0).select("question_id", select.by_perplexity(scored).alias("outputs"))


@query(Q + """, w as (select question_id, q.text, length(q.text) n, unnest(answers) a, generate_subscripts(answers, 1) p from q where q.text is not null),
s as (select question_id, n, p, instr(text, a) - 1 s, instr(text, a) - 1 + length(a) e from w where a is not null and a <> '' and instr(text, a) > 0)
select question_id, cast(s // 200 as integer) sentence_n, list(cast(s as integer) order by p) starts from s where e <= (s // 200 + 1) * 200 group by 1, 2""")
def a10_spans_by_sentence(spark: SparkSession, d: str) -> DataFrame:
    """Where a question's answers stand in its text, by the window of 200 characters that holds them."""
    q = questions(spark, d, "text", "answers").where("text is not null")
    windows = F.transform(F.sequence(F.lit(0), F.floor(F.char_length("text") / 200).cast("int")), lambda k: F.struct((k * 200).alias("start"), (k * 200 + 200).alias("end")))
    at = lambda a: F.position(a, F.col("text")) - 1
    spans = F.transform(F.filter("answers", lambda a: a.isNotNull() & (a != "") & F.contains(F.col("text"), a)), lambda a: F.struct(at(a).alias("start"), (at(a) + F.char_length(a)).alias("end")))
    grouped = A.spans_by_sentence(q.select("question_id", windows.alias("windows"), spans.alias("spans")), "question_id", "spans", "windows")
    return grouped.select("question_id", "sentence_n", F.transform("spans", lambda s: s.start.cast("int")).alias("starts"))


@query(Q + "select article_id, min(question_id) as \"first\", max(question_id) as \"last\", count(*) n from (select article_id, question_id, row_number() over (order by question_id) - row_number() over (partition by article_id order by question_id) run from q where article_id is not null) group by article_id, run")
def a17_runs_of_articles(spark: SparkSession, d: str) -> DataFrame:
    """Runs of questions of the same article that follow one another by id."""
    return select.islands(questions(spark, d, "article_id"), "article_id", "question_id")


_HELD = "len(list_filter(w, lambda x: list_contains(c, x)))"
_VARIANTS = "select question_id, text, '{kind}' kind, unnest({c}) variant, generate_subscripts({c}, 1) - 1 pos from q"


@query(Q + f", v as ({_VARIANTS.format(kind='long', c='answers')} union all {_VARIANTS.format(kind='short', c='short_answers')}), w as (select *, {words('lower(variant)')} w, coalesce({words('lower(text)')}, []) c from v where variant is not null) select question_id, kind, cast(pos as integer) pos, variant, round(1 + 4 * {_HELD} / greatest(len(w), 1), 6) score from w")
def a10_a18_variants(spark: SparkSession, d: str) -> DataFrame:
    """A score of each of a question's answer variants, four long and four short at most, by a stand-in scorer."""
    q = questions(spark, d, "text", "question", "answers", "short_answers")
    return pipeline.variant_scores(q, stand_ins.stand_in_scorer).withColumn("score", F.round("score", 6))


_OWNERS, _PRONOUNS = ("his", "her", "hers", "its", "their", "theirs", "my", "our", "your"), ("he", "she", "it", "they", "we", "i", "you", "him", "them")
_HEAD = "case when question_id % 2 = 0 then 'the authors' else 'the team' end"


@query(Q + f""", w as (select question_id, {words('selected_ans')} w, {_HEAD} head from q where selected_ans is not null),
p as (select *, list_position(list_transform(w, lambda x: list_contains({items([*_OWNERS, *_PRONOUNS])}, lower(x))), true) k from w),
r as (select *, case when list_contains({items(_OWNERS)}, lower(w[k])) then head || case when ends_with(head, 's') then '''' else '''s' end else head end put from p where k > 0),
t as (select question_id, array_to_string(list_transform(w, lambda x, i: case when i = k then put else x end), ' ') t from r)
select question_id, upper(t[1]) || t[2:] sentence from t""")
def f18_resolved_sentence(spark: SparkSession, d: str) -> DataFrame:
    """Each answer with its first pronoun, also a possessive one, replaced by what it stands for."""
    q = questions(spark, d, "selected_ans").where("selected_ans is not null").withColumn("w", T.words(F.col("selected_ans")))
    q = q.withColumn("at", F.array_position(F.transform("w", lambda x: F.lower(x).isin(*_OWNERS, *_PRONOUNS)), True).cast("int") - 1).where("at >= 0")
    head = F.when(F.col("question_id") % 2 == 0, "the authors").otherwise("the team")
    return q.select("question_id", A.resolved_sentence(F.col("w"), F.col("at"), head).alias("sentence"))


@query(Q + """, m as (select question_id, list_filter([selected_ans, generated_selected_ans, details], lambda x: x is not null) m from q),
f as (select question_id, m, list_filter(m, lambda x: ends_with(x, 's') = (question_id % 2 = 0)) fit from m),
p as (select question_id, case when len(fit) > 0 then fit else m end pool from f)
select question_id, list_sort(list_transform(pool, lambda x, i: {'n': length(x), 'i': i, 't': x}))[1].t head from p""")
def t16_cluster_head(spark: SparkSession, d: str) -> DataFrame:
    """The mention that stands for "they" (even ids) or "it": the shortest of its number, else of all. What ends with s counts as several."""
    mentions = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("text"), F.col(c).endswith("s").alias("plural"))) for c in ("selected_ans", "generated_selected_ans", "details")]), lambda m: m.isNotNull())
    pronoun = F.when(F.col("question_id") % 2 == 0, "they").otherwise("it")
    return questions(spark, d, "selected_ans", "generated_selected_ans", "details").select("question_id", A.cluster_head(mentions, pronoun).alias("head"))


_LABEL = "case when regexp_matches(lower({c}), '^[aeiout]') then 'A' else 'B' end"


@query(Q + f""", p as (select question_id answer_id, selected_ans answer, unnest(answers) text, generate_subscripts(answers, 1) - 1 pos from q where selected_ans is not null),
s as (select *, least(length(text), length(answer)) / greatest(length(text), length(answer), 1) score from p where text is not null),
f as (select * from (select *, row_number() over (partition by answer_id, lower(text) order by pos) k from s where {_LABEL.format(c='answer')} = {_LABEL.format(c='text')} and lower(text) <> lower(answer) and score > 0.3 and score < 0.93) where k = 1)
select answer_id, text, round(score, 6) score, cast(rnk as integer) rnk from (select *, row_number() over (partition by answer_id order by score desc, pos) rnk from f) where rnk <= 3""")
def j06_similar_entities(spark: SparkSession, d: str) -> DataFrame:
    """Other answers of the same label as the chosen one, the label being by the first letter, the likest in length first."""
    label = lambda c: F.when(F.lower(c).rlike("^[aeiout]"), "A").otherwise("B")
    p = questions(spark, d, "selected_ans", "answers").where("selected_ans is not null").select(F.col("question_id").alias("answer_id"), F.col("selected_ans").alias("answer"), F.posexplode("answers").alias("pos", "text")).where("text is not null")
    n, m = F.char_length("text"), F.char_length("answer")
    p = p.withColumns({"label": label(F.col("text")), "answer_label": label(F.col("answer")), "score": F.least(n, m) / F.greatest(n, m, F.lit(1))})
    return A.similar_entities(p, 3, 0.3, 0.93).withColumn("score", F.round("score", 6))


@query(f"with n as (select distinct head term, type sense, tail neighbour, 1.0 / (1 + length(tail)) score, length(tail) % 3 <> 0 best from {RECORDS} where head is not null and type is not null and tail is not null), t as (select distinct term, sense from n) select term, sense, neighbour, cast(rnk as integer) rnk from (select t.term, t.sense, neighbour, row_number() over (partition by t.term, t.sense order by score desc, neighbour) rnk from t join n on t.term = n.term and t.sense = n.sense where best) where rnk <= 3")
def x08_sense_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest tails of a head and type, of which those of a length that three divides count as no best sense."""
    r = read_records(table(spark, d, "relation_spans")).where("head is not null and type is not null and tail is not null")
    n = r.select(F.col("head").alias("term"), F.col("type").alias("sense"), F.col("tail").alias("neighbour"), (1.0 / (1 + F.char_length("tail"))).alias("score"), (F.char_length("tail") % 3 != 0).alias("is_best_sense")).distinct()
    return A.sense_neighbours(n.select("term", "sense").distinct(), n, 3).select("term", "sense", "neighbour", "rnk")


_FINAL = "case when length(selected_ans) >= length(generated_selected_ans) then selected_ans else generated_selected_ans end"
_SENTENCE = "string_split(text, '. ')[1]"
_BRACKETS = rf"len(list_filter(list_concat(regexp_extract_all({_SENTENCE}, '\(.*?\)'), regexp_extract_all({_SENTENCE}, '\[.*?\]')), lambda m: contains(m, selected_ans))) > 0"


@query(Q + f"select question_id from q where len({words(_SENTENCE)}) between 10 and 45 and not ({_BRACKETS}) and ends_with(question, '?') and not contains(lower(question), lower(selected_ans)) and generated_selected_ans <> '' and (contains(generated_selected_ans, selected_ans) or contains(selected_ans, generated_selected_ans)) and len({words(f'replace({_FINAL}, {chr(39)}-{chr(39)}, {chr(39)} {chr(39)})')}) >= 3")
def prj14_np_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Questions kept by the cascade, the first sentence of the text being the one that is asked about."""
    q = questions(spark, d, "text", "question", "selected_ans", "generated_selected_ans")
    return q.where(T.kept_phrase_question(F.substring_index("text", ". ", 1), F.col("selected_ans"), F.col("question"), F.col("generated_selected_ans"))).select("question_id")


@query()
def prj16_chosen_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of each article's sections taken one a section, at most ten; a summary's words are its entities."""
    s = table(spark, d, "sections").where("text is not null and summary is not null").dropDuplicates(["article_id", "section_n"])
    ents = F.transform(T.words(F.col("summary")), lambda w: F.struct(w.alias("phrase"), F.when(F.char_length(w) > 6, "NP").otherwise("X").alias("label"), (F.char_length(w) % 4).cast("double").alias("rank")))
    x = s.select("article_id", F.col("section_n").alias("sentence_n"), T.word_count(F.col("text")).alias("tokens"), F.char_length("text").cast("double").alias("rank"), "text", ents.alias("ents"))
    return A.chosen_phrases(x, "article_id", 10, 200, 10).withColumnRenamed("sentence_n", "section_n")


@query(Q + "select round(100 * avg(cast(selected_ans = generated_selected_ans as double)), 6) \"Main_exact\", round(100 * avg(length(selected_ans) / greatest(length(selected_ans), length(generated_selected_ans), 1)), 6) \"Main_f1\", count(*) \"Main_total\" from q where selected_ans is not null and generated_selected_ans is not null")
def prj18_prefixed_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Three metrics under a prefix."""
    q = questions(spark, d, "selected_ans", "generated_selected_ans").where("selected_ans is not null and generated_selected_ans is not null")
    n, m = F.char_length("selected_ans"), F.char_length("generated_selected_ans")
    metrics = q.agg(F.round(100 * F.avg((F.col("selected_ans") == F.col("generated_selected_ans")).cast("double")), 6).alias("exact"), F.round(100 * F.avg(n / F.greatest(n, m, F.lit(1))), 6).alias("f1"), F.count(F.lit(1)).alias("total"))
    return qa_eval.prefixed(metrics, "Main")


_PAIRS = f"(select a.label, a.vec_id, round({dot('a.embedding', 'b.embedding')}, 9) sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


@query(f"select label, vec_id, round(sim, 3) sim, cast(row_number() over (partition by label order by sim desc, vec_id) as integer) rnk from {_PAIRS} where sim > 0.1")
def prj22_t15_similar_above(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts, here of neighbouring ids, above a similarity, listed for each section by similarity descending."""
    e = table(spark, d, "embeddings")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    x = pairs.select("label", "vec_id", F.round(S.dot(F.col("embedding"), F.col("other")), 9).alias("sim")).where("sim > 0.1").withColumn("neg", -F.col("sim"))
    return numbered(x, ["label"], ["neg", "vec_id"]).select("label", "vec_id", F.round("sim", 3).alias("sim"), "rnk")


@query(Q + f", a as (select question_id, w, count(*) n from (select question_id, unnest({tokens('selected_ans')}) w from q) group by all), b as (select question_id, w, count(*) n from (select question_id, unnest({tokens('generated_selected_ans')}) w from q) group by all) select question_id, w, least(a.n, b.n) n from a join b using (question_id, w)")
def u03_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that both answers of a question have, each as often as both do."""
    q = questions(spark, d, "selected_ans", "generated_selected_ans")
    of = lambda c: q.select("question_id", F.explode(T.answer_tokens(F.col(c))).alias("w"))
    return select.multiset_intersection(of("selected_ans"), of("generated_selected_ans"), ["question_id", "w"])


_HTML = "'<div><p>' || text || ' &amp; <b>x</b> &lt;y&gt; &quot;z&quot;<script>var a = 1;</script></p><!-- gone --></div>'"
_READ = sub(sub(_HTML, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"), "<[^>]*>")
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _READ = f"replace({_READ}, '{_entity}', '{_char}')"


@query(f"select article_id, section_n, {sub(_READ, SP + '+', ' ')} as text from (select distinct article_id, section_n, text from sections where text is not null)")
def s09_s11_html_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of a page around each section, with inner tags, a script, a comment and entities; the section's own marks are read as well."""
    s = table(spark, d, "sections").where("text is not null").select("article_id", "section_n", "text").distinct()
    html = F.concat(F.lit("<div><p>"), "text", F.lit(' &amp; <b>x</b> &lt;y&gt; &quot;z&quot;<script>var a = 1;</script></p><!-- gone --></div>'))
    return s.select("article_id", "section_n", T.request_text(F.lit("html"), html, F.array().cast("array<struct<tag:string,text:string>>")).alias("text"))


_EIGHT = [f"coalesce({c}[{i}], '')" for c in ("answers", "short_answers") for i in range(1, 5)]
_BLOCK = "'Q1:' || question || chr(10) || 'Q2:' || new_question || chr(10) || 'Best ans: ' || selected_ans || chr(10) || '[' || " + " || ', ' || ".join(f"'''A{i}: ' || {x} || ''''" for i, x in enumerate(_EIGHT)) + " || ']' || chr(10) || 'Text:' || text || chr(10) || chr(10)"


def _block():
    options = F.array(*[F.coalesce(F.get(c, i), F.lit("")) for c in ("answers", "short_answers") for i in range(4)])
    return writers.question_block(F.col("question"), F.col("new_question"), F.col("selected_ans"), options, F.col("text"))


@query(Q + f"select question_id, {_BLOCK} as block from q")
def k04_question_block(spark: SparkSession, d: str) -> DataFrame:
    """A question's block with all eight options."""
    return questions(spark, d, "question", "new_question", "selected_ans", "answers", "short_answers", "text").select("question_id", _block().alias("block"))


@query(Q + f"select question_id, '(' || question_id || ')TAKEN?' || case when use_question then 'True' else 'False' end || ' RQUGE:' || cast(round_even(rquge, 4) as varchar) || chr(10) || {_BLOCK} as line from q where rquge is not null and not isnan(rquge) and isfinite(rquge)")
def k03_taken_line(spark: SparkSession, d: str) -> DataFrame:
    """The full report's entry of each scored question: the line with the rounded score, and the block."""
    q = questions(spark, d, "question", "new_question", "selected_ans", "answers", "short_answers", "text", "use_question", "rquge").where("rquge is not null and not isnan(rquge) and abs(rquge) < double('Infinity')")
    return q.select("question_id", writers.full_line(F.col("question_id"), F.col("use_question"), F.col("rquge"), _block()).alias("line"))


@query(Q + "select question_id, round_even(rquge, 3) three, round_even(rquge, 4) four from q where rquge is not null and not isnan(rquge)")
def m13_rounded(spark: SparkSession, d: str) -> DataFrame:
    """Scores to 3 and 4 decimals, halves to even."""
    return questions(spark, d, "rquge").where("rquge is not null and not isnan(rquge)").select("question_id", F.bround("rquge", 3).alias("three"), F.bround("rquge", 4).alias("four"))


@query(Q + "select question_id from q where short_answers is null or len(list_filter(short_answers, lambda x: length(x) > 30)) = 0")
def k06_without_distractors(spark: SparkSession, d: str) -> DataFrame:
    """Questions for which no short answer is long enough to be a distractor."""
    q = questions(spark, d, "short_answers").withColumn("long_ones", F.filter("short_answers", lambda x: F.char_length(x) > 30))
    return writers.without_distractors(q, "long_ones").select("question_id")


@query(Q + "select cast(question_id as varchar) example_id, text article, question, selected_ans answer, answers options from q")
def s05_race_rows(spark: SparkSession, d: str) -> DataFrame:
    """Reading records written as JSON texts and read again."""
    q = questions(spark, d, "text", "question", "selected_ans", "answers")
    record = F.to_json(F.struct(F.col("question_id").cast("string").alias("example_id"), F.col("text").alias("article"), "question", F.col("selected_ans").alias("answer"), F.col("answers").alias("options")))
    return q.select(readers.race_record(record).alias("r")).select("r.*")


@query()
def x09_causal_distractors(spark: SparkSession, d: str) -> DataFrame:
    """Distractors that a stand-in language model makes of each answer's first words, filtered and ranked."""
    q = questions(spark, d, "question", "selected_ans", "text").where("selected_ans is not null and text is not null")
    return pipeline.causal_distractors(q, stand_ins.stand_in_continuation, stand_ins.stand_in_encoder)
