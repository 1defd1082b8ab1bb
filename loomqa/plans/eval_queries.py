"""Answer evaluation and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomqa.operators import qa_eval as E
from loomqa.plans.registry import query
from loomqa.plans.sqltext import Q, f1, norm, overlap, tokens
from loomqa.runtime import table

_NA = "coalesce(round(1.0 / (1.0 + question_ppl), 2), 0)"
SCORES = Q + f""", s as (
  select question_id qid, coalesce(len(answers), 0) > 0 has_ans, selected_ans prediction, {_NA} na_prob,
         list_filter(answers, lambda g: g is not null and {norm('g')} <> '') golds
  from q where selected_ans is not null),
g as (select qid, has_ans, prediction, na_prob, unnest(case when len(golds) > 0 then golds else [''] end) gold from s),
t as (select qid, has_ans, prediction, na_prob, {norm('gold')} = {norm('prediction')} same, {tokens('gold')} g, {tokens('prediction')} a from g),
u as (select qid, any_value(has_ans) has_ans, any_value(prediction) prediction, any_value(na_prob) na_prob, max(cast(same as double)) exact, max({f1(overlap('g', 'a'), 'g', 'a')}) f1 from t group by qid)
"""


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = table(spark, d, "questions_df").select("question_id", "answers", "selected_ans", "question_ppl").dropDuplicates(["question_id"]).withColumnRenamed("question_id", "qid")
    na = q.select("qid", F.coalesce(F.round(1.0 / (1.0 + F.col("question_ppl")), 2), F.lit(0.0)).alias("na_prob"))
    return q.select("qid", F.col("answers").alias("golds")), q.select("qid", F.col("selected_ans").alias("prediction")), na


def _scores(spark: SparkSession, d: str) -> DataFrame:
    q, p, na = _inputs(spark, d)
    return E.with_na_probs(E.raw_scores(q, p), na)


@query(Q + "select question_id qid, coalesce(len(answers), 0) > 0 has_ans from q")
def a01_has_answer(spark: SparkSession, d: str) -> DataFrame:
    q, _, _ = _inputs(spark, d)
    return q.select("qid", E.has_answer(F.col("golds")).alias("has_ans"))


@query(SCORES + "select qid, has_ans, prediction, exact, round(f1, 6) f1 from u")
def a02_j01_raw_scores(spark: SparkSession, d: str) -> DataFrame:
    q, p, _ = _inputs(spark, d)
    return E.raw_scores(q, p).withColumn("f1", F.round("f1", 6))


@query(Q + "select question_id qid from q where selected_ans is null")
def j01_missing_predictions(spark: SparkSession, d: str) -> DataFrame:
    q, p, _ = _inputs(spark, d)
    return E.missing_predictions(q, p)


_METRICS = """, m as (
  select unnest(['exact', 'f1', 'total', 'HasAns_exact', 'HasAns_f1', 'HasAns_total', 'NoAns_exact', 'NoAns_f1', 'NoAns_total']) metric,
         unnest([100 * avg(exact), 100 * avg(f1), nullif(count(*), 0), 100 * avg(exact) filter (has_ans), 100 * avg(f1) filter (has_ans), nullif(count(*) filter (has_ans), 0),
                 100 * avg(exact) filter (not has_ans), 100 * avg(f1) filter (not has_ans), nullif(count(*) filter (not has_ans), 0)]) v
  from {src})
select metric, round(v, 6) as value from m where v is not null"""


@query(SCORES + _METRICS.format(src="u"))
def a03_a04_metrics(spark: SparkSession, d: str) -> DataFrame:
    q, p, _ = _inputs(spark, d)
    return E.metrics(E.raw_scores(q, p)).withColumn("value", F.round("value", 6))


@query(SCORES + ", v as (select qid, has_ans, prediction, na_prob, case when na_prob > 0.1 then cast(not has_ans as double) else exact end exact, case when na_prob > 0.1 then cast(not has_ans as double) else f1 end f1 from u)" + _METRICS.format(src="v"))
def m12_j02_j03_thresholded_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.metrics(E.thresholded(_scores(spark, d), 0.1)).withColumn("value", F.round("value", 6))


_POINTS = """, x as (select na_prob, sum(case when has_ans then {c} else 0 end) tp, count(*) n from {src} group by 1),
r as (select na_prob, tp, sum(tp) over (order by na_prob) tps, sum(n) over (order by na_prob) ns, (select count(*) from {src} where has_ans) positives from x)
"""


@query(SCORES + _POINTS.format(c="f1", src="u") + "select na_prob, round(tps / ns, 6) \"precision\", round(tps / positives, 6) recall from r where positives > 0")
def w01_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return E.pr_points(_scores(spark, d), "f1").select("na_prob", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_AP = lambda c, src: "(select 100 * sum(tps / ns * tp / positives) from (select tp, sum(tp) over (order by na_prob) tps, sum(n) over (order by na_prob) ns, (select count(*) from u where has_ans) positives from (select na_prob, sum(case when has_ans then " + c + " else 0 end) tp, count(*) n from u group by 1)))"  # noqa: E731, ARG005


@query(SCORES + f"select 'pr_exact' kind, round({_AP('exact', 'u')}, 6) ap union all select 'pr_f1', round({_AP('f1', 'u')}, 6) union all select 'pr_oracle', round({_AP('1.0', 'u')}, 6)")
def w03_average_precisions(spark: SparkSession, d: str) -> DataFrame:
    return E.pr_analysis(_scores(spark, d)).select("kind", F.round("ap", 6).alias("ap"))


@query(SCORES + """, x as (select na_prob, qid, round(sum(case when has_ans then f1 when prediction <> '' then -1 else 0 end) over (order by na_prob, qid rows unbounded preceding), 9) gained from u),
b as (select gained, na_prob from x order by gained desc, na_prob, qid limit 1), n as (select count(*) filter (not has_ans) none, count(*) n from u)
select round(100 * (none + case when gained > 0 then gained else 0 end) / n, 6) best, case when gained > 0 then na_prob else 0 end threshold from b, n""")
def w02_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return E.best_threshold(_scores(spark, d), "f1").select(F.round("best", 6).alias("best"), "threshold")


@query("select cast(least(floor(l_discount * 20), 19) as integer) bin, round(count(*) / (select count(*) from lineitem where l_discount is not null), 6) share from lineitem where l_discount between 0 and 1 group by 1")
def a14_na_prob_histogram(spark: SparkSession, d: str) -> DataFrame:
    return E.histogram(table(spark, d, "lineitem"), "l_discount").withColumn("share", F.round("share", 6))


@query("select bucket, round(sum(c) over (order by bucket) / sum(c) over (), 6) share from (select cast(floor(n_chars / 100) as bigint) bucket, count(*) c from documents where n_chars is not null group by 1)")
def a15_length_shares(spark: SparkSession, d: str) -> DataFrame:
    return E.cumulative_shares(table(spark, d, "documents"), "n_chars", 100).withColumn("share", F.round("share", 6))


@query(Q + "select round(rquge, 1) score, count(*) n from q where rquge is not null and not isnan(rquge) group by 1")
def a16_score_histogram(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions_df").select("question_id", "rquge").dropDuplicates(["question_id"])
    return q.where("rquge is not null and not isnan(rquge)").groupBy(F.round("rquge", 1).alias("score")).agg(F.count(F.lit(1)).alias("n"))
