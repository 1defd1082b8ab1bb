"""Evaluation of extractive answers: exact match, token F1, no-answer thresholds, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomqa.functions.similarity import f1_of, multiset_overlap
from loomqa.functions.text import answer_tokens, normalize_answer
from loomqa.operators.running import running_sums
from loomqa.runtime import materialize


def has_answer(golds: Column) -> Column:
    """Whether a question has gold answers at all; null counts as none."""
    return F.coalesce(F.size(golds), F.lit(0)) > 0


def raw_scores(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """qid, has_ans, prediction, exact, f1: the best over the gold answers of each predicted question.

    ``questions`` has qid and golds (array<string>), ``predictions`` qid and
    prediction. Gold answers without a normal form are dropped; where none is left
    the gold answer is empty. Questions without a prediction are left out."""
    x = questions.join(predictions.where(F.col("prediction").isNotNull()), "qid")
    # one row a gold answer, so that each normal form is computed once; the maxima are combined where the rows are
    parts = lambda c: F.struct(normalize_answer(c).alias("n"), answer_tokens(c).alias("t"))
    each = x.select("qid", has_answer(F.col("golds")).alias("has_ans"), "prediction", F.inline(F.array(F.struct(parts(F.col("prediction")).alias("p"), F.filter(F.transform(F.coalesce("golds", F.array().cast("array<string>")), parts), lambda g: g.n.isNotNull() & (g.n != "")).alias("gs")))))
    nothing = F.array(F.struct(F.lit("").alias("n"), F.array().cast("array<string>").alias("t")))
    each = each.select("qid", "has_ans", "prediction", "p", F.explode(F.when(F.size("gs") > 0, F.col("gs")).otherwise(nothing)).alias("g"))
    f1 = f1_of(multiset_overlap(F.col("g.t"), F.col("p.t")), F.size("g.t"), F.size("p.t"))
    return each.groupBy("qid", "has_ans", "prediction").agg(F.max((F.col("g.n") == F.col("p.n")).cast("double")).alias("exact"), F.max(f1).alias("f1"))


def missing_predictions(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    return questions.select("qid").join(predictions.where(F.col("prediction").isNotNull()).select("qid"), "qid", "left_anti")


def with_na_probs(scores: DataFrame, na_probs: DataFrame | None) -> DataFrame:
    """Adds na_prob; 0 for every row where there is no table, or no value, of them."""
    if na_probs is None:
        return scores.withColumn("na_prob", F.lit(0.0))
    return scores.join(na_probs, "qid", "left").withColumn("na_prob", F.coalesce("na_prob", F.lit(0.0)))


def thresholded(scores: DataFrame, threshold: float) -> DataFrame:
    """Scores where a question above the threshold counts as unanswered."""
    skip = F.col("na_prob") > threshold
    unanswered = (~F.col("has_ans")).cast("double")
    return scores.withColumns({c: F.when(skip, unanswered).otherwise(F.col(c)) for c in ("exact", "f1")})


def metrics(scores: DataFrame) -> DataFrame:
    """metric, value: exact, f1 and total overall, and for questions with and without an answer where there are any."""
    kinds = (("", F.lit(True)), ("HasAns_", F.col("has_ans")), ("NoAns_", ~F.col("has_ans")))
    aggs = [a.alias(p + n) for p, keep in kinds for n, a in (("exact", 100 * F.avg(F.when(keep, F.col("exact")))), ("f1", 100 * F.avg(F.when(keep, F.col("f1")))), ("total", F.nullif(F.count_if(keep), F.lit(0)).cast("double")))]
    one = scores.agg(*aggs)
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*one.columns))).alias("metric", "value")).where("value is not null")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Every column under ``prefix_name``."""
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def pr_points(scores: DataFrame, score: str) -> DataFrame:
    """na_prob, precision, recall: one point for each distinct no-answer probability, the last of its ties.

    Ties are summed before the running sums, so those run over distinct values
    only. No rows if no question has an answer."""
    has = F.col("has_ans")
    groups = scores.groupBy("na_prob").agg(F.sum(F.when(has, F.col(score)).otherwise(0.0)).alias("tp"), F.count(F.lit(1)).alias("n"), F.count_if(has).alias("pos"))
    run = running_sums(groups, ["na_prob"], {"tps": F.col("tp"), "ns": F.col("n")})
    total = run.agg(F.sum("pos").alias("positives"))
    return run.withColumn("positives", total.scalar()).where("positives > 0").select("na_prob", (F.col("tps") / F.col("ns")).alias("precision"), (F.col("tps") / F.col("positives")).alias("recall"), (F.col("tp") / F.col("positives")).alias("gained"))


def average_precision(points: DataFrame) -> DataFrame:
    """ap: precision weighted by the recall gained at each point, times 100."""
    return points.agg((100 * F.sum(F.col("precision") * F.col("gained"))).alias("ap"))


def pr_analysis(scores: DataFrame) -> DataFrame:
    """kind, ap for exact match, F1 and an oracle that knows which questions have an answer."""
    with_oracle = materialize(scores.select("na_prob", "has_ans", "exact", "f1", F.col("has_ans").cast("double").alias("oracle")))
    parts = [average_precision(pr_points(with_oracle, c)).select(F.lit(f"pr_{c}").alias("kind"), "ap") for c in ("exact", "f1", "oracle")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def best_threshold(scores: DataFrame, score: str) -> DataFrame:
    """best, threshold: the first no-answer threshold with the highest total score.

    Rows are taken by na_prob and then qid; each answerable one adds its score,
    each answered unanswerable one takes one point off."""
    gain = F.when(F.col("has_ans"), F.col(score)).when(F.col("prediction") != "", -1.0).otherwise(0.0)
    run = running_sums(scores.select("qid", "na_prob", (~F.col("has_ans")).alias("none"), gain.alias("gain")), ["na_prob", "qid"], {"gained": F.col("gain")})
    first = F.struct(F.round("gained", 9).alias("g"), (-F.col("na_prob")).alias("p"))
    x = run.agg(F.max_by(F.struct("gained", "na_prob"), first).alias("t"), F.count_if("none").alias("none"), F.count(F.lit(1)).alias("n")).where("n > 0")
    better = F.round(F.col("t.gained"), 9) > 0
    return x.select((100 * (F.col("none") + F.when(better, F.col("t.gained")).otherwise(0.0)) / F.col("n")).alias("best"), F.when(better, F.col("t.na_prob")).otherwise(0.0).alias("threshold"))


def histogram(df: DataFrame, value: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """bin, share: share of rows in each of equal bins; the last bin has its upper end. Values outside are left out of the bins, not of the total."""
    b = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    total = df.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    counted = df.where(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return counted.select("bin", (F.col("c") / total.scalar()).alias("share"))


def cumulative_shares(df: DataFrame, value: str, width: int) -> DataFrame:
    """bucket, share: share of rows up to each bucket of ``width``."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.floor(F.col(value) / width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    run = running_sums(counted, ["bucket"], {"upto": F.col("c")})
    return run.select("bucket", (F.col("upto") / counted.agg(F.sum("c").alias("n")).scalar()).alias("share"))
