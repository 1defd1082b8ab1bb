"""The pipeline with deterministic stand-ins for its models; their output says nothing of any model's quality."""

import pandas as pd
from pyspark.sql import functions as F

from loomqa.plans import pipeline as P


def stand_in_generator():
    return lambda s: s.map(lambda t: [{"text": f"Why is {t.split()[3]}??", "ll": -2.0}, {"text": f"Why is {t.split()[3]}?", "ll": -1.0}, {"text": "What is it?", "ll": -1.0}])


def stand_in_chooser():
    return lambda context, q: q.map(lambda t: t.split("(a) ")[1].split(" (b)")[0].lower())


def test_chain(spark):
    s = spark.createDataFrame([(1, 0, "Seven words stand in this short text."), (1, 1, None), (2, 0, "Too short")], "article_id long, section_n int, text string")
    q = P.generated_questions(s, stand_in_generator, 100, 4)
    rows = q.collect()
    assert sorted(r.question for r in rows) == ["What is it?", "Why is words?"]
    assert all(round(r.ppl, 4) == round(2.718281828 ** (-2.0 / 3), 4) for r in rows if r.question.startswith("Why"))
    a = q.withColumns({"question_id": F.xxhash64("question"), "answers": F.array(F.lit("The Answer"), F.lit("they")), "short_answers": F.array(F.lit("x"))})
    chosen = P.selected_answers(a, stand_in_chooser)
    assert {(r.selected_ans, r.details) for r in chosen.collect()} == {("The Answer", "ANSWER: long .")}
    regen = P.regenerated_questions(chosen, lambda: lambda s: s.map(lambda t: "not" if t.startswith("What") else None), lambda: lambda s: s.map(lambda t: "How come?"))
    assert {r.new_question for r in regen.collect() if r.question.startswith("Why")} == {"How come?"}
    done = P.diversified(regen, lambda: lambda s: s.map(lambda t: [float(len(t)), 1.0]), lambda: lambda *c: pd.Series([3.0] * len(c[0])), n=1)
    assert sum(r.use_question for r in done.collect()) == 1


def test_ids(spark):
    r = spark.range(1).select(P.padded_ids(F.array(F.lit(5), F.lit(6)), 4).alias("p"), P.attention_mask(F.array(F.lit(5), F.lit(6)), 4).alias("m"), P.labels(F.array(F.lit(5), F.lit(6)), 4).alias("l")).first()
    assert (r.p, r.m, r.l) == ([5, 6, 0, 0], [1, 1, 0, 0], [5, 6, -100, -100])
