"""Operators of the mended queries on small fixtures."""

from pyspark.sql import functions as F

from loomqa.functions import text as T
from loomqa.operators import annotations as A, chunking, dates, kb, select
from loomqa.operators.running import numbered
from loomqa.plans import pipeline, stand_ins
from loomqa.sources import readers, writers


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_final_answer_needs_its_colon(spark):
    got = [one(spark, T.clean_answer(F.lit(t))) for t in ("(a) Yes. The final answer (a)", "Yes. The final answer: (a).", "Yes. The final answer is (b)", "Yes. The final answer is: (b).")]
    assert got == ["Yes. The final answer (a)", "Yes.", "Yes.", "Yes."]


def test_score_prompt(spark):
    assert one(spark, T.score_prompt(F.lit("How is it?"), F.lit("The sun"), F.lit("Sunny!"), F.lit("A sunny day."))) == "how is it <q> sun <r> sunny <c> sunny day"
    assert one(spark, T.score_prompt(F.lit(None).cast("string"), F.lit("a"), F.lit("b"), F.lit("c"))) is None


def test_answer_context_of_any_width(spark):
    text = F.lit("One. Two. Three. Four. Five. Six. Seven.")
    for around, expected in ((0, "4"), (1, "345"), (2, "23456"), (3, "1234567")):
        got = one(spark, chunking.answer_context(text, F.lit("Four"), around))
        assert "".join(str(i) for i, w in enumerate("One Two Three Four Five Six Seven".split(), 1) if w in got) == expected


def test_padding_phrases_options_perplexity(spark):
    a, s = T.padded_together(F.array(F.lit("x"), F.lit("y")), F.array(*[F.lit("z")] * 6))
    assert one(spark, F.struct(a.alias("a"), s.alias("s"))) == (["x", "y", "", "", ""], ["z"] * 6 + [""] * 3)
    options = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(v).cast("double").alias("score")) for t, v in (("a", 1.0), (" ", 9.0), ("b", None), ("c", 2.0), ("d", 1.0))])
    assert one(spark, select.ranked_options(options)) == ["c", "a", "d", "b"]
    assert abs(one(spark, T.perplexity(F.lit(-4.0), F.lit("two words"))) - 0.1353352832) < 1e-9 and one(spark, T.perplexity(F.lit(0.0), F.lit(""))) == 1.0
    keep = lambda s, p, q, a: one(spark, T.kept_phrase_question(F.lit(s), F.lit(p), F.lit(q), F.lit(a)))
    s = "The old stone bridge was closed by the council (see the red tape) in the spring."
    assert keep(s, "the old stone", "What was closed?", "old stone") and not keep(s, "red tape", "What?", "the red tape x") and not keep("Short one.", "the old stone", "What?", "old") and not keep(s, "the old stone", "Is the old stone closed?", "old stone")


def test_islands_and_numbers_without_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, None), (6, "a")], "i long, k string")
    assert sorted(select.islands(df, "k", "i").select("k", "first", "last", "n").collect()) == [("a", 1, 2, 2), ("a", 4, 6, 2), ("b", 3, 3, 1)]
    assert [r.rnk for r in numbered(df, [], ["i"]).orderBy("i").collect()] == [1, 2, 3, 4, 5, 6]
    hot = spark.range(3000).selectExpr("id", "if(id % 10 = 0, id % 7, null) g")
    got = {(r.g, r.id): r.rnk for r in numbered(hot, ["g"], ["id"]).collect()}
    place = {}
    for i in range(3000):
        g = i % 7 if i % 10 == 0 else None
        place[g] = place.get(g, 0) + 1
        assert got[g, i] == place[g]
    assert select.islands(df.limit(0), "k", "i").count() == 0


def test_chosen_phrases(spark):
    e = lambda *x: [{"phrase": p, "label": k, "rank": r} for p, k, r in x]
    rows = [
        (1, 0, 20, 3.0, "A (dark) sea", e(("dark", "NP", 1.0), ("sea", "NP", 1.0))), (1, 1, 20, 9.0, "x", e(("zero", "NP", 0.0), ("verb", "VB", 1.0), ("sea", "NP", 1.0))),
        (1, 2, 2, 99.0, "x", e(("short", "NP", 1.0))), (1, 3, 20, 1.0, "x", e(("sea", "NP", 1.0), ("hill", "NP", 1.0), ("lake", "NP", 1.0))), (2, 0, 20, 1.0, None, None), (None, 0, 20, 1.0, "x", e(("y", "NP", 1.0))),
    ]
    df = spark.createDataFrame(rows, "doc long, sentence_n int, tokens int, rank double, text string, ents array<struct<phrase:string,label:string,rank:double>>")
    run = lambda **k: [(r.doc, r.sentence_n, r.phrase, r.rnk) for r in A.chosen_phrases(df, "doc", 10, 45, **k).orderBy("doc", "rnk").collect()]
    assert run(n=5) == [(1, 1, "sea", 1), (1, 3, "hill", 2)]
    assert run(n=1) == [(1, 1, "sea", 1)]
    assert run(n=5, sparse=False) == [(1, 1, "sea", 1), (1, 3, "hill", 2), (1, 3, "lake", 3)]


def test_formats_of_single_texts(spark):
    assert [dates.text_format(t) for t in ("2012-12-25", "12/25/2012", "9 May 1981", "", None)] == ["%Y-%m-%d", "%m/%d/%Y", "%d %b %Y", "", None]
    df = spark.createDataFrame([(1, "2012-12-25", ["1999-10-30", "10/30/1999", None], "DATE"), (2, "noon", ["a", None], "TIME"), (3, None, ["a"], "DATE"), (4, "x", None, "DATE"), (5, "x", ["y"], "PERSON")], "id long, a string, c array<string>, kind string")
    assert {r.id: r.kept for r in dates.same_format(df, "id", "a", "c", "kind").collect()} == {1: ["1999-10-30"], 2: ["a"], 4: []}
    assert one(spark, dates.most_restrictive(F.array(F.lit("%d"), F.lit("%m"), F.lit("%y")))) == "%m" and one(spark, dates.most_restrictive(F.array().cast("array<string>"))) is None
    t = spark.createDataFrame([("k", x) for x in ("1", "2", "24", "b", "c")] + [("k", None)], "k string, t string")
    got = {r.element: r.share for r in dates.match_shares(t, "k", "t").collect()}
    assert got["%d"] == 0.6 and got["%m"] == 0.4 and len(got) == 15


def test_new_spans_intersection_readers_and_metrics(spark, tmp_path, capsys):
    s = "head string, type string, tail string, url string, span_start int, span_end int"
    known, more = spark.createDataFrame([("a", "t", "b", "u", 1, 2)], s), spark.createDataFrame([("a", "t", "b", "u", 1, 2), ("a", "t", "b", "u", 3, 4), ("a", "t", "b", "u", 3, 4), (None, "t", "b", "u", 5, 6)], s)
    assert [tuple(r) for r in kb.new_spans(known, more).collect()] == [("a", "t", "b", "u", 3, 4)]
    a, b = spark.createDataFrame([("x",), ("x",), ("y",)], "w string"), spark.createDataFrame([("x",), ("x",), ("x",), ("z",)], "w string")
    assert [tuple(r) for r in select.multiset_intersection(a, b, ["w"]).collect()] == [("x", 2)]
    (tmp_path / "r.json").write_text('{"example_id": "1", "question": "Q?", "options": ["a", "b"]}\n')
    assert [tuple(r) for r in readers.race(spark, str(tmp_path / "r.json")).collect()] == [("1", None, "Q?", None, ["a", "b"])]
    (tmp_path / "a.csv").write_text('question,answer\n"What, ""now""?","two\nlines"\n')
    assert [tuple(r) for r in readers.annotations(spark, str(tmp_path / "a.csv")).collect()] == [('What, "now"?', "two\nlines")]
    writers.write_metrics(spark.createDataFrame([("exact", 50.0)], "metric string, value double"))
    assert '"exact": 50.0' in capsys.readouterr().out


def test_causal_distractors(spark):
    text = "The old bridge was closed because the river rose after heavy rain and the council feared for the piers of the bridge in the spring of that year"
    df = spark.createDataFrame([(1, "Why?", "the river rose", text), (2, "Why?", "", ""), (3, "Why?", "a", "€ € € €")], "question_id long, question string, selected_ans string, text string")
    got = pipeline.causal_distractors(df, stand_ins.stand_in_continuation, stand_ins.stand_in_encoder, top_n=3).orderBy("question_id", "rnk").collect()
    assert [r.rnk for r in got] == [1, 2, 3] and {r.question_id for r in got} == {1} and all(r.distractor in text for r in got) and len({r.distractor for r in got}) == 3
