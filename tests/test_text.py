import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomqa.functions import similarity as S, text as T


def apply(spark, make, *rows):
    n = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [r.v for r in df.select("i", make(*[F.col(f"c{k}") for k in range(n)]).alias("v")).orderBy("i").collect()]


def test_clean_question(spark):
    got = apply(spark, T.clean_question, ("What is it??",), ("Why...  is it? -",), ("How many?__",), (" Where? a b ",), (None,), ("",))
    assert got == ["What is it?", "Why.  is it?", "How many?", "Where? a b", None, ""]


def test_clean_answer(spark):
    got = apply(spark, T.clean_answer, ("(a) x",), ("b) y",), ("z. The final answer is (a).",), ("the final answer: (b)",))
    assert got == ["x", "y", "z.", ""]


def test_predicates(spark):
    drop = ["What is DOS?", "Whose?", "Whole set?", "who is it?", "WHO is?", "No mark"]
    keep = ["What are they?", "WHO?"]
    assert apply(spark, T.discarded_question, *[(q,) for q in drop + keep]) == [True] * 6 + [False] * 2
    assert all(apply(spark, T.blacklisted_answer, *[(a,) for a in ("we", "We", "we...", "They!", "  the authors", "THEY  _ ", "I")]))
    assert apply(spark, T.bad_answer, ("a list:",), ("fine",)) == [True, False]
    assert apply(spark, T.in_brackets, ("b", "a (b c) d"), ("d", "a (b c) d"), ("x", "[x]")) == [True, False, True]
    assert apply(spark, T.plain_characters, ("Ünï 1, (a)=b",), ("a;b",), ("",)) == [True, False, False]
    assert apply(spark, T.has_long_word, ("a" * 21,), ("a" * 20 + " b",)) == [True, False]


def test_exact_and_f1(spark):
    pairs = [("The Normans", "normans!"), ("Norman conquest", "the Norman"), ("x x y", "x"), ("x x y", "x x"), ("the", ""), ("a", "b"), (None, "b")]
    assert apply(spark, S.exact_match, *pairs) == [1, 0, 0, 0, 1, 0, None]
    assert [v if v is None else round(v, 4) for v in apply(spark, S.token_f1, *pairs)] == [1.0, 0.6667, 0.5, 0.8, 1.0, 0.0, None]
    assert round(apply(spark, S.set_f1, ("x x y", "x x"))[0], 4) == 0.4


def test_string_scores(spark):
    assert apply(spark, S.string_score, ("a", "a"), ("'a'", "a"), ("a b", "a c"), ("a", "b")) == [3.0, 2.0, 0.5, 0.0]
    got = apply(spark, S.normalized_levenshtein, ("paris", "london"), ("paris", "berlin city"), ("london", "londn"), ("", ""), ("abc", ""))
    assert [round(x, 4) for x in got] == [1.0, 0.8182, 0.1667, 0.0, 1.0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("abc ", max_size=6), st.text("abc ", max_size=6)), min_size=20, max_size=40))
def test_one_edit_agrees_with_the_row_function(spark, pairs):
    from loomqa.operators.select import one_edit_apart

    assert apply(spark, S.one_edit, *pairs) == [one_edit_apart(a, b) for a, b in pairs]


def test_rewrites(spark):
    assert apply(spark, lambda q, t: T.flip_negation(q, t), ("It is not so", "is not"), ("It is", "never")) == ["It is so", None]
    assert apply(spark, T.authors, ("we see Our way",)) == ["the authors see The authors' way"]
    assert apply(spark, T.content_words, ("According to the market, prices rose.", "Why did prices change?")) == ["market rose"]
    pairs = [("NYC", "New York City"), ("ROME", "Rank One Model Editing")]
    full = lambda c: T.replace_abbreviations(c, pairs)
    assert apply(spark, full, ("In New York City (NYC) and NYC.",), ("$ROME\\",)) == ["In New York City (NYC) and NYC.", "$Rank One Model Editing (ROME)\\"]
    assert apply(spark, lambda c: T.replace_abbreviations(c, pairs, "long", only_first=False), ("NYC, NYC",)) == ["New York City, New York City"]


def test_substitute_span_is_literal(spark):
    df = spark.createDataFrame([("A.b and a.B, axb", "a.b", "$1\\")], "a string, s string, t string")
    assert df.select(T.substitute_span(F.col("a"), F.col("s"), F.col("t"))).first()[0] == "$1\\ and $1\\, axb"


def test_abbreviation(spark):
    assert apply(spark, T.is_abbreviation, ("N.Y.C.", "New York City"), ("New York City", "xy"), ("a", "b c")) == [True, False, False]


def test_sentences_and_html(spark):
    assert apply(spark, T.sentences, ("One. Two! three? Four… Five",)) == [["One.", "Two! three?", "Four…", "Five"]]
    assert apply(spark, T.html_text, ("<p>a<script>x</script> &lt;b&gt; <b>c</b></p><!-- d -->",)) == ["a <b> c"]
    with pytest.raises(Exception, match="not supported"):
        df = spark.createDataFrame([("pdf",)], "k string")
        df.select(T.request_text(F.col("k"), F.lit(""), F.array().cast("array<struct<tag:string,text:string>>"))).collect()


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=10, max_size=30))
def test_normalisation_is_idempotent(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    once = apply(spark, T.normalize_answer, *[(t,) for t in texts])
    assert apply(spark, T.normalize_answer, *[(t,) for t in once]) == once
