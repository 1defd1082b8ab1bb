from hypothesis import given, settings, strategies as st

from loomqa.llm.splitting import split_balanced, split_oversized


def check(text, limit, overlap):
    spans = split_balanced(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert b - a <= limit
    for (_, e), (s, e2) in zip(spans, spans[1:]):
        assert s <= e < e2 and e - s <= overlap
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n,é́🙂", max_size=600), st.integers(20, 90), st.integers(0, 19))
def test_pieces_cover_the_text_within_the_limits(text, limit, overlap):
    check(text, limit, overlap)


def test_balanced_and_natural():
    text = " ".join(f"Sentence number {i} ends here." for i in range(120))
    spans = check(text, 1500, 200)
    assert all(text[e - 2] == "." for _, e in spans[:-1])
    sizes = [b - a for a, b in spans]
    assert max(sizes) < 1.7 * min(sizes)


def test_long_text_without_boundaries():
    check("x" * 1_000_000, 1500, 200)


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, None, "p", 0), (2, "", "p", 0), (3, "a" * 1500, "p", 0), (4, "a" * 1501, "p", 0), (4, "a" * 1501, "p", 0), (5, " " * 1600, "p", 0)], "k long, t string, piece string, start int")
    got = split_oversized(df, ["k"], "t").collect()
    assert sorted(r.k for r in got) == [4, 4, 4, 4, 5, 5]
    assert split_oversized(df.limit(0), ["k"], "t").count() == 0


def test_the_overlap_asked_for_is_held():
    """Between a half and the whole of it, in prose, in sentences nearly as long as a piece, and without any boundary."""
    prose = " ".join(f"Sentence number {i} ends here, {'and so on, ' * (i % 9)}to be sure." for i in range(300))
    for text in (prose, " ".join("word " * 279 + "end." for _ in range(9)), "x" * 9000, "y" * 700 + ". " + "z" * 5000 + ". " + "w " * 3000):
        spans = check(text, 1500, 200)
        for (a, e), (s, _) in zip(spans, spans[1:]):
            assert 100 <= e - s <= 200, (e - s, a, e)


def test_a_cut_stays_off_marks_without_boundaries():
    text = "é" * 4000
    assert all(text[a] == "e" for a, _ in check(text, 1500, 200))
