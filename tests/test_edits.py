"""Edit distances on texts of any script, against brute force over code points."""

import pyarrow.parquet as pq

from loomqa.plans import registry

PAIRS = [("кот", "дом"), ("мир", "мир"), ("слово", "слава"), ("é", "è"), ("café", "cafè"), ("cafe\u0301", "café"), ("ab", "ba"), ("аб", "ба"), ("éa", "aè"), ("日本", "日本語"), ("a😀b", "a😁b"), ("", "ж"), ("", ""), (None, "я"), ("ёж", None)]


def distance(a, b, swaps=False):
    """Levenshtein distance; with ``swaps`` a swap of neighbours counts as one edit."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, row = row, now
    return row[-1]


def check(spark, folder, pairs):
    got = {n: {r.question_id: r.value for r in registry.queries()[n](spark, folder).collect()} for n in ("m05_levenshtein", "m06_normalized_levenshtein", "m07_one_edit")}
    for k, (a, b) in pairs.items():
        d = None if a is None or b is None else distance(a, b)
        assert got["m05_levenshtein"][k] == d, (a, b)
        assert got["m06_normalized_levenshtein"][k] == (None if d is None else round(d / max(1, len(a), len(b)), 6)), (a, b)
        assert got["m07_one_edit"][k] == (None if d is None else d <= 2 and distance(a, b, True) <= 1), (a, b)


def test_fixture(spark, tmp_path):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "question_id long, generated_selected_ans string, selected_ans string")
    df.write.parquet(str(tmp_path / "questions_df.parquet"))
    check(spark, str(tmp_path), dict(enumerate(PAIRS)))


def test_table(spark, data):
    rows = pq.read_table(f"{data}/questions_df.parquet", columns=["question_id", "generated_selected_ans", "selected_ans"]).to_pylist()
    other = {r["question_id"]: (r["generated_selected_ans"], r["selected_ans"]) for r in rows if not all(x is None or x.isascii() for x in (r["generated_selected_ans"], r["selected_ans"]))}
    assert other
    check(spark, data, other)
