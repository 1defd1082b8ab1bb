import random

from loomqa.llm.topn import top_n

SCHEMA = "article long, chunk long, qid long, score double, ppl double, g1 string, item string, rnk int"


def brute(rows, n):
    inf = float("inf")
    best = {}
    for a, c, q, s, p in {r[:5] for r in rows if r[3] is not None and r[3] == r[3] and r[1] is not None and r[2] is not None}:
        tie = (2, 0.0) if p is None else (1, 0.0) if p != p else (0, p)
        best.setdefault((a, c), []).append((-s if s != inf else -inf, tie, q))
    return {(k, i, x[2]) for k, v in best.items() for i, x in enumerate(sorted(v)[:n], 1)}


def test_matches_brute_force_with_ties_nulls_repeats_and_clashing_names(spark):
    rng = random.Random(1)
    rows = []
    for q in range(400):
        a = rng.choice([None, 1, 1, 1, 2, 3])
        r = (a, rng.choice([None, 0, 0, 1]), q, rng.choice([None, float("nan"), 1.0, 2.0, 2.0, 3.0]), rng.choice([None, 0.5, 0.5, 1.5, float("nan")]))
        rows += [(*r, "x", "y", 9)] * rng.choice([1, 1, 2])
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for n in (1, 3):
        got = {((r.g1, r.g2), r.rnk, r.item) for r in top_n(df, "article", "chunk", "qid", "score", "ppl", n).collect()}
        # NaN tie values are equal to one another, so compare by key
        assert got == brute([tuple(None if x is None else x for x in r) for r in rows], n)


def test_one_group_with_nearly_all_rows(spark):
    df = spark.range(20000).selectExpr("7L as article", "0L as chunk", "id as qid", "cast(id % 100 as double) as score", "1D as ppl")
    assert [(r.item, r.rnk) for r in top_n(df, "article", "chunk", "qid", "score", "ppl", 3).orderBy("rnk").collect()] == [(99, 1), (199, 2), (299, 3)]


def test_empty(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "article", "chunk", "qid", "score", "ppl").count() == 0


def test_the_order_of_repeated_items_makes_no_difference(spark):
    rows = [(1, 0, 7, 0.2, 1.0), (1, 0, 7, 0.9, 1.0), (1, 0, 8, 0.5, 1.0), (1, 0, 9, 0.4, None), (1, 0, 9, 0.4, 2.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "article long, chunk long, qid long, score double, ppl double").coalesce(1)
        assert [(r.item, r.score, r.tie) for r in top_n(df, "article", "chunk", "qid", "score", "ppl", 3).orderBy("rnk").collect()] == [(7, 0.9, 1.0), (8, 0.5, 1.0), (9, 0.4, 2.0)]


def test_a_task_with_many_groups_holds_few_heaps(monkeypatch):
    """600,000 groups in one task: no more rows than the bound, and a batch, are held at once."""
    import pyarrow as pa
    from loomqa.llm import topn

    live = [0, 0]

    class Counted(topn.BoundedHeap):
        __slots__ = ()

        def __init__(self, n):
            super().__init__(n)
            live[0] += 1
            live[1] = max(live)

        def __del__(self):
            live[0] -= 1

    monkeypatch.setattr(topn, "BoundedHeap", Counted)
    size = 10_000
    batches = [topn._batch([(g, 0, g, 1.0, 1.0) for g in range(k * size, (k + 1) * size)], 5) for k in range(60)]
    assert sum(b.num_rows for b in topn._combine(iter(batches), 3)) == 600_000
    assert live[1] <= topn.MOST_HELD + size
    live[1] = live[0]
    out = list(topn._merge(iter(batches), 3))
    assert sum(b.num_rows for b in out) == 600_000 and max(b.num_rows for b in out) <= topn.MOST_OUT + 3 and live[1] <= live[0] + 3
    assert pa.Table.from_batches(out)["rnk"].to_pylist() == [1] * 600_000
