import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomqa.operators import chunking, dates, kb, nested, qa_eval, running, select, vectors


def test_evaluation_with_ties(spark):
    rows = [("q1", True, "x", 1.0, 0.1), ("q2", False, "x", 0.0, 0.2), ("q3", True, "y", 0.5, 0.2), ("q4", False, "", 1.0, 0.9), ("q5", True, "z", 0.0, 0.9)]
    s = spark.createDataFrame([(q, h, p, v, v, n) for q, h, p, v, n in rows], "qid string, has_ans boolean, prediction string, exact double, f1 double, na_prob double")
    points = [(r.na_prob, round(r.precision, 4), round(r.recall, 4)) for r in qa_eval.pr_points(s, "f1").orderBy("na_prob").collect()]
    assert points == [(0.1, 1.0, 0.3333), (0.2, 0.5, 0.5), (0.9, 0.3, 0.5)]
    assert round(qa_eval.average_precision(qa_eval.pr_points(s, "f1")).first().ap, 4) == 41.6667
    assert tuple(qa_eval.best_threshold(s, "f1").first()) == (60.0, 0.1)
    m = {r.metric: r.value for r in qa_eval.metrics(s).collect()}
    assert m["f1"] == 50.0 and m["HasAns_total"] == 3 and m["NoAns_f1"] == 50.0
    assert qa_eval.pr_points(s.where("not has_ans"), "f1").count() == 0


def test_raw_scores_edges(spark):
    q = spark.createDataFrame([("a", ["The x", "y"]), ("b", ["the", "!"]), ("c", None), ("d", ["x"])], "qid string, golds array<string>")
    p = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "z"), ("d", None)], "qid string, prediction string")
    got = {r.qid: (r.has_ans, r.exact, r.f1) for r in qa_eval.raw_scores(q, p).collect()}
    assert got == {"a": (True, 1.0, 1.0), "b": (True, 1.0, 1.0), "c": (False, 0.0, 0.0)}
    assert [r.qid for r in qa_eval.missing_predictions(q, p).collect()] == ["d"]


def test_running_and_numbered(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g", "cast(id % 7 as long) as v")
    run = {r.id: r.s for r in running.running_sums(df, ["id"], {"s": F.col("v")}).collect()}
    acc = 0
    for i in range(1000):
        acc += i % 7
        assert run[i] == acc
    got = {r.id: r.rnk for r in running.numbered(df, ["g"], ["id"]).collect()}
    assert all(got[i] == i // 3 + 1 for i in range(1000))


@pytest.mark.parametrize("t,expected", [(726, [(0, 128), (119, 247), (238, 366), (357, 485), (476, 604), (595, 723)]), (100, [(0, 128)]), (129, [(0, 128), (1, 129)]), (300, [(0, 128), (86, 214), (172, 300)]), (0, [])])
def test_token_windows(spark, t, expected):
    df = spark.range(1).select(F.lit(t).alias("t"))
    got = df.select(chunking.token_windows(F.col("t")).alias("w")).first().w
    assert [(w.start, w.end) for w in got] == expected
    if t == 726:
        assert df.select(chunking.token_windows(F.col("t"), cover_tail=True).alias("w")).first().w[-1].end == 726


def brute_pack(sents, budget):
    out, cur, n = [], [], 0
    for s in sents:
        k = len(s.split())
        if n + k <= budget:
            cur.append(s)
            n += k
        elif not cur:
            out.append(s)
            n = 0
        else:
            out.append(" ".join(cur))
            cur, n = [s], k
    return out + ([" ".join(cur)] if cur else [])


def test_chunks(spark):
    rng = random.Random(2)
    for budget in (3, 7, 20):
        sents = [" ".join(["Word"] * rng.randint(1, 9)) + "." for _ in range(30)]
        text = " ".join(sents)
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(chunking.chunks(F.col("t"), budget).alias("c")).first().c == brute_pack(sents, budget)
        over = df.select(chunking.overlapping_chunks(F.lit("q"), F.col("t"), budget + 10).alias("c")).first().c
        assert over[0].startswith(sents[0]) and over[-1].endswith(sents[-1]) and all(over)
    assert spark.createDataFrame([("short",)], "t string").select(chunking.chunks(F.col("t"), 5).alias("c")).first().c == ["short"]


def test_answer_context_and_prefix(spark):
    text = "One a. Two b. Three c. Four d. Five e. Six f. Seven g."
    df = spark.createDataFrame([(text, "Four"), (text, "none"), (text, "One")], "t string, a string")
    got = [r.c for r in df.select(chunking.answer_context(F.col("t"), F.col("a")).alias("c")).collect()]
    assert got[0] == "Two b. Three c. @SENT_BEGIN@@ANS_BEGIN@Four@ANS_END@ d.@SENT_END@ Five e. Six f." and got[1] == text
    assert got[2].startswith("@SENT_BEGIN@@ANS_BEGIN@One@ANS_END@ a.@SENT_END@ Two b.")
    n = spark.range(1).select(chunking.nearest_prefix(F.array(F.lit("aaaa"), F.lit("bb"), F.lit("c")), F.lit(5)).alias("n")).first().n
    assert n == 1


def greedy(rows, limit, n, least=None):
    out = {}
    for g, i, s, v in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        kept = out.setdefault(g, [])
        if len(kept) < n and (least is None or s >= least) and all(float(np.dot(v, w)) < limit for _, w in kept):
            kept.append((i, v))
    return {(g, i, k) for g, kept in out.items() for k, (i, _) in enumerate(kept, 1)}


def vector_rows(n=300):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(int(k % 3), int(k), float(k % 10), [float(x) for x in v[k]]) for k in range(n)]


def test_greedy_diverse(spark):
    rows = vector_rows()
    df = spark.createDataFrame([*rows, (1, 999, None, rows[0][3]), (1, 998, 1.0, None)], "g int, i int, s double, v array<double>").repartition(5)
    for n, least in ((5, None), (35, 4.0)):
        assert {tuple(r) for r in select.greedy_diverse(df, "g", "i", "s", ["v"], [0.5], n, least).collect()} == greedy(rows, 0.5, n, least)


def mmr(items, target, top_n, d):
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    seed = min(items, key=lambda x: (cos(x[1], target), x[0]))
    chosen, rest = [seed], [x for x in items if x is not seed]
    for _ in range(min(top_n - 1, len(items) - 2)):
        best = min(rest, key=lambda x: (-((1 - d) * cos(x[1], seed[1]) - d * max(cos(x[1], c[1]) for c in chosen)), x[0]))
        chosen.append(best)
        rest.remove(best)
    return [i for i, _ in sorted(((x[0], round(cos(x[1], seed[1]), 4)) for x in chosen), key=lambda p: (-p[1], p[0]))]


@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_marginal_relevance(spark, n):
    rows = vector_rows(n)
    target = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, i, v, target) for _, i, _, v in rows], "g int, i int, v array<double>, t array<double>")
    got = [r.i for r in select.marginal_relevance(df, "g", "i", "v", "t").orderBy("rnk").collect()]
    assert got == mmr([(i, v) for _, i, _, v in rows], target, 5, 0.8)
    assert n != 2 or len(got) == 1


def test_distractors(spark):
    df = spark.createDataFrame([(1, "Paris", ["London", "Londn", "Paris", "Berlin City", "Madrid"]), (2, None, None)], "k int, w string, c array<string>")
    assert {r.k: r.kept for r in select.accept_in_order(df, "k", "w", "c", select.unlike_distractors).collect()} == {1: ["London", "Berlin City"], 2: []}
    c = spark.createDataFrame([(["A ", "a", " ", "b", "B", None, "x"], "X"), (None, "x")], "c array<string>, a string")
    assert [r.v for r in c.select(select.checked_candidates(F.col("c"), F.col("a")).alias("v")).collect()] == [["A ", "b"], None]


def test_cascade(spark):
    kind = "array<string>"
    a = lambda *x: F.array(*map(F.lit, x)).cast(kind)
    none = F.lit(None).cast(kind)
    r = spark.range(1).select(select.cascade(a(), a("x")).alias("p"), select.cascade(none, a(), a("y")).alias("q"), select.cascade(none, none, a()).alias("s")).first()
    assert (r.p, r.q, r.s) == ([], ["y"], [])


def test_nearest(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v) for _, i, _, v in rows], "i long, v array<double>").repartition(4)
    for block in (2048, 4):
        got = vectors.nearest(df, "i", "v", df.where("i % 20 = 0"), 5, block).collect()
        for q in range(0, 300, 20):
            sims = sorted(((-float(np.dot(rows[q][3], v)), i) for _, i, _, v in rows if i != q))[:5]
            assert [r.item for r in sorted((r for r in got if r["query"] == q), key=lambda r: r.rnk)] == [i for _, i in sims]
    assert vectors.nearest(df, "i", "v", df.limit(0), 5).count() == 0


GOLDEN = [
    ("%Y-%m-%d", "2014-01-11, 2014-11-01, 1990-05-05, 2013-12-13"), ("%d %b %Y", "9 May 1981, 31 Dec 1999, 1 Jan 2012"), ("%m/%d/%Y", "12/31/1999, 11/11/1911, 5/9/1981, 6/3/1985"),
    ("%m/%d/%y", "12/31/99, 11/11/11, 5/9/81, 6/3/85"), ("%d/%m/%Y", "13/1/2012"), ("%d %B %Y", "3 August 2009, 2 May 1980"), ("%B %d, %Y", "May 2, 1980; August 3, 2009"),
    ("%d.%m.%y", "31.12.91, 4.4.87, 13.2.8"), ("%d.%m.%Y", "31.12.1991, 4.4.1987, 13.2.2008"), ("%m/%d", "9/24, 6/6, 3/3"),
    ("%a %b %d %H:%M:%S %Z %Y", "Mon Jan 13 09:52:52 MST 2014; Tue Jan 21 15:30:00 EST 2014"), ("%a %b %d %I:%M:%S %p %Z %Y", "Mon Jan 13 9:52:52 am MST 2014; Tue Jan 21 3:30:00 PM EST 2014"),
    ("%a %b %d %I:%M %p %Z %Y", "Mon Jan 13 9:52 am MST 2014; Tue Jan 21 3:30 PM EST 2014"), ("%Y-%m-%dT%H:%M:%S%z", "2014-01-11T12:21:05+0000; 2015-02-16T16:05:31-0400"),
]


def test_date_formats(spark):
    rows = [(f, x) for f, ex in GOLDEN for x in ex.split("; " if ";" in ex else ", ")]
    df = spark.createDataFrame([*rows, ("none", None)], "name string, example string")
    got = {r.name: r.format for r in dates.inferred_formats(df, "name", "example").collect()}
    assert got == {f: f for f, _ in GOLDEN}


def test_date_tokens_and_rules(spark):
    df = spark.createDataFrame([("Sat Jan 11 19:54:52 MST 2014",), ("4/30/1998 4:52 am",)], "t string")
    got = [r.v for r in df.select(dates.tokens(F.col("t")).alias("v")).collect()]
    assert got[0] == ["Sat", " ", "Jan", " ", "11", " ", "19", ":", "54", ":", "52", " ", "MST", " ", "2014"] and got[1] == ["4", "/", "30", "/", "1998", " ", "4", ":", "52", " ", "am"]
    assert dates.format_of(["%d", " -", "%m", " -", "%Y"]) == "%d-%m-%Y"
    assert dates.spark_pattern("%m/%d/%Y") == "M/d/yyyy"
    one = spark.createDataFrame([(1, "5/9/1981", ["6/3/1985", "May 2, 1980"], "DATE"), (2, "x", ["y"], "TIME")], "k int, a string, c array<string>, kind string")
    assert {r.k: r.kept for r in dates.same_format(one, "k", "a", "c", "kind").collect()} == {1: ["6/3/1985"], 2: ["y"]}


def test_triplets(spark):
    rows = ["<s><triplet> Israel <subj> 1948 <obj> inception</s>", "<triplet> A b <subj> C <obj> r <subj> D <obj> s t <triplet> E <subj> F <obj> u", "<triplet> A <subj> B", None, "", "plain"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [[tuple(x) for x in r.v] if r.v is not None else None for r in df.select(kb.triplets(F.col("t")).alias("v")).collect()]
    assert got == [[("Israel", "inception", "1948")], [("A b", "r", "C"), ("A b", "s t", "D"), ("E", "u", "F")], [], None, [], []]


def test_merge_is_the_same_in_any_order(spark):
    rows = [("h", "t", "l", "u1", 0, 128), ("h", "t", "l", "u2", 0, 128), ("h", "t", "l", "u1", 0, 128), ("h", "t", "l", "u1", 119, 247), ("h", "t", None, "u1", 0, 1)]
    schema = "head string, type string, tail string, url string, span_start int, span_end int"
    a, b = spark.createDataFrame(rows[:2], schema), spark.createDataFrame(rows[2:], schema)
    x, y = kb.union_kbs(a, b).collect(), kb.union_kbs(b, a).collect()
    assert x == y and x[0].meta == {"u1": [[0, 128], [119, 247]], "u2": [[0, 128]]}


def test_neighbourhood_and_page(spark):
    e = spark.createDataFrame([("Jordan", "1960", "inception"), ("Israel", "1948", "inception"), ("1948", "1948", "point in time"), ("x", "Israel", "r")], "src string, dst string, label string")
    assert {tuple(r) for r in kb.neighbourhood(e, "1948", 2).collect()} == {("Israel", 1), ("x", 2)}
    v = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    assert '"label": "point in time"' in kb.graph_html(v, e)
    with pytest.raises(ValueError):
        kb.graph_html(v, e, most=2)


def leaves(payload):
    try:
        j = json.loads(payload)
        j = json.loads(j) if isinstance(j, str) else j
    except (ValueError, TypeError):
        return set()
    if not isinstance(j, dict):
        return set()
    r = j.get("result")
    s = r["sections"] if isinstance(r, dict) and r.get("sections") is not None else j.get("sections")
    items = list(s.items()) if isinstance(s, dict) else [((x or {}).get("key"), x) for x in s] if isinstance(s, list) else []
    out = set()
    for i, (k, x) in enumerate(items):
        for side in ("summary", "original"):
            v = (x or {}).get(side)
            v = v.get("text") if isinstance(v, dict) else v
            if v is not None:
                out.add((side, i, k, 0, 0))
        for c, q in enumerate((x or {}).get("questions") or []):
            if q is not None:
                out.add(("question", i, k, c, 0))
                out |= {("distractor", i, k, c, n) for n, t in enumerate(q.get("distractors") or []) if t is not None}
    return out


def test_nested_leaves(spark):
    body = {"summary": {"text": ""}, "original": "bare {text}", "questions": [None, {"question": "q", "distractors": ["a", None, "b"]}, {"distractors": False}, {"question": None, "distractors": []}]}
    payloads = [
        json.dumps({"result": {"sections": {"z 1": body, "a.0": {"summary": {"text": None}}, "n": None}}}), json.dumps({"sections": [None, {"key": "k", **body}, {"summary": "é\n\"x\""}]}),
        json.dumps(json.dumps({"result": {"sections": {"s": body}}})), json.dumps({"result": {"sections": None}}), json.dumps({"result": None, "sections": {"s": body}}), "{\"result\": {\"sections\": {\"a\": {\"summary\": \"x\"}", "", "not json", None, "[]", "null", json.dumps({"result": {"sections": {}}}), " \n" + json.dumps({"sections": {"s": body}}, indent=1),
    ]
    df = spark.createDataFrame([(i, p, "x", 0) for i, p in enumerate(payloads)], "article_id long, payload string, kind string, item_pos int")
    got = {}
    for r in nested.article_leaves(df).collect():
        got.setdefault(r.record_id, set()).add((r.kind, r.item_pos, r.item_key, r.child_pos, r.leaf_pos))
    for i, p in enumerate(payloads):
        assert got.get(i, set()) == leaves(p), p
    assert nested.article_sections(df).where("record_id = 0").count() == 3 and nested.article_questions(df).where("record_id = 0").count() == 3


def test_kb_spans_edges(spark):
    schema = "kb_id long, relations array<struct<head:string,type:string,tail:string,meta:map<string,struct<spans:array<array<int>>>>>>"
    rows = [(1, None), (2, []), (3, [None, ("h", "t", "l", None), ("h", "t", "l", {"u": None, "v": ([[1, 2], None, [3, 4]],), "w": (None,)})])]
    got = {(r.record_id, r.item_pos, r.item_key, r.child_pos) for r in nested.kb_spans(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(3, 2, "v", 0), (3, 2, "v", 2)}
