"""Queries over whole tables against brute force, where their SQL does less."""

import math
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from loomqa.plans import registry


@pytest.fixture(scope="module")
def asked(data):
    """questions_df by question_id."""
    return {r["question_id"]: r for r in pq.read_table(f"{data}/questions_df.parquet").to_pylist()}


def number(x):
    return x is not None and not math.isnan(x)


def test_empty_sections_have_an_entry(spark, data, asked):
    filled, last = defaultdict(list), {}
    for k, r in asked.items():
        last[r["article_id"]] = max(last.get(r["article_id"], -1), r["section_n"])
        if r["use_question"] and number(r["section_n_chunk"]) and number(r["rquge"]):
            filled[r["article_id"], r["section_n"]].append((round(r["section_n_chunk"] * 10), -r["rquge"], k))
    expected = {(a, s, k, i) for (a, s), rows in filled.items() for i, (*_, k) in enumerate(sorted(rows), 1)}
    empty = {(a, s, None, None) for a, n in last.items() for s in range(n + 1) if (a, s) not in filled}
    got = [(r.article_id, r.section_n, r.question_id, r.rnk) for r in registry.queries()["a09_a17_nested_result"](spark, data).collect()]
    assert empty and len(got) == len(set(got)) and set(got) == expected | empty


def test_each_variant_has_a_score(spark, data, asked):
    expected = {}
    for k, r in asked.items():
        held = set((r["text"] or "").lower().split())
        for kind, c in (("long", "answers"), ("short", "short_answers")):
            for i, v in enumerate(r[c] or []):
                if v is not None:
                    w = v.lower().split()
                    expected[k, kind, i] = (v, round(1 + 4 * sum(x in held for x in w) / max(1, len(w)), 6))
    got = registry.queries()["a10_a18_variants"](spark, data).collect()
    assert len(got) == len(expected) and {(r.question_id, r.kind, r.pos): (r.variant, r.score) for r in got} == expected


def test_stages_over_whole_tables(spark, data, asked):
    rows = registry.queries()["pipeline_stages"](spark, data).collect()
    by_id = {r.question_id: r for r in rows}
    assert len(by_id) == len(rows)
    given = {k for k, r in asked.items() if any(x and x.strip() for x in (r["answers"] or [])[:4] + (r["short_answers"] or [])[:4])}
    kept = given & by_id.keys()
    assert len(kept) > 0.5 * len(given) and len(by_id) > len(kept)
    assert all(by_id[k].selected_ans in (asked[k]["answers"] or []) + (asked[k]["short_answers"] or []) for k in kept)
    used = defaultdict(int)
    for r in rows:
        used[r.article_id] += r.use_question
    assert used and max(used.values()) <= 35 and sum(used.values()) > 0
