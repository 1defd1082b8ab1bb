"""Relations that arrive as labelled texts, against a brute-force reading of the records."""

import json
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from loomqa.operators import kb
from loomqa.plans import registry

NAMES = ("head", "type", "tail")


def fields(record):
    if record.lstrip().startswith("{"):
        found = json.loads(record)
    elif "\n" in record:
        found = dict(p.split(" : ", 1) for p in record.split("\n"))
    elif " | " in record:
        found = dict(p.split(": ", 1) for p in record.split(" | "))
    else:
        found = dict(p.split("=", 1) for p in record.split("; "))
    return {k.lower(): v for k, v in found.items()}


@pytest.fixture(scope="module")
def relations(data):
    """(head, type, tail, url, span_start, span_end) of every row."""
    rows = []
    for r in pq.read_table(f"{data}/relation_spans.parquet").to_pylist():
        f = fields(r["record"]) if r["record"] is not None else r
        rows.append((*(f.get(n) for n in NAMES), r["url"], r["span_start"], r["span_end"]))
    return rows


def test_layouts(spark):
    rows = ['{"tail": "c; d", "type": " b", "head": "a\\u00e9"}', "type=b; head=a=x;y; tail= c ", "HEAD: \xa0a  | TAIL: c|d | TYPE: b", "Tail : c\nHead : a\nType : ", "type=b; tail=c", None]
    df = spark.createDataFrame([(i, None, None, None, r) for i, r in enumerate(rows)] + [(9, "H", "T", "L", None)], "i int, head string, type string, tail string, record string")
    got = {r.i: (r.head, r.type, r.tail) for r in kb.read_records(df).collect()}
    assert got == {0: ("aé", " b", "c; d"), 1: ("a=x;y", "b", " c "), 2: ("\xa0a ", "b", "c|d"), 3: ("a", "", "c"), 4: (None, "b", "c"), 5: (None, None, None), 9: ("H", "T", "L")}


def test_merged_and_united(spark, data, relations):
    spans = defaultdict(set)
    for *key, s, e in relations:
        if None not in key and s is not None and e is not None:
            spans[tuple(key)].add((s, e))
    expected = {(*k, s, e) for k, v in spans.items() for s, e in v}
    got = [tuple(r) for r in registry.queries()["a11_u05_merged_relations"](spark, data).select(*NAMES, "url", "span_start", "span_end").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    urls = defaultdict(set)
    for *key, url in spans:
        urls[tuple(key)].add(url)
    for k in pq.read_table(f"{data}/kb.parquet").to_pylist():
        for r in k["relations"] or []:
            for url, m in (r and r["meta"]) or []:
                if any(x and len(x) > 1 and None not in x[:2] for x in (m and m["spans"]) or []) and None not in (r["head"], r["type"], r["tail"]):
                    urls[r["head"], r["type"], r["tail"]].add(url)
    assert {tuple(r[c] for c in (*NAMES, "n_urls")) for r in registry.queries()["j08_union_of_bases"](spark, data).collect()} == {(*k, len(v)) for k, v in urls.items()}


def test_graph_and_neighbours(spark, data, relations):
    q = registry.queries()
    edges = {(h, l, t) for h, t, l, *_ in relations if None not in (h, t, l)}
    assert {(r.src, r.dst, r.label) for r in q["g04_edges"](spark, data).collect()} == edges
    assert {r.node for r in q["g04_vertices"](spark, data).collect()} == {x for e in edges for x in e[:2]}
    assert {r.node for r in q["g06_g07_edge_filter"](spark, data).collect()} == {x for e in edges if e[2] == "part of" for x in e[:2]}
    near = defaultdict(list)
    for h, l, t in edges:
        near[h, t].append(l)
    expected = {(*k, l, i) for k, ls in near.items() for i, l in enumerate(sorted((l for l in ls if len(l) % 3), key=lambda l: (len(l), l.encode()))[:3], 1)}
    assert {(r.term, r.sense, r.neighbour, r.rnk) for r in q["x08_sense_neighbours"](spark, data).collect()} == expected
