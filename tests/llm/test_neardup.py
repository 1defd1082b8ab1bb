import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st

from loomqa.llm import neardup as N


def brute(rows, t):
    sets = {k: N.word_set(a, b) for k, a, b in rows}
    return {(x, y) for x, y in itertools.combinations(sorted(sets), 2) if sets[x] and sets[y] and len(sets[x] & sets[y]) >= t * len(sets[x] | sets[y]) - 1e-12}


def rows_of(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for k in range(n):
        if out and rng.random() < 0.4:
            words = (rng.choice(out)[1] or "none").split()
            for _ in range(rng.choice([0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
        else:
            words = rng.sample(vocabulary[: rng.choice([8, 60])], rng.randint(1, 8))
        out.append((k, " ".join(words), rng.choice([None, "", "W1 w2!", words[0].upper()])))
    return out


@pytest.mark.parametrize("cap_scale", [0.25, 0.01])
def test_pairs_match_brute_force(spark, monkeypatch, cap_scale):
    rng = random.Random(3)
    rows = rows_of(rng, 300) + [(1000, None, None), (1001, "!!", ""), (1002, "x " * 3000, "y"), (1003, "X", "y")]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows] + [(*rows[0], 5, "z")], "key long, q string, a string, path int, record string")
    # a low cap makes every path split deep
    monkeypatch.setattr(N, "max", lambda *x: x[-1] if x[0] in (60, 40) and cap_scale < 0.1 else __builtins__["max"](*x), raising=False)
    for t in (0.75, 0.5):
        got = [tuple(r) for r in N.similar_pairs(df, "key", ["q", "a"], t).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, t)


def test_shingles(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    df = spark.createDataFrame([(1, base), (2, base.upper() + "."), (3, base + " fifteen"), (4, "other text of five words or more")], "key long, t string")
    assert {tuple(r) for r in N.similar_pairs(df, "key", ["t"], 0.8, n=5).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_hot_class_costs_no_pairs(spark):
    df = spark.range(3000).selectExpr("id as key", "case when id % 3 = 0 then 'the same text of a third' else concat('text ', id, ' alone ', id * 7) end as t")
    rows = N.linked_classes(df, "key", ["t"], 0.75).where("n_copies > 1").collect()
    assert len(rows) == 1000 and {r.class_id for r in rows} == {0} and {r.n_copies for r in rows} == {1000}


def test_empty(spark):
    df = spark.createDataFrame([], "key long, t string")
    assert N.similar_pairs(df, "key", ["t"], 0.75).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 14), min_size=1, max_size=9), min_size=2, max_size=25), st.sampled_from([0.5, 0.75, 0.8]), st.integers(1, 4))
def test_tree_and_paths_find_all_pairs(sets, t, cap):
    tokens = [tuple(sorted(s)) for s in sets]
    split, most = set(), 6
    for level in range(1, most):
        counts = {}
        for x in tokens:
            for p, d, _ in N.paths(x, t, split, level):
                if d == level:
                    counts[p] = counts.get(p, 0) + 1
        split |= {p for p, c in counts.items() if c > cap}
    filed = {}
    for i, x in enumerate(tokens):
        for p, d, at in N.paths(x, t, split, most):
            filed.setdefault(p, []).append((len(x), i, d, x[at:]))
    got = set()
    for rows in filed.values():
        tree = N.PrefixTree(t)
        for size, i, d, rest in sorted(rows):
            got |= {(min(i, j), max(i, j)) for j in tree.similar(size, rest, d)}
            tree.insert(size, rest, i)
    expected = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12}
    assert got == expected


@pytest.mark.parametrize("most_split,most_in_path", [(0, 6), (3, 10), (10**6, 4)])
def test_crowded_paths_are_joined_in_blocks(spark, monkeypatch, most_split, most_in_path):
    """With next to no split paths, and few records under one path in a task, no pair is lost or doubled."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(12)]
    rows = [(k, " ".join(w for w in base if rng.random() < 0.9) or "b0", f"own{rng.randrange(40)}") for k in range(250)]
    df = spark.createDataFrame(rows, "key long, q string, a string")
    members = {}
    monkeypatch.setattr(N, "max", lambda *x: 10 if x[0] == 60 else __builtins__["max"](*x), raising=False)
    links, shared = N.similar_classes(df, "key", ["q", "a"], 0.75, most_split=most_split, most_in_path=most_in_path)
    for r in shared.collect():
        members.setdefault(r.record, set()).add(r.key)
    got = {(min(x, y), max(x, y)) for a, b in links.collect() for x in members.get(a, {a}) for y in members.get(b, {b})}
    got |= {(x, y) for m in members.values() for x, y in itertools.combinations(sorted(m), 2)}
    assert got == brute(rows, 0.75)


def test_a_family_of_edited_copies(spark):
    """1,500 texts of one template that differ in two of 20 words: all are found as near one another, as classes and their links."""
    rng = random.Random(2)
    template = [f"t{i}" for i in range(20)]
    rows = []
    for k in range(1500):
        w = list(template)
        for _ in range(2):
            w[rng.randrange(20)] = f"e{rng.randrange(25)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "key long, t string")
    expected = brute([(k, t, None) for k, t in rows], 0.8)
    links = {tuple(r) for r in N.representative_links(df, "key", ["t"], 0.8).collect()}
    assert links <= expected
    assert {tuple(r) for r in N.similar_pairs(df, "key", ["t"], 0.8).collect()} == expected
