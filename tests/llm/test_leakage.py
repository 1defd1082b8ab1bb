import random

from loomqa.llm import leakage as L


def brute(seq, items, n):
    """Items that a text of words holds a passage of."""
    out = set()
    for item, w in items:
        size = min(n, len(w))
        if size and any(seq[i : i + size] == w[j : j + size] for i in range(len(seq) - size + 1) for j in range(len(w) - size + 1)):
            out.add(item)
    return out


def test_automaton_matches_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        words = list("abcd")[: rng.randint(1, 4)]
        items = [(k, [rng.choice(words) for _ in range(rng.randint(0, 9))]) for k in range(rng.randint(1, 6))]
        n = rng.randint(1, 5)
        sam = L.SuffixAutomaton(items, n)
        for _ in range(5):
            seq = [rng.choice([*words, "z"]) for _ in range(rng.randint(0, 30))]
            found = sam.scan(seq)
            assert set(found) == brute(seq, items, n)
            for item, spans in found.items():
                for a, b in spans:
                    assert 0 <= a < b <= len(seq)


def test_operator(spark):
    text = "The quick brown fox jumps over the lazy dog and runs away from it today"
    docs = spark.createDataFrame([(1, f"Intro. {text.upper()}! End.", 0), (2, "a short item", 0), (3, None, 0), (4, "", 0), (5, "a short other item", 0), (6, text[:-30], 0), (1, f"Intro. {text.upper()}! End.", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, text), (11, "A short, item"), (12, None), (13, "..."), (10, text)], "item_id long, text string")
    found = lambda **k: {tuple(r) for r in L.leaked_documents(L.leaked_spans(docs, "doc_id", "text", items, "item_id", "text", **k)).collect()}
    assert found() == {(1, 10), (2, 11)}
    assert found(block_chars=10) == found()
    assert L.leaked_spans(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert L.leaked_spans(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    clean = {r.doc_id: r for r in L.without_leaks(docs, "doc_id", "text", items, "item_id", "text", max_coverage=0.95).collect()}
    assert clean[1].text == "Intro. ! End." and clean[2].dropped and clean[2].text is None and clean[3].text is None and clean[5].text == "a short other item"


def test_many_blocks_give_what_one_gives(spark):
    """Random words in few kinds, items of all lengths, blocks of a few items: spans and cut texts are those of one automaton."""
    rng = random.Random(8)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st".split())
    items = [(k, " ".join(word() for _ in range(rng.choice((1, 3, 5, 14, 30))))) for k in range(60)]
    docs = [(k, " ".join([*(word() for _ in range(rng.randint(0, 25))), *rng.choice(items)[1].split()[: rng.choice((4, 12, 20))], "x²", "end"])) for k in range(150)] + [(900, None), (901, ""), (None, items[0][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    spans = lambda **k: sorted(tuple(r) for r in L.leaked_spans(d, "doc_id", "text", i, "item_id", "text", **k).collect())
    clean = lambda **k: sorted((r.doc_id or -1, r.text or "", r.n_removed, r.dropped) for r in L.without_leaks(d, "doc_id", "text", i, "item_id", "text", **k).collect())
    assert spans() and spans(block_chars=300) == spans()
    assert len(clean()) == len(docs) and clean(block_chars=300) == clean()
    brute_found = {(k, item) for k, t in docs if t and k is not None for item in brute(L.words(t), [(n, L.words(x)) for n, x in items], 12)}
    assert {r[:2] for r in spans(block_chars=300)} == brute_found
