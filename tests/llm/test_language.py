import random
from collections import Counter, defaultdict

from loomqa.llm import defects as D, language as L

SCHEMA = "question_id long, question string, selected_ans string, new_question string, text string, generated_selected_ans string, answers array<string>"
NOUNS = {"en": "archive bridge sensor market kiln ledger harbor engine garden".split(), "de": "Brücke Messung Werkstatt Glocke Mühle Scheune".split(), "fi": "arkisto silta mittari satama puutarha kello".split()}
SAID = {
    "en": ("Why did the {} replace the {}?", "The {} replaced the {} for it was not measured {}."),
    "de": ("Warum ist die {} nicht auf der {}?", "Weil die {} und die {} nicht mit {} zu messen ist."),
    "fi": ("Miksi {} oli suljettu ja {} ei ollut auki?", "Koska {} oli rikki ja {} ei ollut valmis {}."),
}


def pairs(of):
    rng, rows = random.Random(5), []
    for g, n in of.items():
        for _ in range(n):
            a, b = rng.sample(NOUNS[g], 2)
            q, said = SAID[g]
            rows.append((q.format(a, b), said.format(a, b, rng.choice(["", a, rng.choice(NOUNS["en"])]))))
    rng.shuffle(rows)
    return rows


def test_a_language_of_few_rows_in_a_large_table_has_a_profile(spark):
    """60 sound Finnish pairs, of which a sample of 10,000 rows would have too few, and three with an English answer."""
    rows = [*pairs({"en": 20_000, "fi": 60}), *zip([q for q, _ in pairs({"fi": 3})], [a for _, a in pairs({"en": 3})])]
    df = spark.createDataFrame([(k, q, a, None, None, None, None) for k, (q, a) in enumerate(rows)], SCHEMA)
    found = {r.question_id for r in D.main_defect(D.defect_labels(df)).collect() if r.defect == "language"}
    assert found == {len(rows) - 3, len(rows) - 2, len(rows) - 1}


def test_profiles_and_usual_costs_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_HELD", 20)
    rows = [*pairs({"en": 1500, "de": 90, "fi": 39}), (None, None), ("", "Yes"), ("Why is the bridge of the city closed?", None), ("Why is it so?", "Потому что мост закрыт")]
    df = spark.createDataFrame(rows, "question string, selected_ans string").repartition(7)

    def counted(language):
        seen, counts = Counter(), defaultdict(Counter)
        for q, a in rows:
            ws, own = L.words(q), L.words(a)
            g = language(ws)
            if g:
                seen[g] += 1
                counts[g].update(t for w in ws + (own if language(own) == g else []) for t in L.trigrams(w))
        return seen, counts

    seen, counts = counted(L.language_of)
    assert seen["fi"] == 39
    first = L.Profiles({g: counts[g] for g in counts if seen[g] >= 40})
    again = counted(first.language_of)[1]
    plain = L.Profiles({g: again[g] for g in again if seen[g] >= 40})
    got = L.trained_profiles(df)
    assert got.languages == plain.languages == ("de", "en") and got.costs == plain.costs
    costs = defaultdict(list)
    for q, a in rows:
        g, own = plain.language_of(L.words(q)), L.words(a)
        if g in plain.languages and len(own) >= 4:
            costs[g].append(plain.costs_of(own)[plain.languages.index(g)])
    for g, c in costs.items():
        mid, high = sorted(c)[len(c) // 2], sorted(c)[int(len(c) * 0.84)]
        plain.usual[g] = (mid, max(0.15, high - mid))
    marks = L.language_marks(df).cache()
    assert L.usual_costs(marks) == plain.usual
    votes = L.language_votes(marks).collect()
    assert Counter((r.question, r.selected_ans, *(r[c] for c in L.PAIR_VOTES)) for r in votes) == Counter((q, a, *L.pair_votes(q, a, plain)) for q, a in rows)


def test_what_a_language_lacks_is_as_dear_in_a_table_of_any_size():
    counts = {"en": Counter({"the": 900_000, " of": 600_000})}
    one, many = L.Profiles(counts), L.Profiles({"en": {t: 1000 * n for t, n in counts["en"].items()}})
    assert abs(one.word("zq")[0] - many.word("zq")[0]) < 1e-9
