import random

from loomqa.llm import defects as D

SCHEMA = "question_id long, question string, selected_ans string, new_question string, text string, generated_selected_ans string, answers array<string>, labels string, known int"
NOUNS = "archive bridge sensor market kiln ledger harbor engine garden signal voucher turbine".split()


def sound(rng, k):
    a, b, c = rng.sample(NOUNS, 3)
    q, n = f"Why did the {a} replace the {b} of the {c}?", f"For what reason was the {b} of the {c} replaced by the {a}?"
    full = f"The {a} replaced the {b} because the {c} was no longer measured by the {a}."
    return q, n, full


def planted(n=900):
    """Pairs with planted defects: question_id -> defect, and the rows."""
    rng, truth, rows = random.Random(9), {}, []
    for k in range(n):
        q, nq, full = sound(rng, k)
        kind = rng.choice([None] * 12 + list(D.DEFECTS))
        a = rng.choice([full, full[:-1], "Yes", "About 40", "The " + rng.choice(NOUNS), q + " " + full])
        if kind == "empty":
            a = rng.choice([None, "", "  ", "N/A", "null", "-", "''", "(no answer)"])
        elif kind == "refusal":
            a = rng.choice(["I'm sorry, but I cannot answer this question.", "I must decline to answer.", "As an AI assistant, I have no way of knowing that.", "My instructions do not allow me to discuss it.", "No comment.", "Can't say.", "Request declined."])
        elif kind == "copy":
            a = rng.choice([q, q.lower().rstrip("?"), nq, "You ask: " + q, q + " " + q, q.replace(" of the", " of")])
        elif kind == "language":
            a = rng.choice(["El archivo todavía explica la estación, aunque la señal está en revisión desde 1999.", "Уже 18 недель местный отчёт описывает рынок и каждый архив.", "Die Brücke bleibt weiterhin gültig, weil der Händler für die Küste zu spät kommt."])
        elif kind == "truncated":
            a = rng.choice([full[: full.index("because") + 11], full[: full.index("no longer") + 3 + 9 + 5], full[: full.index("measured") + 4], full[: full.index("was")] + "...", "The archive (see the"])
        if kind:
            truth[k] = kind
        rows.append((k, q, a, nq, "Some text.", full if kind in ("truncated", None) else a, [full], "x", 1))
    return rows, truth


def test_planted_defects_validate_the_cutoffs(spark):
    rows, truth = planted()
    found = {r.question_id: r.defect for r in D.main_defect(D.defect_labels(spark.createDataFrame(rows, SCHEMA))).collect()}
    right = sum(found.get(k) == v for k, v in truth.items())
    assert right >= 0.93 * len(truth), [(rows[k], v, found.get(k)) for k, v in truth.items() if found.get(k) != v][:5]
    assert sum(k not in truth for k in found) <= 0.05 * len(truth), [(rows[k], found[k]) for k in found if k not in truth][:5]


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, None, None, None, None, None, None, "x", 1), (2, None, "", None, None, None, [None], "x", 1), (2, None, "", None, None, None, [None], "x", 1), (3, "What?", "word " * 20000, None, None, None, None, "x", 1), (None, "q", None, None, None, None, None, "x", 1)]
    got = D.main_defect(D.defect_labels(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.question_id, r.defect) for r in got if r.question_id < 3) == [(1, "empty"), (2, "empty")]
    assert D.defect_labels(spark.createDataFrame([], SCHEMA)).count() == 0


def test_label_model_keeps_rare_strong_votes():
    post = D.fit_label_model({(0, 0): 9800, (1, 0): 150, (1, 1): 50}, [(0.5, 1e-4), (0.3, 1e-4)])
    assert post[0, 0] < 0.05 and post[1, 0] > 0.9 and post[1, 1] > 0.99


FRESH = [  # sentences that the code does not hold, though some of their words are among its features
    ("refusal", "That falls outside my remit."), ("refusal", "No answer will be provided to this question."), ("refusal", "I'd rather keep quiet about that one."), ("refusal", "We are not permitted to disclose such details."),
    ("refusal", "The assistant does not respond to this kind of query."), ("refusal", "Answering that would violate our policy."),
    ("language", "Das Archiv ersetzte die Brücke, nachdem mehrere Messungen fehlerhaft waren."), ("language", "Arkisto korvasi sillan, koska mittaukset olivat virheellisiä ja kalliita."), ("language", "Archiwum zastąpiło most, ponieważ pomiary nie były już wykonywane."),
    ("language", "Het archief verving de brug omdat de metingen niet langer werden uitgevoerd."), ("language", "Arkivet ersatte bron eftersom mätningarna inte längre utfördes av trädgården."), ("language", "測定が行われなくなったため、アーカイブは橋を取り替えた。"),
    ("language", "استبدل الأرشيف الجسر لأن القياسات لم تعد تجرى."), ("language", "Το αρχείο αντικατέστησε τη γέφυρα επειδή δεν μετριόταν πια."), ("empty", "?!"), ("empty", "—"),
]


def test_fresh_defects_beside_sound_pairs(spark):
    rng, rows, truth = random.Random(4), [], {}
    for k in range(1000):
        q, nq, full = sound(rng, k)
        rows.append((k, q, rng.choice([full, full, full[:-1], "About 40", "The bridge"]), nq, "Some text. " + full, full, [full], "x", 1))
    for k, (defect, a) in enumerate([*FRESH, ("copy", None), ("truncated", None)], 1000):
        q, nq, full = sound(rng, k)
        a = a or (f"Why was the {q.split()[6]} replaced by the {q.split()[3]}?" if defect == "copy" else full[: full.index("because") + 7])
        truth[k] = defect
        rows.append((k, q, a, nq, "Some text. " + full, full if defect == "truncated" else a, [full], "x", 1))
    found = {r.question_id: r.defect for r in D.main_defect(D.defect_labels(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert sum(found.get(k) == v for k, v in truth.items()) >= 0.8 * len(truth), {k: (v, found.get(k)) for k, v in truth.items()}
    assert not [k for k in found if k < 1000]


#: Written after the code and never used to change the refusal features.
HELD_OUT = [
    "Sorry, that one is off the table.", "Let's talk about something else instead.", "This matter is confidential.", "I would prefer to leave this open.", "Nobody authorised me to go into that.", "You will have to ask someone qualified.",
    "Such requests get turned down here.", "My lips are sealed.", "Not something I can get into.", "It would be improper to reply.", "I have no knowledge of that.", "That information is restricted.",
]


def test_held_out_refusals(spark):
    """At least half of the refusals in words of their own are found; the rest shows where the features end."""
    rng, rows = random.Random(4), []
    for k in range(600):
        q, nq, full = sound(rng, k)
        rows.append((k, q, rng.choice([full, full[:-1], "About 40"]), nq, "Some text. " + full, full, [full], "x", 1))
    for k, a in enumerate(HELD_OUT, 1000):
        q, nq, full = sound(rng, k)
        rows.append((k, q, a, nq, "Some text. " + full, a, [full], "x", 1))
    found = {r.question_id: r.defect for r in D.main_defect(D.defect_labels(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert sum(found.get(k) == "refusal" for k in range(1000, 1012)) >= 6 and not [k for k in found if k < 1000]


def test_a_function_that_says_yes_of_many_sound_pairs_does_not_decide_alone():
    rng, patterns = random.Random(0), {}
    for _ in range(100_000):
        bad = rng.random() < 0.02
        v = tuple(int(rng.random() < (s if bad else f)) for s, f in ((0.7, 1e-4), (0.7, 1e-4), (0.8, 0.1)))
        patterns[v] = patterns.get(v, 0) + 1
    post = D.fit_label_model(patterns, [(0.6, 1e-4)] * 3)
    assert post[0, 0, 1] < 0.3 and sum(n for v, n in patterns.items() if post[v] >= 0.5) < 3000


def test_scripts_and_function_words():
    from loomqa.llm import language as L

    empty = L.Profiles({})
    assert L.pair_votes("Why is the bridge closed?", "Потому что мост закрыт", empty)[1] == 1
    assert L.pair_votes("Why is the bridge of the city closed?", "Weil die Brücke der Stadt nicht sicher ist", empty)[0] == 1
    assert L.pair_votes("Why is the bridge of the city closed?", "The bridge is closed for it is not safe", empty)[0] == 0
    assert L.pair_votes(None, None, empty) == (0, 0, -1, -1, -1, -1)
