"""Defective question/answer pairs: noisy labelling functions and an EM label model."""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from loomqa.llm.language import MARKS, language_marks, language_votes
from loomqa.runtime import materialize

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")

#: Marks for a missing answer, reduced to letters and digits.
MISSING = ("na", "nan", "null", "none", "nil", "blank", "noanswer", "notavailable", "notapplicable", "missing", "empty", "tbd", "undefined", "noneavailable", "answer", "noanswergiven", "sinrespuesta", "sansréponse", "keineantwort", "semresposta", "nessunarisposta", "нетответа")
#: Words no answer ends with.
OPEN_WORDS = "the a an and or of by to with for from about every each next its their that which whose because since while although into than as at on in after before between only few several el la los las de del y que con por una un le les des du et der die das und von für zum o os as da do e em il lo gli di della per и в на с что namely such see cf"
#: What a refusal says of its speaker.
_UNABLE = (
    r"\bi(?:['’]m| am|['’]d| would| do| have| must| can| could| won['’]t| will| cannot| can['’]t| refuse| decline| don['’]t)\b[^.?!]{0,25}?"
    r"(?:\bnot\b|n['’]t\b|\bunable\b|\brefuse\b|\bdecline\b|\bno way\b|\bcannot\b)|\bi refuse\b|\bi (?:can['’]t|cannot|won['’]t|don['’]t)\b|\bi['’]m (?:not|unable)\b"
    r"|\blo siento\b|\bno puedo\b|\bje ne (?:peux|suis)\b|\bich kann (?:das |dazu |diese )?[^.]{0,20}nicht\b|\bnão posso\b|\bnon posso\b|\bя не могу\b"
)
_POLITE = r"\boutside what i\b|\bcan be given by me\b|\bappropriate for me\b|\bmy (?:instructions|guidelines|programming|policies)\b|\banything else you need\b|\bcould you rephrase\b|\bplease consult\b|\byou could try asking\b|\bi must decline\b|\bi have to refuse\b|\bi refuse to\b|\brather not\b|\bprefer not\b|\bdeclin(?:e|ed|ing) to (?:answer|comment) (?:this|that|your)\b"
_OPENER = r"^\W*(?:i['’]m (?:really |very |so )?sorry\b|(?:so )?sorry[,.!]|(?:my )?apologies\b|i apologi[sz]e\b|unfortunately\b|regrettably\b|with regret\b|as an? (?:ai|language model|assistant|large)\b|that is a \w+ question\b|hmm\b|thank you for asking\b|lo siento\b|désolé|es tut mir leid|desculpe|mi dispiace|извините)"
#: Refusals that are the whole answer.
_BRIEF = r"^\W*(?:no comment|(?:request|question|answer) (?:declined|denied|refused)|(?:i )?(?:can['’]?t|cannot|can not|couldn['’]?t) (?:say|tell|answer|help|comment)|i (?:decline|refuse|pass)|not at liberty to say|sin comentarios|kein kommentar|sans commentaire|sem comentários|nessun commento|без комментариев)\W*$"
_NEGATION = r"(?:\b(?:no|not|never|unable|cannot|can ?not|declin(?:e|es|ed|ing)|refus(?:e|es|ed|ing)|withh[eo]ld\w*)\b|n['’]t\b)"
_SPEECH = r"\b(?:answer|repl(?:y|ies)|respon[ds]|response|comment|discuss|disclos|say|tell|help|assist|provid|share|speak|talk|address|advi[sc]e|opinion|information|detail)\w*"
_UNSAID = rf"{_NEGATION}[^.?!]{{0,30}}{_SPEECH}|{_SPEECH}[^.?!]{{0,20}}{_NEGATION}|\b(?:request|question)s?(?: is| was| has been)? (?:declined|denied|refused)\b|\b(?:keep|stay|remain)(?:ing)? (?:silent|quiet)\b|\b(?:skip|pass on|abstain)\b"
_OUTSIDE = r"\b(?:outside|beyond|not within|out of)\b[^.?!]{0,25}\b(?:my|our|scope|remit|competence|purview|guidelines|what (?:i|we))\b|\b(?:against|by|under|violates?) (?:my|our|the) (?:rules|polic(?:y|ies)|guidelines|instructions|terms)\b"
_META = r"\b(?:this|that|your|such|these|those)(?: kind of| sort of)? (?:\w+ )?(?:question|request|topic|subject|query|matter|inquiry|prompt|one)s?\b"
_CUT = r"(?:\p{L}[-‐–—]|\.\s?\.\s?\.|…|[:;,(\[]|\b(?:namely|such as)(?: the)?:?|\bthat is:?|[(\[](?:see|cf)\b[^)\]]*|[,;:]\s*(?:and\s*)?\(\d\))\s*$"
_LEAD = r"^(?:(?:the )?(?:question|text|prompt|user|task)(?: (?:is|asks|was|reads|says))?|you (?:ask|asked|want to know)|generate questions?|q|prompt|asked) "


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _words(text: str) -> Column:
    return F.array(*[F.lit(w) for w in dict.fromkeys(text.split())])


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, 0, or -1 where the function abstains; without ``no`` it never abstains."""
    v = F.when(yes, 1)
    return (v.otherwise(0) if no is None else v.when(no, 0).otherwise(-1)).cast("int")


#: (defect, function) -> prior probability that it says yes of a defective and of a sound pair.
PRIORS = {
    ("empty", "blank"): (0.6, 1e-5), ("empty", "mark"): (0.4, 1e-5), ("empty", "tiny"): (0.95, 0.05),
    ("refusal", "unable"): (0.7, 1e-4), ("refusal", "polite"): (0.6, 1e-4), ("refusal", "opener"): (0.6, 1e-4), ("refusal", "person"): (0.95, 0.01), ("refusal", "brief"): (0.3, 1e-6),
    ("refusal", "unsaid"): (0.5, 1e-3), ("refusal", "outside"): (0.2, 1e-4), ("refusal", "meta"): (0.3, 0.01), ("refusal", "unshared"): (0.5, 0.05),
    ("copy", "same"): (0.6, 1e-5), ("copy", "near"): (0.9, 1e-5), ("copy", "covered"): (0.9, 1e-3), ("copy", "asks"): (0.8, 1e-4),
    ("language", "words"): (0.8, 1e-5), ("language", "script"): (0.3, 1e-6), ("language", "profile"): (0.9, 1e-4), ("language", "alien"): (0.8, 0.02), ("language", "foreign"): (0.8, 1e-4), ("language", "strange"): (0.9, 0.02),
    ("truncated", "cut"): (0.4, 1e-5), ("truncated", "bracket"): (0.2, 1e-5), ("truncated", "open"): (0.4, 1e-5), ("truncated", "stem"): (0.4, 1e-5), ("truncated", "prefix"): (0.6, 1e-4), ("truncated", "bare"): (0.95, 0.4),
}


#: Words of the vocabulary that are broadcast, at most; a larger one is joined by a shuffle.
MOST_BROADCAST = 500_000


def known_words(df: DataFrame, share: float = 5e-5) -> DataFrame:
    """Lower-case words that stand before another word in at least ``share`` of all rows, and in three.

    At most (words a row) / share words pass, whatever the size of the table. It is written
    to the shared folder and broadcast only if it has at most :data:`MOST_BROADCAST` words."""
    n = df.count()
    w = df.select(F.explode(F.array_union(
        F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(r"\b\p{Ll}+(?=[ ,;?])"), F.lit(0)),
        F.regexp_extract_all(F.coalesce("selected_ans", F.lit("")), F.lit(r"\b\p{Ll}+(?=,? \p{L}|[.!?](?:\s|$))"), F.lit(0)),
    )).alias("word"))
    known = materialize(w.groupBy("word").count().where(F.col("count") >= max(3, math.ceil(n * share))).select("word", F.lit(True).alias("known")))
    return F.broadcast(known) if known.count() <= MOST_BROADCAST else known


def labelling_votes(df: DataFrame, known: DataFrame) -> DataFrame:
    """question_id and one vote column ``defect__function`` for every labelling function.

    They are computed once and kept as a narrow table in the shared folder, from which the votes on languages follow."""
    df = language_marks(df)
    a0, q0, n0 = F.col("selected_ans"), F.col("question"), F.col("new_question")
    x = df.select(
        "question_id", *MARKS.names, F.coalesce(a0, F.lit("")).alias("a"), a0.isNull().alias("gone"), _tokens(a0).alias("at"), _tokens(q0).alias("qt"), _tokens(n0).alias("nt"),
        F.lower(F.concat_ws(" ", q0, n0, F.col("text"))).alias("around"),
        F.filter(F.concat(F.array("generated_selected_ans"), F.coalesce("answers", F.array().cast("array<string>"))), lambda g: g.isNotNull()).alias("full"),
    )
    x = x.withColumns({
        "low": F.lower("a"), "core": F.rtrim(F.regexp_replace("a", r"(?:[-‐–—…\s,:;(\[]|\.\s?\.\s?\.|\bnamely the|\bsuch as|\bthat is|[(\[](?:see|cf)\b[^)\]]*)+$", "")),
        "na": F.regexp_replace(F.array_join("at", " "), _LEAD, ""), "nq": F.array_join("qt", " "), "nn": F.array_join("nt", " "),
        # words after the last question mark, unless the question comes again there
        "tail": F.array_join(_tokens(F.when(F.col("a").contains("?"), F.substring_index("a", "?", -1)).otherwise(F.lit(""))), " "),
        "last": F.regexp_extract("a", r"(?:^|[\s(])(\p{Ll}{2,})\s*[-‐–—…]?\s*$", 1), "chars": F.length(F.regexp_replace("a", r"[^\p{L}\p{N}]+", "")),
    })
    x = x.join(known, x.last == known.word, "left")
    x = x.withColumn("content", F.filter("at", lambda w: F.length(w) >= 5)).withColumn("asserts", F.size("at") >= 3)
    # copy: distance to the question, or to the question said twice
    flat = F.regexp_replace("na", r"^(.+) \1$", "$1")
    near = lambda q: (F.length(q) >= 12) & (F.abs(F.length(flat) - F.length(q)) <= F.length(q) * 0.3) & (F.levenshtein(flat, q) <= F.length(q) * 0.25)
    answered = (F.col("tail") != "") & ~F.col("nq").endswith(F.col("tail")) & ~F.col("nn").endswith(F.col("tail"))
    ends_alike = F.size(F.array_except(F.slice("at", F.greatest(F.size("at") - 1, F.lit(1)), 2), F.array_union("qt", "nt"))) == 0
    long_enough = F.size("at") >= 4
    extra = F.array_except(F.regexp_extract_all(F.col("na"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array_union("qt", "nt"))
    # truncated
    blank = F.col("gone") | (F.col("chars") == 0)
    mark = F.regexp_replace("low", r"[^\p{L}\p{N}]+", "").isin(*MISSING) | F.col("a").rlike(r"(?i)^\W*(?:a|ans|answer)\s*:\W*$")
    closed = F.col("a").rlike(r"[.!?。)\]»”\"'’]\s*$") & ~F.col("a").rlike(r"(?:\.\s?\.\s?\.?|[,;:]\s*(?:and\s*)?\(\d\))\s*$")
    opened = lambda o, c: (F.length("a") - F.length(F.replace("a", F.lit(o), F.lit("")))) > (F.length("a") - F.length(F.replace("a", F.lit(c), F.lit(""))))
    in_word = F.exists("full", lambda g: F.startswith(F.lower(g), F.lower(F.col("core"))) & F.substr(g, F.length("core") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]"))
    in_phrase = F.exists("full", lambda g: F.startswith(F.lower(g), F.lower(F.col("core"))) & F.substr(g, F.length("core") + 1, F.lit(3)).rlike(r"^ \p{Ll}"))
    # the pattern is only made for words that stand somewhere in the texts
    seen = F.col("known").isNotNull() | F.when(F.contains("around", "last"), F.rlike(F.col("around"), F.concat(F.lit(r"(?<!\p{L})"), F.col("last"), F.lit(r"(?!\p{L})")))).otherwise(False)
    votes = {
        "empty__blank": _vote(blank), "empty__mark": _vote(mark & ~blank), "empty__tiny": _vote(F.col("chars") <= 12),
        "refusal__unable": _vote(F.col("low").rlike(_UNABLE)), "refusal__polite": _vote(F.col("low").rlike(_POLITE)), "refusal__opener": _vote(F.col("low").rlike(_OPENER)),
        "refusal__person": _vote(F.col("low").rlike(r"(?:^|[\s,(])(?:i|i['’]\w+|me|my)\b"), F.size("at") > 4), "refusal__brief": _vote(F.col("low").rlike(_BRIEF)),
        "refusal__unsaid": _vote(F.col("low").rlike(_UNSAID)), "refusal__outside": _vote(F.col("low").rlike(_OUTSIDE)), "refusal__meta": _vote(F.col("low").rlike(_META)),
        "refusal__unshared": _vote(F.col("asserts") & ~F.exists("content", lambda w: F.contains(F.col("around"), w)), F.col("asserts")),
        "copy__same": _vote(long_enough & ~answered & ((flat == F.col("nq")) | (flat == F.col("nn")))),
        "copy__near": _vote(long_enough & ~answered & ends_alike & (near(F.col("nq")) | near(F.col("nn")))),
        "copy__asks": _vote(long_enough & ~answered & F.col("a").rlike(r"\?\W*$") & (2 * F.size(F.array_intersect("at", F.array_union("qt", "nt"))) >= F.size(F.array_distinct("at")))),
        "copy__covered": _vote(long_enough & ~answered & (F.size(extra) == 0), long_enough),
        "truncated__cut": _vote(~blank & F.col("low").rlike(_CUT)), "truncated__bracket": _vote(opened("(", ")") | opened("[", "]")),
        "truncated__open": _vote((F.size("at") >= 2) & ~closed & F.array_contains(_words(OPEN_WORDS), F.element_at("at", -1)) & F.element_at(F.split("a", r"\s+"), -1).rlike(r"^[^A-Z]*$")),
        "truncated__stem": _vote((F.col("last") != "") & ~closed & (F.size("at") >= 2) & ~seen, F.col("last") != ""),
        "truncated__prefix": _vote(~blank & ~closed & (F.length("core") >= 3) & (in_word | (in_phrase & (F.size("at") >= 4)))),
        "truncated__bare": _vote(~closed & (F.size("at") >= 2)),
    }
    return language_votes(materialize(x.select("question_id", *[v.alias(k) for k, v in votes.items()], *MARKS.names)))


#: Functions that say yes of this share of sound pairs, or more, support others but make no defect alone.
WEAK = 0.01
#: Functions that say yes of no larger share of sound pairs than this keep their lone votes in every start.
SURE = 1e-5


def _em(patterns: dict[tuple[int, ...], int], priors: list[tuple[float, float]], start: list[tuple[float, float]], share: float, weight: float, rounds: int) -> tuple[float, dict[tuple[int, ...], float]]:
    """Log-likelihood of the votes and posterior for each pattern, from one starting point."""
    total = sum(patterns.values()) or 1
    sens, fall, p = [s for s, _ in start], [f for _, f in start], share
    post: dict[tuple[int, ...], float] = {}
    fit = 0.0
    for _ in range(rounds):
        fit = 0.0
        for v, n in patterns.items():
            yes, no = math.log(p), math.log1p(-p)
            for k, x in enumerate(v):
                if x >= 0:
                    yes += math.log(sens[k] if x else 1 - sens[k])
                    no += math.log(fall[k] if x else 1 - fall[k])
            post[v] = 1 / (1 + math.exp(min(700.0, no - yes)))
            fit += n * (max(yes, no) + math.log1p(math.exp(-abs(yes - no))))
        bad = sum(n * post[v] for v, n in patterns.items())
        kept = weight * total
        p = min(0.5, max(1e-6, (bad + kept * share) / (total + kept)))
        for k, (s0, f0) in enumerate(priors):
            hit = sum(n * post[v] for v, n in patterns.items() if v[k] == 1)
            cast = sum(n * post[v] for v, n in patterns.items() if v[k] >= 0)
            false = sum(n * (1 - post[v]) for v, n in patterns.items() if v[k] == 1)
            rest = sum(n * (1 - post[v]) for v, n in patterns.items() if v[k] >= 0)
            prior_bad = max(1.0, weight * share * total)
            sens[k] = min(0.999, max(0.02, (hit + s0 * prior_bad) / (cast + prior_bad)))
            fall[k] = min(0.9, max(1e-7, (false + f0 * kept) / (rest + kept)))
    return fit, post


def fit_label_model(patterns: dict[tuple[int, ...], int], priors: list[tuple[float, float]], share: float = 0.02, weight: float = 0.5, rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior probability of the defect for each vote pattern, by expectation-maximization.

    One hidden binary variable; votes are independent given it, an abstention
    says nothing. The priors act as pseudo-counts of ``weight`` times the rows
    (sound) and ``weight`` times the expected defects, so that the fit is the
    same at any size of the table. It starts from several points - the priors; false
    rates as often as each function says yes where no other does; and,
    for each function, that all its lone votes are false - and the fit
    under which the votes are likeliest is taken."""
    # a weak function's yes is common among sound pairs: at least as common as it is overall
    share_of = lambda k: sum(n for v, n in patterns.items() if v[k] == 1) / (sum(n for v, n in patterns.items() if v[k] >= 0) or 1)
    alone = lambda k: sum(n for v, n in patterns.items() if v[k] == 1 and sum(x == 1 for x in v) == 1) / (sum(n for v, n in patterns.items() if v[k] >= 0) or 1)
    priors = [(s, min(0.9, max(f, share_of(k))) if f >= WEAK else f) for k, (s, f) in enumerate(priors)]
    lone = [(s, min(0.9, max(f, alone(k))) if f > SURE else f) for k, (s, f) in enumerate(priors)]
    starts = [priors, lone, *([*priors[:k], lone[k], *priors[k + 1 :]] for k in range(len(priors)) if len(priors) > 1 and priors[k][1] > SURE)]
    return max((_em(patterns, priors, x, share, weight, rounds) for x in starts), key=lambda r: r[0])[1]


#: Posterior cut-offs; tests/llm validates them on pairs with planted defects.
CUTOFFS = {"empty": 0.5, "refusal": 0.5, "copy": 0.5, "language": 0.5, "truncated": 0.5}


def defect_labels(df: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """question_id, labels: array<struct<defect, posterior>>, best first, all that reach their cut-off.

    From the table of votes the counts of the vote patterns (at most 3^9 a defect, so their
    number has a fixed bound) go to the driver, where the model is fitted; the
    posteriors go back as a literal map. Rows without a defect are left out;
    repeated rows count once in the result. Nulls in any text count as empty
    text (a null answer is defective, a null question has no copy or language);
    an empty table gives no rows."""
    cutoffs = CUTOFFS | (cutoffs or {})
    slim = df.select("question_id", "question", "selected_ans", "new_question", "text", "generated_selected_ans", "answers").where("question_id is not null")
    votes = labelling_votes(slim, known_words(slim))
    names = [c for c in votes.columns if c != "question_id"]
    of = {d: [c for c in names if c.startswith(d + "__")] for d in DEFECTS}
    key = {d: F.concat_ws(",", *[F.col(c).cast("string") for c in of[d]]) for d in DEFECTS}
    counts = votes.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), key[d].alias("v")) for d in DEFECTS])).alias("x")).groupBy("x.d", "x.v").count()
    patterns: dict[str, dict] = defaultdict(dict)
    for d, v, n in counts.collect():
        patterns[d][tuple(map(int, v.split(",")))] = n
    cases = []
    for d in DEFECTS:
        post = fit_label_model(patterns[d], [PRIORS[tuple(c.split("__"))] for c in of[d]]) if patterns[d] else {}
        hit = [x for v, p in sorted(post.items()) if p >= cutoffs[d] for x in (F.lit(",".join(map(str, v))), F.lit(round(p, 6)))]
        if hit:
            cases.append(F.struct(F.lit(d).alias("defect"), F.element_at(F.create_map(*hit), key[d]).alias("posterior"), F.lit(-DEFECTS.index(d)).alias("o")))
    kind = "array<struct<defect:string,posterior:double>>"
    if not cases:
        return votes.select("question_id", F.array().cast(kind).alias("labels")).limit(0)
    # a defect earlier in DEFECTS wins a tie; what is empty or a refusal has no other main defect
    ranked = F.sort_array(F.filter(F.array(*cases), lambda c: c.posterior.isNotNull()), asc=False)
    order = F.array_sort(ranked, lambda x, y: y.o - x.o)
    return votes.select("question_id", F.transform(order, lambda c: F.struct(c.defect.alias("defect"), c.posterior.alias("posterior"))).cast(kind).alias("labels")).where(F.size("labels") > 0).distinct()


def main_defect(labels: DataFrame) -> DataFrame:
    """question_id, defect: the first label of each pair."""
    return labels.select("question_id", F.col("labels")[0].defect.alias("defect"))
