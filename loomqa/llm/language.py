"""Whether two texts are in different languages: function words, scripts, letter profiles."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

#: Common function words by language, compared without accents.
FUNCTION_WORDS = {
    "en": "a the of is was are by and to for that with it its not from which what who when where how did does an because this about at on as be you have will or if there",
    "es": "a la el los las de del y que con por para cuando está también porque una se cómo qué aunque ya su",
    "fr": "à la le les des du et est que même ne plus aussi quand comment pourquoi une dans pour sur dès si",
    "de": "der die das und nicht von weil für zu ist nach dem den mit wie wann warum eine auf auch",
    "pt": "a o e os as da do das que não já é em quando está também por como uma um ao embora para",
    "it": "e la il lo gli le di del della che non più è ancora perché per come quando una con benché sono",
    "ru": "и в на не что потому по когда ещё всё уже как почему это для каждый",
    "nl": "het een van en niet dat zijn op met voor maar ook", "sv": "och att det som inte är för på med av ett", "da": "og at det som ikke er for på med af et",
    "fi": "ja on ei että oli joka mutta kun myös ovat", "pl": "w nie na się że jest do z jak oraz przez", "cs": "v na se že je do jak jsou byl pro",
    "hu": "az és nem hogy egy van meg volt", "tr": "ve bir bu için ile değil olarak çok", "ro": "și în nu este că cu pe din care", "uk": "і що та як це або від його",
}
#: Blocks of the scripts.
SCRIPTS = (
    ("Cyrillic", 0x400, 0x52F), ("Greek", 0x370, 0x3FF), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Indic", 0x900, 0xDFF), ("Thai", 0xE00, 0xE7F), ("Georgian", 0x10A0, 0x10FF),
    ("Armenian", 0x530, 0x58F), ("Ethiopic", 0x1200, 0x137F), ("East", 0x3040, 0x30FF), ("East", 0x3400, 0x9FFF), ("Korean", 0xAC00, 0xD7A3),
)
#: Votes that :func:`language_votes` adds.
PAIR_VOTES = ("language__words", "language__script", "language__profile", "language__alien", "language__foreign", "language__strange")
#: What :func:`language_marks` adds: votes, and costs that are held against the usual ones of all rows.
MARKS = T.StructType([
    *(T.StructField(f"language__{c}", T.IntegerType()) for c in ("words", "script", "profile", "strange")),
    T.StructField("language", T.StringType()), T.StructField("answer_cost", T.DoubleType()), T.StructField("rest_cost", T.DoubleType()), T.StructField("bare", T.BooleanType()),
])
_WORD = re.compile(r"[^\W\d_]+")


def plain(word: str) -> str:
    """A word without accents."""
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


_LANGUAGES = tuple(FUNCTION_WORDS)
_BITS: dict[str, int] = defaultdict(int)
for _i, _ws in enumerate(FUNCTION_WORDS.values()):
    for _w in _ws.split():
        _BITS[plain(_w)] |= 1 << _i
_BITS = dict(_BITS)
del _i, _ws, _w


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORD.findall(text.lower()) if text else []


def function_hits(ws: list[str]) -> list[int]:
    """Different function words of each language among the words."""
    hits = [0] * len(_LANGUAGES)
    for w in {plain(w) for w in ws}:
        bits = _BITS.get(w, 0)
        while bits:
            low = bits & -bits
            hits[low.bit_length() - 1] += 1
            bits ^= low
    return hits


def script_of(ws: list[str]) -> tuple[str, int, float]:
    """The script most letters are of, their number, and their share; ``Latin`` is all that is in no block."""
    text = "".join(ws)
    if text.isascii():
        return "Latin", len(text), 1.0
    count: Counter = Counter()
    for c, n in Counter(text).items():
        o = ord(c)
        count["Latin" if o < 0x370 else next((s for s, a, b in SCRIPTS if a <= o <= b), "Latin")] += n
    s, n = count.most_common(1)[0]
    return s, n, n / len(text)


class Profiles:
    """Letter trigrams of each language, with the usual cost of a text in its own language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        vocabulary = len(set().union(*counts.values())) + 1 if counts else 1
        self.languages = tuple(sorted(counts))
        self.costs = []
        for g in self.languages:
            seen = sum(counts[g].values())
            # in proportion from a million trigrams on, so that what is strange is as dear at any size of the table
            more = max(0.3, 3e-7 * seen)
            total = seen + more * vocabulary
            # the second is the cost of a trigram that the language does not have
            self.costs.append(({k: -math.log((n + more) / total) for k, n in counts[g].items()}, -math.log(more / total)))
        self.usual: dict[str, tuple[float, float]] = {}
        self.memo: dict[str, tuple[float, ...]] = {}

    def word(self, w: str) -> tuple[float, ...]:
        """Cost of a word under each language."""
        known = self.memo.get(w)
        if known is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            parts = trigrams(w)
            known = self.memo[w] = tuple(sum(c.get(t, rare) for t in parts) for c, rare in self.costs)
        return known

    def costs_of(self, ws: list[str]) -> list[float]:
        """Mean cost a letter of the words under each language."""
        n = sum(map(len, ws)) or 1
        return [sum(c) / n for c in zip(*map(self.word, ws))] if ws else [0.0] * len(self.languages)

    def language_of(self, ws: list[str]) -> str | None:
        """The language that is clearly the cheapest for the words together with its function words, if it has a profile."""
        if not self.languages or not ws:
            return language_of(ws)
        hits = function_hits(ws)
        scores = sorted((c - 0.1 * min(4, hits[_LANGUAGES.index(g)]), g) for g, c in zip(self.languages, self.costs_of(ws)))
        return scores[0][1] if len(scores) == 1 or scores[1][0] - scores[0][0] > 0.08 else language_of(ws)


def trigrams(word: str) -> list[str]:
    """Letter trigrams of a word with a blank before and after it."""
    x = f" {word} "
    return [x[i : i + 3] for i in range(len(x) - 2)]


def language_of(ws: list[str]) -> str | None:
    """The language whose function words are clearly the most."""
    hits = function_hits(ws)
    first = max(hits)
    return _LANGUAGES[hits.index(first)] if first >= 2 and hits.count(first) == 1 else None


def pair_marks(q: str | None, a: str | None, p: Profiles) -> tuple:
    """What one pair's votes are made of, by the fields of :data:`MARKS`: four votes, the language of the
    question, the answer's cost in it, that of the words the question does not have, and whether those are
    long and without a function word of the language. The last four are null where they are not known."""
    qw, aw = words(q), words(a)
    qs, qn, qshare = script_of(qw)
    as_, an, ashare = script_of(aw)
    east = as_ in ("East", "Korean", "Thai")
    script = int(qn >= 4 and an >= (2 if east else 4) and qs != as_ and qshare >= 0.6 and ashare >= 0.6)
    g = p.language_of(qw) if len(aw) >= 3 else None
    at, cost = None, []
    if len(aw) >= 4 and g in p.languages:
        at, cost = p.languages.index(g), p.costs_of(aw)
    usual = (g, cost[at]) if cost else (None, None)
    if len(aw) < 3 or len(qw) < 3 or script:
        return (-1 if script else 0), script, -1, -1, *usual, None, None
    if g is None:
        return -1, script, -1, -1, None, None, None, None
    qg = _LANGUAGES.index(g)
    ah = function_hits(aw)
    ab = max(ah)
    ag = ah.index(ab)
    by_words = int(ab >= 2 and qg != ag and ab >= ah[qg] + 2)
    strange = int(ab >= 2 and ah[qg] <= 1 and qg != ag)
    if not cost:
        return by_words, script, -1, strange, None, None, None, None
    best = min(range(len(cost)), key=cost.__getitem__)
    profile = int(best != at and cost[at] - cost[best] > 0.3)
    # names that the answer shares with the question say nothing of its language
    rest = [w for w in aw if w not in qw]
    # no function word of the question's language either; single letters are words of many
    own = function_hits([w for w in aw if len(w) > 1])[qg]
    return by_words, script, profile, strange, *usual, p.costs_of(rest)[at] if len(rest) >= 3 else None, own == 0 and sum(map(len, rest)) >= 20


def pair_votes(q: str | None, a: str | None, p: Profiles) -> tuple[int, ...]:
    """The votes of :data:`PAIR_VOTES` on one pair: 1, 0, or -1 where a function abstains."""
    by_words, script, profile, strange, g, cost, rest, bare = pair_marks(q, a, p)
    if profile < 0:
        return by_words, script, -1, -1, -1, strange
    mid, spread = p.usual.get(g, (cost, 1.0))
    apart = (rest - mid) / spread if rest is not None else 0.0
    return by_words, script, profile, int(apart > 4), int(apart > 8 and bare), strange


#: Different words that a task holds before it hands on their trigrams.
MOST_HELD = 100_000


def _counted(texts: DataFrame, held: Broadcast | None) -> tuple[dict[str, int], dict[str, dict[str, int]]]:
    """Questions, and trigram counts of them and of the answers in the same language, by language over all rows.
    The language is that of the broadcast profiles, or without them of the function words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held.value.language_of if held else language_of
        seen: Counter = Counter()
        found: dict[str, Counter] = defaultdict(Counter)

        def handed() -> Iterator[pa.RecordBatch]:
            for g, n in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([""]), pa.array([n], pa.int64())], names=names)
            for g, ws in found.items():
                counts: Counter = Counter()
                for w, n in ws.items():
                    for t in trigrams(w):
                        counts[t] += n
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=names)
            seen.clear()
            found.clear()

        for batch in batches:
            for q, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(q)
                g = of(ws)
                if g:
                    seen[g] += 1
                    own = words(a)
                    found[g].update(ws)
                    if of(own) == g:
                        found[g].update(own)
            if sum(map(len, found.values())) > MOST_HELD:
                yield from handed()
        yield from handed()

    names = ["language", "trigram", "n"]
    rows = texts.mapInArrow(run, "language string, trigram string, n bigint").groupBy("language", "trigram").agg(F.sum("n").alias("n")).toArrow()
    seen: dict[str, int] = {}
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for g, t, n in zip(*(rows.column(c).to_pylist() for c in names)):
        if t:
            counts[g][t] = n
        else:
            seen[g] = n
    return seen, counts


def trained_profiles(texts: DataFrame, least: int = 40) -> Profiles:
    """Profiles of each language with ``least`` questions or more, from all rows of ``texts`` (question, answer).
    The language of a question is the one whose function words it has most of, two at least and more than of any
    other; with the profiles made so, the languages are judged and the trigrams counted once more.

    What reaches the driver, and is broadcast, is one count for each different trigram of a language."""
    seen, counts = _counted(texts, None)
    first = texts.sparkSession.sparkContext.broadcast(Profiles({g: c for g, c in counts.items() if seen[g] >= least}))
    _, counts = _counted(texts, first)
    first.unpersist()
    return Profiles({g: c for g, c in counts.items() if seen.get(g, 0) >= least})


def language_marks(df: DataFrame) -> DataFrame:
    """``df`` (with question and selected_ans) with the columns of :data:`MARKS`; the letter profiles are trained
    on all its rows. Null texts are empty."""
    held = df.sparkSession.sparkContext.broadcast(trained_profiles(df.select("question", "selected_ans")))
    at = [df.columns.index(c) for c in ("question", "selected_ans")]
    kinds = [pa.int32()] * 4 + [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        for batch in batches:
            marks = [pair_marks(q, a, p) for q, a in zip(*(batch.column(i).to_pylist() for i in at))]
            made = [pa.array([m[k] for m in marks], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *MARKS.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *MARKS.fields]))


def usual_costs(marks: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and spread, by ranks among all rows, of the cost that answers to questions of a language have in it.

    Exact: costs are counted in narrow bins, then the values of the few bins that hold the ranks."""
    x = marks.where("answer_cost is not null").select("language", F.col("answer_cost").alias("cost"), F.floor(F.col("answer_cost") * 10_000).alias("bin"))
    bins: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for g, b, n in x.groupBy("language", "bin").count().collect():
        bins[g].append((b, n))
    ranks = {g: (n // 2, int(n * 0.84)) for g, bs in bins.items() for n in [sum(n for _, n in bs)]}
    # bin and the rank within it
    where = {(g, k): _at_rank(bins[g], k) for g, ks in ranks.items() for k in ks}
    if not where:
        return {}
    values: dict[tuple[str, int], list[tuple[float, int]]] = defaultdict(list)
    wanted = reduce(or_, [(F.col("language") == g) & (F.col("bin") == b) for g, b in sorted({(g, b) for (g, _), (b, _) in where.items()})])
    for g, b, c, n in x.where(wanted).groupBy("language", "bin", "cost").count().collect():
        values[g, b].append((c, n))
    usual = {}
    for g, ks in ranks.items():
        mid, high = (_at_rank(values[g, b], rank)[0] for b, rank in (where[g, k] for k in ks))
        usual[g] = (mid, max(0.15, high - mid))
    return usual


def _at_rank(counted: list[tuple], rank: int) -> tuple:
    """The value at a rank, from 0, of counted values in order, and the rank among those equal to it."""
    for v, n in sorted(counted):
        if rank < n:
            return v, rank
        rank -= n
    raise IndexError(rank)


def language_votes(marks: DataFrame) -> DataFrame:
    """A table with :data:`MARKS` with the vote columns of :data:`PAIR_VOTES` in their place; it is read three times."""
    usual = usual_costs(marks)
    known = {k: F.create_map(*[x for g, v in sorted(usual.items()) for x in (F.lit(g), F.lit(v[k]))])[F.col("language")] if usual else F.lit(0.0) for k in (0, 1)}
    apart = F.coalesce((F.col("rest_cost") - known[0]) / known[1], F.lit(0.0))
    cast = lambda yes: F.when(F.col("language__profile") >= 0, yes.cast("int")).otherwise(-1)
    votes = marks.withColumns({"language__alien": cast(apart > 4), "language__foreign": cast((apart > 8) & F.col("bare"))})
    return votes.select(*[c for c in marks.columns if c not in MARKS.names], *PAIR_VOTES)
