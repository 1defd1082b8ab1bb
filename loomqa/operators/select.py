"""Ordered selections: greedy diversity, maximal marginal relevance, n-best spans and top-n."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomqa.functions.similarity import cosine, let
from loomqa.functions.constants import PUNCTUATION, STOP_WORDS
from loomqa.functions.text import strip
from loomqa.runtime import materialize, shuffle_width


def greedy_diverse(df: DataFrame, group: str, item: str, score: str, vectors: list[str], limits: list[float], n: int = 35, least_score: float | None = None) -> DataFrame:
    """group, item, rnk: items accepted best-first, each unlike all accepted before it.

    An item is accepted if, for each vector column, its dot product with every
    accepted item's is below that column's limit, and its score is at least
    ``least_score`` where one is given; the walk of a group ends at ``n``. Order:
    score descending, item ascending. A group's rows stream through one task in
    that order while at most ``n`` vectors are held, so no group is collected;
    rows after the n-th are skipped. Null vectors, scores and items take no part."""
    slim = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"), *[F.col(v).alias(f"v{k}") for k, v in enumerate(vectors)]).dropna()
    if least_score is not None:
        slim = slim.where(F.col("s") >= least_score)
    kind = slim.schema["g"].dataType.simpleString()
    item_kind = slim.schema["i"].dataType.simpleString()
    ordered = slim.repartition(shuffle_width(df.sparkSession), "g").sortWithinPartitions("g", F.desc("s"), "i")
    bounds = tuple(limits)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, taken, held = None, True, 0, [[] for _ in bounds]
        for batch in batches:
            out = []
            gs, it = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for r, g in enumerate(gs):
                if first or g != current:
                    current, first, taken, held = g, False, 0, [[] for _ in bounds]
                if taken >= n:
                    continue
                vs = [batch.column(3 + k)[r].values.to_numpy(zero_copy_only=False).astype("f8") for k in range(len(bounds))]
                if all(not h or float(np.max(np.stack(h) @ v)) < b for h, v, b in zip(held, vs, bounds)):
                    for h, v in zip(held, vs):
                        h.append(v)
                    taken += 1
                    out.append((r, taken))
            at = pa.array([r for r, _ in out], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([k for _, k in out], pa.int32())], names=["g", "i", "rnk"])

    return ordered.mapInArrow(walk, f"g {kind}, i {item_kind}, rnk int").select(F.col("g").alias(group), F.col("i").alias(item), "rnk")


def accept_in_order(df: DataFrame, key: str, word: str, candidates: str, unlike: Callable[[str, str], bool], n: int = 5) -> DataFrame:
    """key, kept: for each row the first ``n`` candidates that are ``unlike`` the word and all kept before."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for w, cs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                got = [w] if w is not None else []
                for c in cs or ():
                    if len(got) > n:
                        break
                    if c is not None and all(unlike(c, g) for g in got):
                        got.append(c)
                kept.append(got[1:] if w is not None else got)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.string()))], names=[key, "kept"])

    return df.select(key, word, candidates).mapInArrow(run, f"{key} {kind}, kept array<string>")


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def one_edit_apart(a: str, b: str) -> bool:
    """Whether at most one insertion, deletion, replacement or swap of neighbours lies between them."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :]
    return len(b) - len(a) == 1 and a[k:] == b[k + 1 :]


def initials_match(a: str, b: str) -> bool:
    """The row function of :func:`loomqa.functions.text.is_abbreviation`."""
    short, long = sorted((a.strip().lower(), b.strip().lower()), key=len)
    short = short.replace(".", "")
    full = [w for w in long.split() if w not in STOP_WORDS]
    return len(short) > 1 and len(full) > 1 and short[0] == full[0][0] and short[1] == full[1][0]


def unlike_distractors(candidate: str, other: str, threshold: float = 0.7) -> bool:
    """No common word, more than one edit apart, no abbreviation, and far by normalised distance."""
    if set(candidate.split()) & set(other.split()) or initials_match(candidate, other):
        return False
    a, b = candidate.lower(), other.lower()
    longest = max(len(a), len(b))
    return not one_edit_apart(a, b) and longest > 0 and edit_distance(a, b) / longest > threshold


def checked_candidates(candidates: Column, answer: Column) -> Column:
    """Candidates that are not blank, not the answer and, but for case and outer blanks, not a copy of one before; null stays null."""
    low = lambda c: F.lower(F.trim(c))
    kept = F.filter(candidates, lambda c: c.isNotNull() & (low(c) != "") & (low(c) != low(answer)))
    first = lambda cs, only: F.filter(cs, lambda c, i: F.array_position(only, low(c)) == i + 1)
    return let([kept], lambda cs: let([cs, F.transform(cs, low)], first))


def marginal_relevance(df: DataFrame, group: str, item: str, vector: str, target: str, top_n: int = 5, diversity: float = 0.8) -> DataFrame:
    """group, item, similarity, rnk: the items of each group by maximal marginal relevance.

    The seed is the item least like the group's target; then min(top_n - 1,
    items - 2) times the item with the highest (1 - diversity) * similarity to the
    seed - diversity * highest similarity to a chosen one; at last by similarity
    to the seed, rounded to 4 places, descending. Two candidates so give one.
    Vectors are written once. Each choice is one aggregation with partial maxima over all groups at once,
    beside a table of what is chosen (at most ``top_n`` vectors a group), so a group may have
    any number of items. Ties: the smaller item."""
    base = materialize(df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(vector).alias("v"), F.col(target).alias("t")).dropna())
    seed = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("i", "v"), F.struct(cosine(F.col("v"), F.col("t")).alias("c"), "i")).alias("s"))
    picks = materialize(seed.select("g", "n", F.array("s").alias("chosen")))
    for k in range(1, top_n):
        x = base.join(picks.where(F.col("n") - 2 >= k), "g").where(~F.exists("chosen", lambda c: c.i == F.col("i")))
        near = F.array_max(F.transform("chosen", lambda c: cosine(F.col("v"), c.v)))
        value = (1 - diversity) * cosine(F.col("v"), F.get("chosen", 0).v) - diversity * near
        best = x.groupBy("g").agg(F.min_by(F.struct("i", "v"), F.struct((-value).alias("x"), "i")).alias("p"))
        picks = materialize(picks.join(best, "g", "left").select("g", "n", F.when(F.col("p").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array("p"))).alias("chosen")))
    done = picks.select("g", F.get("chosen", 0).v.alias("s"), F.explode("chosen").alias("c")).select("g", F.col("c.i").alias("i"), F.round(cosine(F.col("c.v"), F.col("s")), 4).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("similarity"), "i"))
    return done.withColumn("rnk", rank).select(F.col("g").alias(group), F.col("i").alias(item), "similarity", "rnk")


def top_similar(df: DataFrame, group: str, text: str, similarity: str, n: int, low: float, high: float, order: str) -> DataFrame:
    """The ``n`` rows of each group with the highest similarity strictly between the bounds; of texts equal but for case the first by ``order``."""
    first = df.groupBy(group, F.lower(text).alias("__t")).agg(F.min_by(F.struct(text, similarity, order), order).alias("r")).select(group, "r.*")
    w = Window.partitionBy(group).orderBy(F.desc(similarity), order)
    return first.where((F.col(similarity) > low) & (F.col(similarity) < high)).withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n)


def best_spans(starts: Column, ends: Column, question_end: Column, nbest: int) -> Column:
    """array<struct<start, end, score>> of the spans made of the ``nbest`` starts and ends, best first.

    Logits are arrays; positions 1 up to ``question_end`` - 1 belong to the
    question; a span ends at or after its start. Ties: the better start, then the
    better end, then the smaller position."""
    ranked = lambda a: F.slice(F.array_sort(F.transform(a, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.cast("int").alias("i")))), 1, nbest)
    asked = lambda i: (i >= 1) & (i < question_end)
    pairs = F.flatten(F.transform(ranked(starts), lambda s: F.transform(ranked(ends), lambda e: F.struct((s.neg + e.neg).alias("neg"), s.i.alias("start"), e.i.alias("end")))))
    kept = F.filter(pairs, lambda p: ~asked(p.start) & ~asked(p.end) & (p.end >= p.start))
    return F.transform(F.array_sort(kept), lambda p: F.struct(p.start.alias("start"), p.end.alias("end"), (-p.neg).alias("score")))


def best_answers(spans: Column, tokens: Column, null_score: Column, nbest: int) -> Column:
    """array<struct<text, score>>: the best spans that do not start at 0, one for each text, then the null answer."""
    texts = F.transform(F.filter(spans, lambda p: p.start > 0), lambda p: F.struct(F.array_join(F.slice(tokens, p.start + 1, p.end - p.start + 1), " ").alias("text"), p.score.alias("score")))
    first = lambda xs, only: F.filter(xs, lambda x, i: F.array_position(only, x.text) == i + 1)
    kept = let([texts], lambda xs: let([xs, F.transform(xs, lambda y: y.text)], first))
    return F.concat(F.slice(kept, 1, nbest), F.array(F.struct(F.lit("").alias("text"), null_score.cast("double").alias("score"))))


def softmax(scores: Column) -> Column:
    """Shares of the exponentials, moved by the highest score; empty for no scores."""
    moved = lambda xs, top: F.transform(xs, lambda x: F.exp(x - top))
    shares = lambda e: let([e, F.aggregate(e, F.lit(0.0), lambda a, x: a + x)], lambda e, total: F.transform(e, lambda x: x / total))
    return let([scores, F.array_max(scores)], lambda xs, top: let([moved(xs, top)], shares))


def null_margin(answers: Column) -> Column:
    """Score of the null answer, the last, less that of the best."""
    return F.element_at(answers, -1).score - F.element_at(answers, 1).score


def cascade(*strategies: Column) -> Column:
    """The first strategy's result unless it is null; after it the first that found anything."""
    head, *rest = strategies
    return F.coalesce(head, *[F.when(F.size(s) > 0, s) for s in rest], F.array().cast("array<string>"))


def ranked_options(options: Column) -> Column:
    """Texts of array<struct<text, score>> that are not blank, the highest score first, the first on a tie; null scores last."""
    kept = F.filter(options, lambda o: F.coalesce(strip(o.text), F.lit("")) != "")
    placed = F.transform(kept, lambda o, i: F.struct(o.score.isNull().alias("none"), (-o.score).alias("s"), i.alias("i"), o.text.alias("text")))
    return F.transform(F.array_sort(placed), lambda o: o.text)


def by_perplexity(outputs: Column) -> Column:
    """Texts of array<struct<text, ppl>> by perplexity ascending, the first on a tie: the score stays with its text."""
    placed = F.transform(outputs, lambda o, i: F.struct(o.ppl.alias("ppl"), i.alias("i"), o.text.alias("text")))
    return F.transform(F.array_sort(placed), lambda o: o.text)


def multiset_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: the keys that both tables hold, each as often as both do."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    return count(a, "__a").join(count(b, "__b"), keys).select(*keys, F.least("__a", "__b").alias("n"))


def islands(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, first, last, n of each run of rows with the same key that follow one another in the order, which must be total.

    A row's place in the table less its place among the rows of its key is the same all
    along a run. Both places come by ranges, so no task sees the whole table or a whole key."""
    from loomqa.operators.running import numbered

    slim = df.select(key, order).where(F.col(key).isNotNull() & F.col(order).isNotNull())
    x = numbered(numbered(slim, [], [order], "__all"), [key], [order], "__own")
    runs = x.groupBy(key, (F.col("__all") - F.col("__own")).alias("__run"))
    return runs.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")
