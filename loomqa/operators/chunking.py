"""Chunks, token windows and context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomqa.functions.similarity import let
from loomqa.functions.text import sentences, word_count

_CHUNKS = "struct<done:array<string>,cur:array<string>,len:int>"


def packed_sentences(sents: Column, budget: int, length=word_count) -> Column:
    """Sentences packed greedily into chunks within ``budget`` units; a sentence over it is a chunk of its own.

    ``length`` is the injected length of a text, by default its number of words."""
    state = lambda done, cur, n: F.struct(done.alias("done"), cur.alias("cur"), n.alias("len"))
    none = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        n = length(x)
        fits = s.len + n <= budget
        joined = F.concat(s.done, F.array(F.array_join(s.cur, " ")))
        return (
            F.when(fits, state(s.done, F.concat(s.cur, F.array(x)), s.len + n))
            .when(F.size(s.cur) == 0, state(F.concat(s.done, F.array(x)), none, F.lit(0)))
            .otherwise(state(joined, F.array(x), n))
        )

    end = lambda s: F.when(F.size(s.cur) > 0, F.concat(s.done, F.array(F.array_join(s.cur, " ")))).otherwise(s.done)
    return F.aggregate(sents, state(none, none, F.lit(0)).cast(_CHUNKS), step, end)


def chunks(text: Column, budget: int, length=word_count) -> Column:
    """The whole text if it is within the budget, else its packed sentences."""
    return F.when(length(text) <= budget, F.array(text)).otherwise(packed_sentences(sentences(text), budget, length))


def overlapping_chunks(question: Column, text: Column, budget: int, overlap: int = 2, length=word_count) -> Column:
    """Sentences packed beside a question, each chunk after the first opening with the last ``overlap`` sentences before it.

    The last sentence is never lost and no chunk is empty; a chunk is over the
    budget only if its sentences with their overlap cannot be within it."""
    # sentences, their lengths and the question's length are computed once
    return let([sentences(text), length(question)], lambda sents, asked: let([sents, F.transform(sents, length), asked], lambda xs, ns, q: _overlapping(xs, ns, F.lit(budget) - q, overlap)))


def _overlapping(sents: Column, lengths: Column, room: Column, overlap: int) -> Column:
    def step(s: Column, i: Column) -> Column:
        n = F.get(lengths, i)
        fits = (s.len + n <= room) | (i == s.start)
        back = F.greatest(i - overlap, F.lit(0))
        carried = F.aggregate(F.slice(lengths, back + 1, i - back), F.lit(0), lambda a, x: a + x)
        grown = F.struct(s.cuts.alias("cuts"), s.start.alias("start"), (s.len + n).cast("int").alias("len"))
        cut = F.struct(F.concat(s.cuts, F.array(F.struct(s.start.alias("a"), i.alias("b")))).alias("cuts"), back.cast("int").alias("start"), (carried + n).cast("int").alias("len"))
        return F.when(fits, grown).otherwise(cut)

    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("cuts"), F.lit(0).alias("start"), F.lit(0).alias("len")).cast("struct<cuts:array<struct<a:int,b:int>>,start:int,len:int>")
    end = lambda s: F.concat(s.cuts, F.array(F.struct(s.start.alias("a"), F.size(sents).alias("b"))))
    index = F.when(F.size(sents) > 0, F.sequence(F.lit(0), F.size(sents) - 1)).otherwise(F.array().cast("array<int>"))
    spans = F.when(F.size(sents) > 0, F.aggregate(index, start, step, end)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    return F.transform(spans, lambda c: F.array_join(F.slice(sents, c.a + 1, c.b - c.a), " "))


def section_chunks(df: DataFrame, keys: list[str], text: str, budget: int, length=word_count) -> DataFrame:
    """keys, chunk_n, chunk: the chunks of each section with a text, numbered from 0."""
    return df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(chunks(F.col(text), budget, length)).alias("chunk_n", "chunk"))


def enough_words(c: Column, least: int) -> Column:
    """More than ``least`` words."""
    return word_count(c) > least


def token_windows(tokens: Column, length: int = 128, cover_tail: bool = False) -> Column:
    """array<struct<window_n, start, end>>: the least number of windows, moved together so that they overlap evenly.

    As rounding up makes the overlap, the last tokens may stay uncovered;
    ``cover_tail`` ends the last window at the text's end instead."""
    n = F.ceil(tokens / length).cast("int")
    over = F.ceil((n * length - tokens) / F.greatest(n - 1, F.lit(1))).cast("int")
    starts = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("window_n"), (i * (length - over)).cast("int").alias("start"), (i * (length - over) + length).cast("int").alias("end")))
    if not cover_tail:
        return starts
    last = F.greatest(tokens.cast("int") - length, F.lit(0))
    return F.transform(starts, lambda w: F.when((w.window_n == n - 1) & (n > 1), F.struct(w.window_n.alias("window_n"), last.alias("start"), (last + length).alias("end"))).otherwise(w))


def answer_context(context: Column, answer: Column, around: int = 2) -> Column:
    """The answer's first occurrence marked, in its sentence marked, with ``around`` sentences on either side.

    Without the answer the context itself."""
    at = F.position(answer, context)
    marked = F.concat(F.substr(context, F.lit(1), at - 1), F.lit("@ANS_BEGIN@"), answer, F.lit("@ANS_END@"), F.substr(context, at + F.char_length(answer)))
    sents = sentences(marked)
    index = F.array_position(F.transform(sents, lambda s: F.contains(s, F.lit("@ANS_BEGIN@"))), True).cast("int") - 1
    first = F.greatest(index - around, F.lit(0))
    shown = F.transform(sents, lambda s, i: F.when(i == index, F.concat(F.lit("@SENT_BEGIN@"), s, F.lit("@SENT_END@"))).otherwise(s))
    return F.when((at > 0) & (answer != "") & (index >= 0), F.array_join(F.slice(shown, first + 1, index + around + 1 - first), " ")).otherwise(context)


def nearest_prefix(sents: Column, target: Column) -> Column:
    """Number of leading sentences whose joint length in characters is nearest to ``target``, the fewest on a tie; 0 for none."""
    sums = F.aggregate(sents, F.array().cast("array<int>"), lambda a, s: F.concat(a, F.array((F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), a), -1), F.lit(0)) + F.char_length(s)).cast("int"))))
    return F.coalesce(F.array_min(F.transform(sums, lambda v, i: F.struct(F.abs(v - target).alias("d"), (i + 1).alias("n")))).n, F.lit(0))

