"""Similarities of texts and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomqa.functions.text import answer_tokens, normalize_answer, without_odd_characters, without_quotes, words


def let(values: list[Column], body) -> Column:
    """``body`` of values that are computed once, however often it, or a lambda in it, uses them."""
    one = F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))
    return F.get(F.transform(one, lambda s: body(*[s[f"v{i}"] for i in range(len(values))])), 0)


def exact_match(gold: Column, answer: Column) -> Column:
    """1 if the normalised texts are equal, else 0."""
    return (normalize_answer(gold) == normalize_answer(answer)).cast("int")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Common elements, each as often as both lists have it; null if either list is."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    counted = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    # where one side repeats nothing, the distinct common elements are all there is
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted))


def f1_of(common: Column, n_gold: Column, n_answer: Column) -> Column:
    """Harmonic mean of precision and recall; with an empty side 1 if both are empty, else 0."""
    p, r = common / n_answer, common / n_gold
    return F.when((n_gold == 0) | (n_answer == 0), (n_gold == n_answer).cast("double")).when(common == 0, 0.0).otherwise(2 * p * r / (p + r))


def token_f1(gold: Column, answer: Column) -> Column:
    scored = lambda g, a: let([multiset_overlap(g, a), F.size(g), F.size(a)], f1_of)
    return F.when(gold.isNotNull() & answer.isNotNull(), let([answer_tokens(gold), answer_tokens(answer)], scored))


def set_f1(gold: Column, answer: Column) -> Column:
    """As token_f1, with the overlap counted once a token."""
    scored = lambda g, a: let([F.size(F.array_intersect(g, a)), F.size(g), F.size(a)], f1_of)
    return F.when(gold.isNotNull() & answer.isNotNull(), let([answer_tokens(gold), answer_tokens(answer)], scored))


def normalized_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance as a share of the longer length; 0 for two empty texts."""
    n = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a.isNull() | b.isNull(), None).when(n == 0, 0.0).otherwise(F.levenshtein(a, b) / n)


def one_edit(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, replacement or swap of neighbours, or none, makes one text the other."""
    n, m = F.char_length(a), F.char_length(b)
    # position of the first difference decides where a swap must lie
    at = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2))
    swap = (n == m) & F.exists(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: at(i) == b)
    return (F.levenshtein(a, b) <= 1) | ((F.abs(n - m) == 0) & (F.levenshtein(a, b) == 2) & swap)


def shares_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(words(a), words(b))


def string_score(a: Column, b: Column) -> Column:
    """3 identical; 2 identical but for quotes and odd characters; else overlap of blank-separated words by the longer list; 0 for two single words."""

    def score(x: Column, y: Column) -> Column:
        xs, ys = F.split(x, " "), F.split(y, " ")
        share = F.size(F.array_intersect(xs, ys)) / F.greatest(F.size(xs), F.size(ys))
        return F.when(x == y, 2.0).when(x.contains(" ") | y.contains(" "), share).otherwise(0.0)

    return F.when(a.isNull() | b.isNull(), None).when(a == b, 3.0).otherwise(let([without_odd_characters(without_quotes(a)), without_odd_characters(without_quotes(b))], score))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)
