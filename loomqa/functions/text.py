"""Text cleaning and predicates as column expressions (no Python UDF)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from loomqa.functions.constants import ANSWER_BLACKLIST, ANSWER_PREFIXES, ANTONYMS, AUTHORS, PUNCTUATION, SPACE, STOP_WORDS


def sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """Without white space, of any script, at the ends."""
    return sub(c, f"^[{SPACE}]+|[{SPACE}]+$")


def collapse(c: Column) -> Column:
    """Runs of white space become one blank."""
    return sub(c, f"[{SPACE}]+", " ")


def words(c: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def clean_question(c: Column) -> Column:
    """Trimmed, repeated dots and question marks made one, trailing underscores and one token of junk after the last question mark removed."""
    t = sub(sub(sub(strip(c), r"\.+", "."), r"\?+", "?"), r"_+$")
    return strip(F.replace(sub(t, r"(?<=\?)\s*\S*$"), F.lit("? -"), F.lit("?")))


def clean_answer(c: Column) -> Column:
    """Without a leading option letter and a closing "The final answer is (a)."."""
    return strip(sub(sub(strip(c), r"^(?:\([a-zA-Z]\)|[a-zA-Z]\))"), r"[Tt]he final answer(?::| is: |s are:| is) ?\([A-Za-z]\)\.?$"))


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    t = F.translate(F.lower(c), PUNCTUATION, "")
    return F.trim(collapse(sub(t, r"(?U)\b(?:a|an|the)\b", " ")))


def answer_tokens(c: Column) -> Column:
    """Tokens of the normalised answer; none for an empty one."""
    return F.filter(F.split(normalize_answer(c), " "), lambda x: x != "")


def discarded_question(c: Column) -> Column:
    """True for questions not to ask: who-questions, "What is ..." and those without a question mark."""
    return c.rlike(r"^(?:[Ww]ho|WHO .*)") | c.rlike(r"^(?:[Ww]hat is|are the final answer|answers to the question|questions)") | ~c.contains("?")


def blacklisted_answer(c: Column) -> Column:
    """True if the answer, without underscores and punctuation, names nobody."""
    return strip(F.lower(sub(F.replace(c, F.lit("_"), F.lit("")), r"(?U)[^\w\s]"))).isin(*ANSWER_BLACKLIST)


def bad_answer(c: Column) -> Column:
    return blacklisted_answer(c) | strip(c).endswith(":")


def plain_characters(c: Column) -> Column:
    """Only letters, digits, white space and simple punctuation; at least one character."""
    return c.rlike(r"^(?U)[\w\s.,%=+:()\-]+$")


def has_long_word(c: Column, most: int = 20) -> Column:
    return F.exists(words(c), lambda w: F.char_length(w) > most)


def in_brackets(span: Column, sentence: Column) -> Column:
    """Whether a bracketed part of the sentence, round or square, holds the span."""
    found = F.concat(F.regexp_extract_all(sentence, F.lit(r"\(.*?\)"), F.lit(0)), F.regexp_extract_all(sentence, F.lit(r"\[.*?\]"), F.lit(0)))
    return F.exists(found, lambda m: F.contains(m, span))


def longer(a: Column, b: Column) -> Column:
    """The longer of two texts, the first on a tie."""
    return F.when(F.char_length(a) >= F.char_length(b), a).otherwise(b)


def cloze(context: Column, answer: Column) -> Column:
    return F.replace(context, answer, F.lit("___???___"))


def without_quotes(c: Column) -> Column:
    return F.translate(c, "\"'", "")


def without_odd_characters(c: Column) -> Column:
    """Characters that do not survive a round trip become blanks."""
    return sub(c, "[{}^\\\\`⁇<]", " ")


def content_words(answer: Column, question: Column) -> Column:
    """Lower-cased tokens of the answer without its opening phrase, stop words, punctuation and the question's words."""
    prefixes = "|".join(sorted(ANSWER_PREFIXES, key=lambda p: (-len(p), p)))
    t = F.regexp_extract_all(F.lower(sub(answer, f"(?i)^(?:{prefixes}) ")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))
    asked = F.split(F.lower(F.replace(question, F.lit("?"), F.lit(""))), r"\s+")
    drop = F.array(*[F.lit(w) for w in (*STOP_WORDS, *PUNCTUATION)])
    return F.array_join(F.filter(t, lambda w: ~F.array_contains(drop, w) & ~F.array_contains(asked, w)), " ")


def flip_negation(question: Column, token: Column) -> Column:
    """The question with the negated token made positive; null for a token without an antonym."""
    table = F.create_map(*[F.lit(x) for kv in ANTONYMS.items() for x in kv])
    return F.replace(question, token, F.element_at(table, F.lower(token)))


def substitute_span(answer: Column, span: Column, to: Column) -> Column:
    """Every occurrence of ``span``, in any case, replaced literally by ``to``."""
    return F.regexp_replace(answer, F.concat(F.lit(r"(?i)\Q"), F.replace(span, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), F.regexp_replace(to, F.lit(r"([\\$])"), F.lit(r"\\$1")))


def is_abbreviation(a: Column, b: Column) -> Column:
    """Whether the shorter phrase starts with the initials of the first two words, stop words apart, of the longer."""
    x, y = F.lower(strip(a)), F.lower(strip(b))
    short = F.replace(F.when(F.char_length(x) < F.char_length(y), x).otherwise(y), F.lit("."), F.lit(""))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    full = F.filter(words(F.when(F.char_length(x) < F.char_length(y), y).otherwise(x)), lambda w: ~F.array_contains(stop, w))
    enough = (F.char_length(short) >= 2) & (F.size(full) >= 2)
    return F.when(enough, (F.substring(short, 1, 1) == F.substring(F.get(full, 0), 1, 1)) & (F.substring(short, 2, 1) == F.substring(F.get(full, 1), 1, 1))).otherwise(False)


def without_prefix(c: Column, prefix: Column) -> Column:
    """What follows as many characters as the prefix has, trimmed."""
    return strip(F.substr(c, F.char_length(prefix) + 1))


def generated_text(c: Column) -> Column:
    """Generated text up to its author line, in one line."""
    return F.replace(F.substring_index(c, "\nAuthors", 1), F.lit("\n"), F.lit(" "))


def prefix_length(answer: Column, question: Column) -> Column:
    """1 and the number of words after the first that are stop words, punctuation or in the question, up to the first that is not."""
    drop = F.concat(F.array(*[F.lit(w) for w in (*STOP_WORDS, *PUNCTUATION)]), F.split(F.lower(F.replace(question, F.lit("?"), F.lit(""))), r"\s+"))
    rest = F.slice(words(answer), 2, 1 << 20)
    start = F.struct(F.lit(1).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(rest, start, lambda s, w: F.struct((s.n + F.when(s.on & F.array_contains(drop, F.lower(w)), 1).otherwise(0)).alias("n"), (s.on & F.array_contains(drop, F.lower(w))).alias("on")), lambda s: s.n)


def authors(c: Column) -> Column:
    """First person made the authors, word by word between blanks."""
    table = F.create_map(*[F.lit(x) for kv in AUTHORS.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def uppercase_share(c: Column) -> Column:
    """Share of characters that equal their upper case; null for an empty text."""
    n = F.char_length(c)
    return F.when(n > 0, F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0), lambda s, x: s + F.when(x == F.upper(x), 1).otherwise(0)) / n)


def capitalised(c: Column) -> Column:
    """Each word that is no stop word with a capital and small letters."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_join(F.transform(words(c), lambda w: F.when(F.array_contains(stop, w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))), " ")


def option_prompt(question: Column, options: list[Column]) -> Column:
    """The question with its lettered options; the fifth has no blank after its letter, as the selector expects."""
    parts = [F.concat(F.lit(f" ({chr(97 + i)})" + ("" if i == 4 else " ")), o) for i, o in enumerate(options)]
    return F.concat(question, F.lit(" \n"), *parts, F.lit(" \n "))


def split_outputs(outputs: Column, mark: str = "<sep>") -> Column:
    """Generated outputs split at the mark, in one list, trimmed, without empty ones and later copies."""
    flat = F.flatten(F.transform(outputs, lambda x: F.split(x, mark)))
    return F.array_distinct(F.filter(F.transform(flat, strip), lambda x: x != ""))


def sentences(c: Column) -> Column:
    """Sentences: cut after a full stop, question or exclamation mark, or an ellipsis, that white space and no small letter follow."""
    return F.filter(F.transform(F.split(c, rf"(?<=[.!?…])[{SPACE}]+(?=[^\p{{Ll}}])"), strip), lambda s: s != "")


def html_text(c: Column) -> Column:
    """Text of an HTML fragment: comments, scripts, styles and tags dropped, the common entities read."""
    t = sub(sub(c, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"), r"<[^>]*>")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def elements_text(elements: Column) -> Column:
    """Texts of (tag, text) elements other than those tagged I, joined by blanks."""
    return F.array_join(F.transform(F.filter(elements, lambda e: e.tag != "I"), lambda e: e.text), " ")


def request_text(kind: Column, html: Column, elements: Column) -> Column:
    """Text of a request by its kind, with single blanks; an unknown kind is an error."""
    t = F.when(kind == "html", html_text(html)).when(kind == "elems", elements_text(elements)).otherwise(F.raise_error(F.concat(F.lit("input data type not supported: "), F.coalesce(kind, F.lit("null")))))
    return collapse(t)


def replace_abbreviations(c: Column, pairs: list[tuple[str, str]], target: str = "full", only_first: bool = True) -> Column:
    """Abbreviations written in one form: short, long, or full ("long (SHORT)").

    For each (short, long) in order: "long (SHORT)" and "long" become SHORT, then
    the first or all SHORT become the target form. The texts are matched
    literally; later pairs of the same short form win."""
    quote = lambda t: "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    safe = lambda t: t.replace("\\", "\\\\").replace("$", "\\$")

    def one(t: Column, pair: tuple[str, str]) -> Column:
        short, long = pair
        form = {"short": short, "long": long, "full": f"{long} ({short})"}[target]
        t = sub(t, f"(?i){quote(long)} \\({quote(short)}\\)", safe(short))
        t = sub(t, f"(?i){quote(long)}", safe(short))
        word = rf"(?U)(?<!\w){quote(short)}(?!\w)"
        if only_first:
            return sub(t, f"(?s)^(.*?){word}", f"$1{safe(form)}")
        return sub(t, word, safe(form))

    return functools.reduce(one, dict(pairs).items(), c)


def score_prompt(question: Column, gold: Column, predicted: Column, context: Column) -> Column:
    """The scorer's input, of normalised texts: question <q> gold answer <r> predicted answer <c> context."""
    return F.concat(normalize_answer(question), F.lit(" <q> "), normalize_answer(gold), F.lit(" <r> "), normalize_answer(predicted), F.lit(" <c> "), normalize_answer(context))


def perplexity(log_likelihood: Column, text: Column) -> Column:
    """exp of the log-likelihood by the text's words, of which an empty text counts one."""
    return F.exp(log_likelihood / F.greatest(word_count(text), F.lit(1)))


def padded_together(a: Column, b: Column, least: int = 5) -> tuple[Column, Column]:
    """Both lists with as many empty texts after them as the shorter one needs to have ``least`` entries; null is empty."""
    none = F.array().cast("array<string>")
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    more = F.greatest(least - F.size(x), least - F.size(y), F.lit(0))
    return F.concat(x, F.array_repeat(F.lit(""), more)), F.concat(y, F.array_repeat(F.lit(""), more))


def kept_phrase_question(sentence: Column, phrase: Column, question: Column, answer: Column) -> Column:
    """Whether a question asked of a phrase of a sentence is kept: the sentence has 10 to 45 words and the
    phrase stands in no bracket of it, the question ends with its mark and does not give the
    phrase away, the answer holds the phrase or the other way round, and the longer of
    both has three words or more, hyphens parting words."""
    n = word_count(sentence)
    final = words(F.replace(longer(phrase, answer), F.lit("-"), F.lit(" ")))
    fit = F.contains(phrase, answer) | F.contains(answer, phrase)
    return n.between(10, 45) & ~in_brackets(phrase, sentence) & question.endswith("?") & ~F.contains(F.lower(question), F.lower(phrase)) & (answer != "") & fit & (F.size(final) >= 3)
