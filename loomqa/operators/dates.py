"""Date formats inferred from examples."""

from __future__ import annotations

import calendar
import re
import zoneinfo
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

TOKEN = r"[0-9]+|[A-Za-z]+|[!-/:-@\[-`{-~]+|\s+|."

#: The elements from the most to the least restrictive, with their ranges or words.
NUMBERS = {"%m": (1, 12), "%I": (1, 12), "%H": (0, 23), "%d": (1, 31), "%M": (0, 59), "%S": (0, 60), "%y": (0, 99)}
ORDER = ("%p", "%m", "%I", "%H", "%d", "%M", "%S", "%y", "%Y", "%z", "%b", "%B", "%a", "%A", "%Z")
NUMERIC = frozenset(("%m", "%I", "%H", "%d", "%M", "%S", "%y", "%Y"))
WORDS = {
    "%p": ("AM", "PM", "am", "pm"), "%b": tuple(calendar.month_abbr)[1:], "%B": tuple(calendar.month_name)[1:], "%a": tuple(calendar.day_abbr), "%A": tuple(calendar.day_name),
}


def _zones() -> tuple[str, ...]:
    """Names of time zones that can be one token, from the tz database, with the usual abbreviations."""
    short = {z for z in zoneinfo.available_timezones() if z.isalpha()}
    return tuple(sorted(short | {"UTC", "GMT", "EST", "MST", "HST", "CET", "MET", "EET", "WET"}))


_ZONES = frozenset(_zones())


def tokens(c: Column) -> Column:
    """Runs of digits, ASCII letters, punctuation or white space; any other character by itself."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def matches(token: Column) -> dict[str, Column]:
    """For each element whether a token can be it."""
    n = F.when(token.rlike("^[0-9]{1,9}$"), token).cast("int")
    out = {d: F.coalesce(n.between(a, b), F.lit(False)) for d, (a, b) in NUMBERS.items()}
    out["%Y"] = token.rlike("^[0-9]{4}$")
    out["%z"] = token.rlike("^[0-9]{4}$")
    out |= {d: token.isin(*w) for d, w in WORDS.items()}
    out["%Z"] = token.isin(*_zones())
    return {d: out[d] for d in ORDER}


def tagged(df: DataFrame, key: str, example: str) -> DataFrame:
    """key, tags: the likeliest element of each position, or the commonest token as a filler (after a blank marker).

    Examples with the commonest number of tokens count (the fewest on a tie). For
    each position the element that most of them can be is taken, the most
    restrictive on a tie; below a half a filler. Tokens are counted by place before
    anything is joined or matched, and the counts are combined before the shuffle, so a key
    may have any number of examples. Null examples are left out; an empty text has no tokens."""
    x = df.where(F.col(example).isNotNull()).select(key, tokens(F.col(example)).alias("t"))
    by_token = x.select(key, F.size("t").alias("n"), F.posexplode_outer("t").alias("pos", "token")).groupBy(key, "n", "pos", "token").agg(F.count(F.lit(1)).alias("c"))
    sizes = by_token.where("coalesce(pos, 0) = 0").groupBy(key, "n").agg(F.sum("c").alias("c"))
    modal = sizes.groupBy(key).agg(F.min_by("n", F.struct((-F.col("c")).alias("c"), "n")).alias("n"))
    by_token = by_token.join(modal, [key, "n"])
    can = matches(F.col("token"))
    shares = by_token.groupBy(key, "pos").agg(F.min_by("token", F.struct((-F.col("c")).alias("c"), "token")).alias("filler"), *[(F.sum(F.when(m, F.col("c")).otherwise(0)) / F.sum("c")).alias(f"share{i}") for i, m in enumerate(can.values())])
    best = F.array_max(F.array(*[F.struct(F.col(f"share{i}").alias("share"), F.lit(-i).alias("rank"), F.lit(d).alias("d")) for i, d in enumerate(ORDER)]))
    tag = F.when(best.share < 0.5, F.concat(F.lit(" "), F.col("filler"))).otherwise(best.d)
    return shares.select(key, "pos", tag.alias("tag")).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "tag")))), lambda p: p.tag).alias("tags"))


def _is(tag: str, pattern: str) -> bool:
    """A pattern is an element, a filler (marker and text), ``.`` any, ``N`` a number, ``X`` no number."""
    return pattern == "." or pattern == tag or pattern == "N" and tag in NUMERIC or pattern == "X" and tag not in NUMERIC


def find(tags: list[str], pattern: list[str]) -> int:
    """Where a run of tags first fits the pattern; -1 for nowhere."""
    return next((i for i in range(len(tags) - len(pattern) + 1) if all(map(_is, tags[i : i + len(pattern)], pattern))), -1)


#: The rules in order. (all of these runs occur, these elements occur, this element occurs twice; then
#: a run and what it becomes (``=`` keeps, an empty text deletes), or an element and what its first occurrence
#: becomes, outside the run given, if any.)
RULES: tuple[dict, ...] = (
    {"run": ["%m", " :", "N", " :", "N"], "to": ["%I", "=", "%M", "=", "%S"]},
    {"run": ["%H", " :", "N", " :", "N"], "to": ["%H", "=", "%M", "=", "%S"]},
    {"run": ["%m", " :", "N", "X"], "to": ["%I", "=", "%M", "="]},
    {"run": ["%H", " :", "N", "X"], "to": ["%H", "=", "%M", "="]},
    {"seen": ["%I", " :", "%M"], "has": ["%H"], "swap": ("%H", "%d")},
    {"seen": ["%I", " :", "%M"], "twice": "%I", "swap": ("%I", "%m"), "outside": ["%I", " :"]},
    {"seen": ["%H", " :", "%M"], "twice": "%H", "swap": ("%H", "%d"), "outside": ["%H", " :"]},
    {"has": ["%m", "%B"], "swap": ("%m", "%d")},
    {"has": ["%m", "%b"], "swap": ("%m", "%d")},
    {"run": ["%m", ".", "%I"], "to": ["%m", "=", "%d"]},
    {"run": ["%m", ".", "%H"], "to": ["%m", "=", "%d"]},
    {"run": ["%I", ".", "%m"], "to": ["%d", "=", "%m"]},
    {"run": ["%H", ".", "%m"], "to": ["%d", "=", "%m"]},
    {"twice": "%m", "swap": ("%m", "%d")},
    {"run": [" +", "%Y"], "to": ["%z", ""]},
    {"run": [" -", "%Y"], "to": ["%z", ""], "after": ("%S", "%M", "%H", "%I")},
)


def rewrite(tags: list[str], rules: tuple[dict, ...] = RULES) -> list[str]:
    """Apply each rule once, in order, where its conditions hold."""
    for r in rules:
        tags = list(tags)
        if "seen" in r and find(tags, r["seen"]) < 0 or any(d not in tags for d in r.get("has", ())) or "twice" in r and tags.count(r["twice"]) < 2:
            continue
        if "run" in r:
            at = find(tags, r["run"])
            if at < 0 or "after" in r and (at == 0 or tags[at - 1] not in r["after"]):
                continue
            new = [old if x == "=" else x for old, x in zip(tags[at:], r["to"])]
            tags[at : at + len(new)] = [x for x in new if x]
        else:
            old, new = r["swap"]
            start = find(tags, r["outside"]) if "outside" in r else -1
            kept = range(start, start + len(r["outside"])) if start >= 0 else ()
            at = next((i for i, t in enumerate(tags) if t == old and i not in kept), -1)
            if at >= 0:
                tags[at] = new
    return tags


def format_of(tags: list[str], rules: tuple[dict, ...] = RULES) -> str:
    return "".join(t[1:] if t[0] == " " else t for t in rewrite(tags, rules))


def inferred_formats(df: DataFrame, key: str, example: str, rules: tuple[dict, ...] = RULES) -> DataFrame:
    """key, format: the strptime format most likely used in each key's examples.

    Only one short list of tags a key reaches Python. ``rules`` replaces the
    production rules. Null and empty examples: an empty text has no tokens and
    an empty format; a key with null examples only has no row."""

    @F.pandas_udf("string")
    def to_format(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda t: format_of(list(t), rules))

    x = tagged(df, key, example)
    return x.select(key, to_format("tags").alias("format"))


def most_restrictive(classes: Column) -> Column:
    """The element of an array that stands first in the order of restriction; null for none."""
    rank = F.create_map(*[x for i, d in enumerate(ORDER) for x in (F.lit(d), F.lit(i))])
    return F.array_min(F.transform(classes, lambda c: F.struct(F.element_at(rank, c).alias("rank"), c.alias("c")))).c


def elements_of(token: Column) -> Column:
    """The elements a token can be, the most restrictive first."""
    return F.filter(F.array(*[F.when(m, F.lit(d)) for d, m in matches(token).items()]), lambda d: d.isNotNull())


def match_shares(df: DataFrame, key: str, token: str) -> DataFrame:
    """key, element, share: the share of a key's tokens that can be each element. Tokens are counted before they
    are matched, and the counts combined before the shuffle."""
    counted = df.where(F.col(token).isNotNull()).groupBy(key, token).agg(F.count(F.lit(1)).alias("c")).withColumn("can", elements_of(F.col(token)))
    shares = counted.groupBy(key).agg(*[(F.sum(F.when(F.array_contains("can", d), F.col("c")).otherwise(0)) / F.sum("c")).alias(f"share{i}") for i, d in enumerate(ORDER)])
    return shares.select(key, F.inline(F.array(*[F.struct(F.lit(d).alias("element"), F.col(f"share{i}").alias("share")) for i, d in enumerate(ORDER)])))


def text_format(text: str | None) -> str | None:
    """The format of a single text: each token's most restrictive element, or the token itself, rewritten by the rules."""
    if text is None:
        return None
    zones = _ZONES

    def tag(t: str) -> str:
        number = int(t) if t.isascii() and t.isdigit() and len(t) <= 9 else None
        for d in ORDER:
            if d in NUMBERS and number is not None and NUMBERS[d][0] <= number <= NUMBERS[d][1]:
                return d
            if d in ("%Y", "%z") and number is not None and len(t) == 4 or d in WORDS and t in WORDS[d] or d == "%Z" and t in zones:
                return d
        return " " + t

    return format_of([tag(t) for t in re.findall(TOKEN, text, re.S)])


def same_format(df: DataFrame, key: str, answer: str, candidates: str, kind: str) -> DataFrame:
    """key, kept: the candidates of the answer's format, for answers of kind DATE; all of them for kind TIME. Rows of
    another kind or without an answer are left out. One pass without a shuffle."""
    @F.pandas_udf("array<string>")
    def kept(pairs: pd.DataFrame) -> pd.Series:
        memo: dict[str, str | None] = {}

        def of(t):
            if t not in memo:
                memo[t] = text_format(t)
            return memo[t]

        rows = zip(pairs["answer"], pairs["candidates"], pairs["kind"])
        return pd.Series([[c for c in (cs if cs is not None else ()) if c is not None and (k == "TIME" or of(c) == of(a))] for a, cs, k in rows], dtype=object)

    x = df.where(F.col(kind).isin("DATE", "TIME") & F.col(answer).isNotNull())
    return x.select(key, kept(F.struct(F.col(answer).alias("answer"), F.col(candidates).alias("candidates"), F.col(kind).alias("kind"))).alias("kept"))


#: Strptime directive -> Spark date-time pattern; weekdays are not parsed.
SPARK_PATTERN = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%I": "h", "%M": "mm", "%S": "ss", "%p": "a", "%b": "MMM", "%B": "MMMM", "%Z": "z", "%z": "Z"}


def spark_pattern(fmt: str) -> str:
    """The Spark pattern of a strptime format without weekdays (strip their text first)."""
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%" and fmt[i : i + 2] in SPARK_PATTERN:
            out.append(SPARK_PATTERN[fmt[i : i + 2]])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)
