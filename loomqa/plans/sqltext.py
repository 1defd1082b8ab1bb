"""SQL fragments shared by the text queries' SQL."""

from __future__ import annotations

from loomqa.functions.constants import PUNCTUATION, SPACE

SP = f"[{SPACE}]"
#: questions once each
Q = "with q as (select distinct on (question_id) * from questions_df) "
_ARTICLE = r"(^|[^\p{L}\p{N}\p{M}_])(a|an|the)([^\p{L}\p{N}\p{M}_]|$)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{SP}+|{SP}+$")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {lit(SP + '+')}), lambda w: w <> '')"


def norm(x: str) -> str:
    t = f"translate(lower({x}), {lit(PUNCTUATION)}, '')"
    return f"trim({sub(sub(sub(t, _ARTICLE, chr(92) + '1 ' + chr(92) + '3'), _ARTICLE, chr(92) + '1 ' + chr(92) + '3'), SP + '+', ' ')})"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def overlap(a: str, b: str) -> str:
    """Multiset overlap of two list columns."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"


def f1(common: str, g: str, a: str) -> str:
    return f"case when len({g}) = 0 or len({a}) = 0 then cast(len({g}) = len({a}) as double) when {common} = 0 then 0.0 else 2 * ({common} / len({a})) * ({common} / len({g})) / ({common} / len({a}) + {common} / len({g})) end"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: cast({a}[i] as double) * cast({b}[i] as double)))"


_LABEL = r"\s*(?:head|type|tail)\s*[:=]"


def field(name: str) -> str:
    """A labelled value of relation_spans.record: of a JSON object, or up to the next label or the text's end."""
    start = rf"(?is)(?:^|[\n|;])\s*{name}\s*(?:: ?|=)"
    found = f"regexp_extract(record, {lit(start + rf'(.*?)(?: ?[|]{_LABEL}|[\n;]{_LABEL}|$)')}, 1)"
    return f"case when starts_with(ltrim(record), '{{') then json_extract_string(record, '$.{name}') when regexp_matches(record, {lit(start)}) then {found} end"


#: relation_spans with head, type and tail from the record where the columns are null
RECORDS = "(select rel_id, " + ", ".join(f"coalesce({n}, {field(n)}) {n}" for n in ("head", "type", "tail")) + ", url, span_start, span_end, seen_at from relation_spans)"
#: sentences of a text: a cut after an end mark where white space and no small letter follow
_CUT = rf"([.!?…]){SP}+([^\p{{Ll}}])"


def sentences(x: str) -> str:
    cut = "chr(92) || '1' || chr(1) || chr(92) || '2'"
    once = f"regexp_replace({x}, {lit(_CUT)}, {cut}, 'g')"
    twice = f"regexp_replace({once}, {lit(_CUT)}, {cut}, 'g')"
    return f"list_filter(list_transform(string_split({twice}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"


def edits(a: str, b: str, function: str = "levenshtein") -> str:
    """An edit distance by code points: DuckDB's own counts bytes, so each different character of both texts is given a byte first."""
    letters = f"list_sort(list_distinct(string_split({a} || {b}, '')))"
    plain = lambda c: f"coalesce(array_to_string(list_transform(list_filter(string_split({c}, ''), lambda x: x <> ''), lambda x: chr(cast(list_position({letters}, x) as integer))), ''), '')"
    return f"{function}({plain(a)}, {plain(b)})"
