"""Oversized texts cut into pieces at natural boundaries, by balanced targets."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Boundaries from strong to weak; a cut lies at the end of the match.
BOUNDARIES = (
    (6, re.compile(r"\n[ \t\r]*\n\s*")),
    (5, re.compile(r"\n\s*")),
    (4, re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+")),
    (3, re.compile(r"[;:]\s+")),
    (2, re.compile(r",\s+")),
    (1, re.compile(r"\s+")),
)


#: Marks, joiners and selectors that belong to the character before them.
_BELONGS = re.compile("[\u0300-\u036f\u200d\ufe0f\U0001f3fb-\U0001f3ff]")


def boundary_strengths(text: str) -> dict[int, int]:
    """Offset of each possible cut -> strength of the strongest boundary there."""
    found: dict[int, int] = {}
    for strength, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            found[m.end()] = strength
    return found


def _place(n: int, pieces: int, marks: list[int], strength: dict[int, int], text: str, limit: int, overlap: int) -> list[tuple[int, int]] | None:
    """Start and end of ``pieces`` pieces, or None if one is over the limit."""
    target = n / pieces
    slack = max(1, int(target * 0.25))
    cuts = [0]
    for k in range(1, pieces):
        ideal = round(k * target)
        # the piece with its overlap must fit, and what is left must fit into the pieces left
        low = max(cuts[-1] + 1, ideal - slack, n - (pieces - k) * (limit - overlap))
        high = min(ideal + slack, cuts[-1] + limit - (overlap if k > 1 else 0))
        if low > high:
            return None
        i, j = bisect.bisect_left(marks, low), bisect.bisect_right(marks, high)
        best = max(marks[i:j], key=lambda p: (strength[p] - 4 * abs(p - ideal) / (slack + 1), -p), default=None)
        if best is None:
            best = min(max(ideal, low), high)
            # never between a base character and a mark, joiner or selector that belongs to it
            while best > low and _BELONGS.match(text[best]):
                best -= 1
        cuts.append(best)
    cuts.append(n)
    spans = []
    for k in range(pieces):
        start = cuts[k]
        if k and overlap:
            # the overlap asked for, or less by a half at most where a boundary is nearby; a sentence's end goes before a weaker one
            reach, latest = max(cuts[k] - overlap, cuts[k - 1]), cuts[k] - (overlap + 1) // 2
            i, j = bisect.bisect_left(marks, reach), bisect.bisect_right(marks, latest)
            start = min(marks[i:j], key=lambda p: (strength[p] < 4, p), default=None)
            if start is None:
                start = reach
                while start < latest and _BELONGS.match(text[start]):
                    start += 1
        if cuts[k + 1] - start > limit or cuts[k + 1] <= cuts[k]:
            return None
        spans.append((start, cuts[k + 1]))
    return spans


def split_balanced(text: str, limit: int = 1500, overlap: int = 200) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces of a text, each of at most ``limit`` characters.

    The least number of pieces is computed, equal-length targets are placed and
    each is snapped to the strongest nearby boundary; if any piece would exceed
    the limit, one more piece is tried. Each piece after the first repeats ``overlap`` characters of the
    one before it, or less by a half at most, so that it starts at a boundary; the whole of what the one before added, if
    that is shorter. A text within
    the limit, also an empty one, is one piece. Every character is covered."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    strength = boundary_strengths(text)
    marks = sorted(p for p in strength if 0 < p < n)
    pieces = max(2, math.ceil((n - overlap) / (limit - overlap)))
    while True:
        spans = _place(n, pieces, marks, strength, text, limit, overlap)
        if spans:
            return spans
        pieces += 1


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int = 1500, overlap: int = 200) -> DataFrame:
    """The pieces of the texts longer than ``limit``: the key columns with piece_n, n_pieces, start, end, piece.

    Lengths are code points. Null, empty and short texts give no rows. The
    filter runs in the scan's stage, so only oversized texts reach Python; the
    operator needs no shuffle. Columns other than keys and text are not read."""
    slim = df.select(*keys, F.col(text).alias("__text")).where(F.char_length("__text") > limit)
    schema = slim.drop("__text").schema
    for name, kind in (("piece_n", T.IntegerType()), ("n_pieces", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("piece", T.StringType())):
        schema = schema.add(name, kind)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row_of, cols = [], ([], [], [], [], [])
            for i, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                spans = split_balanced(t, limit, overlap)
                for k, (a, b) in enumerate(spans):
                    row_of.append(i)
                    for c, v in zip(cols, (k, len(spans), a, b, t[a:b])):
                        c.append(v)
            kept = [batch.column(i).take(pa.array(row_of, pa.int32())) for i in range(batch.num_columns - 1)]
            made = [pa.array(c, pa.int32()) for c in cols[:4]] + [pa.array(cols[4], pa.string())]
            yield pa.RecordBatch.from_arrays(kept + made, names=[f.name for f in schema])

    return slim.mapInArrow(pieces, schema)
