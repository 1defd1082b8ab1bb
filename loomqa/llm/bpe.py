"""Byte-level BPE of a public vocabulary, with our own merge loop."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Merge ranks (token bytes -> id) of a ``.tiktoken`` vocabulary file's content."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Encoder:
    """Encodes texts with the ranks given; a bounded memo keeps frequent chunks."""

    MEMO = 200_000

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.single = [bytes([b]) for b in range(256)]

    def merge(self, chunk: bytes) -> tuple[int, ...]:
        """Merge by a priority queue of ranks over a doubly linked list of symbols.

        An entry names the left symbol, its version and the right one's; it is
        stale, and skipped, when either symbol was merged or grew since."""
        ranks = self.ranks
        if chunk in ranks:
            return (ranks[chunk],)
        n = len(chunk)
        sym = [self.single[b] for b in chunk]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        version = [0] * n  # -1: merged into its left neighbour
        queue = []
        for i in range(n - 1):
            r = ranks.get(sym[i] + sym[i + 1])
            if r is not None:
                queue.append((r, i, 0, i + 1, 0))
        heapq.heapify(queue)
        while queue:
            _, i, vi, j, vj = heapq.heappop(queue)
            if version[i] != vi or version[j] != vj:
                continue
            sym[i] += sym[j]
            version[i] += 1
            version[j] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                r = ranks.get(sym[i] + sym[k])
                if r is not None:
                    heapq.heappush(queue, (r, i, version[i], k, version[k]))
            h = left[i]
            if h >= 0:
                r = ranks.get(sym[h] + sym[i])
                if r is not None:
                    heapq.heappush(queue, (r, h, version[h], i, version[i]))
        return tuple(ranks[s] for s, v in zip(sym, version) if v >= 0)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; an empty list for an empty or a null text."""
        if not text:
            return []
        memo, out = self.memo, []
        for w in self.words(text):
            ids = memo.get(w)
            if ids is None:
                ids = self.merge(w.encode("utf-8", "replace"))
                if len(w) <= 64:
                    if len(memo) >= self.MEMO:
                        memo.clear()
                    memo[w] = ids
            out += ids
        return out


def decode(ids: list[int], strings: dict[int, bytes]) -> str:
    """The text of ids: their vocabulary strings joined and read as UTF-8."""
    return b"".join(strings[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[tuple[int, str], Encoder] = {}
_STRINGS: dict[int, dict[int, bytes]] = {}


def _content(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary file of more than 64 MB is not broadcast")
    return data


def decode_corpus(df: DataFrame, doc_id: str, ids: str, vocabulary: str) -> DataFrame:
    """doc_id and text of each row's ids: the inverse of :func:`encode_corpus` but for null texts, which come back empty.

    Null ids are empty; an id that is not in the vocabulary is an error. No shuffle."""
    data = _content(vocabulary)
    held = df.sparkSession.sparkContext.broadcast(data)
    key = hash(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _STRINGS.get(key)
        if strings is None:
            strings = _STRINGS[key] = {i: b for b, i in load_ranks(held.value).items()}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or [], strings) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids)).mapInArrow(run, "doc_id long, text string")


def encode_corpus(df: DataFrame, doc_id: str, text: str, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id and ids (array<int>) of each row's text; one output row for each input row.

    ``vocabulary`` is the path of a ``.tiktoken`` rank file that the driver can
    read; ``pattern`` is the one its publisher cuts texts by (the default is that of both public rank files). Its content (under 1 MB, fixed) is broadcast, so that executors need no
    file; each Python worker builds the table once. No shuffle. Null and empty
    texts give an empty list; blank texts are encoded as they are."""
    data = _content(vocabulary)
    held = df.sparkSession.sparkContext.broadcast(data)
    key = (hash(data), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(key)
        if enc is None:
            enc = _ENCODERS[key] = Encoder(load_ranks(held.value), pattern)
        for batch in batches:
            ids = [enc.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")
