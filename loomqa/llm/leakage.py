"""Evaluation texts in a corpus, by a generalised suffix automaton over words."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomqa.runtime import materialize, shuffle_width

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of the items' word sequences.

    ``length``/``link``/``next`` are the usual tables. ``hits[s]`` lists
    (needed length, item) for the passages that end where state ``s`` ends:
    each ``passage``-word passage of an item, and an item of fewer words as a whole."""

    def __init__(self, items: list[tuple[int, list[str]]], passage: int = 12):
        self.length, self.link, self.next = [0], [-1], [{}]
        owner: list[list[int]] = [[]]
        ends: list[list[tuple[int, int]]] = [[]]

        def state(length: int, link: int, edges: dict) -> int:
            self.length.append(length)
            self.link.append(link)
            self.next.append(edges)
            owner.append([])
            ends.append([])
            return len(self.length) - 1

        def extend(last: int, w: str) -> int:
            length, link, nxt = self.length, self.link, self.next
            if w in nxt[last]:  # another item has this text already
                q = nxt[last][w]
                if length[q] == length[last] + 1:
                    return q
                return clone(last, w, q)
            cur = state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else clone(p, w, q)
            return cur

        def clone(p: int, w: str, q: int) -> int:
            length, link, nxt = self.length, self.link, self.next
            c = state(length[p] + 1, link[q], dict(nxt[q]))
            link[q] = c
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = c
                p = link[p]
            return c

        for _, seq in items:
            last = 0
            for w in seq:
                last = extend(last, w)
        # walk each item once more, now that all clones exist
        for item, seq in items:
            s, n = 0, len(seq)
            for i, w in enumerate(seq, 1):
                s = self.next[s][w]
                if i >= passage:
                    t = s
                    while self.length[self.link[t]] >= passage:
                        t = self.link[t]
                    owner[t].append(item)
            if 0 < n < passage:
                ends[s].append((n, item))
        # a state has all that its suffixes have; the order of lengths serves links first
        self.hits: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            own = [(passage, i) for i in dict.fromkeys(owner[s])] + ends[s]
            up = self.hits[self.link[s]]
            self.hits[s] = tuple(dict.fromkeys((*up, *own))) if own else up

    def scan(self, seq: list[str]) -> dict[int, list[tuple[int, int]]]:
        """item -> spans (first word, one past the last word) of its passages in ``seq``; touching spans are joined."""
        found: dict[int, list[tuple[int, int]]] = {}
        nxt, link, length, hits = self.next, self.link, self.length, self.hits
        s = n = 0
        for i, w in enumerate(seq, 1):
            t = nxt[s].get(w)
            if t is None:
                while s and t is None:
                    s = link[s]
                    t = nxt[s].get(w)
                if t is None:
                    n = 0
                    continue
                n = length[s] + 1
            else:
                n += 1
            s = t
            if hits[s]:
                for need, item in hits[s]:
                    if n >= need:
                        a = i - need
                        spans = found.setdefault(item, [])
                        if spans and spans[-1][1] >= a:
                            spans[-1] = (min(spans[-1][0], a), i)
                        else:
                            spans.append((a, i))
        return found


_AUTOMATA: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, items: list[tuple[int, list[str]]], passage: int) -> SuffixAutomaton:
    """The automaton of a block, built once in a Python worker; a worker keeps one."""
    known = _AUTOMATA.get(key)
    if known is None:
        _AUTOMATA.clear()
        known = _AUTOMATA[key] = SuffixAutomaton(items, passage)
    return known


def _slim(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).where("id is not null and t is not null")


_SPANS = "doc_id long, th long, item_id long, first_word int, end_word int, n_words int"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
_NAMES = ("doc_id", "th", "item_id", "first_word", "end_word", "n_words")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ([] for _ in _KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def _scanned(sam: SuffixAutomaton, d: int, th: int, t: str) -> list[tuple]:
    seq = words(t)
    return [(d, th, item, a, b, len(seq)) for item, spans in sam.scan(seq).items() for a, b in spans]


def _one_block(docs: DataFrame, items: DataFrame, passage: int) -> DataFrame:
    """Spans by one automaton, of items that are a block at most: they are broadcast, and the corpus is streamed once without a shuffle."""
    block = [(r.id, seq) for r in items.collect() if (seq := words(r.t))]
    held, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = _automaton(key, held.value, passage)
        for batch in batches:
            yield _rows([r for d, th, t in zip(*(c.to_pylist() for c in batch.columns)) for r in _scanned(sam, d, th, t)])

    return docs.mapInArrow(run, _SPANS)


#: Bits of the filter of passages that is broadcast, at most: 32 MB. A fuller filter lets more candidates through, and loses none.
MOST_BITS = 1 << 28
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _windows(seq: list[str], lengths: tuple[int, ...], memo: dict[str, int]) -> np.ndarray:
    """Hashes of all runs of the lengths given, by one rolling polynomial each."""
    if len(memo) > 500_000:
        memo.clear()
    ids = []
    for w in seq:
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    h, out = np.array(ids, dtype=np.uint64), []
    with np.errstate(over="ignore"):
        for n in lengths:
            if len(h) >= n:
                x = np.full(len(h) - n + 1, n, dtype=np.uint64)
                for k in range(n):
                    x = x * _STEP + h[k : len(h) - n + 1 + k]
                out.append(x ^ (x >> np.uint64(29)))
    return np.unique(np.concatenate(out)) if out else np.array([], dtype=np.uint64)


def _anchors(items: DataFrame, passage: int) -> DataFrame:
    """h, block, n: the hash and number of words of each passage of an item, or of a whole shorter one, with the item's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            hs, bs, ns = [], [], []
            for block, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seq = words(t)
                h = _windows(seq, (min(len(seq), passage),), memo) if seq else ()
                hs.append(np.asarray(h, dtype=np.uint64).view(np.int64))
                bs.append(np.full(len(h), block, dtype=np.int32))
                ns.append(np.full(len(h), min(len(seq), passage), dtype=np.int32))
            cat = lambda x, k: pa.array(np.concatenate(x) if x else np.array([], dtype=k))
            yield pa.RecordBatch.from_arrays([cat(hs, np.int64), cat(bs, np.int32), cat(ns, np.int32)], names=["h", "block", "n"])

    return items.select("block", "t").mapInArrow(run, "h long, block int, n int").distinct()


def _filter_of(anchors: DataFrame) -> np.ndarray:
    """Bits of the passages' hashes. The hashes of items, not of documents, pass the driver, a partition at a time."""
    size = min(MOST_BITS, max(1 << 16, 1 << math.ceil(math.log2(16 * max(1, anchors.count())))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy(zero_copy_only=False).tobytes()], pa.binary())], names=["b"])

    bits = np.zeros(size // 8, dtype=np.uint8)
    for (b,) in anchors.select("h").mapInArrow(packed, "b binary").toLocalIterator():
        for at in _places(np.frombuffer(bytes(b), dtype=np.uint64), size):
            np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    return bits


def _places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(size - 1), (h >> np.uint64(31)) & np.uint64(size - 1)


def _sharded(docs: DataFrame, items: DataFrame, passage: int, n_blocks: int) -> DataFrame:
    """Spans by one automaton for each block of items, of any number of blocks.

    The corpus is scanned twice: once for the documents that hold a passage's hash (the
    filter of hashes is broadcast, at most 32 MB; what passes meets the items' own hashes in a join), and
    once for the texts of those. Each candidate meets the automata of its blocks only: items and candidates go by
    block and salt, and a task reads a block's items before its candidates."""
    spark = docs.sparkSession
    items = items.select("id", "t", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"))
    anchors = materialize(_anchors(items, passage))
    lengths = tuple(sorted(n for (n,) in anchors.select("n").distinct().collect()))
    held = spark.sparkContext.broadcast(_filter_of(anchors))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        bits = held.value
        size = len(bits) * 8
        for batch in batches:
            ds, ts, hs = [], [], []
            for d, th, t in zip(*(c.to_pylist() for c in batch.columns)):
                h = _windows(words(t), lengths, memo)
                x, y = _places(h, size)
                test = lambda at: (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                found = h[(test(x) & test(y)).astype(bool)].view(np.int64).tolist()
                ds += [d] * len(found)
                ts += [th] * len(found)
                hs += found
            yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(ts, pa.int64()), pa.array(hs, pa.int64())], names=["id", "th", "h"])

    found = materialize(docs.mapInArrow(hits, "id long, th long, h long").join(anchors, "h").select("id", "th", "block").distinct())
    width = shuffle_width(spark, 2)
    salts = max(1, width // n_blocks)
    candidates = docs.join(found, ["id", "th"]).select("block", F.pmod(F.xxhash64("id", "th"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "th", "t")
    texts = items.select("block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("th"), "t")
    both = texts.unionByName(candidates).repartition(max(width, n_blocks * salts), "block", "salt").sortWithinPartitions("block", "salt", "kind", "id", "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held_items, sam = None, [], None
        for batch in batches:
            out = []
            for block, salt, kind, d, th, t in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, salt) != current:
                    current, held_items, sam = (block, salt), [], None
                if kind == 0:
                    held_items.append((d, words(t)))
                    continue
                if sam is None:
                    sam = SuffixAutomaton(held_items, passage)
                out += _scanned(sam, d, th, t)
            yield _rows(out)

    return both.mapInArrow(run, _SPANS)


def _spans(df: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, passage: int, block_chars: int) -> DataFrame:
    docs = _slim(df, doc_id, text).withColumn("th", F.xxhash64("t")).select("id", "th", "t")
    known = _slim(items, item_id, item_text).distinct()
    chars = known.agg(F.sum(F.char_length("t"))).first()[0] or 0
    return _one_block(docs, known, passage) if chars <= block_chars else _sharded(docs, known, passage, math.ceil(chars / block_chars))


def leaked_spans(df: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, passage: int = 12, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, first_word, end_word, n_words of every leaked passage.

    A document leaks an item if it has ``passage`` consecutive words of it, or
    all words of an item that has fewer. Items of at most ``block_chars`` characters in all make one
    automaton, which is broadcast and built once a Python worker; the corpus is streamed once without a
    shuffle. More items are cut into blocks of about that size, of which a task holds one, and the
    corpus is scanned twice, whatever their number. Texts are processed whole. Null ids, null, empty
    and wordless texts and items give no rows."""
    return _spans(df, doc_id, text, items, item_id, item_text, passage, block_chars).drop("th")


def leaked_documents(spans: DataFrame) -> DataFrame:
    """doc_id, item_id of :func:`leaked_spans`, distinct."""
    return spans.select("doc_id", "item_id").distinct()


def _cut(t: str | None, spans: list[tuple[int, int]], max_coverage: float) -> tuple[str | None, int, bool]:
    """(text, words removed, dropped) of a text whose words in the spans go."""
    if not spans:
        return t, 0, False
    seq = words(t)
    spans = sorted(spans)
    gone = {k for a, b in spans for k in range(a, b)}
    if len(gone) > max_coverage * len(seq):
        return None, len(gone), True
    if len(t.lower()) != len(t):
        return " ".join(w for k, w in enumerate(seq) if k not in gone), len(gone), False
    at = [(m.start(), m.end()) for m in WORD.finditer(t.lower())]
    keep, last = [], 0
    for a, b in spans:
        if at[b - 1][1] > last:
            keep.append(t[last : max(last, at[a][0])])
            last = at[b - 1][1]
    return "".join(keep) + t[last:], len(gone), False


def without_leaks(df: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, passage: int = 12, max_coverage: float = 0.5, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, text, n_removed, dropped: each document with the words of leaked passages cut out.

    A document of which more than ``max_coverage`` of the words leaked is
    dropped as a whole (``dropped``, text null). Null and wordless texts, and rows with a null id,
    stay as they are. The spans of :func:`leaked_spans` are written to the shared folder and go back by
    the id and the text's hash, so items of any size can be cut out; only documents with a leak
    reach Python."""
    spans = materialize(_spans(df, doc_id, text, items, item_id, item_text, passage, block_chars))
    by_doc = spans.groupBy(F.col("doc_id").alias("id"), "th").agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans"))
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).withColumn("th", F.xxhash64("t"))
    x = docs.join(by_doc, ["id", "th"], "left")

    @F.pandas_udf("text string, n_removed int, dropped boolean")
    def cut(ts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = [_cut(t, [(s["first_word"], s["end_word"]) for s in v] if v is not None else [], max_coverage) for t, v in zip(ts, spans)]
        return pd.DataFrame(rows, columns=["text", "n_removed", "dropped"])

    # texts without a leak don't go to Python
    x = x.withColumn("c", cut(F.when(F.col("spans").isNotNull(), F.col("t")), F.col("spans")))
    return x.select(F.col("id").alias("doc_id"), F.when(F.col("spans").isNull(), F.col("t")).otherwise(F.col("c.text")).alias("text"), "c.n_removed", "c.dropped")
