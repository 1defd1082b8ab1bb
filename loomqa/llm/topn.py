"""Top N rows of every group by a mergeable bounded heap."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomqa.runtime import shuffle_width


def _rank(score: float, tie: float | None, item: int) -> tuple:
    """A key that is larger for better rows: score down, tie value up (NaN, then null, last), id up."""
    if tie is None:
        tail = (-2, 0.0)
    elif math.isnan(tie):
        tail = (-1, 0.0)
    else:
        tail = (0, -tie)
    return (score, *tail, -item)


class BoundedHeap:
    """The ``n`` best items seen so far, worst on top; an item is held once, with its best row.
    ``push`` serves both the single row and, row by row, the merge of another heap; the order of
    the rows makes no difference."""

    __slots__ = ("n", "heap", "held")

    def __init__(self, n: int):
        self.n, self.heap, self.held = n, [], {}

    def push(self, key: tuple, item: int, row: tuple) -> None:
        heap, held = self.heap, self.held
        old = held.get(item)
        if old is not None:
            if key > old:
                held[item] = key
                self.heap = heap = [e for e in heap if e[1] != item]
                heap.append((key, item, row))
                heapq.heapify(heap)
        elif len(heap) < self.n:
            held[item] = key
            heapq.heappush(heap, (key, item, row))
        elif key > heap[0][0]:
            held[item] = key
            del held[heapq.heapreplace(heap, (key, item, row))[1]]

    def best_first(self) -> list[tuple]:
        return [row for _, _, row in sorted(self.heap, key=lambda e: e[:2], reverse=True)]


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32())
_NAMES = ("g1", "g2", "item", "score", "tie", "rnk")


def _batch(rows: list[tuple], width: int) -> pa.RecordBatch:
    cols = zip(*rows) if rows else ([] for _ in range(width))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _TYPES)], names=_NAMES[:width])


#: Rows that the pass before the shuffle holds in heaps, and rows of a batch that goes out, at most (but for one group).
MOST_HELD = 100_000
MOST_OUT = 20_000


def _combine(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Fold rows (g1, g2, item, score, tie) into one heap for each group. When the heaps hold
    :data:`MOST_HELD` rows they go out and start anew: what leaves merges after the shuffle."""
    heaps: dict[tuple, BoundedHeap] = {}
    held = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            h = heaps.get(row[:2])
            if h is None:
                h = heaps[row[:2]] = BoundedHeap(n)
            elif len(h.heap) == n and row[3] < h.heap[0][0][0]:
                continue
            before = len(h.heap)
            h.push(_rank(row[3], row[4], row[2]), row[2], row)
            held += len(h.heap) - before
        if held >= MOST_HELD:
            yield _batch([r for h in heaps.values() for _, _, r in h.heap], 5)
            heaps.clear()
            held = 0
    yield _batch([r for h in heaps.values() for _, _, r in h.heap], 5)


def _merge(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Merge rows that come sorted by group: one heap at a time, with the ranks."""
    group, heap, out = None, BoundedHeap(n), []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != group:
                out += [(*r, i) for i, r in enumerate(heap.best_first(), 1)]
                group, heap = row[:2], BoundedHeap(n)
                if len(out) >= MOST_OUT:
                    yield _batch(out, 6)
                    out = []
            heap.push(_rank(row[3], row[4], row[2]), row[2], row)
    out += [(*r, i) for i, r in enumerate(heap.best_first(), 1)]
    yield _batch(out, 6)


def top_n(df: DataFrame, g1: str, g2: str, item: str, score: str, tie: str, n: int = 3) -> DataFrame:
    """The ``n`` rows of each group (g1, g2) with the highest score: columns g1, g2, item, score, tie, rnk.

    Two passes of the same bounded heap: one before the shuffle, so that a group of any
    size sends few rows a partition (its heap goes out whenever the task's heaps hold
    :data:`MOST_HELD` rows, so a task with millions of groups holds no more), and one after
    it that merges them, a group at a time in sorted order. Ties: ``tie`` ascending with NaN and then
    null last, then ``item`` ascending. Rows whose score is null or NaN, whose
    group's second part is null or whose item is null take no part; a null first
    part is a group of its own; an item that is repeated counts once, with
    its best row. An empty table gives
    no rows. Other columns of ``df`` are not read."""
    slim = df.select(
        F.col(g1).cast("long").alias("g1"), F.col(g2).cast("long").alias("g2"), F.col(item).cast("long").alias("item"),
        F.col(score).cast("double").alias("score"), F.col(tie).cast("double").alias("tie"),
    ).where("score is not null and not isnan(score) and g2 is not null and item is not null")
    local = slim.mapInArrow(lambda b: _combine(b, n), slim.schema)
    sorted_groups = local.repartition(shuffle_width(df.sparkSession), "g1", "g2").sortWithinPartitions("g1", "g2")
    return sorted_groups.mapInArrow(lambda b: _merge(b, n), "g1 long, g2 long, item long, score double, tie double, rnk int")
