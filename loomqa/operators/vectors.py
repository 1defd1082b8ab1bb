"""Nearest vectors of a stated query set, in blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomqa.runtime import shuffle_width

#: Queries and rows of one matrix product.
_STEP = 2048


class _Best:
    """The ``k`` best rows so far of each of some queries; ties go to the smaller item."""

    def __init__(self, ids: list[int], vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = np.array(ids, dtype="i8"), vectors, k
        self.dots = np.full((len(ids), k), -np.inf)
        self.items = np.full((len(ids), k), np.iinfo("i8").max, dtype="i8")

    def add(self, items: np.ndarray, vectors: np.ndarray) -> None:
        for q in range(0, len(self.ids), _STEP):
            for r in range(0, len(items), _STEP):
                self._add(slice(q, q + _STEP), items[r : r + _STEP], vectors[r : r + _STEP])

    def _add(self, q: slice, items: np.ndarray, vectors: np.ndarray) -> None:
        dots = self.vectors[q] @ vectors.T
        dots[self.ids[q][:, None] == items[None, :]] = -np.inf
        # only queries for which a row is as good as the worst that is held
        better = np.nonzero(dots.max(axis=1) >= self.dots[q].min(axis=1))[0]
        if not len(better):
            return
        d = np.hstack([self.dots[q][better], dots[better]])
        i = np.hstack([self.items[q][better], np.broadcast_to(items, (len(better), len(items)))])
        # rows at or above the k-th value; where ties make them more than k, the smaller items
        edge = np.partition(d, d.shape[1] - self.k, axis=1)[:, d.shape[1] - self.k]
        out_d, out_i = np.empty((len(better), self.k)), np.empty((len(better), self.k), dtype="i8")
        for n, (row_d, row_i, e) in enumerate(zip(d, i, edge)):
            at = np.nonzero(row_d >= e)[0]
            at = at[np.lexsort((row_i[at], -row_d[at]))[: self.k]]
            out_d[n], out_i[n] = row_d[at], row_i[at]
        self.dots[q.start + better], self.items[q.start + better] = out_d, out_i

    def rows(self) -> pa.RecordBatch:
        held = self.dots > -np.inf
        at, _ = np.nonzero(held)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at]), pa.array(self.items[held]), pa.array(self.dots[held])], names=["query", "item", "dot"])


_FOUND = "query long, item long, dot double"


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(n, -1)


def nearest(df: DataFrame, item: str, vector: str, queries: DataFrame, k: int = 10, block: int = 65_536) -> DataFrame:
    """query, item, dot, rnk: the ``k`` items with the highest dot product for each query row, itself left out.

    Up to ``block`` queries are broadcast (their number is counted first) and met by all rows in one
    pass without a shuffle. More are cut into blocks: queries and rows go by block and salt, and a task
    reads a block's queries before its rows, so the driver sees no vectors, the plan has one stage whatever
    the number of blocks, and rows are sent once a block. A task keeps ``k`` rows a query. Sums are in double
    precision; ties: the smaller item. Null vectors take no part; vectors of
    another length are an error."""
    spark = df.sparkSession
    asked = queries.select(F.col(item).cast("long").alias("i"), F.col(vector).alias("v")).dropna()
    slim = df.select(F.col(item).cast("long").alias("i"), F.col(vector).alias("v")).dropna()
    n = asked.count()
    out = _by_broadcast(slim, asked, k) if n <= block else _by_blocks(slim, asked, k, math.ceil(n / block), shuffle_width(spark, 2))
    w = Window.partitionBy("query").orderBy(F.desc("dot"), "item")  # at most k rows a task and query
    return out.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)


def _by_broadcast(slim: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.collect()
    if not rows:
        return slim.sparkSession.createDataFrame([], _FOUND)
    held = slim.sparkSession.sparkContext.broadcast(([r.i for r in rows], np.array([r.v for r in rows], dtype="f8")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*held.value, k)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows))
        yield best.rows()

    return slim.mapInArrow(run, _FOUND)


def _by_blocks(slim: DataFrame, asked: DataFrame, k: int, n_blocks: int, width: int) -> DataFrame:
    salts = max(1, math.ceil(width / n_blocks))
    of = F.pmod(F.xxhash64("i"), F.lit(n_blocks)).cast("int")
    q = asked.select(of.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "i", "v")
    r = slim.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod(F.xxhash64("i", F.lit(1)), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "i", "v")
    both = q.unionByName(r).repartition(max(width, n_blocks * salts), "block", "salt").sortWithinPartitions("block", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors, best = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            edges = [0, *(np.nonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                block, salt, kind = keys[:, a].tolist()
                if (block, salt) != current:
                    if best is not None:
                        yield best.rows()
                    current, ids, vectors, best = (block, salt), [], [], None
                items, v = batch.column(3).slice(a, b - a).to_numpy(), _matrix(batch.column(4).slice(a, b - a), b - a)
                if kind == 0:
                    ids += items.tolist()
                    vectors.append(v)
                elif ids:
                    best = best or _Best(ids, np.concatenate(vectors), k)
                    best.add(items, v)
        if best is not None:
            yield best.rows()

    return both.mapInArrow(run, _FOUND)
