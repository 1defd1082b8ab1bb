"""Pairs of records with similar word sets: an exact, distributed prefix-tree join."""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomqa.llm.leakage import WORD
from loomqa.runtime import materialize, shuffle_width

#: Frequent tokens are held as two bytes, others as eight.
MOST_FREQUENT = 60_000
#: Split paths that are broadcast, at most. Those of the most records are taken; what is then
#: still crowded is joined in blocks.
MOST_SPLIT = 1_000_000
#: Records under one path that one task joins, at most; more go in blocks of half as many.
MOST_IN_PATH = 40_000


def word_set(*texts: str | None) -> set[str]:
    """Words (runs of letters and digits, lower-cased) of the texts together; null is empty."""
    out: set[str] = set()
    for t in texts:
        if t:
            out.update(WORD.findall(t.lower()))
    return out


def shingle_set(n: int, *texts: str | None) -> set[str]:
    """n-grams of words of each text; a shorter text is one shingle."""
    out: set[str] = set()
    for t in texts:
        w = WORD.findall(t.lower()) if t else []
        out.update(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1)) if w)
    return out


def _sets(n: int, batch: pa.RecordBatch) -> Iterator[set[str]]:
    for row in zip(*(c.to_pylist() for c in batch.columns[1:])):
        yield word_set(*row) if n == 1 else shingle_set(n, *row)


def least_overlap(n: int, m: int, t: float) -> int:
    """Common elements that sets of n and m elements need for a Jaccard similarity of t."""
    return math.ceil(t * (n + m) / (1 + t) - 1e-9)


def frequent_words(df: DataFrame, texts: list[str], n: int, least: int, cap: int) -> tuple[dict[str, tuple[int, int]], set[int]]:
    """Element -> code and number of rows of the elements that at least ``least`` rows have, the rarest
    first; and the hashes of further elements that more than ``cap`` rows have (:data:`MOST_SPLIT` at most).

    Counted over all rows with a combine before the shuffle. At most
    :data:`MOST_FREQUENT` of them, those of the most rows, are taken; so the
    table that is broadcast has a fixed bound, and the order of the rest needs
    no counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.string()), pa.array(list(c.values()), pa.int64())], names=["w", "c"])
            c.clear()
            return out

        for batch in batches:
            for s in _sets(n, batch):
                c.update(s)
            if len(c) > 500_000:
                yield flush()
        yield flush()

    counted = df.mapInArrow(count, "w string, c long").groupBy("w").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    counted = materialize(counted)
    top = counted.orderBy(F.desc("c"), "w").limit(MOST_FREQUENT).collect()
    more: set[int] = set()
    if len(top) == MOST_FREQUENT and top[-1].c > cap:
        known = {r.w for r in top}
        rest = counted.where(F.col("c") > cap).orderBy(F.desc("c"), "w").limit(MOST_FREQUENT + MOST_SPLIT)
        more = {_rare(w) for (w,) in rest.select("w").toLocalIterator() if w not in known}
    return {r.w: (i, r.c) for i, r in enumerate(reversed(top))}, more


def encoded_sets(df: DataFrame, key: str, texts: list[str], n: int, frequent: dict[str, int]) -> DataFrame:
    """key, enc: each row's set in the global order, as bytes: a count, then the rare
    elements' 64-bit hashes by value, then the frequent ones' codes, the rarest first."""
    held = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = held.value
        for batch in batches:
            enc = []
            for s in _sets(n, batch):
                low = sorted(code[w][0] for w in s if w in code)
                rare = sorted({_rare(w) for w in s if w not in code})
                enc.append(struct.pack(f"<I{len(rare)}Q{len(low)}H", len(rare), *rare, *low) if s else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(enc, pa.binary())], names=["key", "enc"])

    return df.select(F.col(key).alias("key"), *texts).mapInArrow(run, "key long, enc binary").where("enc is not null")


#: Set in every hash, so that none equals a code.
_RARE = 1 << 63


def _rare(w: str) -> int:
    return xxhash.xxh64_intdigest(w) | _RARE


_LAYOUTS: dict[tuple[int, int], struct.Struct] = {}


def decode_set(enc: bytes) -> tuple[int, ...]:
    """The elements of an encoded set in the global order."""
    key = (int.from_bytes(enc[:4], "little"), len(enc))
    layout = _LAYOUTS.get(key)
    if layout is None:
        r = key[0]
        layout = _LAYOUTS[key] = struct.Struct(f"<4x{r}Q{(key[1] - 4 - 8 * r) // 2}H")
    return layout.unpack(enc)


def _extend(path: int, token: int) -> int:
    """Hash of a path of tokens made longer by one. Python hashes tuples of integers alike in every process."""
    return hash((path, token))


def paths(tokens: tuple[int, ...], t: float, split: set[int], most: int) -> Iterator[tuple[int, int, int]]:
    """(path hash, depth, position after the path) of the sub-sequences a record is filed under.

    Two similar records share at least ``least_overlap`` elements; of the common
    ones, the k-th stands at a position below n - least + k in each. So both are
    filed under the first one, or, where that path is in ``split``, under the
    first two, and so on: both decide alike, as ``split`` is the same for all. A
    record that may share no more than the elements of a split path is filed
    under the path's end as well, as its partners then are."""
    n = len(tokens)
    least = math.ceil(t * n - 1e-9)
    slack = n - least  # elements it may have without a partner
    stack = [(0, 0, 0)]
    while stack:
        path, depth, at = stack.pop()
        depth += 1
        for i in range(at, min(n, slack + depth)):
            p = _extend(path, tokens[i])
            if p not in split or depth >= most:
                yield p, depth, i + 1
                continue
            stack.append((p, depth, i + 1))
            if least <= depth:
                yield _extend(p, -1), depth, i + 1


def crowded_paths(sets: DataFrame, t: float, cap: int, most: int, split: set[int], most_split: int | None = None) -> tuple[set[int], bool]:
    """Hashes of the paths under which more than ``cap`` records would be filed, level by level, and
    whether some may be left: paths of the greatest length, or beyond ``most_split`` in number.

    ``split`` has the single elements in more than ``cap`` sets. Each further
    level counts only what lies below the crowded paths of the one before, over
    the records that have one. Their number is at most (paths a record) * rows /
    cap a level; ``cap`` grows with the root of the rows, so the set that is
    broadcast grows with the root, up to its fixed bound."""
    most_split = MOST_SPLIT if most_split is None else most_split
    sc, sets = sets.sparkSession.sparkContext, sets.select("enc")
    for level in range(2, most):
        held = sc.broadcast(split)

        def count(batches: Iterator[pa.RecordBatch], held=held, level=level) -> Iterator[pa.RecordBatch]:
            c: Counter = Counter()

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.int64()), pa.array(list(c.values()), pa.int64())], names=["p", "c"])
                c.clear()
                return out

            for batch in batches:
                for enc in batch.column(0).to_pylist():
                    c.update([p for p, d, _ in paths(decode_set(enc), t, held.value, level) if d == level])
                if len(c) > 300_000:
                    yield flush()
            yield flush()

        crowded = sets.mapInArrow(count, "p long, c long").groupBy("p").agg(F.sum("c").alias("c")).where(F.col("c") > cap)
        room = most_split - len(split)
        # one more than there is room for, so that a full set is noticed; the paths of the most records come first
        found = [p for (p,) in crowded.orderBy(F.desc("c"), "p").limit(max(0, room) + 1).select("p").collect()]
        if not found:
            return split, False
        if len(found) > room:
            return split | set(found[: max(0, room)]), True
        found = set(found)
        if level < 4:
            now = sc.broadcast(found)

            def having(batches: Iterator[pa.RecordBatch], held=held, now=now, level=level) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    kept = [not now.value.isdisjoint([p for p, d, _ in paths(decode_set(enc), t, held.value, level) if d == level]) for enc in batch.column(0).to_pylist()]
                    yield batch.filter(pa.array(kept, pa.bool_()))

            sets = materialize(sets.mapInArrow(having, "enc binary"))
        split = split | found
    return split, True


def _in_blocks(filed: DataFrame, most: int) -> DataFrame:
    """``filed`` with ``part`` and ``side``: paths with more than ``most`` rows are cut into blocks of half of that,
    and each row goes to the part of its block and to those of its block with each other one.

    In a part of two blocks one (side 0) is filed in the tree and the other (side 1) probes it; else
    (side 2) each row does both. So each two rows of a path meet in one task, which holds at most
    ``most`` rows of it."""
    filed = materialize(filed)
    blocks = filed.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("path", F.ceil(F.col("n") * 2.0 / most).cast("int").alias("k"))
    k = F.coalesce("k", F.lit(1))
    x = filed.join(blocks, "path", "left").withColumn("block", F.pmod(F.xxhash64("record"), k).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") == low, 0).otherwise(1)
    return x.select("path", "record", "meta", "rest", (low * k + high).alias("part"), side.alias("side"))


class PrefixTree:
    """A tree of globally ordered element sequences that finds those similar to a probe.

    A node is [fewest elements of a set below it, longest rest below it, children
    by element, sets that end here]; a child may also be a leaf (size, elements
    left, record), so that a chain without a branch takes no nodes."""

    def __init__(self, t: float):
        self.t = t
        self.root = [1 << 30, 0, {}, []]

    def insert(self, size: int, rest: tuple[int, ...], record: int) -> None:
        node, d = self.root, 0
        while True:
            node[0] = min(node[0], size)
            node[1] = max(node[1], len(rest) - d)
            if d == len(rest):
                node[3].append((size, record))
                return
            child = node[2].get(rest[d])
            if child is None:
                node[2][rest[d]] = (size, rest[d + 1 :], record)
                return
            if type(child) is tuple:  # split the chain by one node
                s, r, x = child
                child = node[2][rest[d]] = [s, len(r), {}, []]
                if r:
                    child[2][r[0]] = (s, r[1:], x)
                else:
                    child[3].append((s, x))
            node, d = child, d + 1

    def similar(self, size: int, rest: tuple[int, ...], shared: int) -> Iterator[int]:
        """Records whose overlap with the probe, of ``size`` elements of which ``rest`` follow
        the ``shared`` ones of the path, reaches the threshold."""
        mine, n = set(rest), len(rest)
        need = _needs(size, self.t)
        stack = [(self.root, shared, n)]  # node, overlap so far, elements of the probe left
        while stack:
            node, have, left = stack.pop()
            for s, record in node[3]:
                if have >= need[s]:
                    yield record
            for w, child in node[2].items():
                if w in mine:
                    o, u = have + 1, left - 1
                else:
                    o, u = have, left
                if type(child) is tuple:
                    s, r, record = child
                    a = need[s] - o
                    # remaining-length bounds, then the rest of the chain at once
                    if a <= u and a <= len(r) and a <= len(mine.intersection(r)):
                        yield record
                else:
                    a = need[child[0]] - o
                    if a <= u and a <= child[1]:
                        stack.append((child, o, u))


class _Needs(dict):
    """Size of the other set -> overlap needed."""

    def __init__(self, size: int, t: float):
        super().__init__()
        self.size, self.t = size, t

    def __missing__(self, other: int) -> int:
        a = self[other] = least_overlap(self.size, other, self.t)
        return a


_NEEDS: dict[tuple[int, float], _Needs] = {}


def _needs(size: int, t: float) -> _Needs:
    found = _NEEDS.get((size, t))
    if found is None:
        found = _NEEDS[size, t] = _Needs(size, t)
    return found


def _filed(sets: DataFrame, t: float, split: set[int], most: int) -> DataFrame:
    """path, record, meta (16 * size + depth), rest: one row for each path a record is filed under."""
    held = sets.sparkSession.sparkContext.broadcast(split)
    schema = "path long, record long, meta int, rest binary"

    def out(ps: list, rec: list, meta: list, rest: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(rec, pa.int64()), pa.array(meta, pa.int32()), pa.array(rest, pa.binary())], names=["path", "record", "meta", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ps, rec, meta, rest, size = [], [], [], [], 0
            for record, enc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = decode_set(enc)
                n, r = len(tokens), struct.unpack_from("<I", enc)[0]
                for p, depth, at in paths(tokens, t, held.value, most):
                    ps.append(p)
                    rec.append(record)
                    meta.append(n * 16 + depth)
                    rest.append(struct.pack("<I", max(0, r - at)) + (enc[4 + 8 * at :] if at < r else enc[4 + 8 * r + 2 * (at - r) :]))
                    size += len(rest[-1])
                    if size > 32 << 20:  # sets of very many elements
                        yield out(ps, rec, meta, rest)
                        ps, rec, meta, rest, size = [], [], [], [], 0
            yield out(ps, rec, meta, rest)

    return sets.select("record", "enc").mapInArrow(run, schema)


def _join(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by path (and part and side) and size: probe the tree of the path with each row, then insert it.
    A path's first row waits until there is a second one."""
    current, first, tree = None, None, None
    for batch in batches:
        a, b = [], []
        path_of, record_of, meta_of, rest_of, *parts = (c.to_pylist() for c in batch.columns)
        side_of = parts[1] if parts else None
        for i, path in enumerate(zip(path_of, parts[0]) if parts else path_of):
            side = side_of[i] if side_of else 2
            if path != current:
                current, first, tree = path, (record_of[i], meta_of[i], rest_of[i], side), None
                continue
            if tree is None:
                tree = PrefixTree(t)
                if first[3] != 1:
                    tree.insert(first[1] >> 4, decode_set(first[2]), first[0])
            record, size, tokens = record_of[i], meta_of[i] >> 4, decode_set(rest_of[i])
            if side:
                for other in tree.similar(size, tokens, meta_of[i] & 15):
                    a.append(min(record, other))
                    b.append(max(record, other))
            if side != 1:
                tree.insert(size, tokens, record)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def similar_classes(df: DataFrame, key: str, texts: list[str], t: float, n: int = 1, cap_scale: float = 0.25, most_split: int | None = None, most_in_path: int = MOST_IN_PATH) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs (a, b), a < b, of class representatives whose sets have a Jaccard
    similarity of at least ``t``, and (key, record) of every row with its representative.

    Rows with the same set form a class, represented by its smallest key, so
    copies never meet in the join. Representatives are filed under short
    sub-sequences of their globally ordered sets and the rows of each path are
    joined in a prefix tree. A path with too many records is split into longer
    ones, as often as needed up to 12 elements: no pair is lost by it, as both records
    of a pair decide alike. What is still crowded then - longer paths, or paths beyond the
    number that is broadcast - is joined block by block, so a task never holds more than
    ``most_in_path`` records of a path. Rows without an element take no part."""
    most = 12
    slim = df.select(key, *texts).where(F.col(key).isNotNull())
    rows = slim.count()
    cap = max(60, int(cap_scale * math.sqrt(rows)))
    frequent, more = frequent_words(slim, texts, n, max(40, cap // 2), cap)
    members = materialize(encoded_sets(slim, key, texts, n, frequent))
    sets = materialize(members.groupBy("enc").agg(F.min("key").alias("record"), F.count_distinct("key").alias("copies")).select("record", "enc", "copies"))
    split, left = crowded_paths(sets, t, cap, most, {_extend(0, c) for c, many in frequent.values() if many > cap} | {_extend(0, h) for h in more}, most_split)
    wide = shuffle_width(df.sparkSession, 2)
    filed = _filed(sets, t, split, most)
    if left:
        filed = _in_blocks(filed, most_in_path).repartition(wide, "path", "part").sortWithinPartitions("path", "part", "side", "meta")
    else:
        filed = filed.repartition(wide, "path").sortWithinPartitions("path", "meta")
    links = filed.mapInArrow(lambda b: _join(b, t), "a long, b long").distinct()
    shared = sets.where("copies > 1").select("enc", "record", "copies")
    return links, members.join(shared, "enc").select("key", "record", "copies").distinct()


def similar_pairs(df: DataFrame, key: str, texts: list[str], t: float, n: int = 1) -> DataFrame:
    """All pairs (a, b), a < b, of different keys whose sets are similar, copies written out.

    The result is as large as its pairs; :func:`representative_links` with :func:`linked_classes` says the same
    without writing out copies."""
    links, shared = similar_classes(df, key, texts, t, n)
    shared = materialize(shared)
    links = links.join(shared.select(F.col("record").alias("a"), F.col("key").alias("ka")), "a", "left").join(shared.select(F.col("record").alias("b"), F.col("key").alias("kb")), "b", "left")
    x, y = F.coalesce("ka", "a"), F.coalesce("kb", "b")
    across = links.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # a class of many copies is spread over salts, against which its rows are laid out once each
    salts = shuffle_width(df.sparkSession)
    spread = F.when(F.col("copies") > MANY_COPIES, F.lit(salts)).otherwise(F.lit(1))
    left = shared.select("record", F.pmod(F.xxhash64("key"), spread).cast("int").alias("salt"), F.col("key").alias("a"))
    right = shared.select("record", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"), F.col("key").alias("b"))
    inside = left.join(right, ["record", "salt"]).where("a < b").select("a", "b")
    return across.unionByName(inside)


#: Copies of one class beyond which writing out its pairs is spread over several tasks.
MANY_COPIES = 2_000


def representative_links(df: DataFrame, key: str, texts: list[str], t: float, n: int = 1) -> DataFrame:
    """Pairs (a, b), a < b, of class representatives that are similar; :func:`linked_classes` has who belongs to a class."""
    return similar_classes(df, key, texts, t, n)[0]


def linked_classes(df: DataFrame, key: str, texts: list[str], t: float, n: int = 1) -> DataFrame:
    """One row for each key that has a copy or a similar row: key, class_id, n_copies, n_links.

    ``class_id`` is the smallest key with the same set; ``n_links`` counts the
    similar classes. Copies are not written out as pairs, so a class that holds a
    third of all rows costs no more than its rows."""
    links, shared = similar_classes(df, key, texts, t, n)
    shared = materialize(shared)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = shared.groupBy("record").agg(F.count(F.lit(1)).alias("n_copies")).withColumnRenamed("record", "class_id")
    classes = ends.join(sizes, "class_id", "full").select("class_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    member = shared.select("key", F.col("record").alias("class_id"))
    alone = classes.where("n_copies = 1").select(F.col("class_id").alias("key"), "class_id", "n_copies", "n_links")
    return member.join(classes, "class_id").select("key", "class_id", "n_copies", "n_links").unionByName(alone)
