"""Records that are equal but for their formatting, by bottom-up (Merkle) digests."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomqa.operators.kb import labelled_field
from loomqa.runtime import shuffle_width


def composed(*leaves: Column, marked: Column | None = None) -> Column:
    """Array of the texts with letters and their marks composed (NFC); only rows that hold a mark (``marked``) go to Python."""

    @F.pandas_udf("array<string>")
    def nfc(rows: pd.Series) -> pd.Series:
        return rows.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFC", t) for t in ts])

    all_leaves = F.array(*leaves)
    if marked is None:
        marked = F.exists(all_leaves, lambda t: F.coalesce(t.rlike(r"\p{M}"), F.lit(False)))
    return F.when(marked, nfc(F.when(marked, all_leaves))).otherwise(all_leaves)


def normal_leaf(c: Column, marks: bool = True) -> Column:
    """Lower-cased letters and digits of a leaf, each letter with the marks that go on it, without anything
    between them; null stays null. Without ``marks`` a cheaper form for texts that hold none."""
    if not marks:
        return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.regexp_replace(F.lower(c), r"(?<![\p{L}\p{M}])\p{M}+|[^\p{L}\p{N}\p{M}]+", "")


def leaf_digest(label: str, leaf: Column) -> Column:
    """Digest of a labelled leaf; label and value are kept apart by a length prefix."""
    return F.md5(F.concat(F.lit(f"{label}:"), F.length(leaf).cast("string"), F.lit(":"), leaf))


def node_digest(children: list[Column]) -> Column:
    """Digest of an unordered node: its children's digests are sorted first."""
    return F.md5(F.array_join(F.array_sort(F.array(*children)), "|"))


def record_digest(c: Column, kind: T.DataType) -> Column:
    """Root digest of a value of any nested type, from its leaves up.

    Texts are normalised, other leaves are taken as they print. Fields of a struct and entries of a map are
    unordered, so their digests are sorted; elements of an array keep their order. A null is a leaf of its own."""
    node = lambda sign, parts: F.md5(F.concat(F.lit(sign), parts))
    if isinstance(kind, T.StructType):
        fields = [F.md5(F.concat(F.lit(f"{len(f.name)}:{f.name.lower()}="), record_digest(c.getField(f.name), f.dataType))) for f in kind.fields]
        out = node("{", F.array_join(F.array_sort(F.array(*fields)), "|")) if fields else F.md5(F.lit("{"))
    elif isinstance(kind, T.MapType):
        pair = lambda e: F.md5(F.concat(record_digest(e.key, kind.keyType), F.lit("="), record_digest(e.value, kind.valueType)))
        out = node("<", F.array_join(F.array_sort(F.transform(F.map_entries(c), pair)), "|"))
    elif isinstance(kind, T.ArrayType):
        out = node("[", F.array_join(F.transform(c, lambda x: record_digest(x, kind.elementType)), "|"))
    else:
        out = F.md5(F.concat(F.lit("'"), normal_leaf(c) if isinstance(kind, T.StringType) else c.cast("string")))
    return F.when(c.isNull(), F.md5(F.lit("null"))).otherwise(out)


def record_text(c: Column, kind: T.DataType) -> Column:
    """The whole normalised structure as a text, in which unordered parts are sorted and each part's length stands before it."""
    sized = lambda t: F.concat(F.char_length(t).cast("string"), F.lit(":"), t)
    if isinstance(kind, T.StructType):
        fields = [sized(F.concat(F.lit(f"{len(f.name)}:{f.name.lower()}="), record_text(c.getField(f.name), f.dataType))) for f in kind.fields]
        out = F.concat(F.lit("{"), F.array_join(F.array_sort(F.array(*fields)), "") if fields else F.lit(""))
    elif isinstance(kind, T.MapType):
        pair = lambda e: sized(F.concat(sized(record_text(e.key, kind.keyType)), record_text(e.value, kind.valueType)))
        out = F.concat(F.lit("<"), F.array_join(F.array_sort(F.transform(F.map_entries(c), pair)), ""))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: sized(record_text(x, kind.elementType))), ""))
    else:
        out = F.concat(F.lit("'"), normal_leaf(c) if isinstance(kind, T.StringType) else c.cast("string"))
    return F.coalesce(out, F.lit("null"))


def record_copies(df: DataFrame, key: str, columns: list[str], least_copies: int = 1) -> DataFrame:
    """key, first_key and n_copies of each row of a class of at least ``least_copies`` rows: records of any nested
    shape that are equal but for case, punctuation, white space and the order of fields and map entries.

    Rows with a null key take no part; rows repeated with the same key and record count once. Texts are expected composed
    (NFC), see :func:`composed`. ``columns`` together are the record, nulls included."""
    kind = T.StructType([df.schema[c] for c in columns])
    one = F.struct(*columns)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.unhex(record_digest(one, kind)).alias("root"), record_text(one, kind).alias("whole"))
    return _classes(rows, least_copies).withColumnsRenamed({"key": key, "first": "first_key"})


def relation_parts(df: DataFrame) -> DataFrame:
    """rel_id with normalised h, t, l (head, type, tail), from the columns or from ``record``."""
    part = lambda n: F.when(F.col("record").isNotNull(), labelled_field(F.col("record"), n)).otherwise(F.col(n))
    # each generator keeps what comes after it from evaluating what came before a second time
    raw = df.select("rel_id", F.inline(F.array(F.struct(*[part(n).alias(n) for n in ("head", "type", "tail")]))))
    raw = raw.withColumn("marked", F.concat_ws("", "head", "type", "tail").rlike(r"\p{M}"))
    raw = raw.select("rel_id", "marked", composed(F.col("head"), F.col("type"), F.col("tail"), marked=F.col("marked")).alias("leaves"))
    leaf = lambda i: F.when(F.col("marked"), normal_leaf(F.get("leaves", i))).otherwise(normal_leaf(F.get("leaves", i), False))
    return raw.select("rel_id", F.inline(F.array(F.struct(*[leaf(i).alias(n) for i, n in enumerate("htl")]))))


def canonical_copies(df: DataFrame, least_copies: int = 1) -> DataFrame:
    """Every relation's class: columns rel_id, first_rel_id and n_copies, one row for each rel_id
    of a class of at least ``least_copies`` rows.

    Leaves are normalised, child digests sorted under the unordered node and rows
    grouped by the root digest. The smallest rel_id of a class is found in two
    steps, first for each (class, salt), where the salt comes of the rel_id, and
    then for each class; it goes back to the rows by (root, salt). So a class
    that holds a third of all rows is spread over all salts, and the rows move
    once: the first step and the join use the same partitioning. The whole
    normalised structure is compared in both, so a colliding digest cannot join
    two relations. Rows in which a part is null or has no letter or digit take
    no part; rows repeated with the same rel_id count once; an empty table gives
    no rows."""
    parts = relation_parts(df).where("rel_id is not null and h <> '' and t <> '' and l <> ''")
    root = node_digest([leaf_digest(n, F.col(c)) for n, c in (("head", "h"), ("type", "t"), ("tail", "l"))])
    rows = parts.select(F.col("rel_id").alias("key"), F.unhex(root).alias("root"), F.concat_ws("\x1f", "h", "t", "l").alias("whole"))
    return _classes(rows, least_copies).select(F.col("key").alias("rel_id"), F.col("first").alias("first_rel_id"), "n_copies")


def _classes(rows: DataFrame, least_copies: int) -> DataFrame:
    """key, first, n_copies of rows of key, root and whole, by (root, salt)."""
    width = shuffle_width(rows.sparkSession)
    rows = rows.select("key", F.coalesce("root", F.lit(b"")).alias("root"), "whole", F.coalesce(F.pmod(F.xxhash64("key"), F.lit(width)).cast("int"), F.lit(0)).alias("salt"))
    rows = rows.repartition(width, "root", "salt").dropDuplicates(["root", "salt", "whole", "key"])
    salted = rows.groupBy("root", "salt", "whole").agg(F.min("key").alias("low"), F.count(F.lit(1)).alias("n"))
    first = salted.groupBy("root", "whole").agg(F.min("low").alias("first"), F.sum("n").alias("n_copies"), F.collect_set("salt").alias("salts"))
    spread = first.where(F.col("n_copies") >= least_copies).select("root", F.col("whole").alias("confirmed"), "first", "n_copies", F.explode("salts").alias("salt")).repartition(width, "root", "salt")
    # the comparison stays out of the join's keys, so that the rows keep their partitioning
    return rows.join(spread, ["root", "salt"]).where(F.array_contains(F.array("confirmed"), F.col("whole"))).select("key", "first", "n_copies")
