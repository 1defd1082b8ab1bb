"""Running sums over a whole table without gathering it in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomqa.runtime import materialize, shuffle_width


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], keep_range: bool = False) -> DataFrame:
    """``df`` with the running sum of each expression in the order given (the order must be total).

    The table is cut into ranges of the order; each range is summed by itself and
    moved by the totals of the ranges before it. ``keep_range`` leaves the range's number in ``__p``. Only one row a range, not one a
    row, passes through a single task. Descending order is had by a negated column."""
    # written once: the ranges are found by sampling, and both uses below must see the same ones
    parts = materialize(df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("__p", F.spark_partition_id()).withColumns({f"__{k}": v for k, v in sums.items()}))
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.withColumns({k: F.sum(f"__{k}").over(inside) for k in sums})
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__p").agg(*[F.sum(f"__{k}").alias(k) for k in sums])
    offsets = totals.select("__p", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__o_{k}") for k in sums])
    out = local.join(F.broadcast(offsets), "__p")  # one row a range
    return out.withColumns({k: F.col(k) + F.col(f"__o_{k}") for k in sums}).drop(*([] if keep_range else ["__p"]), *[f"__{k}" for k in sums], *[f"__o_{k}" for k in sums])


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "rnk") -> DataFrame:
    """``df`` with each row's place, from 1, in its group by a total order.

    Rows are numbered over the whole table in ranges and a group's lowest number
    is taken off, so a group of any size is spread over many tasks. Null groups
    are groups of their own."""
    keys = [*group, *order]
    run = running_sums(df, keys, {"__n": F.lit(1)}, keep_range=True)
    if not group:
        return run.select(*df.columns, F.col("__n").cast("int").alias(name))
    # the lowest number of a group goes back by (group, range): a hot group's rows stay where they are spread
    low = run.groupBy(*group, "__p").agg(F.min("__n").alias("__low"))
    first = low.withColumn("__first", F.min("__low").over(Window.partitionBy(*group)))
    first = first.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__p").alias("__q"), "__first")
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    return run.join(first, [F.col("__p") == F.col("__q"), *same]).select(*df.columns, (F.col("__n") - F.col("__first") + 1).cast("int").alias(name))
