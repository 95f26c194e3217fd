"""Running sums, counts and maxima over an order of any length, without a window over all rows.

Rows are range-partitioned by the order and written; the total of each range is one small row, a window over these gives
each range what lies before it, and windows inside the ranges do the rest. With ``by``, each group has its own order, and a group
that holds most rows is still cut into ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemill.session import materialise

_TOTAL = {"sum": F.sum, "count": F.count, "max": F.max}


def in_ranges(df: DataFrame, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``_range``, the number of the row's range; the numbers follow the order within each group."""
    dealt = df.repartitionByRange(*(F.col(c) for c in by), *order)
    return materialise(dealt.withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, kind: str, value: Column, order: list[Column], name: str, by: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Adds ``name``: the sum, count or max of ``value`` over the rows up to this one (before it, if ``strict``; null where
    there are none). ``order`` should end in a key, so that it has no ties."""
    ranged = in_ranges(df.withColumn("_value", value), order, by)
    total = _TOTAL[kind]
    per = ranged.groupBy(*by, "_range").agg(total("_value").alias("_own"))
    before = total("_own") if kind == "max" else F.sum("_own")
    per = per.select(*by, "_range", before.over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inside = total("_value").over(W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if strict else 0))
    out = ranged.withColumn("_inside", inside).join(per, [*by, "_range"])
    if kind == "max":
        both = F.greatest("_before", "_inside")  # ignores nulls
    else:
        both = F.when(F.col("_before").isNotNull() | F.col("_inside").isNotNull(), F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0)))
    return out.select(*df.columns, both.alias(name))


def previous(df: DataFrame, value: str, order: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``name``: ``value`` of the row before in its group, null for the first one."""
    ranged = in_ranges(df, [F.col(order)], by)
    last = ranged.groupBy(*by, "_range").agg(F.max_by(F.struct(value), order).alias("_last"))
    last = last.select(*by, "_range", F.lag("_last").over(W.partitionBy(*by).orderBy("_range")).alias("_last"))
    inside = F.lag(F.struct(value)).over(W.partitionBy(*by, "_range").orderBy(order))
    return ranged.withColumn("_inside", inside).join(last, [*by, "_range"]).select(*df.columns, F.coalesce("_inside", "_last")[value].alias(name))
