"""Joins on time: as-of, interval overlap and fuzzy matches, each with an equi key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, out: str = "nearest") -> DataFrame:
    """``left`` with the nearest ``time`` of ``right`` in its group; of two equally near the later one.

    Both sides are laid into one ordered stream, so the join costs one shuffle and no pairs. Groups without a right row
    get null.
    """
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*keys, F.col(time)).withColumn("_side", F.lit(0)).withColumn("_t", F.col(time))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side")
    before = F.last("_t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # The same stream read backwards: a running frame, where one that ends at the last row would be gone through for every row.
    back = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col("_side").desc())
    after = F.last("_t", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    # A right row at the same time sorts first, so it is found before.
    chosen = F.when(before.isNull(), after).when(after.isNull(), before).when(F.col(time) - before < after - F.col(time), before).otherwise(after)
    return both.withColumn(out, chosen).where("_side = 1").drop("_side", "_t")


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, out: str) -> DataFrame:
    """``left`` with the ``value`` of the last right row at or before its time."""
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*keys, F.col(time), F.struct(F.col(value).alias("v")).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").withColumn(out, F.col("_last")["v"]).drop("_side", "_v", "_last")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of intervals of one group with a.start < b.end and a.end > b.start.

    Both sides are cut into buckets of ``width`` and joined on (keys, bucket); a pair is kept only in the bucket
    where the later of its starts lies, so none is repeated. ``how`` may be inner, left_semi or left_anti. Column names other than
    the keys must differ.
    """
    (a0, a1), (b0, b1) = a, b
    span = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.greatest(F.col(s), F.col(e)) / width)))
    x, y = left.withColumn("_bucket", span(a0, a1)), right.withColumn("_bucket", span(b0, b1))
    meet = (F.col(a0) < F.col(b1)) & (F.col(a1) > F.col(b0)) & (F.floor(F.greatest(F.col(a0), F.col(b0)) / width) == F.col("_b"))
    y = y.withColumnRenamed("_bucket", "_b")
    for k in keys:
        y = y.withColumnRenamed(k, f"_k_{k}")
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    if how == "inner":
        return x.join(y, same & meet).drop("_bucket", "_b", *[f"_k_{k}" for k in keys])
    found = x.join(y, same & meet, "left_semi").drop("_bucket").distinct()
    return found if how == "left_semi" else left.join(found, left.columns, "left_anti")


def overlap_length(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Length of the common part of two intervals, at least 0."""
    return F.greatest(F.lit(0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]))


def best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
