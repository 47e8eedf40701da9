"""Set-based operators over one ordered group: gaps, islands, runs, hysteresis and merges.

Every operator needs one hash shuffle on its group keys at most; chained operators on the same keys share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def gap_to_previous(start: str, end: str, w: WindowSpec) -> Column:
    """Time from the previous row's end to this start; negative for an overlap, null on the first row."""
    return F.col(start) - F.lag(end).over(w)


def gap_to_next(start: str, end: str, w: WindowSpec) -> Column:
    """Time from this end to the next row's start; null on the last row."""
    return F.lead(start).over(w) - F.col(end)


def islands(df: DataFrame, flag: Column, keys: list[str], order: list[str], out: str = "island") -> DataFrame:
    """Number runs of equal ``flag`` within each group, from 0."""
    w = ordered(keys, order)
    changed = F.coalesce((~flag.eqNullSafe(F.lag(flag).over(w))).cast("int"), F.lit(0))
    first = F.row_number().over(w) == 1
    return df.withColumn("_new", F.when(first, 0).otherwise(changed)).withColumn(out, F.sum("_new").over(w)).drop("_new")


def runs(df: DataFrame, flag: Column, keys: list[str], order: str, end: Column | None = None, least: int = 1) -> DataFrame:
    """Runs of at least ``least`` rows where ``flag`` holds: keys, island, n, start and end of ``order`` values."""
    marked = islands(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), F.col("_flag"), keys, [order])
    close = end if end is not None else F.col(order)
    return (
        marked.where("_flag")
        .groupBy(*keys, "island")
        .agg(F.count("*").alias("n"), F.min(order).alias("start"), F.max(close).alias("end"))
        .where(F.col("n") >= least)
    )


def hysteresis(df: DataFrame, value: Column, keys: list[str], order: list[str], open_at: float, stay_at: float, out: str = "open") -> DataFrame:
    """Open at ``open_at``, closed below ``stay_at``, otherwise as before (closed at the start)."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    marker = F.when(value >= open_at, 1).when(value < stay_at, 0)
    return df.withColumn(out, F.coalesce(F.last(marker, ignorenulls=True).over(w), F.lit(0)) == 1)


def merge_gaps(df: DataFrame, keys: list[str], start: str, end: str, max_gap: float, aggregates: list[Column] | None = None) -> DataFrame:
    """Merge intervals whose gap to all earlier ones is at most ``max_gap``: keys, start, end, n and the aggregates."""
    w = ordered(keys, [start, end])
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col(start) - reach > max_gap), 1).otherwise(0)
    marked = df.withColumn("_open", opened).withColumn("_group", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *(aggregates or [])).drop("_group")


def average_rank(value: str, keys: list[str], ties: list[str] | None = None) -> Column:
    """Rank from 1 in which equal values share the mean of their places."""
    by_value = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return F.rank().over(by_value) + (F.count("*").over(same) - 1) / 2


def rank_table(rows: DataFrame, keys: list[str], value: str, out: str, bands: int = 64) -> DataFrame:
    """Each group's distinct values with their average rank ``out``, as ``average_rank`` gives it, without a window over a whole group.

    Values are counted first; approximate quantiles cut a group into bands, whose sizes are summed up apart. Where the cuts lie does not change a rank. Null values have none.
    """
    known = rows.where(F.col(value).isNotNull())
    cuts = known.groupBy(*keys).agg(F.percentile_approx(value, [i / bands for i in range(1, bands)], 10_000).alias("_cuts"))
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("_n")).join(cuts, keys).withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sizes = counts.groupBy(*keys, "_band").agg(F.sum("_n").alias("_all"))
    earlier = F.coalesce(F.sum("_all").over(Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", earlier).drop("_all")
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_band").orderBy(value))
    rank = F.col("_before") + F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2
    return counts.withColumn("_upto", upto).join(offsets, [*keys, "_band"]).select(*keys, value, rank.alias(out))


def ordered_mean(rows: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Mean ``out`` of each group, its values added one by one in the order of the unique column ``order``; nulls do not count.

    The last bits of a sum of doubles depend on its order, and means that are compared or ranked show them: partial sums of tasks would let the
    partitioning decide. The running mean is a window, which spills, so a large group needs no list.
    """
    return _running_mean(rows, keys, value, order).groupBy(*keys).agg(F.max_by("_mean", "_i").alias(out))


def _running_mean(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    sorted_rows = Window.partitionBy(*keys).orderBy(order)
    running = F.avg(value).over(sorted_rows.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select(*keys, F.col(value).alias("_value"), running.alias("_mean"), F.row_number().over(sorted_rows).alias("_i"))


def exact_mean(rows: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Mean ``out`` of each group, added up in decimals and rounded once, so it does not depend on any order, and rows that all come as often again leave it as it is.

    Means that lie a tolerance apart are told by their last bits, which sums of doubles leave to chance. Groups with a value that ten decimals do not hold, or of a hundred million
    or more, have their ``ordered_mean``. Nulls do not count.
    """
    decimal = F.col("_value").try_cast("decimal(18,10)")
    held = F.bool_and(F.coalesce(decimal.cast("double") == F.col("_value"), F.col("_value").isNull()))
    exact = (F.try_sum(decimal) / F.nullif(F.count("_value"), F.lit(0)).cast("decimal(12,0)")).cast("double")
    running = _running_mean(rows, keys, value, order)
    return running.groupBy(*keys).agg(F.coalesce(F.when(held, exact), F.max_by("_mean", "_i")).alias(out))


def reversals(value: str, keys: list[str], order: list[str], tolerance: float) -> Column:
    """1 where a value falls below the one before by more than ``tolerance``."""
    return F.when(F.lag(value).over(ordered(keys, order)) - F.col(value) > tolerance, 1).otherwise(0)


def stress_gate(points: DataFrame, keys: list[str], severity: str, score: str, tolerance: float = 0.005, least_effect: float = 0.05, least_correlation: float = 0.9) -> DataFrame:
    """Whether the defect (1 - ``score``) of each group rises with ``severity``: keys, n, reversals, effect, spearman, passed.

    A reversal is a fall by more than ``tolerance``. A group passes if the defect spans ``least_effect`` and either never falls or, from four points on, has a rank correlation of
    ``least_correlation`` with severity. Of one point, or of equal defects, the correlation is 0. Groups are the points of one stress recipe, a handful each.
    """
    rows = points.withColumn("_d", 1 - F.col(score))
    rows = rows.withColumns({"_r": reversals("_d", keys, [severity], tolerance), "_a": average_rank(severity, keys), "_b": average_rank("_d", keys)})
    n = F.count("*")
    flat = (n < 2) | (F.stddev_pop("_b") == 0) | (F.stddev_pop("_a") == 0)
    stats = rows.groupBy(*keys).agg(n.alias("n"), F.sum("_r").alias("reversals"), (F.max("_d") - F.min("_d")).alias("effect"), F.when(flat, 0.0).otherwise(F.corr("_a", "_b")).alias("spearman"))
    steady = (F.col("reversals") == 0) | ((F.col("n") >= 4) & (F.col("spearman") + 1e-9 >= least_correlation))
    return stats.withColumn("passed", (F.col("effect") >= least_effect) & steady)


def thin(times: Column, least_gap: float) -> Column:
    """Greedy thinning of an array of times: keep the first, then each at least ``least_gap`` after the last kept."""
    kind = "array<double>"
    return F.aggregate(
        F.sort_array(times), F.array().cast(kind),
        lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= least_gap), F.concat(kept, F.array(t.cast("double")))).otherwise(kept),
    )
