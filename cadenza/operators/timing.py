"""Repair, correction, allocation and coverage of timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators.windows import ordered


def correct_linear(words: DataFrame, slopes: DataFrame) -> DataFrame:
    """Starts and ends moved back by slope * position (milliseconds a word), not below zero. ``slopes``: video_id, slope."""
    i = F.row_number().over(ordered(["video_id"], ["idx"])) - 1
    rows = words.withColumn("_i", i).join(slopes.select("video_id", "slope"), "video_id", "left")
    shift = F.floor(F.coalesce("slope", F.lit(0.0)) * F.col("_i") + 0.5)
    moved = {c: F.greatest(F.lit(0).cast("long"), F.col(c) - shift).cast("long") for c in ("start_ms", "end_ms")}
    return rows.withColumns(moved).drop("_i", "slope")


def repair(words: DataFrame) -> DataFrame:
    """Words without a length get the mean length of the video's sound ones; later starts stay."""
    sound = F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms") - F.col("start_ms"))
    mean = F.avg(sound).over(Window.partitionBy("video_id"))
    fixed = F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms")).otherwise(F.col("start_ms") + F.floor(F.coalesce(mean, F.lit(200.0)) + 0.5))
    return words.withColumn("end_ms", fixed.cast("long"))


def rescale(words: DataFrame, durations: DataFrame, least: float = 0.02) -> DataFrame:
    """Times scaled to the true duration when they are off by ``least`` or more. ``durations``: video_id, claimed, actual."""
    rows = words.join(durations, "video_id")
    ratio = F.when(F.abs(F.col("actual") - F.col("claimed")) / F.col("claimed") >= least, F.col("actual") / F.col("claimed")).otherwise(1.0)
    return rows.withColumns({c: F.floor(F.col(c) * ratio + 0.5).cast("long") for c in ("start_ms", "end_ms")}).drop("claimed", "actual")


def rebase(words: DataFrame, start: int, end: int) -> DataFrame:
    """Words that meet [start, end), clipped to it and counted from its start."""
    met = words.where((F.col("end_ms") > start) & (F.col("start_ms") < end))
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(start)), F.lit(end)) - start
    return met.withColumns({"start_ms": clip("start_ms"), "end_ms": clip("end_ms")})


def allocate(words: DataFrame, units: DataFrame) -> DataFrame:
    """Words given to script units in order by the units' word counts; what is left goes to the last unit.

    ``units``: video_id, unit, n_words. A word joins the unit whose running range holds its place.
    """
    w = ordered(["video_id"], ["unit"])
    high = F.sum("n_words").over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(ordered(["video_id"], ["unit"])) == F.count("*").over(Window.partitionBy("video_id"))
    ranges = units.withColumns({"_high": high, "_last": last}).select("video_id", "unit", (F.col("_high") - F.col("n_words")).alias("_low"), F.when(F.col("_last"), F.lit(1 << 62)).otherwise(F.col("_high")).alias("_high"))
    i = F.row_number().over(ordered(["video_id"], ["idx"])) - 1
    placed = words.withColumn("_i", i)
    # Both sides are laid in one order, so that the range is found by the last opening before a word.
    openings = ranges.select("video_id", F.col("_low").alias("_i"), "unit", F.lit(0).alias("_side"))
    both = placed.withColumn("_side", F.lit(1)).unionByName(openings, allowMissingColumns=True)
    order = Window.partitionBy("video_id").orderBy("_i", "_side", "unit").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("unit", F.last(F.when(F.col("_side") == 0, F.col("unit")), ignorenulls=True).over(order))
    return found.where("_side = 1").drop("_side", "_i")


def even_times(videos: DataFrame, count: int) -> DataFrame:
    """``count`` sampling times in the middle of equal parts of each video: video_id, k, at_ms (from duration_ms)."""
    k = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")
    rows = videos.select("video_id", "duration_ms", k)
    return rows.select("video_id", "k", F.expr(f"duration_ms * (2 * k + 1) div {2 * count}").alias("at_ms"))


def cover(scenes: DataFrame, durations: DataFrame) -> DataFrame:
    """Scenes made to cover a duration: what runs over is cut or dropped, and the last scene is stretched over a gap.

    ``scenes``: video_id, scene, start_ms, end_ms; ``durations``: video_id, duration_ms.
    """
    rows = scenes.join(durations, "video_id").where(F.col("start_ms") < F.col("duration_ms"))
    last = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("start_ms").desc(), F.col("scene").desc())) == 1
    end = F.when(last, F.col("duration_ms")).otherwise(F.least("end_ms", "duration_ms"))
    return rows.withColumn("_end", end).select("video_id", "scene", "start_ms", F.col("_end").alias("end_ms"), (F.col("_end") > F.col("end_ms")).alias("stretched"))


def beat_grid(onsets: DataFrame) -> DataFrame:
    """Tempo of each video from the upper median of its onset intervals, and the number of beats: video_id, bpm, beats."""
    gap = F.col("at_ms") - F.lag("at_ms").over(ordered(["video_id"], ["at_ms"]))
    gaps = onsets.withColumn("gap", gap).where("gap > 0").groupBy("video_id").agg(F.sort_array(F.collect_list("gap")).alias("g"), F.max("at_ms").alias("until"))
    upper = F.element_at("g", (F.floor(F.size("g") / 2) + 1).cast("int"))
    return gaps.select("video_id", F.round(60_000 / upper, 6).alias("bpm"), (F.floor(F.col("until") / upper) + 1).alias("beats"))


def onsets(frames: DataFrame, value: str, refractory_ms: int = 80) -> DataFrame:
    """Upward crossings of mean + 2 standard deviations, at least ``refractory_ms`` after the last kept: video_id, at_ms."""
    whole = Window.partitionBy("video_id")
    limit = F.avg(value).over(whole) + 2 * F.stddev_pop(value).over(whole)
    before = F.coalesce(F.lag(value).over(ordered(["video_id"], ["at_ms"])), F.lit(float("-inf")))
    marked = frames.withColumns({"_limit": limit, "_before": before}).where((F.col(value) > F.col("_limit")) & (F.col("_before") <= F.col("_limit")))
    from cadenza.operators.windows import thin

    kept = marked.groupBy("video_id").agg(thin(F.collect_list(F.col("at_ms").cast("double")), float(refractory_ms)).alias("t"))
    return kept.select("video_id", F.explode("t").cast("long").alias("at_ms"))
