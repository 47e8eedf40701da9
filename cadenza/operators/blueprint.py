"""Blueprints of videos: a slot for every shot, and how a script keeps to the blueprint it was written for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import joins

BUCKET_MS = 10_000
WORDS_PER_SECOND = 2.5
#: How far a script may be off before a check fails: scenes, and the share of the duration.
SCENES_OFF, DURATION_OFF = 1, 0.25
# Paces from the fastest on, and what sounds like a call to action.
PACES = ["very_fast", "fast", "moderate", "slow"]
CALLS = ["follow", "subscribe", "like", "comment", "share", "check out", "link"]


def scene_slots(shots: DataFrame, videos: DataFrame, captions: DataFrame, blocks: DataFrame, motion: DataFrame) -> DataFrame:
    """A slot for every shot (video_id, shot_id, start_ms, end_ms, is_last): role, length range, kind of picture, whether captions show, and camera motion.

    ``videos``: video_id, hook_end_ms, escalation_start_ms, payoff_start_ms, has_cta, format. ``captions`` and ``blocks``: video_id, start_ms, end_ms.
    ``motion``: video_id, shot_id, motion. Captions and blocks meet shots in time buckets, as semi joins: no pair of a shot and its captions is kept. A shot that comes twice is one;
    a video without a row in ``videos`` has no slots.
    """
    s = shots.select("video_id", "shot_id", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"), "is_last").dropDuplicates(["video_id", "shot_id"])
    spans = lambda df, a, b: df.select("video_id", F.col("start_ms").alias(a), F.col("end_ms").alias(b))
    shown = joins.overlapping(s, spans(captions, "c0", "c1"), ["video_id"], ("s0", "s1"), ("c0", "c1"), BUCKET_MS, "left_semi").select("video_id", "shot_id", F.lit(True).alias("_captions"))
    inserted = joins.overlapping(s, spans(blocks, "b0", "b1"), ["video_id"], ("s0", "s1"), ("b0", "b1"), BUCKET_MS, "left_semi").select("video_id", "shot_id", F.lit(True).alias("_inserted"))
    moved = motion.groupBy("video_id", "shot_id").agg(F.min("motion").alias("_motion"))
    rows = s.join(videos, "video_id").join(shown, ["video_id", "shot_id"], "left").join(inserted, ["video_id", "shot_id"], "left").join(moved, ["video_id", "shot_id"], "left")
    start, end, hook = F.col("s0"), F.col("s1"), F.col("hook_end_ms")
    role = F.when((start < hook) & (end <= hook + 1000), "hook").when(F.col("is_last") & F.col("has_cta"), "cta").when(
        start >= F.col("payoff_start_ms") - 1000, F.when(F.col("is_last"), "outro").otherwise("climax")).when(start >= F.col("escalation_start_ms"), "escalation").otherwise("point")
    picture = F.when(F.col("_inserted"), "inserted_content").when(F.col("format") == "talking_head", "talking_head").when(F.col("format").isin("compilation", "montage"), "stock_footage").otherwise("b_roll")
    camera = F.when(F.col("_motion") == "static", "static").when(F.col("_motion").isin("zoom_in", "zoom_out"), "zoom_in").when(F.col("_motion").isin("pan_left", "pan_right"), "pan").when(F.col("_motion").isNotNull(), "mixed")
    seconds = (end - start) / 1000
    return rows.select(
        "video_id", "shot_id", role.alias("role"), F.greatest(F.lit(0.5), seconds * 0.7).alias("least_s"), (seconds * 1.3).alias("most_s"), picture.alias("visual_type"),
        F.coalesce("_captions", F.lit(False)).alias("has_captions"), camera.alias("camera_motion"))


def _seconds(text: Column) -> Column:
    return T.word_count(text) / WORDS_PER_SECOND


def compliance(scripts: DataFrame, blueprints: DataFrame) -> DataFrame:
    """Each script with the checks of its blueprint, ``pass``, ``warn`` or ``fail``, and how many there are of each.

    ``scripts``: script_id, blueprint_id, hook, cta, duration_s (null: from the words), scenes array<struct<text, duration_s>>. ``blueprints``: blueprint_id, n_slots,
    target_s, hook_s, has_cta, pace. Scripts whose blueprint is missing are left out. Missing texts count as empty. A hook may be a short first scene,
    a call to action may sound in the last one: both warn.
    """
    rows = scripts.join(blueprints, "blueprint_id")
    scenes, n = F.coalesce("scenes", F.array().cast("array<struct<text:string,duration_s:double>>")), F.col("_n")
    # Seconds are added up scene by scene: the quotient of all words may lie on the other side of a limit by its last bit.
    own = F.when(F.col("duration_s") > 0, F.col("duration_s")).otherwise(F.aggregate("_scenes", F.lit(0.0), lambda a, s: a + _seconds(s["text"])))
    each = F.aggregate("_scenes", F.lit(0.0), lambda a, s: a + F.when(s["duration_s"] > 0, s["duration_s"]).otherwise(_seconds(s["text"])))
    rows = rows.withColumn("_scenes", scenes).withColumn("_n", F.size("_scenes")).withColumns({"_s": own, "_mean": F.when(n > 0, each / n).otherwise(0.0)})
    off = F.abs(n - F.col("n_slots"))
    count = F.when(off == 0, "pass").when(off <= SCENES_OFF, "warn").otherwise("fail")
    ratio = F.when(F.col("target_s") > 0, F.abs(F.col("_s") - F.col("target_s")) / F.col("target_s")).otherwise(0.0)
    duration = F.when(ratio <= 0.1, "pass").when(ratio <= DURATION_OFF, "warn").otherwise("fail")
    present = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    last = F.lower(F.coalesce(F.try_element_at("_scenes", F.lit(-1))["text"], F.lit("")))
    sounds = F.exists(F.array(*map(F.lit, CALLS)), lambda w: last.contains(w))
    cta = F.when(~F.coalesce("has_cta", F.lit(False)) | present(F.col("cta")), "pass").when((n > 0) & sounds, "warn").otherwise("fail")
    short = (n > 0) & (_seconds(F.get("_scenes", 0)["text"]) <= F.col("hook_s") * 2)
    hook = F.when((F.coalesce("hook_s", F.lit(0.0)) <= 0) | present(F.col("hook")), "pass").when(short, "warn").otherwise("fail")
    pace = F.when(F.col("_mean") < 1, PACES[0]).when(F.col("_mean") < 2, PACES[1]).when(F.col("_mean") < 4, PACES[2]).otherwise(PACES[3])
    place = lambda c: F.array_position(F.array(*map(F.lit, PACES)), c)
    pacing = F.when(F.coalesce("pace", F.lit("")) == "", "pass").when(pace == F.col("pace"), "pass").when(F.abs(place(pace) - place(F.col("pace"))) <= 1, "warn").otherwise("fail")
    checks = {"scene_count": count, "duration": duration, "cta": cta, "hook": hook, "pacing": pacing}
    rows = rows.select("script_id", "blueprint_id", *[c.alias(name) for name, c in checks.items()])
    tally = lambda status: sum((F.col(name) == status).cast("int") for name in checks)
    return rows.withColumns({f"n_{status}": tally(status) for status in ("pass", "warn", "fail")})
