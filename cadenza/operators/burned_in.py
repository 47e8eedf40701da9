"""Report on captions that are part of the picture: fourteen sub-scores of a video's caption segments and frames, flicker, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.scores import clamp
from cadenza.operators.scans import caption_words, center_jitter

# Weights of the sub-scores, and the limits they are held against.
WEIGHTS = {
    "rhythm": 0.12, "display": 0.08, "coverage": 0.12, "safe_area": 0.1, "density": 0.06, "punctuation": 0.04, "capitalization": 0.03, "alignment": 0.06, "placement": 0.06,
    "jitter": 0.08, "style": 0.05, "redundancy": 0.05, "segmentation": 0.06, "confidence": 0.09,
}
SAFE_MARGIN, FLASH_MS = 0.05, 500
MOST_LINES, MOST_CHARS = 3, 45
ALL_CAPS = 0.8
MOST_OFF_CENTRE, MOST_SPREAD = 0.1, 0.02
MOST_HEIGHT_CV, MOST_AREA_CV = 0.25, 0.4
LEAST_OVERALL, LEAST_COVERAGE, MOST_FLICKER = 0.75, 0.6, 1
CONJUNCTIONS = ["and", "or", "but", "so", "because", "then"]
#: What a sub-score is where a video has nothing to judge.
EMPTY = dict.fromkeys(WEIGHTS, 1.0) | {"coverage": 0.0, "confidence": 0.0}


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))


def _blank(text: Column) -> Column:
    """Whether the flat text is empty, told by the first character that shows."""
    return ~F.coalesce(text.rlike("\\S"), F.lit(False))


def _segment_scores(segments: DataFrame) -> DataFrame:
    """Sub-scores that segments with text give, and their captioned time."""
    w = Window.partitionBy("video_id").orderBy("start_ms")
    text = F.col("text")
    bare = F.trim(text)
    lines = F.filter(F.transform(F.split(text, "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")
    # Texts are shuffled as they are and cut behind the shuffle; the flat text is a column first, so that what is made of it does not make it again.
    rows = segments.where(~_blank(text)).repartition("video_id").withColumn("flat", _flat(text)).withColumns({
        "s": (F.col("end_ms") - F.col("start_ms")) / 1000, "words": caption_words(F.lower("flat")), "i": F.row_number().over(w), "n_lines": F.when(text.contains("\n"), F.size(lines)).otherwise(1),
        "chars": F.when(text.contains("\n"), F.array_max(F.transform(lines, lambda x: F.length(x)))).otherwise(F.length(bare)), "first": F.nullif(F.regexp_extract(text, "[A-Za-z]", 0), F.lit("")),
        "letters": F.length(F.regexp_replace(text, "[^A-Za-z]+", "")), "capitals": F.length(F.regexp_replace(text, "[^A-Z]+", "")), "stops": bare.rlike("[.!?…]$"),
    })
    rows = rows.withColumns({
        "wps": F.when((F.col("s") > 0), F.size(F.split("flat", " ")) / F.col("s")), "next_first": F.lead("first").over(w), "has_next": F.lead("i").over(w).isNotNull(),
        "before": F.lag("words").over(w), "stopped": F.lag("stops").over(w), "seen": F.lag("i").over(Window.partitionBy("video_id", "flat").orderBy("start_ms")),
        "height": F.when(F.col("y1") > F.col("y0"), (F.col("y1") - F.col("y0")) / F.greatest(F.col("n_lines"), F.lit(1))),
        "area": F.when((F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0")), (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.greatest(F.length(F.regexp_replace("flat", "\\s+", "")), F.lit(1))),
    })
    upper, lower = (lambda c: c.rlike("[A-Z]")), (lambda c: c.rlike("[a-z]"))
    ends_word = F.coalesce(bare.rlike("[A-Za-z0-9]$"), F.lit(False))
    edge = lambda words, k: F.array_join(F.slice(words, -k, k) if k > 0 else F.slice(words, 1, -k), " ")
    last = lambda k: F.when(F.size("before") >= k, edge(F.col("before"), k)).otherwise(F.array_join("before", " "))
    start = lambda k: edge(F.col("words"), -k)
    again = lambda k: (last(k) != "") & (last(k) == start(k))
    sure = lambda c: F.coalesce(c, F.lit(False))
    all_caps = sure(F.col("capitals") / F.when(F.col("letters") > 0, F.col("letters")) >= ALL_CAPS)
    flags = {
        "f_slow": sure((F.col("wps") < 2) | (F.col("wps") > 4)), "f_far": sure((F.col("wps") < 1) | (F.col("wps") > 7)), "f_flash": (F.col("s") > 0) & (F.col("s") < FLASH_MS / 1000), "f_range": (F.col("s") > 0) & ((F.col("s") < 1) | (F.col("s") > 7)),
        "f_lines": F.col("n_lines") > MOST_LINES, "f_chars": sure(F.col("chars") > MOST_CHARS), "f_repeated": text.rlike("[!?]{2,}|\\.{4,}"), "f_stop": sure(lower(bare) & upper(F.col("next_first")) & ends_word & ~F.col("stops")),
        "f_not_caps": ~all_caps, "f_start": F.col("first").isNotNull() & sure(lower(F.col("first"))) & F.coalesce("stopped", F.lit(True)), "f_i": F.col("first").isNotNull() & text.rlike("\\bi\\b"),
        "f_upper": sure(upper(F.col("first"))), "f_lower": sure(lower(F.col("first"))), "f_seen": sure(F.col("seen") < F.col("i") - 1), "f_overlap": sure(again(2) | again(1)),
        "f_dangling": sure(F.try_element_at("words", F.lit(-1)).isin(CONJUNCTIONS)) & F.col("has_next"), "f_middle": sure(ends_word & lower(F.col("next_first"))),
    }
    rows = rows.withColumns({**flags, "cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    n = F.count("*")
    share = lambda *names: sum((F.count_if(c) for c in names), F.lit(0)) / n
    timed = F.greatest(F.count("wps"), F.lit(1))
    spread = lambda c: F.stddev_pop(c) / F.greatest(F.lit(1e-9), F.avg(c))
    half = lambda a, b: clamp((a + b) / 2)
    style = F.when(F.sum("capitals") / F.greatest(F.sum("letters"), F.lit(1)) >= ALL_CAPS, "all_caps").when(F.bool_or("f_upper") & ~F.bool_or("f_lower"), "sentence_case").when(
        ~F.bool_or("f_upper") & F.bool_or("f_lower"), "lowercase").otherwise("mixed")
    return rows.groupBy("video_id").agg(
        n.alias("n_segments"), F.sum("s").alias("captioned_s"), style.alias("case_style"),
        clamp(clamp(1 - F.coalesce(F.stddev_pop("wps"), F.lit(0.0)) / 2) * (1 - F.count_if("f_slow") / timed * 0.5) * (1 - F.count_if("f_far") / timed)).alias("rhythm"),
        clamp(1 - share("f_flash") - share("f_range") / 2).alias("display"), clamp(1 - share("f_lines", "f_chars")).alias("density"), clamp(1 - share("f_stop", "f_repeated")).alias("punctuation"),
        clamp(1 - F.when(style == "all_caps", share("f_not_caps")).when(style == "sentence_case", share("f_start", "f_i")).otherwise(0.0)).alias("capitalization"),
        F.avg(F.abs(F.col("cx") - F.col("width") / 2) / F.col("width")).alias("_off"),
        half(clamp(1 - F.stddev_pop(F.col("cx") / F.col("width")) / MOST_SPREAD), clamp(1 - F.stddev_pop(F.col("cy") / F.col("height_px")) / MOST_SPREAD)).alias("placement"),
        half(clamp(1 - spread("height") / MOST_HEIGHT_CV), clamp(1 - spread("area") / MOST_AREA_CV)).alias("style"),
        clamp(1 - (F.count_if("f_seen") + F.count_if("f_overlap") * 0.5) / n).alias("redundancy"), clamp(1 - share("f_dangling", "f_middle")).alias("segmentation"),
    ).withColumn("alignment", clamp(1 - F.col("_off") / MOST_OFF_CENTRE)).drop("_off")


def burned_in_report(videos: DataFrame, frames: DataFrame, segments: DataFrame) -> DataFrame:
    """One row for each video (video_id, duration_ms, width, height): the fourteen sub-scores, case style, flicker, overall score and whether it passes.

    ``frames``: video_id, at_ms, text, confidence, x0, y0, x1, y1. ``segments``: ``caption_segments`` of the frames, blank runs included. Sub-scores go from 0 to 1 and are 1 where there is
    nothing to judge, but coverage and confidence, which are 0. Flicker is text, a blank run of half a second at most, and text again. All of it is windows and aggregates over a video's
    segments, and aggregates over its frames.
    """
    sized = segments.join(videos.select("video_id", "width", F.col("height").alias("height_px")), "video_id")
    scores = _segment_scores(sized)
    shown = frames.where(~_blank(F.col("text"))).join(videos.select("video_id", "width", "height"), "video_id")
    margin = lambda low, high, size: F.least(F.col(low), F.col(size) - F.col(high)) / (F.col(size) * SAFE_MARGIN)
    seen = shown.groupBy("video_id").agg(
        clamp(F.avg("confidence") - F.stddev_pop("confidence")).alias("confidence"), clamp(F.coalesce(F.min(F.least(margin("x0", "x1", "width"), margin("y0", "y1", "height"))), F.lit(1.0))).alias("safe_area"))
    w = Window.partitionBy("video_id").orderBy("start_ms")
    runs = segments.select("video_id", "start_ms", "end_ms", _blank(F.col("text")).alias("b")).withColumns({"b1": F.lead("b", 1).over(w), "b2": F.lead("b", 2).over(w), "s2": F.lead("start_ms", 2).over(w)})
    flicker = runs.groupBy("video_id").agg(F.count_if(~F.col("b") & F.col("b1") & ~F.col("b2") & (F.greatest(F.lit(0), F.col("s2") - F.col("end_ms")) <= FLASH_MS)).alias("flicker_events"))
    jitter = center_jitter(frames).select("video_id", F.col("score").alias("jitter"))
    rows = videos
    for part in (scores, seen, flicker, jitter):
        rows = rows.join(part, "video_id", "left")
    covered = F.when(F.col("duration_ms") > 0, F.greatest(F.lit(0.0), F.least(F.coalesce("captioned_s", F.lit(0.0)), F.col("duration_ms") / 1000)) / (F.col("duration_ms") / 1000)).otherwise(0.0)
    rows = rows.withColumn("coverage", clamp(covered)).withColumns({k: F.coalesce(k, F.lit(v)) for k, v in EMPTY.items() if k != "coverage"})
    overall = clamp(sum((F.col(k) * v for k, v in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values()))
    events = F.coalesce("flicker_events", F.lit(0))
    return rows.select(
        "video_id", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), *WEIGHTS, F.coalesce("case_style", F.lit("mixed")).alias("case_style"), events.alias("flicker_events"), overall.alias("score"),
        ((overall >= LEAST_OVERALL) & (F.col("coverage") >= LEAST_COVERAGE) & (events <= MOST_FLICKER)).alias("passed"))
