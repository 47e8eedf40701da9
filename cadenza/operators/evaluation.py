"""Scores and checks of whole videos: engagement, paging, segments, visual plans, heuristic quality and small report rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.scores import clamp, js_round, limit_score, minimum_score

# Cue patterns of hooks, calls to action and numbered items, each counted once a text.
HOOK_PATTERNS = (
    r"\?$",
    r"(?i)^(want|wanna|need|hate|love|stop|don't|never|always)",
    r"(?i)^(did you know|here's|this is|imagine|picture this)",
    r"(?i)^(ugh|ok so|alright|hey|listen)",
    r"(?i)(am I right|you know what|let me tell you)",
    r"(?i)^(number \d|step \d|tip \d|#\d)",
)
CTA_PATTERNS = (
    r"(?i)(follow|subscribe|like|comment|share)",
    r"(?i)(link in bio|check out|go to|visit)",
    r"(?i)(more tips|more hacks|next video|part \d)",
    r"(?i)(let me know|drop a comment|tell me)",
)
NUMBER_PATTERNS = (
    r"(?i)^(number|#|tip|step|point|habit|reason|way|thing|mistake)\s*\d",
    r"^\d\s*[:.)]",
)
# Metrics of the heuristic quality score as (name, weight, scale, inverted).
QUALITY_WEIGHTS = (
    ("syncRating", 0.14, 100.0, False), ("captionOverall", 0.09, 1.0, False), ("pacingScore", 0.08, 1.0, False), ("audioScore", 0.08, 100.0, False),
    ("engagementScore", 0.09, 100.0, False), ("scriptScore", 0.06, 1.0, False), ("syncMatchRatio", 0.05, 1.0, False), ("hookTiming", 0.05, 100.0, False),
    ("temporalFlickerScore", 0.06, 1.0, False), ("temporalDuplicateRatio", 0.06, 1.0, True), ("freezeRatio", 0.05, 1.0, True),
    ("blackRatio", 0.03, 1.0, True), ("audioClippingRatio", 0.03, 1.0, True), ("flowMeanWarpError", 0.04, 0.5, True),
)
LOUDNESS, LOUDNESS_WEIGHT, LOUDNESS_TARGET = "audioLoudnessLUFS", 0.04, -14.0
# Defects as (name, metric, bound, whether the metric must lie above it).
DEFECTS = (
    ("low_sync_rating", "syncRating", 40, False), ("audio_quality_poor", "audioScore", 30, False), ("audio_overlap_detected", "audioOverlapCount", 0, True),
    ("caption_quality_poor", "captionOverall", 0.3, False), ("pacing_poor", "pacingScore", 0.3, False), ("low_engagement", "engagementScore", 30, False),
    ("weak_hook", "hookTiming", 20, False), ("high_duplicate_frames", "temporalDuplicateRatio", 0.5, True), ("excessive_freeze", "freezeRatio", 0.3, True),
    ("audio_clipping", "audioClippingRatio", 0.1, True), ("inconsistent_motion", "flowMeanWarpError", 0.3, True),
)


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """Number of patterns found in a text."""
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def engagement_quality(scenes: DataFrame) -> DataFrame:
    """One row per video from scenes (video_id, scene_id, text, start_ms, end_ms): six scores of 0 to 100 and their weighted mean.

    The hook is the first scene up to its first full stop, the call to action the last scene.
    """
    order = Window.partitionBy("video_id").orderBy("scene_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    length = (F.col("end_ms") - F.col("start_ms")) / 1000
    rows = scenes.withColumns({
        "hook": F.substring_index(F.first("text").over(whole), ".", 1), "cta": F.last("text").over(whole), "hook_s": F.first("start_ms").over(whole) / 1000,
        "cta_s": F.last("start_ms").over(whole) / 1000, "total_s": (F.last("end_ms").over(whole) - F.first("start_ms").over(whole)) / 1000,
        "mean_s": F.avg(length).over(whole), "length": length,
    })
    stats = rows.groupBy("video_id").agg(
        *[F.first(c).alias(c) for c in ("hook", "cta", "hook_s", "cta_s", "total_s", "mean_s")], F.count("*").alias("n_scenes"),
        F.count_if(matches(F.col("text"), NUMBER_PATTERNS) > 0).alias("numbered"), F.max(F.abs(F.col("length") - F.col("mean_s"))).alias("apart"),
    )
    n_words = F.size(F.filter(F.split("hook", r"\s+"), lambda x: x != ""))
    hook = F.least(F.lit(100), 50 + 25 * matches(F.col("hook"), HOOK_PATTERNS))
    hook = F.when(n_words <= 6, F.least(F.lit(100), hook + 10)).otherwise(hook)
    found = matches(F.col("cta"), CTA_PATTERNS)
    place = F.when(F.col("total_s") > 0, F.col("cta_s") / F.col("total_s")).otherwise(0.0)
    flow = F.when(F.col("n_scenes") < 3, 60).when(F.col("n_scenes") > 10, 80).otherwise(100)
    scores = {
        "hook_timing": F.when(F.col("hook_s") <= 3, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - (F.col("hook_s") - 3) * 20)),
        "hook_engagement": F.when(n_words <= 4, F.least(F.lit(100), hook + 10)).otherwise(hook).cast("double"),
        "cta_presence": F.when(found > 0, F.least(F.lit(100), 50 + 25 * found)).otherwise(0).cast("double"),
        "cta_timing": F.when(place >= 0.85, 100.0).otherwise(F.greatest(F.lit(0.0), place * 100)),
        "list_structure": F.when(F.col("numbered") == 0, 100.0).otherwise(F.least(F.lit(100.0), F.col("numbered") / F.greatest(F.lit(3), F.col("n_scenes") - 2) * 100)),
        "progression": F.when((F.col("mean_s") > 0) & (F.col("apart") > F.col("mean_s") * 2), F.greatest(F.lit(60), flow - 20)).otherwise(flow).cast("double"),
    }
    weights = dict(zip(scores, (0.2, 0.15, 0.2, 0.1, 0.2, 0.15)))
    scored = stats.withColumns(scores)
    total = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return scored.select("video_id", "n_scenes", "numbered", *[F.round(k, 6).alias(k) for k in scores], F.round(total, 6).alias("score"))


def paging_quality(words: DataFrame) -> DataFrame:
    """One row per video from words (video_id, page, line, idx, word): words a page, their spread, natural ends, line lengths, balance."""
    lines = words.groupBy("video_id", "page", "line").agg(
        (F.sum(F.length("word")) + F.count("*") - 1).alias("chars"), F.count("*").alias("n"), F.max(F.struct("idx", "word")).alias("last"))
    pages = lines.groupBy("video_id", "page").agg(
        F.sum("n").alias("n"), F.max("last")["word"].alias("last"), F.sum("chars").alias("chars"), F.count("*").alias("n_lines"),
        ((F.count("*") > 1) & (F.min("chars") < F.max("chars") * 0.5)).alias("uneven"))
    stats = pages.groupBy("video_id").agg(
        F.count("*").alias("n_pages"), F.avg("n").alias("mean_words"), F.stddev_pop("n").alias("sd_words"), F.avg(F.col("last").rlike("[.!?,;:]$").cast("double")).alias("natural"),
        (F.sum("chars") / F.sum("n_lines")).alias("mean_chars"), F.count_if("uneven").alias("n_uneven"))
    band = lambda x, low, high, least, most: F.when(x.between(low, high), 1.0).when(x.between(least, most), 0.6).otherwise(0.2)
    score = clamp(
        0.25 * band(F.col("mean_words"), 3, 5, 2, 7) + 0.2 * clamp(1 - F.col("sd_words") / 2.5) + 0.25 * clamp(F.col("natural") / 0.5)
        + 0.15 * band(F.col("mean_chars"), 12, 28, 8, 34) + 0.15 * clamp(1 - F.col("n_uneven") / F.col("n_pages") / 0.25))
    return stats.select(
        "video_id", "n_pages", *[F.round(c, 6).alias(c) for c in ("mean_words", "sd_words", "natural", "mean_chars")], "n_uneven",
        F.round(score, 6).alias("score"), (F.round(score, 6) >= 0.75).alias("passed"))


def segment_quality(segments: DataFrame) -> DataFrame:
    """One row per video from caption segments (video_id, text, n_words, start_ms, end_ms, confidence): reading speed, duration, words, confidence."""
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    cps = F.length(F.regexp_replace("text", r"\s+", "")) / (F.col("ms") / 1000)
    rows = segments.withColumn("ms", length).withColumn("cps", F.when(F.col("ms") > 0, cps)).withColumn("sure", F.coalesce("confidence", F.lit(1.0)))
    score = 0.45 * F.coalesce(limit_score(F.col("cps"), 18.0), F.lit(0.0)) + 0.25 * minimum_score(F.col("ms"), 700.0) + 0.2 * limit_score(F.col("n_words"), 7.0) + 0.1 * minimum_score(F.col("sure"), 0.5)
    stats = rows.withColumn("s", score).groupBy("video_id").agg(
        F.count("*").alias("n_segments"), F.round(F.coalesce(F.max("cps"), F.lit(0.0)), 6).alias("max_cps"), F.min("ms").alias("shortest_ms"), F.max("n_words").alias("most_words"),
        F.count_if(F.col("sure") < 0.5).alias("doubtful"), F.count_if(F.col("cps").isNull() | (F.col("cps") > 18)).alias("errors"),
        (js_round(F.round(F.avg("s") * 1000, 6)) / 1000).alias("score"))
    return stats.withColumn("passed", (F.col("errors") == 0) & (F.col("score") >= 0.85))


def visual_quality(assets: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per video of ``targets`` (video_id, target_s) from scene assets: fallbacks, coverage, confidence, portrait and motion.

    Assets: video_id, source, asset_type, motion, llm_confidence, similarity, seconds, width, height (clip sizes; null without a clip).
    """
    sure = F.greatest("llm_confidence", "similarity")
    stats = assets.groupBy("video_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("source").isin("fallback-color", "mock")).alias("fallbacks"), F.sum("seconds").alias("seconds"),
        F.count_if(sure < 0.55).alias("doubtful"), F.count_if((F.col("asset_type") == "image") & (F.col("motion") == "none")).alias("still"),
        F.count("width").alias("clips"), F.count_if(F.col("width") >= F.col("height")).alias("wide"))
    rows = targets.join(stats, "video_id", "left").na.fill(0, ["n", "fallbacks", "seconds", "doubtful", "still", "clips", "wide"])
    rate = F.when(F.col("n") > 0, F.col("fallbacks") / F.col("n")).otherwise(1.0)
    coverage = F.when(F.col("target_s") > 0, clamp(F.col("seconds") / F.col("target_s"))).otherwise(1.0)
    rows = rows.withColumns({"fallback_rate": rate, "coverage": coverage})
    over = F.when(F.col("fallback_rate") <= 0.25, 1.0).otherwise(clamp(1 - (F.col("fallback_rate") - 0.25) / 0.75))
    share = lambda part, of, none: F.when(F.col(of) > 0, 1 - F.col(part) / F.col(of)).otherwise(none)
    score = 0.3 * over + 0.25 * minimum_score(F.col("coverage"), 0.95) + 0.2 * share("doubtful", "n", 0.0) + 0.15 * share("wide", "clips", 1.0) + 0.1 * share("still", "n", 0.0)
    wrong = (F.col("n") == 0) | (F.col("fallback_rate") > 0.5) | ((F.col("target_s") > 0) & (F.col("coverage") < 0.95))
    scored = rows.withColumn("score", js_round(F.round(score * 1000, 6)) / 1000)
    return scored.select("video_id", "n", F.round("fallback_rate", 6).alias("fallback_rate"), F.round("coverage", 6).alias("coverage"), "doubtful", "still", "wide", "score",
                         (~wrong & (F.col("score") >= 0.85)).alias("passed"))


def intrinsic_score(seconds: Column, width: Column, height: Column, confidence: Column) -> Column:
    """Score of a video's own facts: duration, shape, width and caption confidence, a quarter each."""
    ratio = width / height
    length = F.when(seconds.between(20, 60), 25).when(seconds.between(15, 90), 18).when(seconds >= 10, 8).otherwise(2)
    shape = F.when((F.coalesce(width, F.lit(0)) == 0) | (F.coalesce(height, F.lit(0)) == 0), 0).when(ratio < 0.7, 25).when(ratio < 1.0, 15).when(ratio < 1.4, 10).otherwise(5)
    size = F.when(F.coalesce(width, F.lit(0)) == 0, 0).when(width >= 1080, 25).when(width >= 720, 15).otherwise(5)
    return (length + shape + size + F.coalesce(js_round(confidence * 25), F.lit(12))) / 100


def heuristic_quality(rows: DataFrame, top: int = 5) -> DataFrame:
    """Null-aware weighted score of ``metrics`` (a map from name to value) blended with the intrinsic score: no shuffle.

    Output: id, score, confidence, label, defects and the ``top`` factors as name:impact:direction, by absolute impact, ties in the order of the
    weights. Coverage divides by the weighted metrics alone, though loudness can make one more.
    """
    raw = lambda name: F.col("metrics")[name]
    parts = []
    for name, weight, scale, inverted in QUALITY_WEIGHTS:
        normal = F.least(raw(name) / scale, F.lit(1.0))
        parts.append((name, weight, 1 - normal if inverted else normal))
    parts.append((LOUDNESS, LOUDNESS_WEIGHT, F.when(raw(LOUDNESS).isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(raw(LOUDNESS) - LOUDNESS_TARGET) / 20))))
    give = [F.coalesce(normal * weight, F.lit(0.0)) for _, weight, normal in parts]
    weights = [F.when(normal.isNotNull(), weight).otherwise(0.0) for _, weight, normal in parts]
    total = sum(weights[1:], weights[0])
    seen = sum((normal.isNotNull().cast("int") for _, _, normal in parts), F.lit(0))
    rows = rows.withColumns({
        "_repo": F.when(total > 0, sum(give[1:], give[0]) / total).otherwise(0.0), "_cover": seen / len(QUALITY_WEIGHTS),
        "_own": intrinsic_score(F.col("duration_s"), F.col("width"), F.col("height"), F.col("ocr_confidence")),
    })
    blend = F.col("_cover") * 0.8
    rows = rows.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), js_round(F.round((F.col("_repo") * blend + F.col("_own") * (1 - blend)) * 100, 6)))))
    sure = F.least(F.lit(1.0), 0.3 + F.col("_cover") * 0.5 + F.abs(F.col("score") - 50) / 50 * 0.2)
    label = F.when(F.col("score") >= 80, "excellent").when(F.col("score") >= 60, "good").when(F.col("score") >= 40, "average").when(F.col("score") >= 20, "below_average").otherwise("bad")
    factor = lambda at, name, impact, normal: F.when(normal.isNotNull(), F.struct(-F.abs(impact).alias("size"), F.lit(at).alias("at"), F.format_string("%s:%d:%s", F.lit(name), impact, F.when(normal >= 0.5, "positive").otherwise("negative")).alias("text")))
    factors = [factor(i, name, js_round(F.round(normal * weight * 100, 6)).cast("long"), normal) for i, (name, weight, normal) in enumerate(parts)]
    factors.append(factor(len(parts), "_intrinsic", js_round(F.round(F.col("_own") * (1 - blend) * 100, 6)).cast("long"), F.col("_own")))
    best = F.transform(F.slice(F.array_sort(F.array_compact(F.array(*factors))), 1, top), lambda x: x["text"])
    defects = F.array_compact(F.array(*[F.when(raw(m) > bound if above else raw(m) < bound, name) for name, m, bound, above in DEFECTS]))
    return rows.select("id", "score", (js_round(F.round(sure * 100, 6)) / 100).alias("confidence"), label.alias("label"), F.array_join(defects, ",").alias("defects"), F.array_join(best, ",").alias("factors"))


def points_in_spans(spans: DataFrame, points: DataFrame, width: int = 60_000) -> DataFrame:
    """``spans`` (video_id, first, start_ms, end_ms) with the number of points (video_id, at_ms) inside, ends included, and their density score.

    Spans are cut into buckets of ``width`` milliseconds, so spans and points of a video never meet as a whole.
    """
    cut = spans.where("end_ms >= start_ms").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.col("end_ms") / width))))
    at = points.select(F.col("video_id").alias("_v"), "at_ms", F.floor(F.col("at_ms") / width).alias("_p"))
    inside = cut.join(at, (F.col("video_id") == F.col("_v")) & (F.col("_b") == F.col("_p")) & F.col("at_ms").between(F.col("start_ms"), F.col("end_ms")))
    counts = inside.groupBy("video_id", "first").agg(F.count("*").alias("_n"))
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    rows = spans.join(counts, ["video_id", "first"], "left").withColumn("n_points", F.coalesce("_n", F.lit(0))).drop("_n")
    return rows.withColumn("change_score", F.when(seconds > 0, F.round(clamp(F.col("n_points") / F.greatest(F.lit(1.0), seconds / 3)), 6)))


def baseline_check(current: DataFrame, baseline: DataFrame, allowed: float = 0.01) -> DataFrame:
    """One row: videos in both tables (id, score), worst delta (at most 0), how many fell by more than ``allowed``, and pass."""
    delta = F.round(F.col("score") - F.col("_base"), 9)
    met = current.join(baseline.select("id", F.col("score").alias("_base")), "id").withColumn("delta", delta)
    return met.agg(F.count("*").alias("n"), F.round(F.coalesce(F.least(F.lit(0.0), F.min("delta")), F.lit(0.0)), 6).alias("worst_delta"), F.count_if(F.col("delta") < -allowed).alias("regressed"),
                   (F.count_if(F.col("delta") < -allowed) == 0).alias("passed"))


def determinism(runs: DataFrame, epsilon: float = 0.001) -> DataFrame:
    """Spread of repeated ``score`` of each ``id`` and whether it stays within ``epsilon``."""
    spread = F.max("score") - F.min("score")
    return runs.groupBy("id").agg(F.count("*").alias("n"), F.round(spread, 6).alias("spread"), (F.round(spread, 9) <= epsilon).alias("stable"))


def cost_guard(estimates: DataFrame, warn_at: float, most: float) -> DataFrame:
    """Worst estimate of image providers (id, asset_type, cost) for each id, 0 without any, against a warning and a limit."""
    worst = F.coalesce(F.max(F.when(F.col("asset_type") == "image", F.col("cost"))), F.lit(0.0))
    return estimates.groupBy("id").agg(F.round(worst, 6).alias("worst")).withColumns({"warned": F.col("worst") > warn_at, "blocked": F.col("worst") > most})


def dominant_motion(motions: DataFrame) -> DataFrame:
    """Most frequent ``motion`` of each video (ties: first seen by ``at``) as static, zoom_in, pan or mixed."""
    counts = motions.groupBy("video_id", "motion").agg(F.count("*").alias("n"), F.min("at").alias("seen"))
    top = counts.groupBy("video_id").agg(F.min_by("motion", F.struct(-F.col("n"), F.col("seen"))).alias("top"), F.count("*").alias("kinds"))
    name = (
        F.when(F.col("top").isin("unknown", "static"), "static").when(F.col("top").isin("zoom_in", "zoom_out"), "zoom_in")
        .when(F.col("top").isin("pan_left", "pan_right"), "pan").when(F.col("kinds") >= 3, "mixed").otherwise("static"))
    return top.select("video_id", "kinds", name.alias("motion"))


def mean_of_best(best: DataFrame) -> DataFrame:
    """Mean, least and tenth percentile of the items' bests for each video; of an item in several parts the greatest counts."""
    best = best.groupBy("video_id", "item").agg(F.max("best").alias("best"))
    return best.groupBy("video_id").agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("mean"), F.min("best").alias("least"), F.round(F.percentile("best", 0.1), 6).alias("p10"))


def fill_by_position(scenes: DataFrame, responses: DataFrame, fallback: Column) -> DataFrame:
    """Scenes (id, pos, text) with the response (id, pos, keyword) of the same position, or ``fallback`` where none came."""
    met = scenes.join(responses.select("id", "pos", F.col("keyword").alias("_k")), ["id", "pos"], "left")
    return met.select("id", "pos", F.coalesce("_k", fallback).alias("keyword"), F.col("_k").isNull().alias("filled"))


def ordered_by_priority(rows: DataFrame, key: str, priority: list[str], order: Column) -> DataFrame:
    """``rows`` with ``place``: keys of the priority list first and in its order, the rest by ``order``. The list is a literal."""
    at = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(key))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.when(at > 0, at).asc_nulls_last(), order)))


def timing_confidence(source: Column, heard: Column, script: Column) -> Column:
    """Confidence of timings: by their source, less where fewer words were heard than the script has."""
    base = F.when(source == "whisper", 0.95).otherwise(0.8)
    return F.when(script > 0, base * (0.5 + 0.5 * F.least(heard / script, F.lit(1.0)))).otherwise(base)


def source_text_risk(report: DataFrame) -> DataFrame:
    """``report`` (id, coverage, seconds, score, segments, confidence) with the thresholds it reaches and whether it reaches all five."""
    rules = [("coverage", 0.2), ("seconds", 1.5), ("score", 0.7), ("segments", 2), ("confidence", 0.55)]
    met = F.array_compact(F.array(*[F.when(F.col(c) >= least, c) for c, least in rules]))
    return report.select("id", F.array_join(met, ",").alias("reasons"), (F.size(met) == len(rules)).alias("flagged"))
