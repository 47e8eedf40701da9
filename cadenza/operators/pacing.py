"""Pacing, audio and caption quality of timed words, and drift between two timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.scores import js_round, safe_ratio
from cadenza.functions.text import ends_sentence
from cadenza.operators.windows import ordered

CTA = "(?i)follow|subscribe|comment|share|save|link in bio|dm|join|check out|like"


def scene_pacing(words: DataFrame) -> DataFrame:
    """One row per scene: words, duration, rounded words per minute and status.

    Input: video_id, scene_id, idx, word, start_ms, end_ms. Scenes under half a second have no rate. The last scene
    of several, and scenes with a call to action, are only abnormal above 350.
    """
    scenes = words.groupBy("video_id", "scene_id").agg(
        F.count("*").alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"])).alias("text"),
    )
    w = ordered(["video_id"], ["scene_id"])
    whole = Window.partitionBy("video_id")
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    scenes = scenes.withColumns({
        "seconds": seconds, "is_last": (F.row_number().over(w) == F.count("*").over(whole)) & (F.count("*").over(whole) > 1),
        "wpm": F.when(seconds >= 0.5, js_round(F.col("n_words") / seconds * 60)).otherwise(0),
    })
    ending = F.col("is_last") | F.col("text").rlike(CTA)
    status = (
        F.when(ending, F.when(F.col("wpm") > 350, "abnormal").otherwise("normal"))
        .when((F.col("wpm") < 80) | (F.col("wpm") > 280), "abnormal")
        .when(F.col("wpm") < 120, "slow").when(F.col("wpm") > 220, "fast").otherwise("normal")
    )
    return scenes.withColumn("status", status).drop("text")


def pacing_quality(words: DataFrame, max_cv: float = 0.4) -> DataFrame:
    """One row per video: mean rate, coefficient of variation, share of acceptable scenes, score and pass."""
    timed = F.col("seconds") > 0.5
    fine = (F.col("status") != "abnormal").cast("int")
    stats = scene_pacing(words).groupBy("video_id").agg(
        F.count("*").alias("n_scenes"), F.avg(F.when(timed, F.col("wpm"))).alias("mean_wpm"), F.stddev_pop(F.when(timed, F.col("wpm"))).alias("sd_wpm"),
        F.sum(fine).alias("n_fine"),
    )
    cv = F.coalesce(F.try_divide("sd_wpm", "mean_wpm"), F.lit(0.0))
    score = 0.7 * F.col("n_fine") / F.col("n_scenes") + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("cv") / max_cv)
    return stats.withColumn("cv", cv).select(
        "video_id", "n_scenes", F.round("mean_wpm", 6).alias("mean_wpm"), F.round("cv", 6).alias("cv"), F.round(score, 6).alias("score"), (F.round(score, 6) >= 0.75).alias("passed"),
    )


def audio_quality(words: DataFrame) -> DataFrame:
    """One row per video: gap, overlap, pace, pause and transition scores of 0 to 100 and their weighted mean.

    Gaps over 0.8 s warn, over 1.5 s are critical; overlaps over 10 ms count; pauses of 0.2 s are expected after
    punctuation; scene changes under 0.1 s are abrupt.
    """
    w = ordered(["video_id"], ["idx"])
    pairs = words.withColumns({
        "gap": F.lead("start_ms").over(w) - F.col("end_ms"), "next_scene": F.lead("scene_id").over(w), "pausing": F.col("word").rlike("[.!?;:]$"),
    })
    scene = words.groupBy("video_id", "scene_id").agg(F.count("*").alias("n"), ((F.max("end_ms") - F.min("start_ms")) / 1000).alias("seconds"))
    rate = F.when(F.col("seconds") > 0.5, F.col("n") / F.col("seconds"))
    pace = scene.groupBy("video_id").agg(F.coalesce(F.try_divide(F.stddev_pop(rate), F.avg(rate)), F.lit(0.0)).alias("pace_cv"))
    changed = F.col("next_scene") != F.col("scene_id")
    count = lambda c: F.count_if(c)
    stats = pairs.groupBy("video_id").agg(
        count(F.col("gap") > 800).alias("long_gaps"), count(F.col("gap") > 1500).alias("critical_gaps"), count(F.col("gap") < -10).alias("n_overlaps"),
        count(F.col("pausing") & F.col("gap").isNotNull()).alias("expected_pauses"), count(F.col("pausing") & (F.col("gap") >= 200)).alias("pauses"),
        count(changed).alias("changes"), count(changed & (F.col("gap") < 100)).alias("abrupt"),
    ).join(pace, "video_id")
    hundred = F.lit(100.0)
    scores = {
        "silence_score": F.greatest(F.lit(0.0), hundred - 10 * F.col("long_gaps")), "overlap_score": F.greatest(F.lit(0.0), hundred - 20 * F.col("n_overlaps")),
        "pace_score": F.when(F.col("pace_cv") > 0.4, F.greatest(F.lit(0.0), hundred - 200 * (F.col("pace_cv") - 0.4))).otherwise(hundred),
        "pause_score": F.when(F.col("expected_pauses") == 0, hundred).otherwise(100.0 * F.col("pauses") / F.col("expected_pauses")),
        "transition_score": F.when(F.col("changes") == 0, hundred).otherwise(100.0 * (F.col("changes") - F.col("abrupt")) / F.col("changes")),
    }
    stats = stats.withColumns(scores)
    total = 0.25 * F.col("silence_score") + 0.25 * F.col("overlap_score") + 0.2 * F.col("pace_score") + 0.15 * F.col("pause_score") + 0.15 * F.col("transition_score")
    return stats.select("video_id", "long_gaps", "critical_gaps", "n_overlaps", *[F.round(s, 6).alias(s) for s in scores], F.round(total, 6).alias("score"))


# Words that recognition cuts in two, as (first part, second part); contractions are counted on their own.
SPLIT_WORDS = (("Str", "uggling"), ("Str", "ong"), ("Str", "eet"), ("Str", "ategic"), ("hyd", "rate"), ("hyd", "rogen"), ("hyd", "ration"),
               ("I", "'m"), ("I", "'ve"), ("I", "'ll"), ("I", "'d"), ("you", "'re"), ("you", "'ll"), ("you", "'ve"), ("you", "'d"),
               ("we", "'re"), ("we", "'ll"), ("we", "'ve"), ("we", "'d"), ("they", "'re"), ("they", "'ll"), ("they", "'ve"), ("they", "'d"))
WHOLE_WORDS = ("struggling", "strong", "street", "strategic", "hydrate", "hydrogen", "hydration")
CAPTION_WEIGHTS = {"word_integrity": 0.2, "contraction_integrity": 0.15, "duration_health": 0.15, "timestamp_validity": 0.15, "confidence_health": 0.1, "readability": 0.15, "paging": 0.1}
CAPTION_LEAST = {"word_integrity": 0.95, "contraction_integrity": 0.9, "duration_health": 0.9, "timestamp_validity": 1.0, "confidence_health": 0.8, "readability": 0.85, "paging": 0.8}


def caption_quality(words: DataFrame) -> DataFrame:
    """One row per video from words with confidence: seven scores of 0 to 1, their weighted mean and pass.

    Timing is valid (1) or not (0): any overlap over 10 ms voids it. Reading speed is that of the whole video, 15 characters a second at
    most. Paging is always 1.
    """
    w = ordered(["video_id"], ["idx"])
    length = F.col("end_ms") - F.col("start_ms")
    following = F.lead("word").over(w)
    known = F.concat_ws("|", F.col("word"), F.lower(following)).isin([f"{a}|{b}" for a, b in SPLIT_WORDS]) & following.isNotNull()
    partial = F.col("word").rlike("^[A-Z][a-z]{0,2}$") & following.rlike("^[a-z]{4,}$") & F.concat(F.lower("word"), following).isin(*WHOLE_WORDS)
    rows = words.withColumns({
        "_split": known | F.coalesce(partial, F.lit(False)), "_cut": following.rlike("(?i)^'[a-z]+$"), "_short": length < 50,
        "_over": F.col("end_ms") - F.lead("start_ms").over(w) > 10, "_doubt": F.coalesce("confidence", F.lit(1.0)) < 0.5,
    })
    n = F.count("*")
    share = lambda c: 1 - F.count_if(F.col(c)) / n
    seconds = (F.max_by("end_ms", "idx") - F.min_by("start_ms", "idx")) / 1000
    cps = F.when(seconds > 0, F.sum(F.length("word")) / seconds)
    stats = rows.groupBy("video_id").agg(
        n.alias("n_words"), share("_split").alias("word_integrity"), share("_cut").alias("contraction_integrity"), share("_short").alias("duration_health"),
        F.when(F.count_if("_over") == 0, 1.0).otherwise(0.0).alias("timestamp_validity"), share("_doubt").alias("confidence_health"),
        F.when(cps > 15, F.greatest(F.lit(0.0), 1 - (cps - 15) / 15)).otherwise(1.0).alias("readability"),
    ).withColumn("paging", F.lit(1.0))
    total = F.round(sum((F.col(k) * v for k, v in CAPTION_WEIGHTS.items()), F.lit(0.0)), 6)
    passed = total >= 0.85
    for name, least in CAPTION_LEAST.items():
        passed = passed & (F.col(name) >= least)
    return stats.select("video_id", "n_words", *[F.round(k, 6).alias(k) for k in CAPTION_WEIGHTS], total.alias("score"), passed.alias("passed"))


def drift(words: DataFrame, heard: DataFrame) -> DataFrame:
    """(video_id, idx, i, drift_ms): heard start minus script start, numbered from 0 in order."""
    pairs = heard.select("video_id", "idx", F.col("start_ms").alias("heard_ms")).join(words.select("video_id", "idx", "start_ms"), ["video_id", "idx"])
    w = ordered(["video_id"], ["idx"])
    return pairs.select("video_id", "idx", (F.row_number().over(w) - 1).alias("i"), (F.col("heard_ms") - F.col("start_ms")).alias("drift_ms"))


def drift_classes(drifts: DataFrame, tolerance: float = 30.0, jump: float = 200.0) -> DataFrame:
    """Per video: mean drift, slope per word, R2, jumps and acceleration, and the class they give.

    In order: stepped with any jump, progressive (ratio of the changes over 0.1 and R2 under 0.95), linear
    (R2 over 0.85 and slope over 5), none within ``tolerance``, progressive again over 0.05, else random.
    """
    w = ordered(["video_id"], ["i"])
    rows = drifts.withColumn("d", F.col("drift_ms") - F.lag("drift_ms").over(w))
    rows = rows.withColumn("dd", F.col("d") - F.lag("d").over(w))
    n = F.count("*")
    constant = F.max("drift_ms") == F.min("drift_ms")
    stats = rows.groupBy("video_id").agg(
        n.alias("n"), F.avg("drift_ms").alias("mean_drift"), F.max(F.abs("drift_ms")).alias("max_drift"),
        F.when(constant, 0.0).otherwise(F.regr_slope(F.col("drift_ms").cast("double"), F.col("i").cast("double"))).alias("slope"),
        F.when(constant, 0.0).otherwise(F.regr_r2(F.col("drift_ms").cast("double"), F.col("i").cast("double"))).alias("r2"),
        F.count_if(F.abs("d") >= jump).alias("jumps"), F.avg(F.abs("dd")).alias("mean_dd"), F.avg(F.abs("d")).alias("mean_d"),
    )
    rate = F.when(F.col("n") < 4, F.lit(0.0)).otherwise(safe_ratio(F.col("mean_dd"), F.col("mean_d")))
    stats = stats.withColumn("rate", rate)
    kind = (
        F.when(F.col("jumps") > 0, "stepped").when((F.col("rate") > 0.1) & (F.col("r2") < 0.95), "progressive")
        .when((F.col("r2") > 0.85) & (F.abs("slope") > 5), "linear").when(F.col("max_drift") <= tolerance, "none")
        .when(F.col("rate") > 0.05, "progressive").otherwise("random")
    )
    return stats.select("video_id", "n", F.round("mean_drift", 6).alias("mean_drift"), "max_drift", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), "jumps", F.round("rate", 6).alias("rate"), kind.alias("drift_class"))


def sync_metrics(drifts: DataFrame) -> DataFrame:
    """Drift aggregates per video; with ten matches or more, drifts over 0.4 s are cut when under 30 % are."""
    far = F.abs("drift_ms") > 400
    whole = Window.partitionBy("video_id")
    rows = drifts.withColumns({"n_all": F.count("*").over(whole), "n_far": F.count_if(far).over(whole)})
    cut = (F.col("n_all") >= 10) & (F.col("n_far") / F.col("n_all") < 0.3)
    kept = rows.where(~(cut & far)).withColumn("a", F.abs("drift_ms").cast("double"))
    return kept.groupBy("video_id").agg(
        F.count("*").alias("n"), F.max("n_all").alias("n_matches"), F.round(F.avg("a"), 6).alias("mean_ms"), F.round(F.median("a"), 6).alias("median_ms"),
        F.round(F.percentile("a", 0.95), 6).alias("p95_ms"), F.max("a").alias("max_ms"), F.round(F.stddev_pop(F.col("drift_ms")), 6).alias("sd_ms"),
        F.count_if(F.col("drift_ms") > 0).alias("late"), F.count_if(F.col("drift_ms") < 0).alias("early"),
    )


def sync_rating(metrics: DataFrame) -> DataFrame:
    """Rating of 0 to 100 by deductions, and its label."""
    over = lambda x, low, most, per: F.when(x > low, F.least(F.lit(float(most)), (x - low) / per)).otherwise(0.0)
    m = F.col
    gap = F.abs(m("mean_ms") - m("median_ms"))
    lost = over(m("median_ms"), 50, 30, 8.33) + over(gap, 50, 10, 25) + over(m("max_ms"), 200, 20, 20) + over(m("p95_ms"), 80, 15, 21.3) + over(m("sd_ms"), 50, 10, 25)
    rating = F.greatest(F.lit(0), js_round(100 - lost))
    label = F.when(m("rating") >= 90, "excellent").when(m("rating") >= 75, "good").when(m("rating") >= 60, "fair").when(m("rating") >= 40, "poor").otherwise("broken")
    return metrics.withColumn("rating", rating).withColumn("label", label)


def sentence_starts(words: DataFrame) -> DataFrame:
    """Words that open a sentence: the first of a video, or after one that ends a sentence."""
    w = ordered(["video_id"], ["idx"])
    return words.withColumn("opens", F.coalesce(ends_sentence(F.lag("word").over(w)), F.lit(True)))


def mean_share(flag: Column) -> Column:
    """Share of rows where the flag holds."""
    return F.avg(F.when(flag, 1.0).otherwise(0.0))
