"""Rendered captions held against the expected ones: a padded interval join, the best observed caption of each expected one, and a report of each video.

Also overlays that the speech under them supports, or that repeat an inserted block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import joins

PAD_MS = 500
#: Width of the time buckets of the joins.
BUCKET_MS = 10_000
#: Width where one side is whole blocks, which are sent once for each bucket they touch.
BLOCK_BUCKET_MS = 60_000
# Limits of a sync report, with the defect that each one reports and whether it only warns.
LIMITS = {
    "min_coverage": 0.35, "min_quality": 0.55, "min_confidence": 0.45, "min_match_ratio": 0.65, "min_duration_ratio": 0.55, "max_median_drift_ms": 350, "max_p95_drift_ms": 900,
}
#: Decimals that a mean keeps: what comes after them depends on the order of the sum, and would decide halves, limits and ranks of equals.
EXACT = 12
WARNINGS = ["low-caption-quality", "low-ocr-confidence"]


def normalised(text: Column) -> Column:
    """Lower-case letters a-z, digits and apostrophes between single spaces; null is empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9'\\s]", " ")
    return F.trim(F.regexp_replace(kept, "\\s+", " "))


def tokens(norm: Column, least: int = 1) -> Column:
    return F.filter(F.split(norm, " "), lambda t: F.length(t) >= least)


def loosely_alike(a: Column, b: Column) -> Column:
    """Equal, sharing the first four letters of either, or at most two edits apart."""
    begins = lambda x, y: (F.length(x) >= 4) & y.startswith(F.left(x, F.lit(4)))
    return (a == b) | begins(a, b) | begins(b, a) | (F.levenshtein(a, b, 2) >= 0)


def text_similarity(a: Column, b: Column, x: Column | None = None, y: Column | None = None) -> Column:
    """Of two normalised texts: 1 if equal, 0.92 if one holds the other, else the F1 of their words as multisets; 0 if either is empty.

    ``x`` and ``y`` are the texts' words where they are at hand.
    """
    x, y = tokens(a) if x is None else x, tokens(b) if y is None else y
    count = lambda words, w: F.size(F.filter(words, lambda v: v == w))
    counted = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, w: n + F.least(count(x, w), count(y, w)))
    shared = F.when(F.size(F.array_distinct(x)) == F.size(x), F.size(F.array_intersect(x, y))).otherwise(counted)
    precision, recall = shared / F.size(x), shared / F.size(y)
    f1 = F.when(shared == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when(a.contains(b) | b.contains(a), F.lit(0.92)).otherwise(f1)


def _share(flags: Column) -> Column:
    return F.when(F.size(flags) == 0, F.lit(0.0)).otherwise(F.size(F.filter(flags, lambda f: f)) / F.size(flags))


def match_captions(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected captions with the observed one that shows them best; captions without a match are left out.

    ``expected``: video_id, expected_id, text, start_ms, end_ms. ``observed``: video_id, observed_id, text, start_ms, end_ms. The two meet
    in time buckets if they touch after half a second is added on both sides. Of a caption's candidates, in the
    order of their ids, one replaces the best so far if its score (0.6 words seen, 0.25 likeness, 0.15 time) is above what the best one holds
    (0.85 of the better of words and likeness, 0.15 time). Start and end come from the first and last candidate
    that shows the caption. Null texts count as empty and match nothing; rows without times meet nothing. A caption's candidates are
    those within half a second of it, which bounds the list that is folded. Texts are cut into words before they meet, once and not for every pair and word.
    """
    e = expected.select(
        F.col("video_id"), "expected_id", normalised(F.col("text")).alias("_e"), F.col("start_ms").alias("e0"), F.col("end_ms").alias("e1"),
        (F.greatest(F.lit(0), F.col("start_ms") - PAD_MS) - 1).alias("_from"), (F.col("end_ms") + PAD_MS + 1).alias("_to"))
    o = observed.select("video_id", "observed_id", normalised(F.col("text")).alias("_o"), F.col("start_ms").alias("o0"), F.col("end_ms").alias("o1"))
    e, o = e.withColumn("_ew", tokens(F.col("_e"))), o.withColumn("_ow", tokens(F.col("_o")))
    met = joins.overlapping(e, o, ["video_id"], ("_from", "_to"), ("o0", "o1"), BUCKET_MS)
    alike = lambda w: F.exists("_ow", lambda v: (F.length(v) >= 2) & loosely_alike(w, v))
    flags = F.transform(F.filter("_ew", lambda w: F.length(w) >= 2), lambda w: F.array_contains("_ow", w) | alike(w))
    met = met.withColumns({"flags": flags, "alike": text_similarity(F.col("_e"), F.col("_o"), F.col("_ew"), F.col("_ow"))})
    shared = joins.overlap_length((F.col("e0"), F.col("e1")), (F.col("o0"), F.col("o1"))) / F.greatest(F.lit(1), F.col("e1") - F.col("e0"))
    met = met.withColumns({"seen": _share(F.col("flags")), "shared": shared})
    near = F.greatest(F.col("shared"), F.greatest(F.lit(0.0), 1 - F.abs(F.col("o0") - F.col("e0")) / 2000))
    score = F.col("seen") * 0.6 + F.col("alike") * 0.25 + near * 0.15
    hold = F.greatest("seen", "alike") * 0.85 + near * 0.15
    row = F.struct("observed_id", "o0", "o1", "seen", "alike", "shared", "flags", score.alias("score"), hold.alias("hold"))
    rows = met.groupBy("video_id", "expected_id", "e0", "e1").agg(F.array_sort(F.collect_list(row)).alias("c"))
    # A word of the caption is seen if any candidate shows it.
    seen_by_any = F.aggregate("c", F.transform(F.col("c")[0]["flags"], lambda f: F.lit(False)), lambda acc, x: F.zip_with(acc, x["flags"], lambda a, b: a | b))
    rows = rows.withColumn("evidence", _share(seen_by_any)).where("evidence >= 0.55")
    fits = F.filter("c", lambda x: (F.greatest(F.col("evidence"), x["seen"]) >= 0.55) | (x["alike"] >= 0.5) | ((x["alike"] >= 0.4) & (x["shared"] >= 0.5)))
    shown = F.filter("c", lambda x: (x["seen"] >= 0.45) | (x["alike"] >= 0.55))
    # Evidence of 0.55 lets every candidate through, so the fold starts with the first.
    best = F.aggregate("_fits", F.col("_fits")[0], lambda b, x: F.when(x["score"] > b["hold"], x).otherwise(b))
    rows = rows.withColumns({"_fits": fits, "_shown": shown}).withColumn("b", best)
    start = F.coalesce(F.array_min(F.transform("_shown", lambda x: x["o0"])), F.col("b.o0"))
    end = F.coalesce(F.array_max(F.transform("_shown", lambda x: x["o1"])), F.col("b.o1"))
    return rows.select(
        "video_id", "expected_id", F.col("b.observed_id").alias("observed_id"), "e0", "e1", start.alias("observed_start_ms"), end.alias("observed_end_ms"),
        (start - F.col("e0")).alias("start_drift_ms"), (end - F.col("e1")).alias("end_drift_ms"), F.greatest("b.seen", "b.alike").alias("similarity"),
    ).withColumnsRenamed({"e0": "expected_start_ms", "e1": "expected_end_ms"})


def sync_report(expected: DataFrame, observed: DataFrame, matches: DataFrame, quality: DataFrame) -> DataFrame:
    """One row for each video of ``expected``: match ratios by count and by duration, start drift, and the defects found.

    ``quality``: video_id, coverage, quality, confidence (0 where a video has no row). Drifts are whole milliseconds, of which a video has few
    different ones, so the exact percentiles need no sort. A video passes if no defect is more than a warning.
    """
    length = lambda a, b: F.greatest(F.lit(0), F.col(b) - F.col(a))
    e = expected.groupBy("video_id").agg(F.count("*").alias("n_expected"), F.sum(length("start_ms", "end_ms")).alias("_ms"))
    o = observed.groupBy("video_id").agg(F.count("*").alias("n_observed"))
    drift = F.abs("start_drift_ms")
    m = matches.groupBy("video_id").agg(
        F.count("*").alias("n_matched"), F.sum(length("expected_start_ms", "expected_end_ms")).alias("_matched_ms"), F.percentile(drift, F.array(F.lit(0.5), F.lit(0.95))).alias("_p"),
        F.max(drift).alias("max_drift_ms"), F.avg(drift).alias("mean_drift_ms"), F.round(F.avg("similarity"), EXACT).alias("mean_similarity"))
    rows = e.join(o, "video_id", "left").join(m, "video_id", "left").join(quality.select("video_id", "coverage", "quality", "confidence"), "video_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.select(
        "video_id", "n_expected", zero(F.col("n_observed")).alias("n_observed"), zero(F.col("n_matched")).alias("n_matched"),
        (zero(F.col("n_matched")) / F.col("n_expected")).alias("match_ratio"), F.when(F.col("_ms") > 0, zero(F.col("_matched_ms")) / F.col("_ms")).otherwise(0.0).alias("duration_ratio"),
        zero(F.col("_p")[0]).alias("median_drift_ms"), zero(F.col("_p")[1]).alias("p95_drift_ms"), zero(F.col("max_drift_ms")).alias("max_drift_ms"), zero(F.col("mean_drift_ms")).alias("mean_drift_ms"),
        zero(F.col("mean_similarity")).alias("mean_similarity"), *[zero(F.col(c)).alias(c) for c in ("coverage", "quality", "confidence")])
    # Names of the defects, in the order in which they are told.
    told = F.array_compact(F.array(
        F.when(F.col("n_observed") == 0, "missing-captions"), F.when(F.col("coverage") < LIMITS["min_coverage"], "low-caption-coverage"),
        F.when(F.col("quality") < LIMITS["min_quality"], "low-caption-quality"), F.when(F.col("confidence") < LIMITS["min_confidence"], "low-ocr-confidence"),
        F.when(F.col("match_ratio") < LIMITS["min_match_ratio"], "low-match-ratio"), F.when(F.col("duration_ratio") < LIMITS["min_duration_ratio"], "low-duration-match"),
        F.when(F.col("median_drift_ms") > LIMITS["max_median_drift_ms"], "high-median-drift"), F.when(F.col("p95_drift_ms") > LIMITS["max_p95_drift_ms"], "high-p95-drift")))
    rows = rows.withColumn("issues", told)
    return rows.withColumn("passed", F.size(F.array_except("issues", F.array(*map(F.lit, WARNINGS)))) == 0)


def needs_second_look() -> Column:
    """Whether a failed report asks for another region of the picture."""
    weak = (F.col("quality") < LIMITS["min_quality"]) | (F.col("confidence") < LIMITS["min_confidence"])
    return ~F.col("passed") & (weak | (F.col("n_matched") == 0) | (F.col("match_ratio") < LIMITS["min_match_ratio"]))


def better_reports(first: DataFrame, second: DataFrame) -> DataFrame:
    """The better report of each video: the first, or the second where the first needs another look and the second is better; ``region`` says which.

    Passed before failed, then more matches, higher ratio, quality and confidence, lower median and 95th percentile; of equals the first.
    """
    rank = F.struct("passed", "n_matched", "match_ratio", "quality", "confidence", (-F.col("median_drift_ms")).alias("m"), (-F.col("p95_drift_ms")).alias("p"))
    names = first.columns
    a = first.select("video_id", F.struct(*names).alias("_a"), rank.alias("_x"), needs_second_look().alias("_again"))
    b = second.select("video_id", F.struct(*names).alias("_b"), rank.alias("_y"))
    other = F.col("_again") & F.col("_b").isNotNull() & (F.col("_y") > F.col("_x"))
    picked = a.join(b, "video_id", "left").select(F.when(other, F.col("_b")).otherwise(F.col("_a")).alias("r"), F.when(other, 2).otherwise(1).alias("region"))
    return picked.select("r.*", "region")


def overlay_tokens(text: Column, least: int = 3) -> Column:
    """Words of letters a-z, digits and inner apostrophes of at least ``least`` characters."""
    bare = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9']+"), lambda w: F.regexp_replace(w, "^'+|'+$", ""))
    return F.filter(bare, lambda w: F.length(w) >= least)


def supported_overlays(overlays: DataFrame, speech: DataFrame) -> DataFrame:
    """``overlays`` (video_id, overlay_id, text, start_ms, end_ms) with ``speech_id`` of the speech they overlap longest, and whether it supports them.

    ``speech``: video_id, speech_id, text, start_ms, end_ms. Support: at least one and 0.34 of the overlay's words are spoken, or both texts are 0.45
    alike by edit distance. Of equally long overlaps the least id counts. Without a word of three letters on either side there is no support;
    in a video without speech every overlay is supported.
    """
    o = overlays.select("video_id", "overlay_id", F.col("text").alias("_text"), F.col("start_ms").alias("_o0"), F.col("end_ms").alias("_o1"))
    s = speech.select("video_id", "speech_id", F.col("text").alias("_said"), F.col("start_ms").alias("_s0"), F.col("end_ms").alias("_s1"))
    met = joins.overlapping(o, s, ["video_id"], ("_o0", "_o1"), ("_s0", "_s1"), BUCKET_MS)
    shared = joins.overlap_length((F.col("_o0"), F.col("_o1")), (F.col("_s0"), F.col("_s1")))
    # A maximum of structs combines before the shuffle, where a ranking would hold every pair of an overlay.
    found = met.groupBy("video_id", "overlay_id", "_text").agg(F.max(F.struct(shared.alias("ms"), (-F.col("speech_id")).alias("first"), "speech_id", "_said")).alias("b")).where("b.ms > 0")
    words, said = overlay_tokens(F.col("_text")), overlay_tokens(F.col("b._said"))
    hits = F.size(F.filter(words, lambda w: F.array_contains(said, w)))
    alike = T.similarity(T.plain(F.col("_text")), T.plain(F.col("b._said"))) >= 0.45
    held = (F.size(words) > 0) & (F.size(said) > 0) & (((hits >= 1) & (hits / F.size(words) >= 0.34)) | alike)
    found = found.select("video_id", "overlay_id", F.col("b.speech_id").alias("speech_id"), held.alias("_held"))
    spoken = speech.select("video_id").distinct().withColumn("_spoken", F.lit(True))
    rows = overlays.join(found, ["video_id", "overlay_id"], "left").join(spoken, "video_id", "left")
    return rows.withColumn("supported", F.when(F.col("_spoken").isNull(), True).otherwise(F.coalesce("_held", F.lit(False)))).drop("_held", "_spoken")


def repeated_overlays(overlays: DataFrame, blocks: DataFrame) -> DataFrame:
    """``overlays`` that repeat an inserted block (video_id, text, start_ms, end_ms): some block at the same time holds half their words or more.

    Overlays and blocks meet in time buckets, each block with its different words, so that no word is dealt on its own; only pairs of one time are compared.
    """
    o = overlays.select("video_id", "overlay_id", F.col("start_ms").alias("_o0"), F.col("end_ms").alias("_o1"), overlay_tokens(F.col("text")).alias("_words")).where("size(_words) > 0")
    b = blocks.select("video_id", F.col("start_ms").alias("_b0"), F.col("end_ms").alias("_b1"), F.array_distinct(overlay_tokens(F.col("text"))).alias("_said")).where("size(_said) > 0")
    met = joins.overlapping(o, b, ["video_id"], ("_o0", "_o1"), ("_b0", "_b1"), BLOCK_BUCKET_MS)
    hits = F.size(F.filter("_words", lambda w: F.array_contains("_said", w)))
    held = met.where(hits / F.size("_words") >= 0.5).select("video_id", "overlay_id").distinct()
    return overlays.join(held, ["video_id", "overlay_id"], "left_semi")
