"""Structure of a video from its shots, captions and transcript: reports, arcs, classes and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.scores import clamp, cosine
from cadenza.operators.windows import ordered

# Weights of the caption sub-scores that text and times give.
CAPTION_WEIGHTS = {"rhythm": 0.12, "display": 0.08, "density": 0.06, "punctuation": 0.04, "redundancy": 0.05, "confidence": 0.09}
PACE_ORDER = {"very_fast": 0, "fast": 1, "moderate": 2, "slow": 3}


def caption_report(segments: DataFrame) -> DataFrame:
    """Sub-scores of each video's caption segments and their weighted mean.

    Input: video_id, seg, text, start_ms, end_ms, confidence. Rhythm: words a second steady and within 2 to 4 (1 to 7 at all);
    display: 1 to 7 s, flashes under 0.5 s; density: 45 characters; punctuation: a text that ends a sentence is
    followed by a capital; redundancy: texts seen before, but not just before.
    """
    w = ordered(["video_id"], ["seg"])
    again = Window.partitionBy("video_id", "text").orderBy("seg")
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    rows = segments.withColumns({
        "s": seconds, "wps": F.when(seconds > 0, F.size(F.split("text", " ")) / seconds), "next": F.lead("text").over(w),
        "seen": F.coalesce(F.lag("seg").over(again) < F.col("seg") - 1, F.lit(False)),
    })
    n = F.count("*")
    share = lambda c: F.count_if(c) / n
    timed = F.greatest(F.count("wps"), F.lit(1))
    outside = lambda low, high: F.count_if((F.col("wps") < low) | (F.col("wps") > high)) / timed
    ends, capital = F.col("text").rlike("[.!?]$"), F.col("next").rlike("^[^a-z]")
    scores = {
        "rhythm": clamp(clamp(1 - F.coalesce(F.stddev_pop("wps"), F.lit(0.0)) / 2) * (1 - 0.5 * outside(2, 4)) * (1 - outside(1, 7))),
        "display": clamp(1 - share((F.col("s") > 0) & (F.col("s") < 0.5)) - share((F.col("s") > 0) & ((F.col("s") < 1) | (F.col("s") > 7))) / 2),
        "density": clamp(1 - share(F.length("text") > 45)), "punctuation": clamp(1 - share(ends & F.col("next").isNotNull() & ~capital)),
        "redundancy": clamp(1 - share(F.col("seen"))), "confidence": clamp(F.avg("confidence")),
    }
    stats = rows.groupBy("video_id").agg(n.alias("n"), *[v.alias(k) for k, v in scores.items()])
    total = sum((weight * F.col(k) for k, weight in CAPTION_WEIGHTS.items()), F.lit(0.0)) / sum(CAPTION_WEIGHTS.values())
    return stats.select("video_id", "n", *[F.round(k, 6).alias(k) for k in scores], F.round(total, 6).alias("score"))


def narrative_arc(videos: DataFrame) -> DataFrame:
    """Hook, escalation and payoff bounds from ``duration_ms`` and ``first_cut_ms`` (null without a cut)."""
    d = F.col("duration_ms")
    hook = F.least(F.coalesce(F.col("first_cut_ms"), F.floor(d * 0.2)), F.lit(3000), d)
    hook = F.when(d >= 500, F.greatest(F.lit(500), hook)).otherwise(hook)
    return videos.withColumn("hook_end_ms", hook).withColumn("payoff_start_ms", F.least(F.greatest(F.col("hook_end_ms"), F.floor(d * 0.75)), d))


def archetype(text: Column) -> Column:
    """listicle, versus, howto, myth or story, the first pattern that a transcript shows."""
    low = F.lower(text)
    rules = [("listicle", r"\b(number (one|two|1|2)|first.*second)\b"), ("versus", r"\b(vs|versus|better than)\b"), ("howto", r"\b(how to|step (one|1)|here's how)\b"), ("myth", r"\b(myth|debunk|actually)\b")]
    out = F.lit("story")
    for name, pattern in reversed(rules):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def editing_style(shots: Column, effects: Column, pace: Column) -> Column:
    """Energy from the pace and editing density from shots and effects, as a struct."""
    energy = F.when(pace.isin("very_fast", "fast"), "high").when(pace == "slow", "low").otherwise("medium")
    density = F.when((shots <= 3) & (effects <= 2), "minimal").when((shots >= 15) | (effects >= 10), "hyper").when((shots >= 8) | (effects >= 5), "dense").otherwise("moderate")
    return F.struct(energy.alias("energy"), density.alias("density"))


def pace_similarity(a: Column, b: Column) -> Column:
    """1 for equal paces, a third less for each step between them."""
    rank = lambda c: F.coalesce(*[F.when(c == k, v) for k, v in PACE_ORDER.items()])
    return clamp(1 - F.abs(rank(a) - rank(b)) / 3)


def duration_similarity(a: Column, b: Column) -> Column:
    """Cosine of two sorted duration arrays, the shorter filled with zeros at its end; two empty ones are alike."""
    filled = lambda x, y: F.transform(F.zip_with(F.sort_array(x), y, lambda p, q: F.coalesce(p, F.lit(0.0))), lambda p: p.cast("double"))
    return cosine(filled(a, b), filled(b, a), on_zero=1.0)


def compare_specs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Similarity of two specs of each key: durations, pace and number of shots (weights 1, 1 and 0.6)."""
    x = a.select(key, F.col("durations").alias("da"), F.col("pace").alias("pa"))
    y = b.select(key, F.col("durations").alias("db"), F.col("pace").alias("pb"))
    rows = x.join(y, key)
    shots = 1 / (1 + F.abs(F.size("da") - F.size("db")) / 0.2 / F.greatest(F.size("da"), F.size("db"), F.lit(1)))
    rows = rows.select(key, F.round(duration_similarity(F.col("da"), F.col("db")), 6).alias("durations"), F.round(pace_similarity(F.col("pa"), F.col("pb")), 6).alias("pace"), F.round(shots, 6).alias("shots"))
    return rows.withColumn("score", F.round((F.col("durations") + F.col("pace") + 0.6 * F.col("shots")) / 2.6, 6))
