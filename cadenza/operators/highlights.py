"""Highlight spans: candidates, scores, choice, snapping and approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions.scores import clamp
from cadenza.functions.text import ends_sentence, plain
from cadenza.operators import joins
from cadenza.operators.windows import ordered
from cadenza.sources.shared import written

# Fillers, and the cues that open a hook and close with a payoff.
FILLERS = ["um", "uh", "erm", "ah", "like", "basically", "literally", "actually", "just", "kinda", "kind", "sorta", "sort"]
HOOK_CUES = ["why", "how", "what", "when", "stop", "never", "nobody", "most", "biggest", "mistake", "secret", "truth"]
PAYOFF_CUES = ["because", "means", "therefore", "so", "that", "why", "fix", "result", "instead", "now"]


def marked_words(words: DataFrame) -> DataFrame:
    """Words with sentence marks, filler marks, gaps, running filler counts, and the places of the next hook and the last payoff cue."""
    w = ordered(["video_id"], ["idx"])
    rows = words.withColumns({
        "ends": ends_sentence(F.col("word")), "opens": F.coalesce(ends_sentence(F.lag("word").over(w)), F.lit(True)),
        "filler": plain(F.col("word")).isin(FILLERS).cast("int"), "gap_before": F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w), F.lit(0)),
        "gap_after": F.coalesce(F.lead("start_ms").over(w) - F.col("end_ms"), F.lit(0)),
    })
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("video_id").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({
        "fillers": F.sum("filler").over(so_far), "hook_at": F.min(F.when(plain(F.col("word")).isin(HOOK_CUES), F.col("idx"))).over(back),
        "payoff_at": F.max(F.when(plain(F.col("word")).isin(PAYOFF_CUES), F.col("idx"))).over(so_far),
    })


def candidate_spans(words: DataFrame, least: int = 20_000, target: int = 35_000, most: int = 60_000, every: int = 8) -> DataFrame:
    """One span for each start (sentence starts and every eighth word): the end nearest the target length.

    An end of a sentence counts as 0.75 s nearer; of equal ends the first wins. Starts, laid at the time where their target ends, and the ends of all words
    make one ordered stream of a video: of the ends of sentences and of all ends only the last before that time and the first after it can win, so no pairs are made.
    Ends that lie ``least`` or more after a word that follows them could hide a later word's end there; such starts, which no video has whose words come in
    order, meet all ends of their time instead.
    """
    rows = marked_words(words)
    so_far = ordered(["video_id"], ["idx"]).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.col("opens") | (F.col("idx") % every == 0), F.lit(False)) & F.col("start_ms").isNotNull()
    odd = F.coalesce(F.max("end_ms").over(so_far) - F.col("start_ms") >= least, F.lit(False))
    own = F.struct(F.col("end_ms").alias("e"), F.col("idx").alias("last"), "ends", "gap_after", "payoff_at", F.col("fillers").alias("f1"))
    begin = F.struct(F.col("idx").alias("first"), F.col("start_ms").alias("s"), "opens", "gap_before", "hook_at", (F.col("fillers") - F.col("filler")).alias("f0"), odd.alias("odd"))
    marked = rows.withColumns({"_end": own, "_start": F.when(start, begin)}).where("video_id IS NOT NULL").select("video_id", "idx", "_end", "_start")
    moments = F.filter(F.array(
        F.struct(F.col("_end.e").alias("t"), F.lit(0).alias("side"), F.col("_end").alias("end"), F.lit(None).cast(marked.schema["_start"].dataType).alias("start")),
        F.struct((F.col("_start.s") + target).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(marked.schema["_end"].dataType).alias("end"), F.col("_start").alias("start")),
    ), lambda m: m["t"].isNotNull())
    stream = marked.select("video_id", "idx", F.explode(moments).alias("m")).select("video_id", "idx", "m.*")
    # Of equal times the first word is the last to come before a start, and the last again when the stream is read backwards.
    forth = Window.partitionBy("video_id").orderBy("t", "side", F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("video_id").orderBy(F.desc("t"), "side", F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    closing = F.when(F.col("end.ends"), F.col("end"))
    near = {"_a": F.last("end", ignorenulls=True).over(forth), "_b": F.last(closing, ignorenulls=True).over(forth),
            "_c": F.last("end", ignorenulls=True).over(back), "_d": F.last(closing, ignorenulls=True).over(back)}
    found = stream.withColumns(near).where("side = 1").select("video_id", "start.*", F.array("_a", "_b", "_c", "_d").alias("_near"))

    def choose(ends: Column, s: Column) -> Column:
        length = lambda x: x["e"] - s
        ranked = F.transform(ends, lambda x: F.struct((F.abs(length(x) - target) - F.when(x["ends"], 750).otherwise(0)).alias("distance"), x["last"].alias("last"), x.alias("end")))
        return F.array_min(F.filter(ranked, lambda r: (length(r["end"]) >= least) & (length(r["end"]) <= most)))

    usual = found.withColumn("_best", choose(F.col("_near"), F.col("s")))
    spans = usual.where("odd OR _best IS NOT NULL").select(
        "video_id", "first", "s", "opens", "gap_before", "hook_at", "f0", "odd", F.when(~F.col("odd"), F.col("_best.end")).alias("end"))
    spans = written(spans, "spans")
    if not spans.where("odd").isEmpty():
        spans = spans.where("NOT odd").unionByName(_of_pairs(spans.where("odd").drop("end"), marked, least, target, most))
    ends = spans.select("*", "end.*").drop("end")
    spans = ends.select("video_id", "first", "last", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), "opens", "ends", "gap_before", "gap_after",
                        (F.col("last") - F.col("first") + 1).alias("n_words"), (F.col("f1") - F.col("f0")).alias("fillers"),
                        F.coalesce(F.col("hook_at") <= F.least(F.col("first") + 7, F.col("last")), F.lit(False)).alias("hook_cue"),
                        F.coalesce(F.col("payoff_at") >= F.greatest(F.col("last") - 9, F.col("first")), F.lit(False)).alias("payoff_cue"))
    return _with_inner_gaps(spans, rows)


def _of_pairs(starts: DataFrame, marked: DataFrame, least: int, target: int, most: int) -> DataFrame:
    """``starts`` with the end nearest the target length among all that do not come before them; they meet in buckets of time."""
    ends = marked.select(F.col("video_id").alias("_v"), "_end", F.expr("_end.e div 60000").alias("_b"))
    spread = starts.withColumn("_b0", F.explode(F.sequence(F.expr(f"(s + {least}) div 60000"), F.expr(f"(s + {most}) div 60000"))))
    length = F.col("_end.e") - F.col("s")
    pairs = spread.join(ends, (F.col("video_id") == F.col("_v")) & (F.col("_b0") == F.col("_b")) & (length >= least) & (length <= most) & (F.col("_end.last") >= F.col("first")))
    distance = F.abs(length - target) - F.when(F.col("_end.ends"), 750).otherwise(0)
    best = joins.best(pairs.withColumn("_distance", distance), ["video_id", "first"], [F.col("_distance"), F.col("_end.last")])
    return best.withColumn("end", F.col("_end")).drop("_v", "_end", "_b", "_b0", "_distance")


def _with_inner_gaps(spans: DataFrame, rows: DataFrame, width: int = 60_000, least: int = 650) -> DataFrame:
    """``spans`` with ``inner_gap``, the longest pause between two of their words; only pauses over ``least`` are looked for (0 else).

    Pauses and spans meet in buckets of time.
    """
    pauses = rows.where(F.col("gap_before") > least).select(F.col("video_id").alias("_v"), F.col("idx").alias("_i"), F.col("gap_before").alias("_g"), F.floor(F.col("start_ms") / width).alias("_p"))
    cut = spans.select("video_id", "first", "last", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor((F.col("end_ms") + 60) / width))).alias("_b"))
    met = cut.join(pauses, (F.col("video_id") == F.col("_v")) & (F.col("_b") == F.col("_p")) & (F.col("_i") > F.col("first")) & (F.col("_i") <= F.col("last")))
    longest = met.groupBy("video_id", "first").agg(F.max("_g").alias("_longest"))
    return spans.join(longest, ["video_id", "first"], "left").withColumn("inner_gap", F.coalesce("_longest", F.lit(0))).drop("_longest")


def score_spans(spans: DataFrame, target: int = 35_000, most: int = 60_000, least_words: int = 8) -> DataFrame:
    """Spans with hook, coherence, payoff, boundary, filler and silence risk and total scores."""
    opens, ends = F.col("opens"), F.col("ends")
    give = lambda c, x: F.when(c, x).otherwise(0.0)
    near = clamp(1 - F.abs(F.col("end_ms") - F.col("start_ms") - target) / float(most - target))
    silence = clamp(F.greatest(F.lit(0.0), F.col("inner_gap") / 1000 - 0.65) / 1.5)
    hook = clamp(F.when(F.col("hook_cue"), 0.68).otherwise(0.08) + give(opens, 0.2) + give(F.col("fillers") == 0, 0.18))
    coherence = clamp(0.7 * near + give(ends, 0.2) + give(silence < 0.25, 0.1))
    payoff = clamp(F.when(F.col("payoff_cue"), 0.42).otherwise(0.16) + give(ends, 0.34) + give(F.col("n_words") >= least_words, 0.24))
    boundary = clamp(give(opens, 0.36) + give(ends, 0.36) + give((F.col("gap_before") >= 350) | (F.col("n_words") <= least_words), 0.14) + give(F.col("gap_after") >= 350, 0.14))
    risk = clamp(4.0 * F.col("fillers") / F.col("n_words"))
    total = clamp(0.28 * hook + 0.24 * coherence + 0.18 * payoff + 0.2 * boundary + 0.06 * (1 - risk) + 0.04 * (1 - silence))
    return spans.withColumns({"filler_risk": F.round(risk, 6), "silence_risk": F.round(silence, 6), "score": F.round(total, 6)})


def snap(spans: DataFrame, words: DataFrame, lead: int = 900, tail: int = 1100, gap: int = 450) -> DataFrame:
    """Spans widened to the nearest earlier sentence start or gap within ``lead`` and later sentence end or gap within ``tail``."""
    rows = marked_words(words)
    opening = rows.where(F.col("opens") | (F.col("gap_before") >= gap)).select(F.col("video_id").alias("_v"), F.col("start_ms").alias("_s"))
    closing = rows.where(F.col("ends") | (F.col("gap_after") >= gap)).select(F.col("video_id").alias("_v"), F.col("end_ms").alias("_e"))
    keys = ["video_id", "first", "start_ms", "end_ms"]
    base = spans.select(*keys).distinct()
    # One ordered stream of spans and boundaries each way, so no span meets all boundaries of its video.
    at = opening.select(F.col("_v").alias("video_id"), F.col("_s").alias("_t"), "_s").distinct()
    a = joins.asof(base.withColumn("_t", F.col("start_ms")), at, ["video_id"], "_t", "_s", "_s").drop("_t")
    upto = closing.select(F.col("_v").alias("video_id"), (-F.col("_e")).alias("_t"), "_e").distinct()
    b = joins.asof(a.withColumn("_t", -F.col("end_ms")), upto, ["video_id"], "_t", "_e", "_e").drop("_t")
    start, end = F.when(F.col("_s") >= F.col("start_ms") - lead, F.col("_s")), F.when(F.col("_e") <= F.col("end_ms") + tail, F.col("_e"))
    return b.select(*keys, F.coalesce(start, "start_ms").alias("snapped_start"), F.coalesce(end, "end_ms").alias("snapped_end"))
