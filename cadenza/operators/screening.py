"""Screens and digests before a video is made: evidence for a prompt, recognised words and inserted blocks worth keeping, risky visuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_ITEMS, MOST_LENGTH, ROOM = 10, 2500, 50
# Headings of a context and the mark of what is left out.
HEADINGS = ("## Research Evidence\n", "Use these verified facts in your script:\n", "\n## Suggested Content Angles\n")
CUT_OFF = "\n\n[...truncated for length]"


def evidence_context(evidence: DataFrame, angles: DataFrame) -> DataFrame:
    """(topic_id, n_items, context): the ten most relevant items of each topic as a text for a prompt, and its angles, 2500 characters at most.

    ``evidence``: topic_id, item_id, title, source, relevance, summary, url; ``angles``: topic_id, rank, archetype, angle, hook. Of equal relevance the smaller item_id comes first; missing texts count as empty,
    a missing summary leaves its line out. The rank keeps ten rows of a topic within each task before anything is shuffled. Topics without evidence have no row.
    """
    w = Window.partitionBy("topic_id").orderBy(F.desc("relevance"), "item_id")
    best = evidence.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MOST_ITEMS)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    share = F.round(F.coalesce("relevance", F.lit(0.0)) * 100, 0).cast("long").cast("string")
    head = F.concat(F.lit("- **"), text("title"), F.lit("** ("), text("source"), F.lit(", relevance: "), share, F.lit("%)"))
    line = F.concat_ws("\n", head, F.when(text("summary") != "", F.concat(F.lit("  "), F.col("summary"))), F.concat(F.lit("  Source: "), text("url")))
    listed = lambda c, o: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, c.alias("_t")))), lambda x: x["_t"]), "\n")
    items = best.groupBy("topic_id").agg(F.count("*").alias("n_items"), listed(line, "_r").alias("_items"))
    told = F.concat(F.lit("- "), text("archetype"), F.lit(': "'), text("angle"), F.lit('" (hook: "'), text("hook"), F.lit('")'))
    ideas = angles.groupBy("topic_id").agg(listed(told, "rank").alias("_angles"))
    rows = items.join(ideas, "topic_id", "left")
    whole = F.concat_ws("\n", F.lit(HEADINGS[0]), F.lit(HEADINGS[1]), "_items", F.when(F.col("_angles").isNotNull(), F.lit(HEADINGS[2])), "_angles")
    capped = F.when(F.length("_whole") > MOST_LENGTH, F.concat(F.left("_whole", F.lit(MOST_LENGTH - ROOM)), F.lit(CUT_OFF))).otherwise(F.col("_whole"))
    return rows.withColumn("_whole", whole).select("topic_id", "n_items", capped.alias("context"))


def shown_token(text: Column) -> Column:
    """A recognised word without signs at its edges that a word does not have, blanks folded."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^[^a-z0-9@#/]+|[^a-z0-9!?.,'\"@/#:+-]+$", "")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def _counts(text: Column) -> tuple[Column, Column, Column]:
    """Characters that are no blanks, and the shares of letters and digits and of signs that texts seldom have."""
    return _of_compact(F.regexp_replace(text, "\\s+", ""))


def _of_compact(compact: Column) -> tuple[Column, Column, Column]:
    n = F.length(compact)
    return n, F.length(F.regexp_replace(compact, "[^a-zA-Z0-9]", "")) / F.greatest(n, F.lit(1)), F.length(F.regexp_replace(compact, r"[a-zA-Z0-9.,!?'\"\\:-]", "")) / F.greatest(n, F.lit(1))


def kept_words(words: DataFrame) -> DataFrame:
    """Recognised words of inserted pictures (text, confidence) that are worth keeping, cleaned: no counters, no icons, no short capitals that are unsure, no doubtful words.

    A word without a known confidence is doubted only if it is two to four capitals. All columns pass through; null texts go.
    """
    # As rows of their own, the cleaned word and its characters are made once; a filter would take their expressions in, once for every use.
    rows = words.withColumn("_t", F.explode(F.array(shown_token(F.col("text"))))).withColumn("_c", F.explode(F.array(F.regexp_replace("_t", "\\s+", ""))))
    n, plain, odd = _of_compact(F.col("_c"))
    unsure = F.coalesce(F.col("confidence"), F.lit(0.0))
    counter = F.col("_t").rlike(r"^\d{1,4}\+?$") | F.col("_t").rlike(r"(?i)^[a-z]?\)\d{1,4}\+?$")
    sure = ~F.coalesce(F.col("confidence") < 0.25, F.lit(False))
    keep = sure & (n >= 2) & (plain >= 0.4) & (odd <= 0.35) & F.col("_t").rlike("[a-zA-Z0-9]") & ~counter & ~(F.col("_t").rlike("^[A-Z]{2,4}$") & (unsure < 0.8))
    return rows.where(keep).withColumn("text", F.col("_t")).drop("_t", "_c")


def is_worth_showing(kind: Column, text: Column, words: Column, area: Column, quality: Column) -> Column:
    """Whether an inserted block is more than captions: enough letters and words that are sure, and for a generic picture a region and quality of note.

    ``words``: array<struct<text, confidence>>. A block without a region fills the picture; unknown quality counts as 0.
    """
    text, words = F.coalesce(text, F.lit("")), F.coalesce(words, F.array().cast("array<struct<text:string,confidence:double>>"))
    letters = F.length(F.regexp_replace(text, "[^a-zA-Z0-9]", ""))
    real = F.filter(words, lambda w: F.coalesce(w["text"].rlike("[a-zA-Z0-9]"), F.lit(False)))
    sure = F.filter(real, lambda w: F.coalesce(w["confidence"] >= 0.45, F.lit(False)))
    _, plain, odd = _counts(text)
    quality = F.coalesce(quality, F.lit(0.0))
    generic = letters.between(24, 700) & (F.size(real) >= 5) & (F.size(sure) >= 4) & (F.coalesce(area, F.lit(1.0)) >= 0.06) & (quality >= 0.35) & (plain >= 0.55) & (odd <= 0.2)
    return F.when(F.coalesce(kind, F.lit("")) == "generic_screenshot", generic).otherwise((letters >= 12) & (F.size(real) >= 3) & (quality >= 0.2))


def still_without_motion(asset_type: Column, motion: Column) -> Column:
    return F.coalesce((asset_type == "image") & (motion == "none"), F.lit(False))


def not_portrait(width: Column, height: Column) -> Column:
    return F.coalesce(width >= height, F.lit(False))


def match_confidence(*values: Column) -> Column:
    """The greatest of what is known; null if nothing is."""
    return F.greatest(*values)
