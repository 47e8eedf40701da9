"""Words that recognised frames show, also where recognition has cut them in pieces or written signs for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import text as T

LEAST_CONFIDENCE = 0.3
MOST_PARTS, LEAST_LETTERS = 3, 5
# Signs with the words they are spoken as, and the letters that are words of their own.
SPOKEN = {"plus": "^[+＋]$", "minus": "^[-−]$", "equals": "^[=≈]$", "times": "^[*×]$", "over": "^[/÷]$", "to": "^(?:->|→)$", "sqrt": "^(?:√|(?i:sqrt))$"}
SINGLE = ["a", "i", "x", "y", "z"]


def candidate_words(text: Column) -> Column:
    """The different words of a frame's text, and those of two or three neighbours put together that all hold a letter and have five characters or more."""
    base = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")), " ")
    base = F.filter(base, lambda w: w != "")

    def merged(parts: int) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size(base) - parts + 1, F.lit(1))), lambda i: F.slice(base, i, parts))
        whole = F.filter(pieces, lambda p: (F.size(p) == parts) & F.forall(p, lambda w: w.rlike("[a-zA-Z]")))
        return F.filter(F.transform(whole, lambda p: F.array_join(p, "")), lambda w: F.length(w) >= LEAST_LETTERS)

    return F.array_distinct(F.concat(base, *[merged(k) for k in range(2, MOST_PARTS + 1)]))


def comparable_tokens(word: Column) -> Column:
    """What a shown word is compared as: its letters a-z and digits, the word that a sign stands for, and the number and the word of degrees."""
    number = F.regexp_extract(word, "^([0-9]+)\\s*[°º]$", 1)
    signs = [F.when(word.rlike(pattern), F.lit(name)) for name, pattern in SPOKEN.items()]
    found = F.array(F.nullif(T.plain(word), F.lit("")), *signs, F.nullif(number, F.lit("")), F.when(word.rlike("[°º]"), F.lit("degrees")))
    return F.array_distinct(F.array_compact(found))


def can_be_compared(token: Column) -> Column:
    """Two characters or more, a single letter that is a word, or a digit; but no number of more than three digits."""
    return ((F.length(token) >= 2) | token.isin(SINGLE) | token.rlike("^[0-9]$")) & ~token.rlike("^[0-9]{4,}$")


def word_appearances(frames: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(video_id, word, at_ms, n): which words frames (video_id, at_ms, text, confidence) show when, and as how many of a frame's words.

    Frames below ``least`` confidence are left out, those of unknown confidence too. Counts are folded in the task that reads a frame, so a word that every frame shows costs one row for a frame.
    """
    words = frames.where(F.col("confidence") >= least).select("video_id", "at_ms", F.explode(candidate_words(F.col("text"))).alias("w"))
    tokens = words.select("video_id", "at_ms", F.explode(comparable_tokens(F.trim("w"))).alias("word")).where(can_be_compared(F.col("word")))
    return tokens.groupBy("video_id", "word", "at_ms").agg(F.count("*").alias("n"))
