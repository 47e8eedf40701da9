"""Column functions on words and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \\t\\n\\r\\f]+"
SENTENCE_END = "[.!?][\"')]*$"


def words(text: Column) -> Column:
    """Non-empty blank-separated words; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def plain(word: Column) -> Column:
    """Lower-case letters a-z and digits only."""
    return F.regexp_replace(F.lower(word), "[^a-z0-9]", "")


def trimmed(word: Column) -> Column:
    """Lower case without punctuation at the edges (letters and digits of any script stay)."""
    return F.regexp_replace(F.lower(word), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")


def ends_sentence(word: Column) -> Column:
    return word.rlike(SENTENCE_END)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared distinct tokens over the smaller set; 0 when either is empty."""
    small = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(small == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / small)


def fnv1a32(text: Column) -> Column:
    """FNV-1a 32-bit hash over code points below 2**16 (ASCII tokens), as a long."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    start = F.lit(2166136261).cast("long")
    return F.aggregate(points, start, lambda h, c: (h.bitwiseXOR(c.cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm of milliseconds."""
    whole = ms.cast("long")
    part = lambda unit, size: F.pmod(F.floor(whole / unit), F.lit(size)).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3_600_000).cast("int"), part(60_000, 60), part(1000, 60), F.pmod(whole, F.lit(1000)).cast("int"))


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc of milliseconds, centiseconds cut off."""
    whole = ms.cast("long")
    part = lambda unit, size: F.pmod(F.floor(whole / unit), F.lit(size)).cast("int")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(whole / 3_600_000).cast("int"), part(60_000, 60), part(1000, 60), part(10, 100))


def excerpt(text: Column, size: int) -> Column:
    """The first ``size`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def first_text(*columns: Column) -> Column:
    """The first value that is not null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])
