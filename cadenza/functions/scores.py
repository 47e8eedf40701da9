"""Column functions for scores, statistics and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x limited to [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def js_round(x: Column) -> Column:
    """floor(x + 0.5): halves go up, for negatives too."""
    return F.floor(x + 0.5)


def range_score(value: Column, low: float, high: float) -> Column:
    """1 inside [low, high], falling linearly to 0 with the relative distance outside."""
    below = clamp(1 - (low - value) / low) if low else F.lit(0.0)
    return F.when(value < low, below).when(value > high, clamp(1 - (value - high) / high)).otherwise(F.lit(1.0))


def limit_score(value: Column, limit: float) -> Column:
    """1 up to the limit, then limit / value."""
    return F.when(value <= limit, F.lit(1.0)).otherwise(clamp(F.lit(limit) / value))


def minimum_score(value: Column, minimum: float) -> Column:
    """1 from the minimum on, value / minimum below."""
    return F.when(value >= minimum, F.lit(1.0)).otherwise(clamp(value / minimum))


def difference_score(a: Column, b: Column, scale: float) -> Column:
    """1 / (1 + |a - b| / scale)."""
    return 1 / (1 + F.abs(a - b) / scale)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(score: Column, slope: float, intercept: float) -> Column:
    """Platt scaling of a raw score."""
    return sigmoid(slope * score + intercept)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, on_zero: float = 0.0) -> Column:
    """Cosine similarity; ``on_zero`` when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(on_zero)).otherwise(dot(a, b) / size)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """The vector scaled to length one; zero vectors stay."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit integers."""
    return F.bit_count(a.bitwiseXOR(b))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def energy_of_rms(db: Column) -> Column:
    """Loudness -60..0 dB mapped to 0..1."""
    return clamp((db + 60) / 60)
