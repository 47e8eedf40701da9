"""Rights rules over asset ledgers, publish ledgers and their dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import first_text

# Statuses that pass or fail a rights review, and rights flags that forbid publishing.
PASSING = ["approved", "verified", "cleared", "pass", "passed", "documented", "documented-local", "licensed", "permissioned", "owned", "owned-or-permissioned", "generated", "generated-local"]
FAILING = ["rejected", "blocked", "reference-only", "inspiration-only", "needs-review", "unknown", "unclear", "unreviewed", "pending", "todo"]
PROHIBITED = ["editorial-only", "non-commercial", "no-derivatives", "watermark", "watermarked", "scraper-only", "unlicensed", "copyright-unclear", "rights-unclear"]


def status_passes(status: Column) -> Column:
    """True or false for known statuses of any case; null when missing or unknown to both lists."""
    s = F.lower(F.trim(status))
    return F.when(s.isin(PASSING), True).when(s.isin(FAILING), False)


def rights_checks(assets: DataFrame) -> DataFrame:
    """One row per rule and asset that the rule concerns: asset_id, check_id, passed.

    Input: asset_id, status, usage, provider, source_url, licence, flags array<string>, attribution. One projection
    builds the rules as an array; no shuffle.
    """
    has = lambda *names: first_text(*[F.col(n) for n in names]).isNotNull()
    flags = F.transform(F.coalesce("flags", F.array().cast("array<string>")), F.lower)
    bad = F.exists(flags, lambda f: F.lit(False) | f.contains(PROHIBITED[0]) | f.rlike("|".join(PROHIBITED[1:])))
    external = F.coalesce(F.col("provider") == "external", F.lit(False))
    generated = F.coalesce(F.col("provider") == "generated", F.lit(False))
    credit = F.exists(flags, lambda f: f.contains("attribution")) | F.coalesce(F.lower("licence").contains("cc by"), F.lit(False))
    rule = lambda name, passed, when=None: (F.struct(F.lit(name).alias("check_id"), passed.alias("passed")) if when is None
                                            else F.when(when, F.struct(F.lit(name).alias("check_id"), passed.alias("passed"))))
    rules = F.array_compact(F.array(
        rule("review-status", F.coalesce(status_passes(F.col("status")), F.lit(False))),
        rule("usage-mode-publishable", ~F.coalesce(F.lower("usage").isin("reference-only", "inspiration-only"), F.lit(False))),
        rule("rights-flags-allowed", ~bad), rule("external-source-evidence", has("source_url"), external), rule("external-license-evidence", has("licence"), external),
        rule("attribution-present", has("attribution"), credit), rule("generated-provider-present", has("provider"), generated),
    ))
    return assets.select("asset_id", F.inline(rules))


def join_key(url: Column, id_: Column, platform: Column, path: Column, title: Column) -> Column:
    """Ledger key: the url, else id and platform, else the path, else the title; trimmed lower case."""
    norm = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    both = F.when(norm(id_).isNotNull() & norm(platform).isNotNull(), F.concat_ws("|", norm(id_), norm(platform)))
    return F.coalesce(norm(url), both, norm(path), norm(title))


def merge_ledgers(publish: DataFrame, metrics: DataFrame, key: str, order: str) -> DataFrame:
    """Full outer join of a publish ledger and the last metrics row of each key; metrics alone stay as placeholders."""
    kept = [c for c in metrics.columns if c != key]
    last = metrics.groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("_m")).select(key, "_m.*")
    both = publish.withColumn("in_publish", F.lit(True)).join(last.withColumn("in_metrics", F.lit(True)), key, "full")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_publish", "in_metrics")})


def window_status(due: Column, captured: Column, now: Column, soon_hours: int = 24) -> Column:
    """captured, unscheduled, overdue, due-soon or upcoming."""
    soon = now + F.make_dt_interval(hours=F.lit(soon_hours))
    return F.when(captured.isNotNull(), "captured").when(due.isNull(), "unscheduled").when(due < now, "overdue").when(due <= soon, "due-soon").otherwise("upcoming")


def parse_date(value: Column) -> Column:
    """Epoch seconds (10 digits), epoch milliseconds (13 digits) or an ISO time; anything else is null."""
    v = F.trim(value)
    return F.when(v.rlike("^[0-9]{10}$"), F.timestamp_seconds(v.try_cast("long"))).when(v.rlike("^[0-9]{13}$"), F.timestamp_millis(v.try_cast("long"))).otherwise(F.try_to_timestamp(v))


def duration_hours(words: Column) -> Column:
    """Hours of words such as 15m, 24h, 7d or 2w; null otherwise."""
    n, unit = F.regexp_extract(words, r"^\s*(\d+)\s*([mhdw])\s*$", 1), F.regexp_extract(words, r"^\s*(\d+)\s*([mhdw])\s*$", 2)
    size = F.when(unit == "m", 1 / 60).when(unit == "h", 1.0).when(unit == "d", 24.0).when(unit == "w", 168.0)
    return n.try_cast("double") * size


def normal_url(url: Column) -> Column:
    """Host and path in lower case without scheme, query and closing slash."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z]+://", ""), "[?#].*$", "")), "/+$", "")


def with_utm(url: Column, source: str, medium: str) -> Column:
    """The url with campaign parameters appended."""
    return F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit(f"utm_source={source}&utm_medium={medium}"))


def media_type(path: Column) -> Column:
    """image, video, audio or other by the file extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.when(ext.isin("png", "jpg", "jpeg", "webp", "gif"), "image").when(ext.isin("mp4", "mov", "webm", "mkv"), "video").when(ext.isin("mp3", "wav", "m4a", "ogg"), "audio").otherwise("other")
