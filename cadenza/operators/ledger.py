"""Asset ledger entries and their warnings, media manifests, session eviction and metric snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scores import clamp, js_round
from cadenza.functions.text import first_text

# Provider names of visual sources, and the words that mark an asset as audio.
PROVIDERS = {
    "stock-pexels": "pexels", "stock-pixabay": "pixabay", "stock-unsplash": "unsplash", "generated-nanobanana": "nanobanana", "generated-dalle": "dalle",
    "user-footage": "user-supplied",
}
AUDIO_WORDS = r"\b(audio|music|sfx|sound|ambience|voice|voiceover)\b"


def visual_provider(source: Column, own: str) -> Column:
    """Provider of a visual source: ``own`` makes colours and mocks, and unknown sources name themselves."""
    known = F.create_map(*[F.lit(x) for pair in (PROVIDERS | {"fallback-color": own, "mock": own}).items() for x in pair])
    return F.coalesce(known[source], source)


def visual_entries(scenes: DataFrame, own: str, workflow: str) -> DataFrame:
    """One ledger entry for each scene ``(scene_id, source, asset_type, path, prompt, cue, topic)``; null types are videos.

    ``own`` is the provider's name of what is made here, ``workflow`` the step that generates assets. One projection: a path is remote, made up (a colour or ``mock://``) or local; generated assets carry prompt, workflow and licence.
    """
    source, path = F.col("source"), F.col("path")
    remote = F.coalesce(path.rlike("(?i)^https?://"), F.lit(False))
    made_up = F.coalesce(path.startswith("#") | path.startswith("mock://"), F.lit(False))
    generated = source.startswith("generated-") | (source == "fallback-color")
    ours = generated | (source == "mock")
    review = F.when(ours, "generated-local").otherwise("needs-review")
    return scenes.select(
        F.concat(F.lit("visual:"), F.col("scene_id").cast("string")).alias("asset_id"), F.coalesce("asset_type", F.lit("video")).alias("asset_type"),
        F.when(~remote & ~made_up, path).alias("local_path"), F.when(remote, path).alias("source_url"), visual_provider(source, own).alias("provider"),
        F.when(generated, F.coalesce("prompt", "cue", "topic")).alias("prompt"), F.when(generated, workflow).alias("workflow"),
        F.when(ours, "generated-asset").when(source.startswith("stock-"), "downloaded-asset").when(source == "user-footage", "user-supplied").otherwise("needs-classification").alias("usage_mode"),
        review.alias("review_status"), F.when(generated, "repo-generated").alias("licence_name"),
    )


def ledger_warnings(assets: DataFrame) -> DataFrame:
    """``(row_id, ref, warning)``: what each asset's entry lacks, at most one row for each rule; no shuffle.

    Input: row_id, asset_id, asset_type, kind, path, usage_mode, review_status, risk, licence. Empty text counts as missing.
    """
    ref = F.coalesce("asset_id", "path", F.concat(F.lit("asset-"), F.col("row_id").cast("string")))
    lacks = lambda name: first_text(F.col(name)).isNull()
    audio = F.lower(F.concat_ws(" ", "asset_type", "kind", "path")).rlike(AUDIO_WORDS)
    unproven = F.coalesce(F.col("usage_mode") == "downloaded-asset", F.lit(False)) & lacks("licence")
    # The texts of the five warnings.
    found = F.array_compact(F.array(
        F.when(lacks("asset_id"), " is missing assetId."), F.when(lacks("usage_mode"), " is missing usageMode."), F.when(lacks("review_status"), " is missing reviewStatus."),
        F.when(audio & lacks("risk"), " is audio-like but missing contentIdRisk."),
        F.when(unproven, " is downloaded-asset but missing license or permission evidence."),
    ))
    return assets.select("row_id", ref.alias("ref"), F.explode(found).alias("_w")).select("row_id", "ref", F.concat("ref", "_w").alias("warning"))


def apply_manifest(visuals: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """``visuals`` whose scene has a synthesised video in ``manifest (keys, video_path)`` point at it, as a video without further motion.

    The manifest's rows without a path are dropped before the join; a key that comes twice takes the greatest path.
    """
    made = manifest.where("video_path is not null and video_path <> ''").groupBy(*keys).agg(F.max("video_path").alias("_video"))
    joined = visuals.join(made, keys, "left")
    found = F.col("_video").isNotNull()
    return joined.withColumns({
        "asset_path": F.coalesce("_video", "asset_path"), "asset_type": F.when(found, "video").otherwise(F.col("asset_type")),
        "motion": F.when(found, "none").otherwise(F.col("motion")), "motion_applied": found | F.col("motion_applied"),
    }).drop("_video")


def evicted_sessions(sessions: DataFrame, now_ms: Column, ttl_ms: int, most: int) -> DataFrame:
    """``(session_id, reason)`` of the sessions ``(session_id, last_ms)`` that go: idle beyond the limit, then the least recently used.

    The ``most`` sessions that stay are a top-k, so nothing is sorted whole; of equal times the greater id stays.
    """
    timed = sessions.withColumn("_old", now_ms - F.col("last_ms") > ttl_ms)
    kept = timed.where("not _old").orderBy(F.desc("last_ms"), F.desc("session_id")).limit(most).select("session_id")
    gone = timed.join(kept, "session_id", "left_anti")
    return gone.select("session_id", F.when(F.col("_old"), "ttl").otherwise("lru").alias("reason"))


def metric_snapshot(runs: DataFrame, sync: DataFrame, captions: DataFrame, scores: DataFrame) -> DataFrame:
    """Each run with the three optional reports' marks as whole numbers from 0 to 100 (null without a report).

    Inputs: ``run_id`` with ``rating`` (0 to 100), ``overall`` and ``score`` (0 to 1), one row a run each.
    """
    mark = lambda x: js_round(clamp(x, 0.0, 100.0)).cast("long")
    joined = runs.select("run_id").join(sync, "run_id", "left").join(captions, "run_id", "left").join(scores, "run_id", "left")
    whole = {"sync_rating": F.col("rating"), "caption_overall": F.col("overall") * 100, "proxy_score": F.col("score") * 100}
    return joined.select("run_id", *[F.when(c.isNotNull(), mark(c)).alias(n) for n, c in whole.items()])
