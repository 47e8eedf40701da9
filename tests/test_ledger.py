"""Ledger entries, warnings, manifests, eviction and snapshots on hand-made rows."""

from pyspark.sql import functions as F

from cadenza.operators import ledger

SCENE = "scene_id bigint, source string, asset_type string, path string, prompt string, cue string, topic string"
ASSET = "row_id bigint, asset_id string, asset_type string, kind string, path string, usage_mode string, review_status string, risk string, licence string"


def test_visual_entries(spark):
    rows = [
        (1, "generated-dalle", None, "HTTPS://x/y.png", None, "cue", "topic"), (2, "stock-pexels", "image", "clips/a.mp4", "p", None, "topic"),
        (3, "mock", "video", "mock://a", "p", None, "topic"), (4, None, None, None, None, None, None),
    ]
    got = {r["asset_id"]: r for r in ledger.visual_entries(spark.createDataFrame(rows, SCENE), "own", "own/visuals").collect()}
    one = got["visual:1"]
    assert (one["asset_type"], one["source_url"], one["local_path"], one["prompt"], one["usage_mode"], one["licence_name"]) == (
        "video", "HTTPS://x/y.png", None, "cue", "generated-asset", "repo-generated")
    assert (got["visual:2"]["provider"], got["visual:2"]["local_path"], got["visual:2"]["usage_mode"], got["visual:2"]["prompt"]) == ("pexels", "clips/a.mp4", "downloaded-asset", None)
    assert (got["visual:3"]["local_path"], got["visual:3"]["review_status"], got["visual:3"]["workflow"]) == (None, "generated-local", None)
    assert (got["visual:4"]["provider"], got["visual:4"]["usage_mode"]) == (None, "needs-classification")


def test_ledger_warnings(spark):
    rows = [
        (1, "a", "video", "clip", "x.mp4", "owned", "verified", None, None), (2, None, "Music", None, None, "downloaded-asset", "", None, " "),
        (3, None, "video", None, "soundtrack.mp4", None, "verified", None, None),
    ]
    got = sorted((r["row_id"], r["warning"]) for r in ledger.ledger_warnings(spark.createDataFrame(rows, ASSET)).collect())
    assert got == sorted([
        (2, "asset-2 is missing assetId."), (2, "asset-2 is missing reviewStatus."), (2, "asset-2 is audio-like but missing contentIdRisk."),
        (2, "asset-2 is downloaded-asset but missing license or permission evidence."), (3, "soundtrack.mp4 is missing assetId."), (3, "soundtrack.mp4 is missing usageMode."),
    ])


def test_apply_manifest(spark):
    visuals = spark.createDataFrame([(1, "a", "image", "pan", False), (2, "b", "image", "pan", False), (None, "c", "video", "none", True)], "id bigint, asset_path string, asset_type string, motion string, motion_applied boolean")
    manifest = spark.createDataFrame([(1, "made.mp4"), (1, "made.mp4"), (2, ""), (None, "lost.mp4")], "id bigint, video_path string")
    got = sorted((r["asset_path"], r["asset_type"], r["motion"], r["motion_applied"]) for r in ledger.apply_manifest(visuals, manifest, ["id"]).collect())
    assert got == [("b", "image", "pan", False), ("c", "video", "none", True), ("made.mp4", "video", "none", True)]


def test_evicted_sessions(spark):
    sessions = spark.createDataFrame([("a", 10), ("b", 95), ("c", 96), ("d", 96), ("e", 99)], "session_id string, last_ms bigint")
    got = {r["session_id"]: r["reason"] for r in ledger.evicted_sessions(sessions, F.lit(100), 50, 2).collect()}
    assert got == {"a": "ttl", "b": "lru", "c": "lru"}
    assert ledger.evicted_sessions(sessions.limit(0), F.lit(100), 50, 2).count() == 0


def test_metric_snapshot(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run_id bigint")
    one = lambda name, x: spark.createDataFrame([(1, x)], f"run_id bigint, {name} double")
    got = sorted(tuple(r) for r in ledger.metric_snapshot(runs, one("rating", 130.0), one("overall", 0.625), one("score", -0.1)).collect())
    assert got == [(1, 100, 63, 0), (2, None, None, None)]
