"""Slots and compliance on hand-made videos and scripts."""

from cadenza.operators import blueprint as B

SPAN = "video_id bigint, start_ms bigint, end_ms bigint"
VIDEO = "video_id bigint, hook_end_ms bigint, escalation_start_ms bigint, payoff_start_ms bigint, has_cta boolean, format string"
PRINT = "blueprint_id bigint, n_slots int, target_s double, hook_s double, has_cta boolean, pace string"
SCRIPT = "script_id bigint, blueprint_id bigint, hook string, cta string, duration_s double, scenes array<struct<text: string, duration_s: double>>"


def test_slots(spark):
    shots = [(1, 1, 0, 2500, False), (1, 2, 2500, 5000, False), (1, 3, 5000, 8000, False), (1, 4, 8000, 9500, False), (1, 5, 9500, 9600, True), (2, 1, 0, 9000, True), (3, 1, 0, 10, True)]
    videos = [(1, 2000, 4500, 9000, True, "vlog"), (2, 1000, 2000, 8000, False, "talking_head")]
    made = B.scene_slots(
        spark.createDataFrame(shots, "video_id bigint, shot_id bigint, start_ms bigint, end_ms bigint, is_last boolean"), spark.createDataFrame(videos, VIDEO),
        spark.createDataFrame([(1, 2400, 2600), (1, 2450, 2550), (1, 9600, 9700)], SPAN), spark.createDataFrame([(1, 5000, 5100)], SPAN), spark.createDataFrame([(1, 1, "zoom_out"), (1, 2, "pan_left"), (1, 3, "spin")], "video_id bigint, shot_id bigint, motion string"))
    got = {(r["video_id"], r["shot_id"]): r for r in made.collect()}
    assert [got[1, i]["role"] for i in range(1, 6)] == ["hook", "point", "escalation", "climax", "cta"]
    assert [got[1, i]["has_captions"] for i in range(1, 6)] == [True, True, False, False, False]
    assert [got[1, i]["camera_motion"] for i in range(1, 6)] == ["zoom_in", "pan", "mixed", None, None]
    assert [got[1, i]["visual_type"] for i in (2, 3)] == ["b_roll", "inserted_content"] and got[2, 1]["visual_type"] == "talking_head"
    assert got[1, 5]["least_s"] == 0.5 and len(got) == 6 and got[2, 1]["role"] == "point"


def test_compliance(spark):
    prints = [(1, 2, 8.0, 2.0, True, "moderate"), (2, 0, 0.0, 0.0, False, None)]
    words = lambda n, last="x": " ".join(["word"] * (n - 1) + [last])
    scripts = [
        (1, 1, "hook", "follow me", None, [(words(10), None), (words(10), None)]), (2, 1, " ", None, 9.0, [(words(12), 2.0), (words(3, "Subscribe!"), 2.5), (None, 3.0)]),
        (3, 1, None, None, None, [(words(40), None)]), (4, 2, None, None, None, None), (5, 9, None, None, None, None),
    ]
    got = {r["script_id"]: r for r in B.compliance(spark.createDataFrame(scripts, SCRIPT), spark.createDataFrame(prints, PRINT)).collect()}
    status = lambda i: [got[i][c] for c in ("scene_count", "duration", "cta", "hook", "pacing")]
    assert status(1) == ["pass"] * 4 + ["warn"]  # four seconds a scene are slow
    assert status(2) == ["warn", "warn", "fail", "fail", "pass"]
    assert status(3) == ["warn", "fail", "fail", "fail", "warn"]
    assert status(4) == ["pass"] * 5 and set(got) == {1, 2, 3, 4}
    assert (got[3]["n_pass"], got[3]["n_warn"], got[3]["n_fail"]) == (0, 2, 3)


def test_seconds_of_scenes_are_added_one_by_one(spark):
    """The scenes' seconds come to 52.800000000000004, above the limit of a tenth over 48; the quotient of all words is 52.8."""
    scenes = [(" ".join(["word"] * n), None) for n in (14, 20, 25, 25, 1, 23, 15, 9)]
    row = B.compliance(spark.createDataFrame([(1, 1, None, None, None, scenes)], SCRIPT), spark.createDataFrame([(1, 8, 48.0, 0.0, False, None)], PRINT)).first()
    assert (row["scene_count"], row["duration"]) == ("pass", "warn")
