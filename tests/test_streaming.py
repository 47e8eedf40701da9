"""Streams give their batch twins' rows."""

import pytest
from pyspark.sql import functions as F

from cadenza.operators import sequences
from cadenza.plans import analytics, editing, views
from cadenza.streaming import pipelines as P


@pytest.fixture
def attempts_log(spark, sf_dir, tmp_path):
    """The attempts in time order over several files, read one file at a time."""
    rows = views.attempts(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    for day in range(0, 31, 6):
        part = rows.where((F.dayofmonth("ts") > day) & (F.dayofmonth("ts") <= day + 6))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "log")), rows


def _collect(stream, tmp_path, mode="append"):
    out = []
    P.drain(stream, lambda df, _: out.extend(df.collect()), str(tmp_path / "check"), mode)
    return out


def test_provider_windows(spark, sf_dir, attempts_log, tmp_path):
    stream, _ = attempts_log
    got = {(r["window_start"].replace(tzinfo=None), r["provider"]): (r["attempts"], r["successes"]) for r in _collect(P.provider_windows(stream), tmp_path)}
    want = {(r["window_start"], r["provider"]): (r["attempts"], r["successes"]) for r in analytics.provider_windows(spark, sf_dir).collect()}
    # Windows still open at the watermark have not come out yet.
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 8


def test_running_costs(attempts_log, tmp_path):
    stream, rows = attempts_log
    got = {}
    P.drain(P.running_costs(stream), lambda df, _: got.update({(r["run_id"], r["provider"]): r["attempts"] for r in df.collect()}), str(tmp_path / "c"), "update")
    assert got == {(r["run_id"], r["provider"]): r["count"] for r in rows.groupBy("run_id", "provider").count().collect()}


def test_cursor_resumes(spark, tmp_path):
    log, seen = tmp_path / "in", []
    log.mkdir()
    for i in range(3):
        (log / f"{i}.jsonl").write_text(f'{{"n": {i}}}\nbroken\n')
        P.drain(P.tail_jsonl(spark, str(log), "n int"), lambda df, _: seen.extend(r["n"] for r in df.collect()), str(tmp_path / "check"))
    assert seen == [0, 1, 2]


def test_subscriptions(spark):
    e = spark.createDataFrame([("stage:start",), ("stage:end",), ("pipeline:end",)], "type string")
    assert [P.subscription(e, p).count() for p in ("*", "stage:*", "stage:end")] == [3, 2, 1]


def test_caption_sessions(spark, sf_dir, tmp_path):
    frames = editing.ocr_frames(spark, sf_dir).where("video_id < 3")
    frames.coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "f"))
    got = {(r["video_id"], r["start_ms"]): (r["text"], r["end_ms"], r["n_frames"]) for r in _collect(P.caption_sessions(stream), tmp_path)}
    want = {(r["video_id"], r["start_ms"]): (r["text"], r["end_ms"], r["n_frames"]) for r in sequences.caption_sessions(frames).collect()}
    # The last run of each video is still open.
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 3
