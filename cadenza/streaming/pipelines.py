"""Structured Streaming forms of the log-shaped operators; each has a batch twin with the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from cadenza.operators.sequences import similar_captions

LATE = "10 minutes"


def provider_windows(attempts: DataFrame, every: str = "6 hours", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts of attempts and successes by provider; rows later than the watermark are dropped."""
    timed = attempts.withWatermark("ts", LATE)
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    rows = timed.groupBy(window, "provider").agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"))
    return rows.select(F.col("window.start").alias("window_start"), "provider", "attempts", "successes")


def sessions(events: DataFrame, keys: list[str], gap: str = "6 hours") -> DataFrame:
    """Session windows of each key that close after ``gap`` of silence."""
    rows = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """First event of each key within the watermark; state of older keys is let go."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def subscription(events: DataFrame, pattern: str) -> DataFrame:
    """Events of one type, of a ``prefix:*``, or all with ``*``."""
    if pattern == "*":
        return events
    if pattern.endswith(":*"):
        return events.where(F.col("type").startswith(pattern[:-1]))
    return events.where(F.col("type") == pattern)


def enriched(events: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """Stream-static left join with a profile table."""
    return events.join(profiles, key, "left")


def heard_near_shown(shown: DataFrame, heard: DataFrame, seconds: int = 2) -> DataFrame:
    """Stream-stream interval join of shown and heard words of a video that start within ``seconds``.

    Both need ``video_id``, ``ts`` and ``word``; watermarks on both sides bound the state.
    """
    a = shown.withWatermark("ts", LATE).select("video_id", F.col("ts").alias("shown_at"), F.col("word").alias("shown"))
    b = heard.withWatermark("ts", LATE).select(F.col("video_id").alias("_v"), F.col("ts").alias("heard_at"), F.col("word").alias("heard"))
    near = F.expr(f"video_id = _v AND heard_at BETWEEN shown_at - INTERVAL {seconds} SECONDS AND shown_at + INTERVAL {seconds} SECONDS")
    return a.join(b, near).drop("_v")


SESSION_ROWS = "video_id bigint, text string, start_ms bigint, end_ms bigint, n_frames bigint"
SESSION_STATE = "text string, best double, start_ms bigint, last_ms bigint, n_frames bigint"


def caption_sessions(frames: DataFrame, step_ms: int = 500) -> DataFrame:
    """Caption segments as their runs end; the open run of a video is the state, and comes out with the next different frame.

    Frames of a video must arrive in time order, as a frame log writes them.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        run: list[Any] | None = list(state.get) if state.exists else None

        def close() -> None:
            if run and run[0].strip():
                out.append((key[0], run[0], run[2], run[3] + step_ms, run[4]))

        for rows in batches:
            for r in rows.sort_values("at_ms").itertuples():
                if run and similar_captions(r.text, run[0]):
                    text, best = (r.text, r.confidence) if r.confidence > run[1] else (run[0], run[1])
                    run = [text, best, run[2], r.at_ms, run[4] + 1]
                else:
                    close()
                    run = [r.text, r.confidence, r.at_ms, r.at_ms, 1]
        if run:
            state.update(tuple(run))
        yield pd.DataFrame(out, columns=["video_id", "text", "start_ms", "end_ms", "n_frames"])

    grouped = frames.groupBy("video_id")
    return grouped.applyInPandasWithState(advance, SESSION_ROWS, SESSION_STATE, "append", GroupStateTimeout.NoTimeout)


def running_costs(events: DataFrame) -> DataFrame:
    """Running totals of each run and provider, for the update mode."""
    return events.groupBy("run_id", "provider").agg(F.count("*").alias("attempts"), F.sum("latency").alias("total"))


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is available and stop; the checkpoint carries the cursor to the next call."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def tail_jsonl(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """A growing folder of JSON lines as a stream; lines that do not parse are consumed and dropped."""
    raw = spark.readStream.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_a_batch).json(path)
    return raw.where("_corrupt is null").drop("_corrupt")
