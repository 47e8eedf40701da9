"""Timed-media views derived from the test tables, in Spark and as DuckDB common table expressions.

Integer arithmetic throughout, so that both engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import text as T
from cadenza.sources.tables import table

#: Turns of conversation that one partition of words holds, about; a video stays in one.
PART_TURNS = 1000

VIEW_SQL = {
    "tokens": """
        SELECT conv_id AS video_id, turn AS scene_id, CAST(p AS BIGINT) - 1 AS pos, w AS word,
               length(w) + CASE WHEN regexp_matches(w, '[.?!]$') THEN 3 ELSE 0 END AS weight
        FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
            SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS ws FROM conversations))
    """,
    "scenes": """
        SELECT video_id, scene_id, n_words, total_weight, dur_ms,
               CAST(coalesce(sum(dur_ms + (video_id + scene_id * 211) % 1500) OVER (PARTITION BY video_id ORDER BY scene_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scene_start
        FROM (SELECT video_id, scene_id, count(*) AS n_words, CAST(sum(weight) AS BIGINT) AS total_weight,
                     count(*) * (200 + (video_id * 37 + scene_id * 101) % 650) AS dur_ms
              FROM tokens GROUP BY video_id, scene_id)
    """,
    "words": """
        SELECT video_id, scene_id, idx, word, start_ms - CASE WHEN idx % 23 = 0 AND start_ms >= 60 THEN 60 ELSE 0 END AS start_ms,
               start_ms + (next_ms - start_ms) * 85 // 100 AS end_ms
        FROM (SELECT video_id, scene_id, word, row_number() OVER (PARTITION BY video_id ORDER BY scene_id, pos) - 1 AS idx,
                     scene_start + before * dur_ms // total_weight AS start_ms,
                     scene_start + (before + weight) * dur_ms // total_weight AS next_ms
              FROM (SELECT t.*, s.scene_start, s.dur_ms, s.total_weight,
                           CAST(coalesce(sum(t.weight) OVER (PARTITION BY t.video_id, t.scene_id ORDER BY t.pos
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
                    FROM tokens t JOIN scenes s USING (video_id, scene_id)))
    """,
    "asr_words": """
        SELECT video_id, idx, CASE WHEN idx % 11 = 0 THEN left(word, length(word) - 1) || 'x' ELSE word END AS word,
               greatest(0, start_ms + (idx * 37) % 400 - 200) AS start_ms, greatest(0, end_ms + (idx * 37) % 400 - 200) AS end_ms,
               ((idx * 13) % 100) / 100.0 AS confidence
        FROM words WHERE idx % 17 <> 0
    """,
    "cuts": """
        SELECT user_id AS video_id, CAST(date_diff('second', min(ts) OVER (PARTITION BY user_id), ts) AS BIGINT) * 1000 // 36000 AS cut_ms
        FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)
    """,
    "attempts": """
        SELECT event_id, ts, user_id AS run_id, event_type AS provider, event_type <> 'error' AS success, value AS latency,
               CAST(json_extract(props, '$.k') AS BIGINT) AS k
        FROM events
    """,
    "scripts": """
        SELECT doc_id, text, source, lang, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS scenes FROM documents
    """,
    "checks": """
        SELECT doc_id AS report_id, 'quality' AS check_id, quality = 1 AS passed, doc_id % 13 = 0 AS skipped FROM labels
        UNION ALL SELECT doc_id, 'safety', toxic = 0, doc_id % 17 = 0 FROM labels
        UNION ALL SELECT doc_id, 'pacing', (doc_id * 7) % 10 < 7, doc_id % 11 = 0 FROM labels
    """,
    "frames": "SELECT label AS video_id, vec_id AS frame, embedding FROM embeddings",
}
_NEEDS = {"scenes": ("tokens",), "words": ("tokens", "scenes"), "asr_words": ("tokens", "scenes", "words")}


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the named views, and those they need, as common table expressions in front."""
    order = []
    for name in names:
        order += [n for n in (*_NEEDS.get(name, ()), name) if n not in order]
    body = sql.strip()
    own = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {own}, {body[5:]}"
    return f"WITH {own} {body}"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word of a conversation turn, with its timing weight."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("scene_id"), F.posexplode(T.words(F.col("text"))).alias("pos", "word")
    )
    weight = F.length("word") + F.when(F.col("word").rlike("[.?!]$"), 3).otherwise(0)
    return rows.select("video_id", "scene_id", F.col("pos").cast("long").alias("pos"), "word", weight.cast("long").alias("weight"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words: each scene lasts by its word count, words share it by weight; some overlap the one before.

    Whatever is worked out for a video follows in the same tasks, with many times the rows, so the number of partitions grows with the turns: sizes
    of the shuffle, by which Spark would merge partitions, do not show what a task comes to hold.
    """
    scene = Window.partitionBy("video_id", "scene_id")
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "conversations").count() // PART_TURNS))
    rows = tokens(spark, sf_dir).repartition(parts, "video_id")
    before = F.coalesce(F.sum("weight").over(scene.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({
        "before": before, "total": F.sum("weight").over(scene), "n": F.count("*").over(scene),
        "last": F.max("pos").over(scene) == F.col("pos"),
    })
    rows = rows.withColumn("dur_ms", F.col("n") * (200 + (F.col("video_id") * 37 + F.col("scene_id") * 101) % 650))
    gap = F.when(F.col("last"), F.col("dur_ms") + (F.col("video_id") + F.col("scene_id") * 211) % 1500).otherwise(0)
    video = Window.partitionBy("video_id").orderBy("scene_id", "pos")
    # Whole scenes before this one: the running sum at the row before the scene's first word.
    passed = F.coalesce(F.sum(gap).over(video.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"scene_start": passed, "idx": (F.row_number().over(video) - 1).cast("long")})
    start = F.col("scene_start") + F.expr("before * dur_ms div total")
    following = F.col("scene_start") + F.expr("(before + weight) * dur_ms div total")
    rows = rows.withColumns({"s": start, "e": following})
    early = F.when((F.col("idx") % 23 == 0) & (F.col("s") >= 60), 60).otherwise(0)
    return rows.select("video_id", "scene_id", "idx", "word", (F.col("s") - early).alias("start_ms"), F.expr("s + (e - s) * 85 div 100").alias("end_ms"))


def asr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noisy hearing of ``words``: some dropped, shifted or misspelt."""
    shift = (F.col("idx") * 37) % 400 - 200
    rows = words(spark, sf_dir).where("idx % 17 <> 0")
    heard = F.when(F.col("idx") % 11 == 0, F.concat(F.expr("left(word, length(word) - 1)"), F.lit("x"))).otherwise(F.col("word"))
    return rows.select(
        "video_id", "idx", heard.alias("word"), F.greatest(F.lit(0), F.col("start_ms") + shift).alias("start_ms"),
        F.greatest(F.lit(0), F.col("end_ms") + shift).alias("end_ms"), ((F.col("idx") * 13) % 100 / F.lit(100.0)).alias("confidence"),
    )


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut times of each video in milliseconds: hours since its first event, a tenth of a second each."""
    at = F.unix_timestamp(F.date_trunc("second", "ts"))
    first = F.min(at).over(Window.partitionBy("user_id"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.expr("0").alias("_"), (at - first).alias("s")).select(
        "video_id", F.expr("s * 1000 div 36000").alias("cut_ms")
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider attempts: type as provider, anything but an error as success, value as latency."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("run_id"), F.col("event_type").alias("provider"), (F.col("event_type") != "error").alias("success"),
        F.col("value").alias("latency"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scripts: non-blank lines are scenes."""
    scenes = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", scenes.alias("scenes"))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three check rows for each labelled document."""
    labels = table(spark, sf_dir, "labels")
    rows = F.explode(F.array(
        F.struct(F.lit("quality").alias("check_id"), (F.col("quality") == 1).alias("passed"), (F.col("doc_id") % 13 == 0).alias("skipped")),
        F.struct(F.lit("safety").alias("check_id"), (F.col("toxic") == 0).alias("passed"), (F.col("doc_id") % 17 == 0).alias("skipped")),
        F.struct(F.lit("pacing").alias("check_id"), ((F.col("doc_id") * 7) % 10 < 7).alias("passed"), (F.col("doc_id") % 11 == 0).alias("skipped")),
    )).alias("c")
    return labels.select(F.col("doc_id").alias("report_id"), rows).select("report_id", "c.*")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame embeddings of each video."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame"), "embedding")
