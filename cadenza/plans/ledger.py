"""Queries on asset ledgers, media manifests, sessions and metric snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import ledger, windows
from cadenza.plans.registry import register
from cadenza.sources.tables import table

_SOURCES = ["stock-pexels", "stock-pixabay", "generated-dalle", "fallback-color", "mock", "user-footage", "stock-unsplash", "archive"]
_SCENES_SQL = f"""SELECT page_id AS scene_id, {_SOURCES}[page_id % 8 + 1] AS source, CASE WHEN page_id % 3 = 0 THEN 'image' END AS asset_type,
    CASE page_id % 4 WHEN 0 THEN '#336699' WHEN 1 THEN 'mock://clip' WHEN 2 THEN 'assets/' || page_id || '.mp4' ELSE url END AS path,
    CASE WHEN page_id % 5 = 0 THEN 'prompt ' || page_id END AS prompt, CASE WHEN page_id % 7 < 4 THEN 'cue' END AS cue, 'topic' AS topic FROM pages"""
_ENTRIES_SQL = f"""SELECT 'visual:' || scene_id AS asset_id, coalesce(asset_type, 'video') AS asset_type,
      CASE WHEN NOT coalesce(regexp_matches(path, '^https?://', 'i'), false) AND NOT coalesce(starts_with(path, '#') OR starts_with(path, 'mock://'), false) THEN path END AS local_path,
      CASE WHEN regexp_matches(path, '^https?://', 'i') THEN path END AS source_url,
      CASE source WHEN 'stock-pexels' THEN 'pexels' WHEN 'stock-pixabay' THEN 'pixabay' WHEN 'stock-unsplash' THEN 'unsplash' WHEN 'generated-dalle' THEN 'dalle' WHEN 'fallback-color' THEN 'studio'
        WHEN 'mock' THEN 'studio' WHEN 'user-footage' THEN 'user-supplied' ELSE source END AS provider,
      CASE WHEN gen THEN coalesce(prompt, cue, topic) END AS prompt, CASE WHEN gen THEN 'studio/visuals' END AS workflow,
      CASE WHEN gen OR source = 'mock' THEN 'generated-asset' WHEN starts_with(source, 'stock-') THEN 'downloaded-asset' WHEN source = 'user-footage' THEN 'user-supplied' ELSE 'needs-classification' END AS usage_mode,
      CASE WHEN gen OR source = 'mock' THEN 'generated-local' ELSE 'needs-review' END AS review_status, CASE WHEN gen THEN 'repo-generated' END AS licence_name
    FROM (SELECT *, starts_with(source, 'generated-') OR source = 'fallback-color' AS gen FROM ({_SCENES_SQL}))"""


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    kind = page % 4
    path = F.when(kind == 0, "#336699").when(kind == 1, "mock://clip").when(kind == 2, F.concat(F.lit("assets/"), page.cast("string"), F.lit(".mp4"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        page.alias("scene_id"), F.array(*map(F.lit, _SOURCES))[(page % 8).cast("int")].alias("source"), F.when(page % 3 == 0, "image").alias("asset_type"), path.alias("path"),
        F.when(page % 5 == 0, F.concat(F.lit("prompt "), page.cast("string"))).alias("prompt"), F.when(page % 7 < 4, "cue").alias("cue"), F.lit("topic").alias("topic"))


@register("visual_entries", _ENTRIES_SQL)
def visual_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.visual_entries(_scenes(spark, sf_dir), "studio", "studio/visuals")


@register("ledger_warnings", """WITH a AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 6 <> 0 THEN 'asset:' || p_partkey END AS asset_id, CASE WHEN p_partkey % 4 = 0 THEN 'Audio' ELSE 'video' END AS asset_type,
      p_name AS kind, CASE WHEN p_partkey % 9 <> 0 THEN 'media/' || p_partkey END AS path, CASE WHEN p_size > 25 THEN 'downloaded-asset' WHEN p_size > 5 THEN 'owned' ELSE '' END AS usage_mode,
      CASE WHEN p_size % 4 <> 0 THEN 'verified' END AS review_status, CASE WHEN p_size % 3 = 0 THEN 'low' END AS risk, CASE WHEN p_partkey % 5 = 0 THEN 'CC0' END AS licence FROM part),
    r AS (SELECT *, coalesce(asset_id, path, 'asset-' || row_id) AS ref FROM a)
    SELECT row_id, ref, ref || ' is missing assetId.' AS warning FROM r WHERE asset_id IS NULL
    UNION ALL SELECT row_id, ref, ref || ' is missing usageMode.' FROM r WHERE usage_mode = ''
    UNION ALL SELECT row_id, ref, ref || ' is missing reviewStatus.' FROM r WHERE review_status IS NULL
    UNION ALL SELECT row_id, ref, ref || ' is audio-like but missing contentIdRisk.' FROM r WHERE risk IS NULL AND regexp_matches(lower(concat_ws(' ', asset_type, kind, path)), '\\b(audio|music|sfx|sound|ambience|voice|voiceover)\\b')
    UNION ALL SELECT row_id, ref, ref || ' is downloaded-asset but missing license or permission evidence.' FROM r WHERE usage_mode = 'downloaded-asset' AND licence IS NULL""")
def ledger_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return ledger.ledger_warnings(table(spark, sf_dir, "part").select(
        key.alias("row_id"), F.when(key % 6 != 0, F.concat(F.lit("asset:"), key.cast("string"))).alias("asset_id"), F.when(key % 4 == 0, "Audio").otherwise("video").alias("asset_type"),
        F.col("p_name").alias("kind"), F.when(key % 9 != 0, F.concat(F.lit("media/"), key.cast("string"))).alias("path"),
        F.when(size > 25, "downloaded-asset").when(size > 5, "owned").otherwise("").alias("usage_mode"), F.when(size % 4 != 0, "verified").alias("review_status"),
        F.when(size % 3 == 0, "low").alias("risk"), F.when(key % 5 == 0, "CC0").alias("licence")))


@register("manifest_visuals", """SELECT l_orderkey, l_linenumber, CASE WHEN made THEN 'made/' || l_orderkey || '.mp4' ELSE 'stock/' || l_partkey END AS asset_path,
      CASE WHEN made OR l_linestatus = 'F' THEN 'video' ELSE 'image' END AS asset_type, CASE WHEN made THEN 'none' ELSE l_returnflag END AS motion, made OR l_discount > 0.05 AS motion_applied
    FROM (SELECT l.*, coalesce(o_orderpriority = '1-URGENT', false) AS made FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey)""")
def manifest_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scenes; urgent orders have a synthesised video."""
    visuals = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("stock/"), F.col("l_partkey").cast("string")).alias("asset_path"), F.when(F.col("l_linestatus") == "F", "video").otherwise("image").alias("asset_type"),
        F.col("l_returnflag").alias("motion"), (F.col("l_discount") > 0.05).alias("motion_applied"))
    made = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("made/"), F.col("o_orderkey").cast("string"), F.lit(".mp4")))
    return ledger.apply_manifest(visuals, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), made.alias("video_path")), ["l_orderkey"])


@register("evicted_sessions", """WITH s AS (SELECT user_id AS session_id, max(epoch_ms(date_trunc('second', ts))) AS last_ms FROM events GROUP BY user_id), t AS (SELECT *, (SELECT max(last_ms) FROM s) - last_ms > 7200000 AS old FROM s),
    k AS (SELECT session_id FROM t WHERE NOT old ORDER BY last_ms DESC, session_id DESC LIMIT 20)
    SELECT session_id, CASE WHEN old THEN 'ttl' ELSE 'lru' END AS reason FROM t WHERE session_id NOT IN (SELECT session_id FROM k)""")
def evicted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions, now at the last event: two hours' idle limit, twenty sessions stay."""
    sessions = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg((F.max(F.unix_timestamp(F.date_trunc("second", "ts"))) * 1000).alias("last_ms"))
    now = sessions.agg(F.max("last_ms").alias("_now"))
    # One row: the time of the last event.
    timed = sessions.join(F.broadcast(now))
    return ledger.evicted_sessions(timed, F.col("_now"), 7_200_000, 20)


@register("metric_snapshot", """WITH c AS (SELECT o_custkey AS id, avg(CAST(o_totalprice AS DOUBLE)) / 250000 AS overall FROM orders GROUP BY o_custkey), p AS (SELECT user_id AS id, max(value) / 40 AS score FROM events GROUP BY user_id)
    SELECT c_custkey AS run_id, CASE WHEN c_acctbal IS NOT NULL THEN CAST(floor(greatest(0, least(100, CAST(c_acctbal AS DOUBLE) / 60)) + 0.5) AS BIGINT) END AS sync_rating, CASE WHEN c.overall IS NOT NULL THEN CAST(floor(greatest(0, least(100, c.overall * 100)) + 0.5) AS BIGINT) END AS caption_overall,
      CASE WHEN p.score IS NOT NULL THEN CAST(floor(greatest(0, least(100, p.score * 100)) + 0.5) AS BIGINT) END AS proxy_score
    FROM (SELECT * FROM customer) LEFT JOIN c ON c.id = c_custkey LEFT JOIN p ON p.id = c_custkey""")
def metric_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs: balance as rating, mean order price as caption mark, greatest event value as score."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_acctbal").cast("double") / 60).alias("rating"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    captions = windows.ordered_mean(orders, ["run_id"], "price", "o_orderkey", "mean").select("run_id", (F.col("mean") / 250000).alias("overall"))
    scores = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg((F.max("value") / 40).alias("score"))
    return ledger.metric_snapshot(customers.select("run_id"), customers, captions, scores)
