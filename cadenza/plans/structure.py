"""Queries on the structure of videos: caption reports, arcs, classes and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import spec
from cadenza.plans import views
from cadenza.plans.analytics import _SHOT_SQL, _shots
from cadenza.plans.registry import register
from cadenza.plans.views import with_views
from cadenza.sources.tables import table


@register("caption_report", with_views("""WITH g AS (SELECT video_id, idx // 5 AS seg, string_agg(word, ' ' ORDER BY idx) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, avg(confidence) AS confidence FROM asr_words GROUP BY ALL),
    r AS (SELECT *, (end_ms - start_ms) / 1000 AS s, CASE WHEN end_ms > start_ms THEN len(string_split(text, ' ')) / ((end_ms - start_ms) / 1000) END AS wps, lead(text) OVER (PARTITION BY video_id ORDER BY seg) AS nxt,
      coalesce(lag(seg) OVER (PARTITION BY video_id, text ORDER BY seg) < seg - 1, false) AS seen FROM g),
    a AS (SELECT video_id, count(*) AS n, greatest(0, least(1, greatest(0, least(1, 1 - coalesce(stddev_pop(wps), 0) / 2)) * (1 - 0.5 * count(*) FILTER (wps < 2 OR wps > 4) / greatest(count(wps), 1)) * (1 - count(*) FILTER (wps < 1 OR wps > 7) / greatest(count(wps), 1)))) AS rhythm,
      greatest(0, least(1, 1 - count(*) FILTER (s > 0 AND s < 0.5) / count(*) - count(*) FILTER (s > 0 AND (s < 1 OR s > 7)) / count(*) / 2)) AS display,
      1 - count(*) FILTER (length(text) > 45) / count(*) AS density, 1 - count(*) FILTER (regexp_matches(text, '[.!?]$') AND nxt IS NOT NULL AND NOT regexp_matches(nxt, '^[^a-z]')) / count(*) AS punctuation,
      1 - count(*) FILTER (seen) / count(*) AS redundancy, greatest(0, least(1, avg(confidence))) AS confidence FROM r GROUP BY video_id)
    SELECT video_id, n, round(rhythm, 6) AS rhythm, round(display, 6) AS display, round(density, 6) AS density, round(punctuation, 6) AS punctuation, round(redundancy, 6) AS redundancy, round(confidence, 6) AS confidence,
      round((0.12 * rhythm + 0.08 * display + 0.06 * density + 0.04 * punctuation + 0.05 * redundancy + 0.09 * confidence) / 0.44, 6) AS score FROM a""", "asr_words"))
def caption_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = views.asr_words(spark, sf_dir)
    groups = heard.groupBy("video_id", F.expr("idx div 5").alias("seg")).agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"])).alias("text"),
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.avg("confidence").alias("confidence"))
    return spec.caption_report(groups)


@register("narrative_arc", with_views(f"""WITH {_SHOT_SQL}, v AS (SELECT video_id, max(end_ms) AS d, CASE WHEN count(*) >= 2 THEN min(end_ms) END AS c FROM shots GROUP BY video_id),
    h AS (SELECT video_id, d, CASE WHEN d >= 500 THEN greatest(500, least(coalesce(c, CAST(floor(d * 0.2) AS BIGINT)), 3000, d)) ELSE least(coalesce(c, CAST(floor(d * 0.2) AS BIGINT)), 3000, d) END AS k FROM v)
    SELECT video_id, d AS duration_ms, k AS hook_end_ms, least(greatest(k, CAST(floor(d * 0.75) AS BIGINT)), d) AS payoff_start_ms FROM h""", "cuts"))
def narrative_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _shots(spark, sf_dir).groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"), F.when(F.count("*") >= 2, F.min("end_ms")).alias("first_cut_ms"))
    return spec.narrative_arc(v).select("video_id", "duration_ms", "hook_end_ms", "payoff_start_ms")


@register("archetypes", """SELECT doc_id, CASE WHEN regexp_matches(t, '\\b(number (one|two|1|2)|first.*second)\\b') THEN 'listicle' WHEN regexp_matches(t, '\\b(vs|versus|better than)\\b') THEN 'versus'
    WHEN regexp_matches(t, '\\b(how to|step (one|1)|here''s how)\\b') THEN 'howto' WHEN regexp_matches(t, '\\b(myth|debunk|actually)\\b') THEN 'myth' ELSE 'story' END AS archetype
    FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")
def archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", spec.archetype(F.coalesce("text", F.lit(""))).alias("archetype"))


@register("editing_style", with_views(f"""WITH {_SHOT_SQL}, v AS (SELECT video_id, count(*) AS n, avg(seconds) AS m, count(*) FILTER (seconds < 0.2) AS fx FROM shots GROUP BY video_id)
    SELECT video_id, CASE WHEN m < 2 THEN 'high' WHEN m >= 4 THEN 'low' ELSE 'medium' END AS energy,
      CASE WHEN n <= 3 AND fx <= 2 THEN 'minimal' WHEN n >= 15 OR fx >= 10 THEN 'hyper' WHEN n >= 8 OR fx >= 5 THEN 'dense' ELSE 'moderate' END AS density FROM v""", "cuts"))
def editing_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _specs(spark, sf_dir)
    return v.select("video_id", spec.editing_style(F.size("durations"), F.size(F.filter("durations", lambda x: x < 0.2)), F.col("pace")).alias("x")).select("video_id", "x.*")


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shot durations and pace of each video."""
    mean = F.avg("seconds")
    pace = F.when(mean < 1, "very_fast").when(mean < 2, "fast").when(mean < 4, "moderate").otherwise("slow")
    return _shots(spark, sf_dir).groupBy("video_id").agg(F.collect_list("seconds").alias("durations"), pace.alias("pace"))


@register("spec_compare", with_views(f"""WITH {_SHOT_SQL}, v AS (SELECT video_id, list_sort(list(seconds)) AS l, avg(seconds) AS m, count(*) AS n FROM shots GROUP BY video_id),
    r AS (SELECT *, CASE WHEN m < 1 THEN 0 WHEN m < 2 THEN 1 WHEN m < 4 THEN 2 ELSE 3 END AS k FROM v),
    p AS (SELECT a.video_id, list_transform(range(greatest(a.n, b.n)), lambda i: coalesce(a.l[i + 1], 0)) AS x, list_transform(range(greatest(a.n, b.n)), lambda i: coalesce(b.l[i + 1], 0)) AS y, a.n AS na, b.n AS nb, a.k AS ka, b.k AS kb FROM r a JOIN r b ON b.video_id = a.video_id + 1),
    z AS (SELECT video_id, round(CASE WHEN list_inner_product(x, x) * list_inner_product(y, y) = 0 THEN 1 ELSE list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)) END, 6) AS durations,
      round(greatest(0, 1 - abs(ka - kb) / 3), 6) AS pace, round(1 / (1 + abs(na - nb) / 0.2 / greatest(na, nb, 1)), 6) AS shots FROM p)
    SELECT *, round((durations + pace + 0.6 * shots) / 2.6, 6) AS score FROM z""", "cuts"))
def spec_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video against the one numbered next."""
    v = _specs(spark, sf_dir)
    return spec.compare_specs(v, v.withColumn("video_id", F.col("video_id") - 1), "video_id")
