"""Queries on timed words: pacing, audio and caption quality, joins on time, drift and highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import text as T
from cadenza.operators import joins, pacing, windows
from cadenza.plans import views
from cadenza.plans.registry import register
from cadenza.plans.views import with_views

_SCENE_SQL = """
scene_pace AS (
    SELECT *, CASE WHEN is_last OR regexp_matches(text, '(?i)follow|subscribe|comment|share|save|link in bio|dm|join|check out|like')
                   THEN CASE WHEN wpm > 350 THEN 'abnormal' ELSE 'normal' END
                   WHEN wpm < 80 OR wpm > 280 THEN 'abnormal' WHEN wpm < 120 THEN 'slow' WHEN wpm > 220 THEN 'fast' ELSE 'normal' END AS status
    FROM (SELECT *, CASE WHEN seconds >= 0.5 THEN CAST(floor(n_words / seconds * 60 + 0.5) AS BIGINT) ELSE 0 END AS wpm,
                 row_number() OVER (PARTITION BY video_id ORDER BY scene_id) = count(*) OVER (PARTITION BY video_id)
                 AND count(*) OVER (PARTITION BY video_id) > 1 AS is_last
          FROM (SELECT video_id, scene_id, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
                       (max(end_ms) - min(start_ms)) / 1000 AS seconds, string_agg(word, ' ' ORDER BY idx) AS text
                FROM words GROUP BY video_id, scene_id)))
"""


@register("words_view", with_views("SELECT * FROM words", "words"))
def words_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.words(spark, sf_dir)


@register("scene_pacing", with_views(f"WITH {_SCENE_SQL} SELECT video_id, scene_id, n_words, start_ms, end_ms, seconds, is_last, wpm, status FROM scene_pace", "words"))
def scene_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.scene_pacing(views.words(spark, sf_dir))


@register(
    "pacing_quality",
    with_views(f"""WITH {_SCENE_SQL}, s AS (
        SELECT video_id, count(*) AS n_scenes, avg(wpm) FILTER (seconds > 0.5) AS mean_wpm, stddev_pop(wpm) FILTER (seconds > 0.5) AS sd,
               count(*) FILTER (status <> 'abnormal') AS n_fine FROM scene_pace GROUP BY video_id),
      c AS (SELECT *, CASE WHEN mean_wpm > 0 THEN sd / mean_wpm ELSE 0 END AS cv FROM s)
      SELECT video_id, n_scenes, round(mean_wpm, 6) AS mean_wpm, round(cv, 6) AS cv,
             round(0.7 * n_fine / n_scenes + 0.3 * greatest(0, 1 - cv / 0.4), 6) AS score,
             round(0.7 * n_fine / n_scenes + 0.3 * greatest(0, 1 - cv / 0.4), 6) >= 0.75 AS passed FROM c""", "words"),
)
def pacing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.pacing_quality(views.words(spark, sf_dir))


@register(
    "audio_quality",
    with_views("""WITH p AS (SELECT *, lead(start_ms) OVER w - end_ms AS gap, lead(scene_id) OVER w AS next_scene, regexp_matches(word, '[.!?;:]$') AS pausing
                 FROM words WINDOW w AS (PARTITION BY video_id ORDER BY idx)),
      pace AS (SELECT video_id, coalesce(stddev_pop(rate) / nullif(avg(rate), 0), 0) AS cv FROM (
                 SELECT video_id, CASE WHEN s > 0.5 THEN n / s END AS rate FROM (
                   SELECT video_id, scene_id, count(*) AS n, (max(end_ms) - min(start_ms)) / 1000 AS s FROM words GROUP BY ALL)) GROUP BY video_id),
      c AS (SELECT video_id, count(*) FILTER (gap > 800) AS long_gaps, count(*) FILTER (gap > 1500) AS critical_gaps, count(*) FILTER (gap < -10) AS n_overlaps,
                 count(*) FILTER (pausing AND gap IS NOT NULL) AS ep, count(*) FILTER (pausing AND gap >= 200) AS p,
                 count(*) FILTER (next_scene <> scene_id) AS ch, count(*) FILTER (next_scene <> scene_id AND gap < 100) AS ab FROM p GROUP BY video_id),
      s AS (SELECT c.*, greatest(0, 100 - 10 * long_gaps) AS a, greatest(0, 100 - 20 * n_overlaps) AS b,
                 CASE WHEN cv > 0.4 THEN greatest(0, 100 - 200 * (cv - 0.4)) ELSE 100 END AS d,
                 CASE WHEN ep = 0 THEN 100 ELSE 100.0 * p / ep END AS e, CASE WHEN ch = 0 THEN 100 ELSE 100.0 * (ch - ab) / ch END AS f
            FROM c JOIN pace USING (video_id))
      SELECT video_id, long_gaps, critical_gaps, n_overlaps, CAST(a AS DOUBLE) AS silence_score, CAST(b AS DOUBLE) AS overlap_score, round(d, 6) AS pace_score,
             round(e, 6) AS pause_score, round(f, 6) AS transition_score, round(0.25 * a + 0.25 * b + 0.2 * d + 0.15 * e + 0.15 * f, 6) AS score FROM s""", "words"),
)
def audio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.audio_quality(views.words(spark, sf_dir))


@register(
    "caption_quality",
    with_views("""WITH r AS (SELECT *, end_ms - start_ms AS len, end_ms - lead(start_ms) OVER v AS ov, lead(word) OVER v AS nxt FROM asr_words WINDOW v AS (PARTITION BY video_id ORDER BY idx)),
      f AS (SELECT *, coalesce((word = 'Str' AND lower(nxt) IN ('uggling', 'ong', 'eet', 'ategic')) OR (word = 'hyd' AND lower(nxt) IN ('rate', 'rogen', 'ration')) OR (word = 'I' AND lower(nxt) IN ('''m', '''ve', '''ll', '''d'))
              OR (word IN ('you', 'we', 'they') AND lower(nxt) IN ('''re', '''ll', '''ve', '''d'))
              OR (length(word) <= 3 AND regexp_matches(word, '^[A-Z][a-z]*$') AND regexp_matches(nxt, '^[a-z]+$') AND length(nxt) > 3
                  AND lower(word) || nxt IN ('struggling', 'strong', 'street', 'strategic', 'hydrate', 'hydrogen', 'hydration')), false) AS split FROM r),
      s AS (SELECT video_id, count(*) AS n_words, 1 - count(*) FILTER (split) / count(*) AS word_integrity, 1 - count(*) FILTER (regexp_matches(nxt, '(?i)^''[a-z]+$')) / count(*) AS contraction_integrity,
              1 - count(*) FILTER (len < 50) / count(*) AS duration_health, CASE WHEN count(*) FILTER (ov > 10) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS timestamp_validity,
              1 - count(*) FILTER (confidence < 0.5) / count(*) AS confidence_health, sum(length(word)) AS chars, (arg_max(end_ms, idx) - arg_min(start_ms, idx)) / 1000 AS seconds FROM f GROUP BY video_id),
      t AS (SELECT *, CASE WHEN seconds > 0 AND chars / seconds > 15 THEN greatest(0::DOUBLE, 1 - (chars / seconds - 15) / 15) ELSE 1.0::DOUBLE END AS readability FROM s),
      u AS (SELECT *, round(0.2::DOUBLE * word_integrity + 0.15::DOUBLE * contraction_integrity + 0.15::DOUBLE * duration_health + 0.15::DOUBLE * timestamp_validity + 0.1::DOUBLE * confidence_health + 0.15::DOUBLE * readability + 0.1::DOUBLE, 6) AS score FROM t)
      SELECT video_id, n_words, round(word_integrity, 6) AS word_integrity, round(contraction_integrity, 6) AS contraction_integrity, round(duration_health, 6) AS duration_health, timestamp_validity,
        round(confidence_health, 6) AS confidence_health, round(readability, 6) AS readability, 1.0::DOUBLE AS paging, score,
        score >= 0.85 AND word_integrity >= 0.95 AND contraction_integrity >= 0.9 AND duration_health >= 0.9 AND timestamp_validity >= 1 AND confidence_health >= 0.8 AND readability >= 0.85 AS passed FROM u""", "asr_words"),
)
def caption_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.caption_quality(views.asr_words(spark, sf_dir))


@register(
    "word_gaps",
    with_views("""SELECT video_id, idx, start_ms - lag(end_ms) OVER w AS gap_before, lead(start_ms) OVER w - end_ms AS gap_after,
      coalesce(regexp_matches(lag(word) OVER w, '[.!?]["'')]*$'), true) AS opens FROM words WINDOW w AS (PARTITION BY video_id ORDER BY idx)""", "words"),
)
def word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.ordered(["video_id"], ["idx"])
    rows = pacing.sentence_starts(views.words(spark, sf_dir))
    return rows.select("video_id", "idx", windows.gap_to_previous("start_ms", "end_ms", w).alias("gap_before"), windows.gap_to_next("start_ms", "end_ms", w).alias("gap_after"), "opens")


_DRIFT_SQL = """d AS (SELECT video_id, a.idx, row_number() OVER (PARTITION BY video_id ORDER BY a.idx) - 1 AS i, a.start_ms - w.start_ms AS drift_ms
      FROM asr_words a JOIN words w USING (video_id, idx))"""


@register(
    "sync_rating",
    with_views(f"""WITH {_DRIFT_SQL}, f AS (SELECT *, count(*) OVER v AS na, count(*) FILTER (abs(drift_ms) > 400) OVER v AS nf FROM d WINDOW v AS (PARTITION BY video_id)),
      m AS (SELECT video_id, count(*) AS n, max(na) AS n_matches, round(avg(abs(drift_ms)), 6) AS mean_ms, round(median(abs(drift_ms)), 6) AS median_ms,
              round(quantile_cont(abs(drift_ms), 0.95), 6) AS p95_ms, CAST(max(abs(drift_ms)) AS DOUBLE) AS max_ms, round(stddev_pop(drift_ms), 6) AS sd_ms,
              count(*) FILTER (drift_ms > 0) AS late, count(*) FILTER (drift_ms < 0) AS early
            FROM f WHERE NOT (na >= 10 AND nf / na < 0.3 AND abs(drift_ms) > 400) GROUP BY video_id),
      r AS (SELECT *, greatest(0, CAST(floor(100 - (CASE WHEN median_ms > 50 THEN least(30, (median_ms - 50) / 8.33::DOUBLE) ELSE 0 END
              + CASE WHEN abs(mean_ms - median_ms) > 50 THEN least(10, (abs(mean_ms - median_ms) - 50) / 25) ELSE 0 END
              + CASE WHEN max_ms > 200 THEN least(20, (max_ms - 200) / 20) ELSE 0 END + CASE WHEN p95_ms > 80 THEN least(15, (p95_ms - 80) / 21.3::DOUBLE) ELSE 0 END
              + CASE WHEN sd_ms > 50 THEN least(10, (sd_ms - 50) / 25) ELSE 0 END) + 0.5) AS BIGINT)) AS rating FROM m)
      SELECT *, CASE WHEN rating >= 90 THEN 'excellent' WHEN rating >= 75 THEN 'good' WHEN rating >= 60 THEN 'fair' WHEN rating >= 40 THEN 'poor' ELSE 'broken' END AS label FROM r""", "asr_words"),
)
def sync_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.sync_rating(pacing.sync_metrics(pacing.drift(views.words(spark, sf_dir), views.asr_words(spark, sf_dir))))


@register(
    "drift_classes",
    with_views(f"""WITH {_DRIFT_SQL}, a AS (SELECT *, drift_ms - lag(drift_ms) OVER v AS d1 FROM d WINDOW v AS (PARTITION BY video_id ORDER BY i)),
      b AS (SELECT *, d1 - lag(d1) OVER v AS d2 FROM a WINDOW v AS (PARTITION BY video_id ORDER BY i)),
      s AS (SELECT video_id, count(*) AS n, avg(drift_ms) AS md, max(abs(drift_ms)) AS max_drift,
              CASE WHEN max(drift_ms) = min(drift_ms) THEN 0 ELSE regr_slope(drift_ms, i) END AS sl,
              CASE WHEN max(drift_ms) = min(drift_ms) THEN 0 ELSE regr_r2(drift_ms, i) END AS r, count(*) FILTER (abs(d1) >= 200) AS jumps,
              avg(abs(d2)) AS q, avg(abs(d1)) AS p FROM b GROUP BY video_id),
      t AS (SELECT *, CASE WHEN n < 4 THEN 0 WHEN p > 0 THEN q / p ELSE 0 END AS ra FROM s)
      SELECT video_id, n, round(md, 6) AS mean_drift, max_drift, round(sl, 6) AS slope, round(r, 6) AS r2, jumps, round(ra, 6) AS rate,
             CASE WHEN jumps > 0 THEN 'stepped' WHEN ra > 0.1 AND r < 0.95 THEN 'progressive' WHEN r > 0.85 AND abs(sl) > 5 THEN 'linear'
                  WHEN max_drift <= 30 THEN 'none' WHEN ra > 0.05 THEN 'progressive' ELSE 'random' END AS drift_class FROM t""", "asr_words"),
)
def drift_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.drift_classes(pacing.drift(views.words(spark, sf_dir), views.asr_words(spark, sf_dir)))


@register(
    "nearest_heard",
    with_views("""SELECT w.video_id, w.idx, w.start_ms, coalesce(min(CASE WHEN dist = best THEN t END) FILTER (dist = best AND t >= w.start_ms),
                    max(t) FILTER (dist = best)) AS nearest_ms
      FROM (SELECT w.video_id, w.idx, w.start_ms, a.start_ms AS t, abs(a.start_ms - w.start_ms) AS dist,
                   min(abs(a.start_ms - w.start_ms)) OVER (PARTITION BY w.video_id, w.idx) AS best
            FROM words w LEFT JOIN asr_words a ON a.video_id = w.video_id AND a.confidence >= 0.3) w GROUP BY w.video_id, w.idx, w.start_ms""", "asr_words"),
)
def nearest_heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest confident heard start for every word; of two equally near the later."""
    heard = views.asr_words(spark, sf_dir).where("confidence >= 0.3")
    rows = joins.nearest(views.words(spark, sf_dir).select("video_id", "idx", "start_ms"), heard, ["video_id"], "start_ms", "nearest_ms")
    return rows.select("video_id", "idx", "start_ms", "nearest_ms")


@register(
    "active_word",
    with_views("""SELECT a.video_id, a.idx AS heard_idx, max_by(w.word, w.start_ms * 1000000 + w.idx) AS active FROM asr_words a
      LEFT JOIN words w ON w.video_id = a.video_id AND w.start_ms <= a.start_ms GROUP BY a.video_id, a.idx""", "asr_words"),
)
def active_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script word showing when each heard word starts: the last to start at or before it."""
    script = views.words(spark, sf_dir).groupBy("video_id", "start_ms").agg(F.max_by("word", "idx").alias("word"))
    rows = joins.asof(views.asr_words(spark, sf_dir).drop("word"), script, ["video_id"], "start_ms", "word", "active")
    return rows.select("video_id", F.col("idx").alias("heard_idx"), "active")


@register(
    "fuzzy_match",
    with_views("""WITH c AS (SELECT w.video_id, w.idx, a.idx AS heard_idx, abs(a.start_ms - w.start_ms) AS diff_ms, pw = pa AS exact,
        CASE WHEN greatest(length(pw), length(pa)) = 0 THEN 1 ELSE 1 - levenshtein(pw, pa) / greatest(length(pw), length(pa)) END AS sim
        FROM (SELECT *, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS pw FROM words) w
        JOIN (SELECT *, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS pa FROM asr_words WHERE confidence >= 0.3) a USING (video_id)
        WHERE abs(a.start_ms - w.start_ms) <= 2000 AND pw <> '' AND pa <> ''),
      g AS (SELECT * FROM c WHERE exact OR (sim >= 0.55 AND diff_ms <= 1000))
      SELECT video_id, idx, heard_idx, diff_ms, exact FROM (
        SELECT *, row_number() OVER (PARTITION BY video_id, idx ORDER BY diff_ms, exact DESC, heard_idx) AS r FROM g) WHERE r = 1""", "asr_words"),
)
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best heard word for each script word: exact within 2 s or similar (0.55) within 1 s, nearest first."""
    w = views.words(spark, sf_dir).select("video_id", "idx", "start_ms", T.plain(F.col("word")).alias("pw")).where("pw <> ''")
    a = views.asr_words(spark, sf_dir).where("confidence >= 0.3").select("video_id", F.col("idx").alias("heard_idx"), F.col("start_ms").alias("heard_ms"), T.plain(F.col("word")).alias("pa"))
    # Two-second buckets give the join an equi key besides the video; a heard word is tried in its own and both next buckets.
    w = w.withColumn("bucket", F.expr("start_ms div 2000"))
    a = a.where("pa <> ''").withColumn("bucket", F.explode(F.array(*[F.expr("heard_ms div 2000") + k for k in (-1, 0, 1)])))
    pairs = w.join(a, ["video_id", "bucket"]).withColumn("diff_ms", F.abs(F.col("heard_ms") - F.col("start_ms"))).where("diff_ms <= 2000")
    exact = F.col("pw") == F.col("pa")
    pairs = pairs.withColumn("exact", exact).where(exact | ((F.col("diff_ms") <= 1000) & (T.similarity(F.col("pw"), F.col("pa")) >= 0.55)))
    return joins.best(pairs, ["video_id", "idx"], [F.col("diff_ms"), F.col("exact").desc(), F.col("heard_idx")]).select("video_id", "idx", "heard_idx", "diff_ms", "exact")


@register(
    "punctuation_restore",
    with_views("""WITH b AS (SELECT *, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS base FROM words),
      s AS (SELECT *, row_number() OVER (PARTITION BY video_id, base ORDER BY idx) AS k FROM b WHERE base <> ''),
      h AS (SELECT *, row_number() OVER (PARTITION BY video_id, base ORDER BY idx) AS k FROM (
              SELECT video_id, idx, word, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS base FROM asr_words))
      SELECT h.video_id, h.idx, coalesce(s.word, h.word) AS word FROM h LEFT JOIN s ON s.video_id = h.video_id AND s.base = h.base AND s.k = h.k""", "asr_words"),
)
def punctuation_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th hearing of a word takes the form of its k-th occurrence in the script."""
    k = F.row_number().over(Window.partitionBy("video_id", "base").orderBy("idx"))
    s = views.words(spark, sf_dir).withColumn("base", T.plain(F.col("word"))).where("base <> ''").withColumn("k", k).select("video_id", "base", "k", F.col("word").alias("form"))
    h = views.asr_words(spark, sf_dir).withColumn("base", T.plain(F.col("word"))).withColumn("k", k)
    return h.join(s, ["video_id", "base", "k"], "left").select("video_id", "idx", F.coalesce("form", "word").alias("word"))


@register(
    "overlap_best",
    with_views("""WITH s AS (SELECT video_id, scene_id, min(start_ms) AS s0, max(end_ms) AS s1 FROM words GROUP BY ALL),
      h AS (SELECT video_id, idx // 12 AS seg, min(start_ms) AS h0, max(end_ms) AS h1 FROM asr_words GROUP BY ALL),
      o AS (SELECT h.video_id, seg, scene_id, least(s1, h1) - greatest(s0, h0) AS shared_ms FROM h JOIN s ON s.video_id = h.video_id AND s0 < h1 AND s1 > h0)
      SELECT video_id, seg, scene_id, shared_ms FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seg ORDER BY shared_ms DESC, scene_id) AS r FROM o) WHERE r = 1""", "asr_words"),
)
def overlap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene that each heard segment n_overlaps longest; of equals the earliest."""
    s = views.words(spark, sf_dir).groupBy("video_id", "scene_id").agg(F.min("start_ms").alias("s0"), F.max("end_ms").alias("s1"))
    h = views.asr_words(spark, sf_dir).groupBy("video_id", F.expr("idx div 12").alias("seg")).agg(F.min("start_ms").alias("h0"), F.max("end_ms").alias("h1"))
    met = joins.overlapping(h, s, ["video_id"], ("h0", "h1"), ("s0", "s1"), 10_000)
    met = met.withColumn("shared_ms", joins.overlap_length((F.col("s0"), F.col("s1")), (F.col("h0"), F.col("h1"))))
    return joins.best(met, ["video_id", "seg"], [F.col("shared_ms").desc(), F.col("scene_id")]).select("video_id", "seg", "scene_id", "shared_ms")


@register(
    "silence_in_span",
    with_views("""WITH g AS (SELECT video_id, end_ms AS g0, n AS g1 FROM (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY idx) AS n FROM words) WHERE n - end_ms >= 300),
      s AS (SELECT video_id, scene_id, min(start_ms) AS s0, max(end_ms) + 500 AS s1 FROM words GROUP BY ALL)
      SELECT s.video_id, scene_id, CAST(coalesce(sum(CASE WHEN g0 IS NOT NULL THEN greatest(0, least(s1, g1) - greatest(s0, g0)) END), 0) AS BIGINT) AS silence_ms, count(g0) AS n_gaps
      FROM s LEFT JOIN g ON g.video_id = s.video_id AND s0 < g1 AND s1 > g0 GROUP BY ALL""", "words"),
)
def silence_in_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence of at least 0.3 s within each scene and the half second after it."""
    w = views.words(spark, sf_dir)
    nxt = F.lead("start_ms").over(windows.ordered(["video_id"], ["idx"]))
    g = w.withColumn("g1", nxt).where(F.col("g1") - F.col("end_ms") >= 300).select("video_id", F.col("end_ms").alias("g0"), "g1")
    s = w.groupBy("video_id", "scene_id").agg(F.min("start_ms").alias("s0"), (F.max("end_ms") + 500).alias("s1"))
    met = joins.overlapping(s, g, ["video_id"], ("s0", "s1"), ("g0", "g1"), 10_000)
    shared = joins.overlap_length((F.col("s0"), F.col("s1")), (F.col("g0"), F.col("g1")))
    sums = met.groupBy("video_id", "scene_id").agg(F.sum(shared).alias("ms"), F.count("*").alias("n"))
    return s.join(sums, ["video_id", "scene_id"], "left").select("video_id", "scene_id", F.coalesce("ms", F.lit(0)).alias("silence_ms"), F.coalesce("n", F.lit(0)).alias("n_gaps"))


@register(
    "low_confidence_runs",
    with_views("""WITH f AS (SELECT *, confidence < 0.4 AS low FROM asr_words),
      n AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY idx) AS g FROM (
            SELECT *, CASE WHEN lag(low) OVER (PARTITION BY video_id ORDER BY idx) IS DISTINCT FROM low THEN 1 ELSE 0 END AS c FROM f))
      SELECT video_id, count(*) AS n, min(idx) AS start, max(idx) AS "end" FROM n WHERE low GROUP BY video_id, g HAVING count(*) >= 3""", "asr_words"),
)
def low_confidence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more poorly heard words."""
    return windows.runs(views.asr_words(spark, sf_dir), F.col("confidence") < 0.4, ["video_id"], "idx", least=3).drop("island")


@register(
    "hysteresis_segments",
    with_views("""WITH m AS (SELECT *, CASE WHEN confidence >= 0.7 THEN 1 WHEN confidence < 0.4 THEN 0 END AS k FROM asr_words),
      h AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) = 1 AS open FROM m)
      SELECT video_id, count(*) FILTER (open) AS n_open, count(*) AS n FROM h GROUP BY video_id""", "asr_words"),
)
def hysteresis_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside segments that open at confidence 0.7 and hold down to 0.4."""
    rows = windows.hysteresis(views.asr_words(spark, sf_dir), F.col("confidence"), ["video_id"], ["idx"], 0.7, 0.4)
    return rows.groupBy("video_id").agg(F.count_if("open").alias("n_open"), F.count("*").alias("n"))


@register(
    "speech_blocks",
    with_views("""WITH r AS (SELECT *, max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words),
      g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS b FROM r)
      SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM g GROUP BY video_id, b""", "words"),
)
def speech_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words merged into blocks across gaps of at most half a second."""
    return windows.merge_gaps(views.words(spark, sf_dir), ["video_id"], "start_ms", "end_ms", 500)


@register(
    "timestamp_errors",
    with_views("""WITH e AS (SELECT video_id, idx, CASE WHEN end_ms < start_ms THEN 'inverted' WHEN end_ms = start_ms THEN 'empty'
        WHEN start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY idx) > 500 THEN 'gap' END AS error FROM words)
      SELECT video_id, min(idx) AS idx, min_by(error, idx) AS error, count(*) AS n_errors FROM e WHERE error IS NOT NULL GROUP BY video_id""", "words"),
)
def timestamp_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First timing error of each video and how many there are."""
    w = windows.ordered(["video_id"], ["idx"])
    error = F.when(F.col("end_ms") < F.col("start_ms"), "inverted").when(F.col("end_ms") == F.col("start_ms"), "empty").when(windows.gap_to_previous("start_ms", "end_ms", w) > 500, "gap")
    rows = views.words(spark, sf_dir).withColumn("error", error).where("error is not null")
    return rows.groupBy("video_id").agg(F.min("idx").alias("idx"), F.min_by("error", "idx").alias("error"), F.count("*").alias("n_errors"))
