"""Queries that hold rendered captions and overlays against what was expected and said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import caption_sync
from cadenza.plans import views
from cadenza.plans.registry import register
from cadenza.plans.views import with_views
from cadenza.sources.shared import written

_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9''\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_CAPTIONS = """e AS (SELECT video_id, idx // 5 AS e_id, string_agg(word, ' ' ORDER BY idx) AS e_text, min(start_ms) AS e0, max(end_ms) AS e1 FROM words GROUP BY ALL),
    o AS (SELECT video_id, idx // {size} AS o_id, string_agg(word, ' ' ORDER BY idx) AS o_text, min(start_ms) + {late} AS o0, max(end_ms) + {late} AS o1 FROM asr_words GROUP BY ALL)"""
#: Each expected caption with its best observed one, by loops over lists.
_MATCHES = f"""en AS (SELECT *, {_NORM.format('e_text')} AS a FROM e), os AS (SELECT *, {_NORM.format('o_text')} AS b FROM o),
    p AS (SELECT en.video_id, e_id, e0, e1, o_id, o0, o1, a, b, list_filter(string_split(a, ' '), lambda x: x <> '') AS aw, list_filter(string_split(b, ' '), lambda x: x <> '') AS bw,
          greatest(0, least(e1, o1) - greatest(e0, o0)) / greatest(1, e1 - e0) AS shared
          FROM en JOIN os ON en.video_id = os.video_id AND o1 >= greatest(0, e0 - 500) AND o0 <= e1 + 500),
    f AS (SELECT *, list_transform(list_filter(aw, lambda x: length(x) >= 2), lambda w: len(list_filter(bw, lambda v: length(v) >= 2 AND (w = v OR (length(w) >= 4 AND starts_with(v, w[1:4])) OR (length(v) >= 4 AND starts_with(w, v[1:4])) OR levenshtein(w, v) <= 2))) > 0) AS flags,
          list_sum(list_transform(list_distinct(aw), lambda w: least(len(list_filter(aw, lambda v: v = w)), len(list_filter(bw, lambda v: v = w))))) AS common FROM p),
    s AS (SELECT *, CASE WHEN len(flags) = 0 THEN 0 ELSE len(list_filter(flags, lambda x: x)) / len(flags) END AS seen,
          CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 0.92 WHEN common = 0 THEN 0 ELSE 2 * (common / len(aw)) * (common / len(bw)) / (common / len(aw) + common / len(bw)) END AS alike,
          greatest(shared, greatest(0, 1 - abs(o0 - e0) / 2000)) AS near FROM f),
    c AS (SELECT video_id, e_id, e0, e1, list({{'o_id': o_id, 'o0': o0, 'o1': o1, 'seen': seen, 'alike': alike, 'flags': flags, 'score': seen * 0.6 + alike * 0.25 + near * 0.15, 'hold': greatest(seen, alike) * 0.85 + near * 0.15}} ORDER BY o_id) AS c,
          min(o0) FILTER (seen >= 0.45 OR alike >= 0.55) AS s0, max(o1) FILTER (seen >= 0.45 OR alike >= 0.55) AS s1 FROM s GROUP BY ALL),
    v AS (SELECT *, len(list_filter(range(1, len(c[1].flags) + 1), lambda i: len(list_filter(c, lambda x: x.flags[i])) > 0)) / greatest(1, len(c[1].flags)) AS evidence FROM c),
    r AS (SELECT *, list_reduce(c, lambda b, x: CASE WHEN x.score > b.hold THEN x ELSE b END) AS b FROM v WHERE evidence >= 0.55),
    m AS (SELECT video_id, e_id, b.o_id AS o_id, e0, e1, coalesce(s0, b.o0) AS m0, coalesce(s1, b.o1) AS m1, greatest(b.seen, b.alike) AS similarity FROM r)"""
_REPORT = """q AS (SELECT video_id, least(1.0, sum(o1 - o0) / max(o1)) AS coverage, avg(least(1.0, 3000 / greatest(1, o1 - o0))) AS quality FROM o GROUP BY video_id),
    h AS (SELECT video_id, avg(confidence) AS confidence FROM asr_words GROUP BY video_id),
    t AS (SELECT e.video_id, count(*) AS n_expected, sum(greatest(0, e1 - e0)) AS ms, any_value(n_observed) AS n_observed FROM e LEFT JOIN (SELECT video_id, count(*) AS n_observed FROM o GROUP BY ALL) n USING (video_id) GROUP BY ALL),
    g AS (SELECT video_id, count(*) AS n_matched, sum(greatest(0, e1 - e0)) AS m_ms, quantile_cont(abs(m0 - e0), 0.5) AS p50, quantile_cont(abs(m0 - e0), 0.95) AS p95, max(abs(m0 - e0)) AS top, avg(abs(m0 - e0)) AS mean, avg(similarity) AS similarity FROM m GROUP BY video_id),
    z AS (SELECT video_id, n_expected, coalesce(n_observed, 0) AS n_observed, coalesce(n_matched, 0) AS n_matched, coalesce(n_matched, 0) / n_expected AS match_ratio, CASE WHEN ms > 0 THEN coalesce(m_ms, 0) / ms ELSE 0 END AS duration_ratio,
          coalesce(p50, 0) AS median_drift_ms, coalesce(p95, 0) AS p95_drift_ms, coalesce(top, 0) AS max_drift_ms, coalesce(mean, 0) AS mean_drift_ms, coalesce(similarity, 0) AS mean_similarity, coalesce(coverage, 0) AS coverage, coalesce(quality, 0) AS quality, coalesce(confidence, 0) AS confidence
          FROM t LEFT JOIN g USING (video_id) LEFT JOIN q USING (video_id) LEFT JOIN h USING (video_id)),
    y AS (SELECT *, n_observed = 0 AS i1, coverage < 0.35 AS i2, quality < 0.55 AS i3, confidence < 0.45 AS i4, match_ratio < 0.65 AS i5, duration_ratio < 0.55 AS i6, median_drift_ms > 350 AS i7, p95_drift_ms > 900 AS i8 FROM z),
    k AS (SELECT *, concat_ws(',', CASE WHEN i1 THEN 'missing-captions' END, CASE WHEN i2 THEN 'low-caption-coverage' END, CASE WHEN i3 THEN 'low-caption-quality' END, CASE WHEN i4 THEN 'low-ocr-confidence' END,
          CASE WHEN i5 THEN 'low-match-ratio' END, CASE WHEN i6 THEN 'low-duration-match' END, CASE WHEN i7 THEN 'high-median-drift' END, CASE WHEN i8 THEN 'high-p95-drift' END) AS issues, NOT (i1 OR i2 OR i5 OR i6 OR i7 OR i8) AS passed FROM y)"""
_ROUNDED = ("match_ratio", "duration_ratio", "median_drift_ms", "p95_drift_ms", "mean_drift_ms", "mean_similarity", "coverage", "quality", "confidence")
_COUNTS = ("n_expected", "n_observed", "n_matched", "max_drift_ms")


def _captions(words: DataFrame, size: int, key: str, late: int = 0) -> DataFrame:
    spoken = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda w: w["word"]), " ")
    return words.groupBy("video_id", F.expr(f"idx div {size}").alias(key)).agg(spoken.alias("text"), (F.min("start_ms") + late).alias("start_ms"), (F.max("end_ms") + late).alias("end_ms"))


def _quality(observed: DataFrame, sure: DataFrame) -> DataFrame:
    length = F.col("end_ms") - F.col("start_ms")
    q = observed.groupBy("video_id").agg(F.least(F.lit(1.0), F.sum(length) / F.max("end_ms")).alias("coverage"), F.round(F.avg(F.least(F.lit(1.0), 3000 / F.greatest(F.lit(1), length))), caption_sync.EXACT).alias("quality"))
    return q.join(sure, "video_id")


def _reports(spark: SparkSession, sf_dir: str, *kinds: tuple[int, int]) -> list[DataFrame]:
    """A report for each size and delay of the observed captions. What several parts of the reports read is written once: all captions and the confidence of each video."""
    heard = views.asr_words(spark, sf_dir)
    expected = written(_captions(views.words(spark, sf_dir), 5, "expected_id"), "expected")
    sure = written(heard.groupBy("video_id").agg(F.round(F.avg("confidence"), caption_sync.EXACT).alias("confidence")), "confidence")
    reports = []
    for size, late in kinds:
        observed = written(_captions(heard, size, "observed_id", late), "observed")
        reports.append(caption_sync.sync_report(expected, observed, caption_sync.match_captions(expected, observed), _quality(observed, sure)))
    return reports


def _shown(report: DataFrame, *more: str) -> DataFrame:
    return report.select("video_id", *[F.col(c).cast("long").alias(c) for c in _COUNTS], *[F.round(c, 6).alias(c) for c in _ROUNDED], F.array_join("issues", ",").alias("issues"), "passed", *more)


_SHOWN = ", ".join(["video_id", *[f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTS], *[f"round({c}, 6) AS {c}" for c in _ROUNDED], "issues", "passed"])


@register("caption_matches", with_views(f"WITH {_CAPTIONS.format(size=6, late=0)}, {_MATCHES} SELECT video_id, e_id AS expected_id, o_id AS observed_id, m0 - e0 AS start_drift_ms, m1 - e1 AS end_drift_ms, round(similarity, 6) AS similarity FROM m", "asr_words"))
def caption_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word captions with the six heard words that show them best."""
    expected, observed = _captions(views.words(spark, sf_dir), 5, "expected_id"), _captions(views.asr_words(spark, sf_dir), 6, "observed_id")
    return caption_sync.match_captions(expected, observed).select("video_id", "expected_id", "observed_id", "start_drift_ms", "end_drift_ms", F.round("similarity", 6).alias("similarity"))


@register("caption_sync_report", with_views(f"WITH {_CAPTIONS.format(size=6, late=0)}, {_MATCHES}, {_REPORT} SELECT {_SHOWN} FROM k", "asr_words"))
def caption_sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync report of every video."""
    return _shown(*_reports(spark, sf_dir, (6, 0)))


_BOTH = "WITH one AS ({0}), two AS ({1})".format(*(with_views(f"WITH {_CAPTIONS.format(size=s, late=n)}, {_MATCHES}, {_REPORT} SELECT * FROM k", "asr_words") for s, n in ((9, 400), (6, 0))))
_RANK = "(CASE WHEN {0}.passed THEN 1 ELSE 0 END, {0}.n_matched, {0}.match_ratio, {0}.quality, {0}.confidence, -{0}.median_drift_ms, -{0}.p95_drift_ms)"


@register("caption_sync_second_look", f"""{_BOTH}, j AS (SELECT one.video_id, NOT one.passed AND (one.quality < 0.55 OR one.confidence < 0.45 OR one.n_matched = 0 OR one.match_ratio < 0.65) AND two.video_id IS NOT NULL AND row{_RANK.format('two')} > row{_RANK.format('one')} AS other FROM one LEFT JOIN two USING (video_id))
    SELECT {_SHOWN}, region FROM (SELECT one.*, 1 AS region FROM one JOIN j USING (video_id) WHERE NOT other UNION ALL SELECT two.*, 2 AS region FROM two JOIN j USING (video_id) WHERE other)""")
def caption_sync_second_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from late nine-word captions, and from those of another region where the first fails."""
    return _shown(caption_sync.better_reports(*_reports(spark, sf_dir, (9, 400), (6, 0))), "region")


_TOKENS = "list_filter(list_transform(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9'']+'), lambda w: regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: length(w) >= 3)"


@register("supported_overlays", with_views(rf"""WITH o AS (SELECT video_id, idx // 4 AS overlay_id, string_agg(word, ' ' ORDER BY idx) AS text, min(start_ms) AS o0, max(end_ms) + 300 AS o1 FROM asr_words GROUP BY ALL),
    s AS (SELECT video_id, idx // 9 AS speech_id, string_agg(word, ' ' ORDER BY idx) AS said, min(start_ms) AS s0, max(end_ms) AS s1 FROM words WHERE video_id % 5 <> 0 GROUP BY ALL),
    j AS (SELECT o.*, speech_id, said, greatest(0, least(o1, s1) - greatest(o0, s0)) AS ms FROM o JOIN s ON s.video_id = o.video_id AND o0 < s1 AND o1 > s0),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, overlay_id ORDER BY ms DESC, speech_id) AS r FROM j WHERE ms > 0) WHERE r = 1),
    t AS (SELECT *, {_TOKENS.format('text')} AS x, {_TOKENS.format('said')} AS y, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS pt, regexp_replace(lower(said), '[^a-z0-9]', '', 'g') AS ps FROM b),
    h AS (SELECT *, len(list_filter(x, lambda w: list_contains(y, w))) AS hits FROM t),
    k AS (SELECT video_id, overlay_id, speech_id, len(x) > 0 AND len(y) > 0 AND ((hits >= 1 AND hits / len(x) >= 0.34) OR CASE WHEN greatest(length(pt), length(ps)) = 0 THEN 1 ELSE 1 - levenshtein(pt, ps) / greatest(length(pt), length(ps)) END >= 0.45) AS held FROM h)
    SELECT o.video_id, o.overlay_id, k.speech_id, CASE WHEN o.video_id NOT IN (SELECT video_id FROM s) THEN true ELSE coalesce(held, false) END AS supported FROM o LEFT JOIN k ON k.video_id = o.video_id AND k.overlay_id = o.overlay_id""", "asr_words"))
def supported_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four heard words as an overlay, nine script words as speech; every fifth video is silent."""
    overlays = _captions(views.asr_words(spark, sf_dir), 4, "overlay_id").withColumn("end_ms", F.col("end_ms") + 300)
    speech = _captions(views.words(spark, sf_dir).where("video_id % 5 <> 0"), 9, "speech_id")
    return caption_sync.supported_overlays(overlays, speech).select("video_id", "overlay_id", "speech_id", "supported")


@register("repeated_overlays", with_views(rf"""WITH o AS (SELECT video_id, idx // 4 AS overlay_id, string_agg(word, ' ' ORDER BY idx) AS text, min(start_ms) AS o0, max(end_ms) AS o1 FROM asr_words GROUP BY ALL),
    b AS (SELECT video_id, scene_id, string_agg(word, ' ' ORDER BY idx) AS said, min(start_ms) AS b0, max(end_ms) AS b1 FROM words GROUP BY ALL),
    t AS (SELECT o.video_id, overlay_id, {_TOKENS.format('text')} AS x, {_TOKENS.format('said')} AS y FROM o JOIN b ON b.video_id = o.video_id AND o0 < b1 AND b0 < o1)
    SELECT DISTINCT video_id, overlay_id FROM t WHERE len(x) > 0 AND len(list_filter(x, lambda w: list_contains(y, w))) / len(x) >= 0.5""", "asr_words"))
def repeated_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four heard words that repeat the scene shown at the same time."""
    spoken = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda w: w["word"]), " ")
    blocks = views.words(spark, sf_dir).groupBy("video_id", F.col("scene_id").alias("block_id")).agg(spoken.alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return caption_sync.repeated_overlays(_captions(views.asr_words(spark, sf_dir), 4, "overlay_id"), blocks).select("video_id", "overlay_id")
