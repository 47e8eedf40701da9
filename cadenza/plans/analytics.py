"""Queries on telemetry, check reports, embeddings, shots and scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import scores as S
from cadenza.functions import text as T
from cadenza.operators import joins, reports, retrieval, scans, telemetry, windows
from cadenza.plans import views
from cadenza.plans.registry import register
from cadenza.plans.views import with_views
from cadenza.sources.tables import table


@register("provider_summary", with_views("""SELECT provider, count(*) AS attempts, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures,
    round(avg(latency), 6) AS avg_latency FROM attempts GROUP BY provider""", "attempts"))
def provider_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.provider_summary(views.attempts(spark, sf_dir))


@register("provider_windows", with_views("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, provider, count(*) AS attempts, count(*) FILTER (success) AS successes
    FROM attempts GROUP BY ALL""", "attempts"))
def provider_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling six-hour telemetry; the streaming twin gives the same rows."""
    rows = views.attempts(spark, sf_dir).groupBy(F.window("ts", "6 hours"), "provider").agg(F.count("*").alias("attempts"), F.count_if("success").alias("successes"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "provider", "attempts", "successes")


@register("routing_metrics", with_views("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS r FROM attempts),
    s AS (SELECT run_id, count(*) AS n, avg(CASE WHEN success THEN 1.0 ELSE 0 END) AS sr, avg(CASE WHEN provider = 'view' THEN 1.0 ELSE 0 END) AS fr, avg(latency) AS c FROM r WHERE r <= 20 GROUP BY run_id)
    SELECT run_id, n, round(sr, 6) AS success_rate, round(fr, 6) AS fallback_rate, round(c, 6) AS cost,
      CASE WHEN sr < 0.6 OR fr > 0.35 THEN 'quality-first' WHEN c > 20 THEN 'cost-first' ELSE 'balanced' END AS policy, least(1.0, n / 40) AS confidence FROM s""", "attempts"))
def routing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.routing_metrics(views.attempts(spark, sf_dir))


@register("stage_costs", with_views("""WITH l AS (SELECT run_id, provider, arg_max(latency, ts) AS latency, arg_max(k, ts) AS k FROM attempts GROUP BY ALL)
    SELECT run_id, count(*) AS stages, round(sum(latency), 6) AS total_cost, CAST(sum(k) AS BIGINT) AS tokens FROM l GROUP BY run_id""", "attempts"))
def stage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost totals of each run in which the last write of a stage counts."""
    last = telemetry.latest_per_stage(views.attempts(spark, sf_dir).select("run_id", "provider", "ts", "event_id", "latency", "k"), ["run_id"], "provider", ["ts", "event_id"])
    return last.groupBy("run_id").agg(F.count("*").alias("stages"), F.round(F.sum("latency"), 6).alias("total_cost"), F.sum("k").alias("tokens"))


@register("provider_rollup", with_views("""SELECT provider, success, count(*) AS n, grouping(provider) + grouping(success) AS level FROM attempts GROUP BY ROLLUP (provider, success)""", "attempts"))
def provider_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.attempts(spark, sf_dir).rollup("provider", "success").agg(F.count("*").alias("n"), (F.grouping("provider") + F.grouping("success")).cast("int").alias("level"))
    return rows


@register("provider_order", with_views("""WITH p AS (SELECT provider, 100 * avg(CASE WHEN success THEN 1.0 ELSE 0 END) AS quality, round(avg(latency), 6) AS cost FROM attempts GROUP BY provider),
    i AS (SELECT *, row_number() OVER (ORDER BY provider) AS idx FROM p)
    SELECT provider, row_number() OVER (ORDER BY cost, quality DESC, idx) AS place, cost <= 17 AS allowed FROM i""", "attempts"))
def provider_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers (a fixed small set) in cost-first order with the budget filter."""
    p = views.attempts(spark, sf_dir).groupBy("provider").agg((100 * F.avg(F.when(F.col("success"), 1.0).otherwise(0.0))).alias("quality"), F.round(F.avg("latency"), 6).alias("cost"))
    p = p.withColumn("idx", F.row_number().over(Window.orderBy("provider"))).withColumn("latency", F.col("cost"))
    ranked = p.withColumn("place", F.row_number().over(Window.orderBy(*telemetry.policy_order("cost-first"))))
    return telemetry.within_budget(ranked, 17).select("provider", "place", "allowed")


@register("session_gaps", with_views("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o FROM attempts),
    s AS (SELECT *, sum(o) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT run_id, session, count(*) AS n, round(sum(latency), 6) AS latency FROM s GROUP BY ALL""", "attempts"))
def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a run: a new one after more than six hours of silence."""
    w = windows.ordered(["run_id"], ["ts", "event_id"])
    silent = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > 6 * 3600 * 1_000_000
    rows = views.attempts(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("o", F.when(F.coalesce(silent, F.lit(True)), 1).otherwise(0)).withColumn("session", F.sum("o").over(w))
    return rows.groupBy("run_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("latency"), 6).alias("latency"))


@register("overall_score", with_views("""WITH w AS (SELECT *, CASE check_id WHEN 'quality' THEN 0.15::DOUBLE WHEN 'safety' THEN 0.2::DOUBLE WHEN 'pacing' THEN 0.12::DOUBLE ELSE 0.05::DOUBLE END AS w FROM checks),
    s AS (SELECT report_id, sum(CASE WHEN NOT skipped AND passed THEN w ELSE 0 END) AS g, sum(CASE WHEN NOT skipped THEN w ELSE 0 END) AS t,
      bool_or(NOT skipped AND check_id = 'safety' AND NOT passed) AS u, round(count(*) FILTER (NOT skipped) / count(*), 6) AS confidence FROM w GROUP BY report_id),
    o AS (SELECT report_id, CASE WHEN u OR t = 0 THEN 0.0::DOUBLE ELSE round(g / t, 6) END AS score, confidence FROM s)
    SELECT report_id, score, CASE WHEN score >= 0.7 THEN 'good' WHEN score >= 0.4 THEN 'borderline' ELSE 'bad' END AS label, confidence FROM o""", "checks"))
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overall(views.checks(spark, sf_dir))


@register("report_compare", with_views("""SELECT a.report_id, a.check_id, a.passed AS was, (b.passed <> (a.report_id % 5 = 0)) AS now,
    CASE WHEN a.passed AND NOT (b.passed <> (a.report_id % 5 = 0)) THEN 'regression' WHEN NOT a.passed AND (b.passed <> (a.report_id % 5 = 0)) THEN 'improvement' ELSE 'unchanged' END AS change
    FROM checks a JOIN checks b USING (report_id, check_id) WHERE NOT a.skipped AND NOT b.skipped""", "checks"))
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report against a later one in which every fifth report's outcomes turned."""
    before = views.checks(spark, sf_dir)
    after = before.withColumn("passed", F.col("passed") != (F.col("report_id") % 5 == 0))
    return reports.compare(before, after)


@register("batch_totals", with_views("SELECT check_id, count(*) FILTER (passed AND NOT skipped) AS passed, count(*) FILTER (NOT passed AND NOT skipped) AS failed, count(*) FILTER (skipped) AS skipped FROM checks GROUP BY check_id", "checks"))
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = ~F.col("skipped")
    return views.checks(spark, sf_dir).groupBy("check_id").agg(F.count_if(F.col("passed") & live).alias("passed"), F.count_if(~F.col("passed") & live).alias("failed"), F.count_if("skipped").alias("skipped"))


_CHECK_NAMES = ["quality", "safety", "pacing"]
_VECTOR_SQL = """v AS (SELECT report_id, """ + ", ".join(
    f"coalesce(max(CASE WHEN skipped THEN 0.5 WHEN passed THEN 1 ELSE 0 END) FILTER (check_id = '{n}'), 0.5)::DOUBLE AS {n}" for n in _CHECK_NAMES
) + " FROM checks GROUP BY report_id)"


@register("check_vectors", with_views(f"WITH {_VECTOR_SQL} SELECT *, round(1 / (1 + exp(-(-1 + 2 * quality + 1.5 * safety + 0.5 * pacing))), 6) AS score FROM v", "checks"))
def check_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = reports.feature_vector(views.checks(spark, sf_dir), _CHECK_NAMES)
    return reports.calibrated(vectors, {"quality": 2.0, "safety": 1.5, "pacing": 0.5}, -1.0)


@register("annotation_order", with_views("""WITH w AS (SELECT *, CASE check_id WHEN 'quality' THEN 0.15::DOUBLE WHEN 'safety' THEN 0.2::DOUBLE ELSE 0.12::DOUBLE END AS w FROM checks),
    s AS (SELECT report_id, CASE WHEN bool_or(NOT skipped AND check_id = 'safety' AND NOT passed) OR sum(CASE WHEN NOT skipped THEN w ELSE 0 END) = 0 THEN 0
        ELSE round(sum(CASE WHEN NOT skipped AND passed THEN w ELSE 0 END) / sum(CASE WHEN NOT skipped THEN w ELSE 0 END), 6) END AS score,
      coalesce(avg(CASE WHEN passed THEN 1.0 ELSE 0 END) FILTER (NOT skipped), 0.5) AS p FROM w GROUP BY report_id)
    SELECT report_id, round(0.5 * (1 - 2 * abs(score - 0.5)) + 0.5 * (1 - 2 * abs(p - 0.5)), 6) AS uncertainty FROM s ORDER BY uncertainty DESC, report_id LIMIT 50""", "checks"))
def annotation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty reports most worth annotating."""
    return reports.uncertainty(views.checks(spark, sf_dir)).orderBy(F.col("uncertainty").desc(), "report_id").limit(50)


@register("preference_rows", with_views(f"""WITH {_VECTOR_SQL}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN a.quality > b.quality THEN 'A' WHEN a.quality < b.quality THEN 'B' ELSE 'tie' END AS winner
      FROM labels a JOIN labels b ON b.doc_id // 40 = a.doc_id // 40 AND a.doc_id < b.doc_id)
    SELECT a, b, x.quality - y.quality AS quality, x.safety - y.safety AS safety, x.pacing - y.pacing AS pacing, CASE WHEN winner = 'A' THEN 1 ELSE 0 END AS y
    FROM p JOIN v x ON x.report_id = a JOIN v y ON y.report_id = b WHERE winner <> 'tie'""", "checks"))
def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs within bands of forty ids, as calibrator training rows."""
    labels = table(spark, sf_dir, "labels").withColumn("band", F.expr("doc_id div 40"))
    a, b = labels.select("band", F.col("doc_id").alias("a"), F.col("quality").alias("qa")), labels.select("band", F.col("doc_id").alias("b"), F.col("quality").alias("qb"))
    winner = F.when(F.col("qa") > F.col("qb"), "A").when(F.col("qa") < F.col("qb"), "B").otherwise("tie")
    pairs = a.join(b, "band").where("a < b").select("a", "b", winner.alias("winner"))
    vectors = reports.feature_vector(views.checks(spark, sf_dir), _CHECK_NAMES)
    return reports.preference_rows(pairs, vectors, _CHECK_NAMES)


@register("calibration_error", with_views(f"""WITH {_VECTOR_SQL}, p AS (SELECT round(1 / (1 + exp(-(-1 + 2 * v.quality + 1.5 * safety + 0.5 * pacing))), 6) AS p, l.quality AS y FROM v JOIN labels l ON l.doc_id = v.report_id),
    b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM p GROUP BY 1)
    SELECT (SELECT round(sum(n * abs(p - y)) / sum(n), 6) FROM b) AS ece, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
      round((count(*) FILTER (y = 1 AND p >= 0.5) / count(*) FILTER (y = 1) + count(*) FILTER (y = 0 AND p < 0.5) / count(*) FILTER (y = 0)) / 2, 6) AS balanced FROM p""", "checks"))
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = check_vectors(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("report_id"), F.col("quality").alias("y")), "report_id")
    return reports.calibration_error(scored.select(F.col("score").alias("p"), "y"))


@register("vector_top_k", """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id AS id, round(list_inner_product(q::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings)
    SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best vectors by inner product for every query vector (ids divisible by 20)."""
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.top_k(index, index.where("id % 20 = 0"), 10)


@register("video_similarity", """WITH c AS (SELECT a.label AS a, b.label AS b, round(max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON a.label < b.label GROUP BY ALL) SELECT * FROM c""")
def video_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.video_similarity(views.frames(spark, sf_dir))


@register("set_diversity", """WITH c AS (SELECT round(max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS s
    FROM embeddings a JOIN embeddings b ON a.label < b.label GROUP BY a.label, b.label)
    SELECT round(greatest(0, least(1, 1 - avg(s))), 6) AS diversity, count(*) FILTER (s > 0.95) AS duplicates FROM c""")
def set_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.diversity(retrieval.video_similarity(views.frames(spark, sf_dir)))


@register("novelty", """SELECT a.vec_id AS id, round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance
    FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id % 20 = 0) b GROUP BY a.vec_id""")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.novelty(rows, rows.where("id % 20 = 0"))


@register("active_order", """WITH d AS (SELECT a.vec_id AS id, round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id % 20 = 0) b GROUP BY a.vec_id),
    p AS (SELECT id, (id * 37 % 101) / 100 AS quality_uncertainty, CASE WHEN max(distance) OVER () > 0 THEN distance / max(distance) OVER () ELSE 0 END AS diversity FROM d),
    r AS (SELECT *, round(0.7 * quality_uncertainty + 0.3 * diversity, 6) AS priority FROM p)
    SELECT id, round(priority, 6) AS priority, row_number() OVER (ORDER BY priority DESC, id) AS place FROM r""")
def active_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in the order in which labels are wanted: uncertain ones and those far from the labelled set first."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    uncertain = rows.select("id", ((F.col("id") * 37 % 101) / 100).alias("uncertainty"))
    return retrieval.active_order(retrieval.novelty(rows, rows.where("id % 20 = 0")), uncertain).select("id", "priority", "place")


@register("hash_embedding")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed bag of words of the benchmark items; SQL has no FNV hash, so tests hold it against a plain version."""
    return retrieval.hash_embedding(table(spark, sf_dir, "benchmark"), "text", "item_id", 64)


_SHOT_SQL = """b AS (SELECT DISTINCT video_id, cut_ms FROM cuts UNION SELECT DISTINCT video_id, 0 FROM cuts),
    s AS (SELECT video_id, cut_ms AS start_ms, lead(cut_ms) OVER (PARTITION BY video_id ORDER BY cut_ms) AS end_ms FROM b),
    shots AS (SELECT *, (end_ms - start_ms) / 1000 AS seconds FROM s WHERE end_ms IS NOT NULL)"""


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots between consecutive distinct cuts, from 0 to the last cut."""
    c = views.cuts(spark, sf_dir)
    bounds = c.union(c.select("video_id", F.lit(0).cast("long"))).distinct()
    ends = F.lead("cut_ms").over(windows.ordered(["video_id"], ["cut_ms"]))
    return bounds.select("video_id", F.col("cut_ms").alias("start_ms"), ends.alias("end_ms")).where("end_ms is not null").withColumn("seconds", (F.col("end_ms") - F.col("start_ms")) / 1000)


@register("shot_pacing", with_views(f"""WITH {_SHOT_SQL} SELECT video_id, count(*) AS shots, round(avg(seconds), 6) AS mean_s, round(median(seconds), 6) AS median_s, round(stddev_pop(seconds), 6) AS sd_s,
    CASE WHEN avg(seconds) < 1 THEN 'very_fast' WHEN avg(seconds) < 2 THEN 'fast' WHEN avg(seconds) < 4 THEN 'moderate' ELSE 'slow' END AS pace FROM shots GROUP BY video_id""", "cuts"))
def shot_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = F.avg("seconds")
    pace = F.when(mean < 1, "very_fast").when(mean < 2, "fast").when(mean < 4, "moderate").otherwise("slow")
    return _shots(spark, sf_dir).groupBy("video_id").agg(
        F.count("*").alias("shots"), F.round(mean, 6).alias("mean_s"), F.round(F.median("seconds"), 6).alias("median_s"), F.round(F.stddev_pop("seconds"), 6).alias("sd_s"), pace.alias("pace"))


@register("cut_cadence", with_views(f"""WITH {_SHOT_SQL}, i AS (SELECT video_id, seconds FROM shots UNION ALL SELECT video_id, 1.5::DOUBLE FROM cuts GROUP BY video_id)
    SELECT video_id, count(*) - 1 AS cuts, round(median(seconds), 6) AS median_interval, median(seconds) <= 3 AND count(*) - 1 >= 5 AS passed FROM i GROUP BY video_id""", "cuts"))
def cut_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median interval between cuts, head and tail (1.5 s) included."""
    s = _shots(spark, sf_dir)
    tail = views.cuts(spark, sf_dir).select("video_id").distinct().select("video_id", F.lit(1.5).alias("seconds"))
    rows = s.select("video_id", "seconds").union(tail).groupBy("video_id").agg((F.count("*") - 1).alias("cuts"), F.median("seconds").alias("m"))
    return rows.select("video_id", "cuts", F.round("m", 6).alias("median_interval"), ((F.col("m") <= 3) & (F.col("cuts") >= 5)).alias("passed"))


@register("thinned_cuts", with_views("""WITH RECURSIVE k AS (SELECT video_id, min(cut_ms) AS t FROM cuts GROUP BY video_id
      UNION ALL SELECT video_id, t FROM (SELECT k.video_id, min(c.cut_ms) AS t FROM k JOIN cuts c ON c.video_id = k.video_id AND c.cut_ms >= k.t + 2000 GROUP BY k.video_id, k.t))
    SELECT video_id, count(*) AS kept, CAST(sum(t) AS BIGINT) AS total_ms FROM k GROUP BY video_id""", "cuts").replace("WITH cuts", "WITH RECURSIVE cuts", 1).replace(", RECURSIVE k", ", k", 1))
def thinned_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts kept by greedy thinning with a least gap of two seconds."""
    kept = scans.thin_by_gap(views.cuts(spark, sf_dir), ["video_id"], "cut_ms", 2000, 600_000)
    return kept.groupBy("video_id").agg(F.count("*").alias("kept"), F.sum("cut_ms").alias("total_ms"))


@register("script_scores", with_views("""WITH c AS (SELECT doc_id, len(scenes) AS n_scenes, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n_words,
      len(list_filter(string_split_regex(coalesce(scenes[1], ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS title_words,
      len(list_filter(string_split_regex(coalesce(scenes[-1], ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS hook_words FROM scripts),
    d AS (SELECT doc_id, n_scenes, n_words, n_words / 2.5::DOUBLE AS seconds,
      CASE WHEN title_words < 6 THEN greatest(0, least(1, 1 - (6 - title_words) / 6)) WHEN title_words > 14 THEN greatest(0, least(1, 1 - (title_words - 14) / 14)) ELSE 1 END AS title,
      CASE WHEN hook_words < 3 THEN greatest(0, least(1, 1 - (3 - hook_words) / 3)) WHEN hook_words > 12 THEN greatest(0, least(1, 1 - (hook_words - 12) / 12)) ELSE 1 END AS hook,
      CASE WHEN n_scenes < 3 THEN greatest(0, least(1, 1 - (3 - n_scenes) / 3)) WHEN n_scenes > 10 THEN greatest(0, least(1, 1 - (n_scenes - 10) / 10)) ELSE 1 END AS structure FROM c)
    SELECT doc_id, n_scenes, n_words, round(seconds, 6) AS seconds, round(0.25 * title + 0.35 * hook + 0.25 * structure + 0.15, 6) AS score FROM d""", "scripts"))
def script_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script dimensions: title (first line), hook (last line) and number of scenes against their ranges."""
    s = views.scripts(spark, sf_dir)
    c = s.select("doc_id", F.size("scenes").alias("n_scenes"), T.word_count(F.col("text")).alias("n_words"), T.word_count(F.try_element_at("scenes", F.lit(1))).alias("tw"), T.word_count(F.try_element_at("scenes", F.lit(-1))).alias("hw"))
    total = 0.25 * S.range_score(F.col("tw"), 6, 14) + 0.35 * S.range_score(F.col("hw"), 3, 12) + 0.25 * S.range_score(F.col("n_scenes"), 3, 10) + 0.15
    return c.select("doc_id", "n_scenes", "n_words", F.round(F.col("n_words") / 2.5, 6).alias("seconds"), F.round(total, 6).alias("score"))


@register("top_themes", """WITH t AS (SELECT source, w, count(*) AS n FROM (SELECT source, unnest(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\f]+')) AS w FROM documents)
      WHERE length(w) >= 8 GROUP BY ALL)
    SELECT source, w AS theme, n, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS place FROM t) WHERE place <= 5""")
def top_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent long words of each source."""
    words = table(spark, sf_dir, "documents").select("source", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), T.BLANK)).alias("theme")).where(F.length("theme") >= 8)
    n = words.groupBy("source", "theme").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.col("n").desc(), F.col("theme"))
    return n.withColumn("place", F.row_number().over(w)).where("place <= 5")


@register("rank_correlation", """WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rv,
      rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2 AS rk FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))
    SELECT event_type, round(corr(rv, rk), 6) AS spearman FROM r GROUP BY event_type""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman correlation of value and k for each type, ties at their mean rank."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    # Equal pairs fold before they meet the ranks.
    pairs = e.groupBy("event_type", "value", "k").agg(F.count("*").alias("n"))
    ranks = [windows.rank_table(e, ["event_type"], c, r) for c, r in (("value", "rv"), ("k", "rk"))]
    r = pairs.join(ranks[0], ["event_type", "value"]).join(ranks[1], ["event_type", "k"]).withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    return r.groupBy("event_type").agg(F.round(F.corr("rv", "rk"), 6).alias("spearman"))


@register("stress_monotone", with_views("""WITH p AS (SELECT run_id, provider, k // 20 AS severity, avg(latency) AS v FROM attempts GROUP BY ALL),
    g AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY run_id, provider ORDER BY severity) - v > 0.005 THEN 1 ELSE 0 END AS rev FROM p)
    SELECT run_id, provider, count(*) AS n, CAST(sum(rev) AS BIGINT) AS reversals, round(max(v) - min(v), 6) AS effect FROM g GROUP BY ALL""", "attempts"))
def stress_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversals of the mean value along rising severity for every run and provider."""
    p = windows.exact_mean(views.attempts(spark, sf_dir).withColumn("severity", F.expr("k div 20")), ["run_id", "provider", "severity"], "latency", "event_id", "v")
    p = p.withColumn("rev", windows.reversals("v", ["run_id", "provider"], ["severity"], 0.005))
    return p.groupBy("run_id", "provider").agg(F.count("*").alias("n"), F.sum("rev").alias("reversals"), F.round(F.max("v") - F.min("v"), 6).alias("effect"))


@register("token_overlap", """WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS t FROM benchmark)
    SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard
    FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.1""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard similarity, at least 0.1, of benchmark items."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.words(F.lower(F.col("text")))).alias("t"))
    return retrieval.similar_sets(w, "item_id", "t", 0.1)
