"""Queries on word filters, caption text, gates, timing repairs, packaging and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import captions as C
from cadenza.functions import scores as S
from cadenza.functions import text as T
from cadenza.operators import pacing, timing, windows
from cadenza.plans import views
from cadenza.plans.registry import register
from cadenza.plans.views import with_views
from cadenza.sources.tables import table


@register("word_filters", with_views("""WITH p AS (SELECT *, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS q FROM asr_words)
    SELECT video_id, count(*) AS n, count(*) FILTER (trim(word) <> '' AND regexp_matches(word, '[\\p{L}\\p{N}]') AND NOT regexp_matches(word, '^\\s*(\\[.*\\]|<.*>)\\s*$') AND confidence >= 0.15) AS shown,
      count(*) FILTER (length(lower(word)) = 1 AND regexp_matches(lower(word), '[a-z]') AND lower(word) NOT IN ('a', 'i', 'o')) AS artifacts,
      count(*) FILTER (length(q) > 1 AND NOT regexp_matches(q, '^[0-9]{4,}$')) AS sync_tokens, count(*) FILTER (length(q) <= 2 OR regexp_matches(q, '[0-9]')) AS risky,
      count(*) FILTER (end_ms >= start_ms) AS sound FROM p GROUP BY video_id""", "asr_words"))
def word_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.plain(F.col("word"))
    return views.asr_words(spark, sf_dir).groupBy("video_id").agg(
        F.count("*").alias("n"), F.count_if(C.displayable(F.col("word"), F.col("confidence"))).alias("shown"), F.count_if(C.heard_artifact(F.col("word"))).alias("artifacts"),
        F.count_if(C.sync_token(q)).alias("sync_tokens"), F.count_if(C.risky_token(q)).alias("risky"), F.count_if(F.col("end_ms") >= F.col("start_ms")).alias("sound"))


@register("emphasis_counts", with_views("""WITH w AS (SELECT *, regexp_replace(lower(word), '[^a-z0-9''%$]', '', 'g') AS q FROM words),
    e AS (SELECT video_id, CASE WHEN regexp_matches(q, '^[$]?[0-9][0-9]*[%xk]?$') THEN 'number' WHEN q IN ('no', 'not', 'never', 'don''t', 'won''t', 'can''t', 'nothing') THEN 'negation'
      WHEN q IN ('never', 'always', 'best', 'worst', 'secret', 'free', 'instantly', 'amazing', 'shocking') THEN 'power' WHEN regexp_matches(word, '[!?]$') THEN 'punctuation' END AS kind FROM w)
    SELECT kind, count(*) AS n, count(DISTINCT video_id) AS videos FROM e WHERE kind IS NOT NULL GROUP BY kind""", "words"))
def emphasis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.words(spark, sf_dir).select("video_id", C.emphasis(F.col("word")).alias("kind")).where("kind is not null")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("video_id").alias("videos"))


@register("text_flags", """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '\\s', '', 'g') AS dense FROM documents),
    s AS (SELECT *, length(regexp_replace(dense, '[^A-Za-z]', '', 'g')) / greatest(length(dense), 1) AS letters, length(regexp_replace(dense, '[A-Za-z0-9]', '', 'g')) / greatest(length(dense), 1) AS symbols FROM d)
    SELECT doc_id, round(letters, 6) AS letters, round(symbols, 6) AS symbols, letters >= 0.5 AND symbols <= 0.35 AND length(trim(t)) >= 2 AS keep,
      regexp_matches(lower(t), 'follow|subscribe|comment|share|save|link in bio|dm|join') AS cta, left(t, 40) || CASE WHEN length(t) > 40 THEN '...' ELSE '' END AS head FROM s""")
def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption-candidate test, calls to action and excerpts of documents."""
    t = F.coalesce("text", F.lit(""))
    letters, symbols = C.char_shares(t)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(letters, 6).alias("letters"), F.round(symbols, 6).alias("symbols"), C.keep_caption(t, F.lit(1.0)).alias("keep"), C.call_to_action(t).alias("cta"), T.excerpt(t, 40).alias("head"))


@register("media_gates", """WITH p AS (SELECT p_partkey AS id, 1080 * (1 + p_partkey % 2) AS width, 1920 AS height, (p_partkey * 7) % 90 AS seconds, round(p_retailprice / 50, 6) AS brisque FROM part)
    SELECT id, gate, passed FROM (SELECT id, 'resolution' AS gate, width = 1080 AND height = 1920 AS passed FROM p UNION ALL SELECT id, 'duration', seconds BETWEEN 30 AND 60 FROM p UNION ALL SELECT id, 'brisque', brisque <= 25 FROM p)""")
def media_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile gates as rows, from one projection."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (1080 * (1 + F.col("p_partkey") % 2)).alias("width"), ((F.col("p_partkey") * 7) % 90).alias("seconds"), F.round(F.col("p_retailprice") / 50, 6).alias("brisque"))
    gates = p.select("id", (F.col("width") == 1080).alias("resolution"), F.col("seconds").between(30, 60).alias("duration"), (F.col("brisque") <= 25).alias("brisque"))
    return gates.unpivot("id", ["resolution", "duration", "brisque"], "gate", "passed")


@register("repaired_words", with_views("""WITH z AS (SELECT video_id, idx, start_ms, CASE WHEN idx % 9 = 0 THEN start_ms ELSE end_ms END AS end_ms FROM words),
    m AS (SELECT *, avg(CASE WHEN end_ms > start_ms THEN end_ms - start_ms END) OVER (PARTITION BY video_id) AS mean FROM z)
    SELECT video_id, idx, CASE WHEN end_ms > start_ms THEN end_ms ELSE start_ms + CAST(floor(coalesce(mean, 200) + 0.5) AS BIGINT) END AS end_ms FROM m""", "words"))
def repaired_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = views.words(spark, sf_dir).withColumn("end_ms", F.when(F.col("idx") % 9 == 0, F.col("start_ms")).otherwise(F.col("end_ms")))
    return timing.repair(z).select("video_id", "idx", "end_ms")


@register("clip_words", with_views("""SELECT video_id, idx, least(greatest(start_ms, 5000), 20000) - 5000 AS start_ms, least(greatest(end_ms, 5000), 20000) - 5000 AS end_ms FROM words WHERE end_ms > 5000 AND start_ms < 20000""", "words"))
def clip_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.rebase(views.words(spark, sf_dir), 5000, 20000).select("video_id", "idx", "start_ms", "end_ms")


@register("allocated_words", with_views("""WITH u AS (SELECT video_id, scene_id AS unit, count(*) - scene_id % 2 AS n FROM words GROUP BY video_id, scene_id),
    r AS (SELECT *, sum(n) OVER v - n AS low, CASE WHEN row_number() OVER v = count(*) OVER (PARTITION BY video_id) THEN 1000000000000 ELSE sum(n) OVER v END AS high FROM u WINDOW v AS (PARTITION BY video_id ORDER BY unit))
    SELECT w.video_id, w.idx, max(unit) AS unit FROM words w JOIN r ON r.video_id = w.video_id AND w.idx >= low AND w.idx < high GROUP BY ALL""", "words"))
def allocated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words dealt to scenes by slightly short word counts."""
    w = views.words(spark, sf_dir)
    units = w.groupBy("video_id", F.col("scene_id").alias("unit")).agg((F.count("*") - F.col("scene_id") % 2).alias("n_words"))
    return timing.allocate(w.select("video_id", "idx"), units).select("video_id", "idx", "unit")


@register("even_samples", with_views("""SELECT video_id, k, max_ms * (2 * k + 1) // 10 AS at_ms FROM (SELECT video_id, max(end_ms) AS max_ms FROM words GROUP BY video_id), (SELECT unnest(range(5)) AS k)""", "words"))
def even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.even_times(views.words(spark, sf_dir).groupBy("video_id").agg(F.max("end_ms").alias("duration_ms")), 5)


@register("visual_coverage", with_views("""WITH s AS (SELECT video_id, scene_id AS scene, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM words GROUP BY ALL), d AS (SELECT video_id, max(end_ms) - 3000 + (video_id % 3) * 3000 AS dur FROM words GROUP BY video_id),
    r AS (SELECT s.*, dur, row_number() OVER (PARTITION BY video_id ORDER BY start_ms DESC, scene DESC) AS r FROM s JOIN d USING (video_id) WHERE start_ms < dur)
    SELECT video_id, scene, start_ms, CASE WHEN r = 1 THEN dur ELSE least(end_ms, dur) END AS end_ms, CASE WHEN r = 1 THEN dur ELSE least(end_ms, dur) END > end_ms AS stretched FROM r""", "words"))
def visual_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.words(spark, sf_dir)
    scenes = w.groupBy("video_id", F.col("scene_id").alias("scene")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    durations = w.groupBy("video_id").agg((F.max("end_ms") - 3000 + (F.col("video_id") % 3) * 3000).alias("duration_ms"))
    return timing.cover(scenes, durations)


@register("beat_grid", with_views("""WITH g AS (SELECT video_id, cut_ms, cut_ms - lag(cut_ms) OVER (PARTITION BY video_id ORDER BY cut_ms) AS gap FROM cuts), p AS (SELECT * FROM g WHERE gap > 0),
    u AS (SELECT video_id, list_sort(list(gap)) AS l, max(cut_ms) AS until FROM p GROUP BY video_id)
    SELECT video_id, round(60000 / l[len(l) // 2 + 1], 6) AS bpm, until // l[len(l) // 2 + 1] + 1 AS beats FROM u""", "cuts"))
def beat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.beat_grid(views.cuts(spark, sf_dir).select("video_id", F.col("cut_ms").alias("at_ms")))


@register("signal_flicker", with_views("""WITH l AS (SELECT run_id, abs(latency - lag(latency) OVER (PARTITION BY run_id ORDER BY ts, event_id)) AS d FROM attempts)
    SELECT run_id, round(avg(d) / 30, 6) AS flicker, round(var_pop(d), 6) AS variance FROM l GROUP BY run_id""", "attempts"))
def signal_flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute step of a signal over 30, and the steps' variance."""
    d = F.abs(F.col("latency") - F.lag("latency").over(windows.ordered(["run_id"], ["ts", "event_id"])))
    return views.attempts(spark, sf_dir).withColumn("d", d).groupBy("run_id").agg(F.round(F.avg("d") / 30, 6).alias("flicker"), F.round(F.var_pop("d"), 6).alias("variance"))


@register("freeze_runs", with_views("""WITH d AS (SELECT *, abs(latency - lag(latency) OVER v) <= 1.2 AS still, row_number() OVER v AS i FROM attempts WINDOW v AS (PARTITION BY run_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(CASE WHEN still IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY i) AS g FROM (SELECT *, lag(still) OVER (PARTITION BY run_id ORDER BY i) AS p FROM (SELECT * REPLACE (coalesce(still, false) AS still) FROM d)))
    SELECT run_id, count(*) AS n, min(i) AS start, max(i) AS "end" FROM g WHERE still GROUP BY run_id, g HAVING count(*) >= 3""", "attempts"))
def freeze_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least three nearly unchanged samples."""
    w = windows.ordered(["run_id"], ["ts", "event_id"])
    rows = views.attempts(spark, sf_dir).withColumns({"i": F.row_number().over(w).cast("long"), "still": F.abs(F.col("latency") - F.lag("latency").over(w)) <= 1.2})
    return windows.runs(rows, F.col("still"), ["run_id"], "i", least=3).drop("island")


@register("packaging_choice", """WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[1:3] AS v FROM documents),
    x AS (SELECT doc_id, generate_subscripts(v, 1) AS i, len(list_filter(string_split_regex(unnest(v), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS n FROM l),
    s AS (SELECT doc_id, i, round(0.45 * CASE WHEN n < 6 THEN greatest(0, 1 - (6 - n) / 6) WHEN n > 14 THEN greatest(0, 1 - (n - 14) / 14) ELSE 1 END + 0.3 * CASE WHEN n < 2 THEN greatest(0, 1 - (2 - n) / 2) WHEN n > 6 THEN greatest(0, 1 - (n - 6) / 6) ELSE 1 END
      + 0.25 * CASE WHEN n < 3 THEN greatest(0, 1 - (3 - n) / 3) WHEN n > 10 THEN greatest(0, 1 - (n - 10) / 10) ELSE 1 END, 6) AS score FROM x)
    SELECT doc_id, i AS variant, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM s) WHERE r = 1""")
def packaging_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of up to three title variants (first lines); the first wins ties."""
    lines = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1, 3)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("variant"), T.word_count(F.col("line")).alias("n"))
    n = F.col("n")
    score = F.round(0.45 * S.range_score(n, 6, 14) + 0.3 * S.range_score(n, 2, 6) + 0.25 * S.range_score(n, 3, 10), 6)
    best = rows.withColumn("score", score).groupBy("doc_id").agg(F.max_by(F.struct("variant", "score"), F.struct("score", -F.col("variant"))).alias("b"))
    return best.select("doc_id", "b.*")


@register("separation", """WITH s AS (SELECT doc_id, n_chars % 101 AS v, lang = 'en' AS pro FROM documents), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS k FROM s),
    c AS (SELECT count(*) FILTER (pro) AS a, count(*) FILTER (NOT pro) AS b, sum(k) FILTER (pro) AS w FROM r) SELECT round((w - a * (a + 1) / 2) / (a * b), 6) AS win_rate FROM c""")
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rate of one set of scores over another (ties count half), from counts by value, without pairing the sets."""
    s = table(spark, sf_dir, "documents").select((F.col("n_chars") % 101).alias("v"), (F.col("lang") == "en").alias("pro"))
    # A row for each value; the running sum runs over those alone.
    by = s.groupBy("v").agg(F.count_if("pro").alias("a"), F.count_if(~F.col("pro")).alias("b"))
    below = F.coalesce(F.sum("b").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = by.withColumn("w", F.col("a") * (below + F.col("b") / 2)).agg(F.sum("w").alias("w"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return wins.select(F.round(F.col("w") / (F.col("a") * F.col("b")), 6).alias("win_rate"))


@register("corrected_drift", with_views("""WITH d AS (SELECT video_id, a.idx, a.start_ms, a.end_ms, row_number() OVER (PARTITION BY video_id ORDER BY a.idx) - 1 AS i, a.start_ms - w.start_ms AS drift_ms FROM asr_words a JOIN words w USING (video_id, idx)),
    s AS (SELECT video_id, round(CASE WHEN max(drift_ms) = min(drift_ms) THEN 0 ELSE regr_slope(drift_ms, i) END, 6) AS slope FROM d GROUP BY video_id)
    SELECT video_id, idx, greatest(0, start_ms - CAST(floor(slope * i + 0.5) AS BIGINT)) AS start_ms, greatest(0, end_ms - CAST(floor(slope * i + 0.5) AS BIGINT)) AS end_ms FROM d JOIN s USING (video_id)""", "asr_words"))
def corrected_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heard words with the linear part of their drift taken out."""
    heard = views.asr_words(spark, sf_dir)
    slopes = pacing.drift_classes(pacing.drift(views.words(spark, sf_dir), heard)).select("video_id", "slope")
    return timing.correct_linear(heard, slopes).select("video_id", "idx", "start_ms", "end_ms")


@register("distinct_keep_order", """SELECT conv_id, list_reduce(list(role ORDER BY turn), lambda a, b: CASE WHEN list_contains(string_split(a, ','), b) THEN a ELSE a || ',' || b END) AS roles FROM conversations GROUP BY conv_id""")
def distinct_keep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of each conversation in order of first appearance."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


@register("image_hash", """WITH v AS (SELECT vec_id, embedding, list_sum(embedding::DOUBLE[]) / 64 AS m FROM embeddings)
    SELECT vec_id, (SELECT count(*) FROM (SELECT unnest(embedding) AS x) WHERE x > m) AS bits_set FROM v""")
def image_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average hash of 64 cells: how many lie above their mean (the hash itself is a signed 64-bit number)."""
    e = table(spark, sf_dir, "embeddings").withColumn("m", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x) / 64)
    return e.select("vec_id", F.bit_count(average_hash(F.col("embedding"), F.col("m"))).cast("long").alias("bits_set"))


def average_hash(cells, mean):
    """64-bit hash whose bit i tells whether cell i lies above the mean."""
    bits = F.transform(cells, lambda x, i: F.when(x > mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
