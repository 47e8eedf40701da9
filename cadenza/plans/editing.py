"""Queries with sequential operators, highlights and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import text as T
from cadenza.operators import governance, highlights, joins, reconcile, reports, sequences
from cadenza.plans import views
from cadenza.plans.registry import register
from cadenza.plans.views import with_views
from cadenza.sources.tables import table


@register("caption_chunks")
def caption_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.caption_chunks(views.words(spark, sf_dir).select("video_id", "idx", "word", "start_ms", "end_ms"))


@register("caption_pages")
def caption_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.caption_pages(views.words(spark, sf_dir).select("video_id", "idx", "word", "start_ms", "end_ms"))


@register("merge_fragments")
def merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.merge_fragments(views.asr_words(spark, sf_dir))


@register("transcript_segments")
def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.transcript_segments(views.asr_words(spark, sf_dir))


@register("fix_overlaps")
def fix_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fix_overlaps(views.words(spark, sf_dir).select("video_id", "idx", "word", "start_ms", "end_ms"))


@register("align_script")
def align_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.align(views.words(spark, sf_dir), views.asr_words(spark, sf_dir))


def ocr_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames twice a second that show the words under way, or nothing."""
    w = views.words(spark, sf_dir).select("video_id", "idx", "word", F.expr("start_ms div 500").alias("a"), F.expr("greatest(start_ms, end_ms) div 500").alias("b"))
    shown = w.select("video_id", F.explode(F.sequence("a", "b")).alias("k"), F.struct("idx", "word").alias("w"))
    rows = shown.groupBy("video_id", "k").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return rows.select("video_id", (F.col("k") * 500).alias("at_ms"), F.concat_ws(" ", F.transform("ws", lambda x: x["word"])).alias("text"), ((F.col("k") * 13) % 100 / F.lit(100.0)).alias("confidence"))


@register("caption_sessions")
def caption_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.caption_sessions(ocr_frames(spark, sf_dir))


@register("speech_chunks")
def speech_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.speech_chunks(table(spark, sf_dir, "documents"))


_MARK_SQL = """m AS (SELECT *, sum(filler) OVER (PARTITION BY video_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS fillers FROM (
      SELECT video_id, idx, word, start_ms, end_ms, regexp_matches(word, '[.!?]["'')]*$') AS ends, coalesce(regexp_matches(lag(word) OVER v, '[.!?]["'')]*$'), true) AS opens,
        CASE WHEN regexp_replace(lower(word), '[^a-z0-9]', '', 'g') IN ('um', 'uh', 'erm', 'ah', 'like', 'basically', 'literally', 'actually', 'just', 'kinda', 'kind', 'sorta', 'sort') THEN 1 ELSE 0 END AS filler,
        coalesce(start_ms - lag(end_ms) OVER v, 0) AS gap_before, coalesce(lead(start_ms) OVER v - end_ms, 0) AS gap_after
      FROM words WINDOW v AS (PARTITION BY video_id ORDER BY idx))),
    p AS (SELECT a.video_id, a.idx AS first, b.idx AS last, a.start_ms, b.end_ms, a.opens, b.ends, a.gap_before, b.gap_after, b.idx - a.idx + 1 AS n_words, b.fillers - (a.fillers - a.filler) AS fillers,
        abs(b.end_ms - a.start_ms - 35000) - CASE WHEN b.ends THEN 750 ELSE 0 END AS distance
      FROM m a JOIN m b ON a.video_id = b.video_id AND b.idx >= a.idx AND b.end_ms - a.start_ms BETWEEN 20000 AND 60000 WHERE a.opens OR a.idx % 8 = 0),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, first ORDER BY distance, last) AS r FROM p) WHERE r = 1)"""


@register("highlight_spans", with_views(f"""WITH {_MARK_SQL}, q AS (SELECT video_id, idx, gap_before, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS w FROM m),
    d AS (SELECT s.*, coalesce((SELECT bool_or(w IN ('why', 'how', 'what', 'when', 'stop', 'never', 'nobody', 'most', 'biggest', 'mistake', 'secret', 'truth')) FROM q WHERE q.video_id = s.video_id AND idx BETWEEN first AND least(first + 7, last)), false) AS hc,
        coalesce((SELECT bool_or(w IN ('because', 'means', 'therefore', 'so', 'that', 'why', 'fix', 'result', 'instead', 'now')) FROM q WHERE q.video_id = s.video_id AND idx BETWEEN greatest(last - 9, first) AND last), false) AS pc,
        coalesce((SELECT max(q.gap_before) FROM q WHERE q.video_id = s.video_id AND idx > first AND idx <= last), 0) AS gap FROM s),
    c AS (SELECT *, greatest(0, least(1, 4.0::DOUBLE * fillers / n_words)) AS risk, greatest(0, least(1, 1 - abs(end_ms - start_ms - 35000) / 25000)) AS near, greatest(0, least(1, greatest(0, gap / 1000 - 0.65::DOUBLE) / 1.5::DOUBLE)) AS silence FROM d)
    SELECT video_id, first, last, start_ms, end_ms, n_words, CAST(fillers AS BIGINT) AS fillers, round(risk, 6) AS filler_risk, round(silence, 6) AS silence_risk, round(greatest(0, least(1,
      0.28::DOUBLE * least(1, CASE WHEN hc THEN 0.68 ELSE 0.08 END + CASE WHEN opens THEN 0.2 ELSE 0 END + CASE WHEN fillers = 0 THEN 0.18 ELSE 0 END)
      + 0.24::DOUBLE * least(1, 0.7 * near + CASE WHEN ends THEN 0.2 ELSE 0 END + CASE WHEN silence < 0.25 THEN 0.1 ELSE 0 END)
      + 0.18::DOUBLE * least(1, CASE WHEN pc THEN 0.42 ELSE 0.16 END + CASE WHEN ends THEN 0.34 ELSE 0 END + CASE WHEN n_words >= 8 THEN 0.24 ELSE 0 END)
      + 0.2::DOUBLE * least(1, CASE WHEN opens THEN 0.36 ELSE 0 END + CASE WHEN ends THEN 0.36 ELSE 0 END + CASE WHEN gap_before >= 350 OR n_words <= 8 THEN 0.14 ELSE 0 END + CASE WHEN gap_after >= 350 THEN 0.14 ELSE 0 END)
      + 0.06::DOUBLE * (1 - risk) + 0.04::DOUBLE * (1 - silence))), 6) AS score FROM c""", "words"))
def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = highlights.score_spans(highlights.candidate_spans(views.words(spark, sf_dir)))
    return spans.select("video_id", "first", "last", "start_ms", "end_ms", "n_words", "fillers", "filler_risk", "silence_risk", "score")


@register("highlight_choice")
def highlight_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice among the spans; order dependent, so tests hold it against a plain version."""
    spans = highlight_spans(spark, sf_dir).withColumn("fine", (F.col("score") >= 0.45) & (F.col("filler_risk") <= 0.65) & (F.col("silence_risk") <= 0.65))
    return sequences.suppress(spans.select("video_id", "start_ms", "end_ms", "score", "fine"))


@register("highlight_snap", with_views(f"""WITH {_MARK_SQL}, t AS (SELECT video_id, first, start_ms, end_ms FROM s)
    SELECT t.*, coalesce((SELECT max(m.start_ms) FROM m WHERE m.video_id = t.video_id AND (m.opens OR m.gap_before >= 450) AND m.start_ms BETWEEN t.start_ms - 900 AND t.start_ms), t.start_ms) AS snapped_start,
      coalesce((SELECT min(m.end_ms) FROM m WHERE m.video_id = t.video_id AND (m.ends OR m.gap_after >= 450) AND m.end_ms BETWEEN t.end_ms AND t.end_ms + 1100), t.end_ms) AS snapped_end FROM t""", "words"))
def highlight_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.words(spark, sf_dir)
    return highlights.snap(highlights.candidate_spans(w), w)


_ASSETS = """assets AS (SELECT page_id AS asset_id, url AS source_url, CASE page_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'Pending' WHEN 2 THEN 'licensed' WHEN 3 THEN 'odd' END AS status,
      CASE WHEN page_id % 7 = 0 THEN 'Reference-Only' ELSE 'publish' END AS usage, CASE page_id % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'generated' ELSE 'own' END AS provider,
      CASE WHEN page_id % 4 = 0 THEN 'CC BY 4.0' WHEN page_id % 4 = 1 THEN ' ' END AS licence,
      CASE WHEN page_id % 6 = 0 THEN ['Watermark'] WHEN page_id % 6 = 1 THEN ['attribution-required'] END AS flags, CASE WHEN page_id % 8 = 0 THEN 'credit' END AS attribution FROM pages)"""


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as media assets, with statuses, licences and flags by their number."""
    m = lambda k: F.col("page_id") % k
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("asset_id"), F.col("url").alias("source_url"), F.when(m(5) == 0, "approved").when(m(5) == 1, "Pending").when(m(5) == 2, "licensed").when(m(5) == 3, "odd").alias("status"),
        F.when(m(7) == 0, "Reference-Only").otherwise("publish").alias("usage"), F.when(m(3) == 0, "external").when(m(3) == 1, "generated").otherwise("own").alias("provider"),
        F.when(m(4) == 0, "CC BY 4.0").when(m(4) == 1, " ").alias("licence"), F.when(m(6) == 0, F.array(F.lit("Watermark"))).when(m(6) == 1, F.array(F.lit("attribution-required"))).alias("flags"),
        F.when(m(8) == 0, "credit").alias("attribution"),
    )


_RULES = """WITH {a}, f AS (SELECT *, list_transform(coalesce(flags, []), lambda x: lower(x)) AS fl, trim(coalesce(licence, '')) <> '' AS lic FROM assets)
    SELECT asset_id, 'review-status' AS check_id, coalesce(lower(status) IN ('approved', 'licensed'), false) AS passed FROM f
    UNION ALL SELECT asset_id, 'usage-mode-publishable', lower(usage) <> 'reference-only' FROM f
    UNION ALL SELECT asset_id, 'rights-flags-allowed', NOT list_contains(fl, 'watermark') FROM f
    UNION ALL SELECT asset_id, 'external-source-evidence', source_url IS NOT NULL FROM f WHERE provider = 'external'
    UNION ALL SELECT asset_id, 'external-license-evidence', lic FROM f WHERE provider = 'external'
    UNION ALL SELECT asset_id, 'attribution-present', attribution IS NOT NULL FROM f WHERE list_contains(fl, 'attribution-required') OR coalesce(contains(lower(licence), 'cc by'), false)
    UNION ALL SELECT asset_id, 'generated-provider-present', true FROM f WHERE provider = 'generated'"""


@register("rights_checks", _RULES.format(a=_ASSETS))
def rights_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.rights_checks(_assets(spark, sf_dir))


@register("rights_summary", f"SELECT check_id, count(*) AS n, count(*) FILTER (passed) AS passed FROM ({_RULES.format(a=_ASSETS)}) GROUP BY check_id")
def rights_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rights_checks(spark, sf_dir).groupBy("check_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@register("publish_ledger", """WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS state, o_orderdate AS due FROM orders),
    m AS (SELECT CAST(l_orderkey AS VARCHAR) AS key, round(sum(l_extendedprice), 2) AS views, max(l_shipdate) AS captured FROM lineitem GROUP BY 1)
    SELECT coalesce(p.key, m.key) AS key, p.state, m.views, p.key IS NOT NULL AS in_publish, m.key IS NOT NULL AS in_metrics FROM p FULL JOIN m ON p.key = m.key""")
def publish_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ledgers with partly shared keys, fully joined."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("state"))
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("key")).agg(F.round(F.sum("l_extendedprice"), 2).alias("views"), F.max("l_shipdate").alias("captured"))
    return governance.merge_ledgers(p, m, "key", "captured").select("key", "state", "views", "in_publish", "in_metrics")


@register("due_windows", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'captured' WHEN o_orderdate < TIMESTAMP '1996-06-01' THEN 'overdue'
    WHEN o_orderdate <= TIMESTAMP '1996-06-01' + INTERVAL 480 HOUR THEN 'due-soon' ELSE 'upcoming' END AS status FROM orders""")
def due_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each order's window against a fixed now, due soon within twenty days."""
    due, captured = F.col("o_orderdate").cast("timestamp"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", governance.window_status(due, captured, F.lit("1996-06-01").cast("timestamp"), 480).alias("status"))


@register("lenient_dates", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN to_timestamp(1000000000 + o_orderkey)::TIMESTAMP WHEN 1 THEN epoch_ms(1500000000000 + o_orderkey) WHEN 2 THEN CAST(o_orderdate AS TIMESTAMP) END AS at FROM orders""")
def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as epoch seconds, epoch milliseconds, ISO days and nonsense."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, (k + 1000000000).cast("string")).when(k % 4 == 1, (k + 1500000000000).cast("string")).when(k % 4 == 2, F.col("o_orderdate").cast("string")).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "orders").select("o_orderkey", governance.parse_date(raw).cast("timestamp_ntz").alias("at"))


@register("upsert_assets", """WITH old AS (SELECT user_id AS k, event_type AS v, event_id AS o FROM events WHERE event_type <> 'error'), new AS (SELECT user_id AS k, event_type AS v, event_id AS o FROM events WHERE event_type = 'error')
    SELECT k, arg_max(v, n * 100000000 + o) AS v, max(n * 100000000 + o) % 100000000 AS o FROM (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new) GROUP BY k""")
def upsert_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed upsert: new rows win, the last of several wins."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), F.col("event_id").alias("o"))
    return reports.upsert(e.where("v <> 'error'"), e.where("v = 'error'"), ["k"], "o")


@register("url_dedupe", """WITH u AS (SELECT *, regexp_replace(lower(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', '')), '/+$', '') AS key FROM pages)
    SELECT key, min(page_id) AS page_id, count(*) AS n FROM u GROUP BY key""")
def url_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of each normalised url."""
    rows = table(spark, sf_dir, "pages").select("page_id", governance.normal_url(F.col("url")).alias("key"))
    return rows.groupBy("key").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@register("asset_cache_keys", """SELECT page_id, left(sha256(trim(url)), 24) AS cache_key, left(sha256(url), 16) || '.bin' AS bundle_path, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=feed&utm_medium=video' AS tagged FROM pages""")
def asset_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed cache keys and campaign links."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.substring(F.sha2(F.trim("url"), 256), 1, 24).alias("cache_key"), F.concat(F.substring(F.sha2("url", 256), 1, 16), F.lit(".bin")).alias("bundle_path"),
        governance.with_utm(F.col("url"), "feed", "video").alias("tagged"))


@register("srt_lines", with_views("""SELECT video_id, idx + 1 AS number, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS start_text,
    printf('%d:%02d:%02d.%02d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms // 10 % 100) AS ass_text FROM words WHERE start_ms >= 0""", "words"))
def srt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle times of every word in both formats."""
    w = views.words(spark, sf_dir).where("start_ms >= 0")
    return w.select("video_id", (F.col("idx") + 1).alias("number"), T.srt_time(F.col("start_ms")).alias("start_text"), T.ass_time(F.col("start_ms")).alias("ass_text"))


@register("anti_semi", """SELECT (SELECT count(*) FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS known,
    (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)) AS unlabelled""")
def anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a document, and documents without a label."""
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    known, rest = l.join(d, "doc_id", "left_semi").agg(F.count("*").alias("known")), d.join(l, "doc_id", "left_anti").agg(F.count("*").alias("unlabelled"))
    one = F.lit(1).alias("_k")
    return known.select(one, "known").join(rest.select(one, "unlabelled"), "_k").drop("_k")


@register("round_robin", with_views("""WITH s AS (SELECT DISTINCT video_id, scene_id FROM words), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY scene_id) - 1 AS i FROM s),
    p AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation), n AS (SELECT count(*) AS n FROM p)
    SELECT video_id, scene_id, n_nationkey FROM r, n JOIN p ON k = i % n""", "words"))
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes take the clips of a small list in turn."""
    scenes = table(spark, sf_dir, "conversations").where(F.size(T.words(F.col("text"))) > 0).select(F.col("conv_id").alias("video_id"), F.col("turn").alias("scene_id"))
    clips = table(spark, sf_dir, "nation").select("n_nationkey").withColumn("k", F.row_number().over(Window.orderBy("n_nationkey")) - 1)
    n = max(clips.count(), 1)
    i = F.row_number().over(Window.partitionBy("video_id").orderBy("scene_id")) - 1
    return scenes.withColumn("k", F.pmod(i, F.lit(n))).join(F.broadcast(clips), "k").select("video_id", "scene_id", "n_nationkey")


@register("ocr_flicker", with_views("""WITH k AS (SELECT video_id, k, string_agg(word, ' ' ORDER BY idx) AS t FROM (SELECT video_id, idx, word, unnest(range(start_ms // 500, greatest(start_ms, end_ms) // 500 + 1)) AS k FROM words) GROUP BY ALL),
    l AS (SELECT *, lead(k) OVER v AS k1, lead(t) OVER v AS t1 FROM k WINDOW v AS (PARTITION BY video_id ORDER BY k))
    SELECT video_id, count(*) FILTER (t1 = t AND k1 = k + 2) AS flickers, count(*) AS frames FROM l GROUP BY video_id""", "words"))
def ocr_flicker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that goes blank for one frame and comes back."""
    w = Window.partitionBy("video_id").orderBy("at_ms")
    f = ocr_frames(spark, sf_dir).withColumns({"t1": F.lead("text").over(w), "a1": F.lead("at_ms").over(w)})
    return f.groupBy("video_id").agg(F.count_if((F.col("t1") == F.col("text")) & (F.col("a1") == F.col("at_ms") + 1000)).alias("flickers"), F.count("*").alias("frames"))


@register("best_match_files", """WITH q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS t FROM benchmark WHERE item_id % 20 = 0),
    f AS (SELECT doc_id, n_chars, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS t FROM documents)
    SELECT item_id, doc_id, shared FROM (SELECT item_id, doc_id, len(list_intersect(q.t, f.t)) AS shared, row_number() OVER (PARTITION BY item_id ORDER BY len(list_intersect(q.t, f.t)) DESC, n_chars DESC, doc_id) AS r
      FROM q, f WHERE len(list_intersect(q.t, f.t)) > 0) WHERE r = 1""")
def best_match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every query (ids divisible by 20) the document sharing most words, then the longest."""
    q = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select("item_id", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("w"))
    f = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.array_distinct(T.words(F.lower("text")))).alias("w"))
    shared = f.join(F.broadcast(q), "w").groupBy("item_id", "doc_id", "n_chars").agg(F.count("*").alias("shared"))
    return joins.best(shared, ["item_id"], [F.col("shared").desc(), F.col("n_chars").desc(), F.col("doc_id")]).select("item_id", "doc_id", "shared")


@register("reconciled_words")
def reconciled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heard words in the script's spelling; a greedy walk, so tests hold it on hand-made cases."""
    return reconcile.reconcile(views.words(spark, sf_dir), views.asr_words(spark, sf_dir))


@register("forced_timing")
def forced_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every script word timed between aligned hearings."""
    return reconcile.force_timing(views.words(spark, sf_dir), views.asr_words(spark, sf_dir))
