"""Queries on frames with recognised text that are scanned in order, and on growing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import styled_subtitles as S
from cadenza.operators import burned_in, scans, shown_words, windows
from cadenza.plans import views
from cadenza.plans.editing import ocr_frames
from cadenza.plans.registry import register
from cadenza.plans.views import with_views
from cadenza.sources import artifacts, tail
from cadenza.sources.shared import new_path, written
from cadenza.sources.tables import table
from cadenza.streaming import caches

#: DuckDB's edit distance counts bytes, so both engines see characters beyond ASCII as question marks here.
_SHOWN = """f AS (SELECT video_id, k * 500 AS at_ms, regexp_replace(string_agg(word, ' ' ORDER BY idx), '[^\\x00-\\x7F]', '?', 'g') AS text, (k * 13) % 100 / 100 AS confidence FROM
    (SELECT video_id, idx, word, unnest(range(start_ms // 500, greatest(start_ms, end_ms) // 500 + 1)) AS k FROM words) GROUP BY ALL)"""


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_frames(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7F]", "?"))


@register("text_sessions", with_views(f"""WITH {_SHOWN}, l AS (SELECT video_id, list({{'at': at_ms, 'text': text, 'plain': regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 'c': confidence}} ORDER BY at_ms, text) AS l FROM f GROUP BY video_id),
    g AS (SELECT video_id, list_reduce(list_transform(l, lambda r: [{{'head': r.text, 'plain': r.plain, 'at': r.at, 'c': r.c, 'run': 1}}]),
          lambda a, x: list_append(a, CASE WHEN a[-1].plain = x[1].plain OR 1 - levenshtein(a[-1].head, x[1].head) / greatest(length(a[-1].head), length(x[1].head)) >= 0.9
            THEN {{'head': a[-1].head, 'plain': a[-1].plain, 'at': x[1].at, 'c': x[1].c, 'run': a[-1].run}} ELSE {{'head': x[1].head, 'plain': x[1].plain, 'at': x[1].at, 'c': x[1].c, 'run': a[-1].run + 1}} END)) AS g FROM l),
    u AS (SELECT video_id, unnest(g) AS r FROM g)
    SELECT video_id, min(r.at) AS start_ms, max(r.at) + 500 AS end_ms, any_value(r.head) AS text, round(avg(r.c), 6) AS confidence, count(*) AS n_frames FROM u GROUP BY video_id, r.run""", "words"))
def text_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of frames that show the text of their first one; a video's blocks are ten seconds each."""
    rows = scans.text_sessions(_shown(spark, sf_dir), 500, block_ms=10_000)
    return rows.select("video_id", "start_ms", "end_ms", "text", F.round("confidence", 6).alias("confidence"), "n_frames")


_BOXES = "SELECT *, 100 + (at_ms // 500 * 7) % 13 AS x0, 40 + (at_ms // 500 * 5) % 29 AS y0, 300 + (at_ms // 500 * 11) % 17 AS x1, 90 + (at_ms // 500 * 3) % 19 AS y1 FROM f"


@register("center_jitter", with_views(f"""WITH {_SHOWN}, b AS ({_BOXES}), p AS (SELECT video_id, at_ms, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM b),
    n AS (SELECT *, lag(t) OVER v AS u, lag(x) OVER v AS px, lag(y) OVER v AS py FROM p WINDOW v AS (PARTITION BY video_id ORDER BY at_ms)),
    w AS (SELECT *, list_filter(list_transform(string_split(t, ' '), lambda w: regexp_replace(w, '[^a-z0-9'']', '', 'g')), lambda w: w <> '') AS a, list_filter(list_transform(string_split(u, ' '), lambda w: regexp_replace(w, '[^a-z0-9'']', '', 'g')), lambda w: w <> '') AS c, levenshtein(t, u) AS d FROM n WHERE u IS NOT NULL),
    m AS (SELECT video_id, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS moved FROM w WHERE t = u OR len(list_filter(a, lambda z: list_contains(c, z))) / greatest(len(a), len(c), 1) >= 0.8 OR d <= 2 OR (d <= 6 AND 1 - d / greatest(length(t), length(u)) >= 0.88)),
    s AS (SELECT video_id, count(*) AS n_moves, avg(moved) AS mean_px, quantile_cont(moved, 0.95) AS p95_px FROM m GROUP BY video_id),
    k AS (SELECT video_id, coalesce(n_moves, 0) AS n_moves, coalesce(mean_px, 0) AS mean_px, coalesce(p95_px, 0) AS p95_px FROM (SELECT DISTINCT video_id FROM f) LEFT JOIN s USING (video_id))
    SELECT video_id, n_moves, round(mean_px, 6) AS mean_px, round(p95_px, 6) AS p95_px, round((greatest(0, least(1, 1 - mean_px / 10)) + greatest(0, least(1, 1 - p95_px / 40))) / 2, 6) AS score FROM k""", "words"))
def center_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movement of the words' box from frame to frame."""
    k = F.expr("at_ms div 500")
    boxed = _shown(spark, sf_dir).withColumns({"x0": 100 + (k * 7) % 13, "y0": 40 + (k * 5) % 29, "x1": 300 + (k * 11) % 17, "y1": 90 + (k * 3) % 19})
    rows = scans.center_jitter(boxed)
    return rows.select("video_id", "n_moves", *[F.round(c, 6).alias(c) for c in ("mean_px", "p95_px", "score")])


@register("log_tail", with_views("SELECT run_id, provider, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM attempts WHERE event_id % 50 <> 0 GROUP BY ALL", "attempts"))
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts written as a folder of JSON lines, every fiftieth line broken, and read back by byte positions."""
    path = new_path(spark, "log")
    line = F.to_json(F.struct("event_id", "run_id", "provider", "k"))
    views.attempts(spark, sf_dir).select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    rows, _ = tail.read_since(spark, path, "event_id bigint, run_id bigint, provider string, k bigint")
    return rows.groupBy("run_id", "provider").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@register("cache_hits", with_views("""WITH l AS (SELECT provider AS key, epoch_ms(ts) AS ms, count(*) AS n FROM attempts GROUP BY ALL),
    g AS (SELECT key, list_reduce(list_prepend({'last': -10000000::BIGINT, 'hits': 0::BIGINT, 'n': 0::BIGINT}, list({'last': ms, 'hits': 0::BIGINT, 'n': n} ORDER BY ms)),
          lambda a, x: CASE WHEN x.last - a.last <= 3600000 THEN {'last': a.last, 'hits': a.hits + x.n, 'n': a.n + x.n} ELSE {'last': x.last, 'hits': a.hits + x.n - 1, 'n': a.n + x.n} END) AS r FROM l GROUP BY key)
    SELECT key, r.n AS lookups, r.hits AS hits FROM g""", "attempts"))
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lookups of each provider an hour's cache would have answered."""
    lookups = views.attempts(spark, sf_dir).select(F.col("provider").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return caches.cache_hits(lookups).groupBy("key").agg(F.sum("lookups").alias("lookups"), F.sum("hits").alias("hits"))


@register("word_appearances", with_views(rf"""WITH {_SHOWN}, s AS (SELECT video_id, at_ms, list_filter(string_split_regex(CASE (at_ms // 500) % 4 WHEN 0 THEN text || ' + 30° sqrt' WHEN 1 THEN 'multip lying ' || text || ' 12345 x' ELSE text END, '\s+'), lambda w: w <> '') AS b FROM f WHERE confidence >= 0.3),
    c AS (SELECT video_id, at_ms, list_distinct(list_concat(b,
        list_filter(list_transform(range(1, len(b)), lambda i: CASE WHEN regexp_matches(b[i], '[a-zA-Z]') AND regexp_matches(b[i + 1], '[a-zA-Z]') THEN b[i] || b[i + 1] ELSE '' END), lambda w: length(w) >= 5),
        list_filter(list_transform(range(1, len(b) - 1), lambda i: CASE WHEN regexp_matches(b[i], '[a-zA-Z]') AND regexp_matches(b[i + 1], '[a-zA-Z]') AND regexp_matches(b[i + 2], '[a-zA-Z]') THEN b[i] || b[i + 1] || b[i + 2] ELSE '' END), lambda w: length(w) >= 5))) AS ws FROM s),
    w AS (SELECT video_id, at_ms, unnest(ws) AS w FROM c),
    t AS (SELECT video_id, at_ms, unnest(list_distinct(list_filter([regexp_replace(lower(w), '[^a-z0-9]', '', 'g'), CASE WHEN w = '+' THEN 'plus' WHEN w = '-' THEN 'minus' WHEN w = '=' THEN 'equals' WHEN w = '*' THEN 'times' WHEN w = '/' THEN 'over' WHEN w = '->' THEN 'to' END,
        CASE WHEN lower(w) = 'sqrt' THEN 'sqrt' END, CASE WHEN contains(w, '°') THEN 'degrees' END], lambda x: x IS NOT NULL AND x <> ''))) AS word FROM w)
    SELECT video_id, word, at_ms, count(*) AS n FROM t WHERE (length(word) >= 2 OR word IN ('a', 'i', 'x', 'y', 'z') OR regexp_matches(word, '^[0-9]$')) AND NOT regexp_matches(word, '^[0-9]{{4,}}$') GROUP BY ALL""", "words"))
def word_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that frames show, some with signs and some in pieces."""
    k = F.expr("at_ms div 500") % 4
    text = F.when(k == 0, F.concat("text", F.lit(" + 30° sqrt"))).when(k == 1, F.concat(F.lit("multip lying "), "text", F.lit(" 12345 x"))).otherwise(F.col("text"))
    return shown_words.word_appearances(_shown(spark, sf_dir).withColumn("text", text))


@register("nested_references", """WITH r AS (SELECT conv_id, turn, unnest([{'k': 'ref', 'v': 'conv-' || conv_id}, {'k': 'source_ref', 'v': role}, {'k': 'sourceRef', 'v': 'turn-' || turn}, {'k': 'exact_url_or_redacted_path', 'v': text}]) AS p FROM conversations)
    SELECT DISTINCT conv_id, turn, p.k AS key, p.v AS value FROM r WHERE p.v IS NOT NULL""")
def nested_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in a nested JSON text of every turn."""
    c = table(spark, sf_dir, "conversations")
    inner = F.array(F.struct(F.concat(F.lit("turn-"), F.col("turn")).alias("sourceRef"), F.struct(F.col("text").alias("exact_url_or_redacted_path"), F.col("turn").alias("ref")).alias("deep")))
    doc = F.to_json(F.struct(F.concat(F.lit("conv-"), F.col("conv_id")).alias("ref"), F.array(F.struct(F.col("role").alias("source_ref"), F.array(inner).alias("parts"))).alias("list"), F.col("text").alias("other")))
    return artifacts.collect_references(c.select("conv_id", "turn", doc.alias("doc")), "doc", ["ref", "sourceRef", "source_ref", "exact_url_or_redacted_path"])


_SCORES = ("rhythm", "display", "coverage", "safe_area", "density", "punctuation", "capitalization", "alignment", "placement", "jitter", "style", "redundancy", "segmentation", "confidence", "score")
_CUT = "list_filter(list_transform(string_split({0}, ' '), lambda w: regexp_replace(w, '[^a-z0-9'']', '', 'g')), lambda w: w <> '')"
_ALIKE = """(x[1].l = a[-1].hl OR (x[1].l <> '' AND a[-1].hl <> '' AND ((len(x[1].w) > 0 AND len(a[-1].hw) > 0 AND len(list_filter(x[1].w, lambda z: list_contains(a[-1].hw, z))) / greatest(len(x[1].w), len(a[-1].hw)) >= 0.8)
    OR levenshtein(x[1].l, a[-1].hl) <= 2 OR (levenshtein(x[1].l, a[-1].hl) <= 6 AND 1 - levenshtein(x[1].l, a[-1].hl) / greatest(length(x[1].l), length(a[-1].hl)) >= 0.88))))"""
_HEAD = "'h': {h}, 'hl': {l}, 'hw': {w}, 'hc': {c}"
_ROW = "'ms': x[1].ms, 'c': x[1].c, 'l': x[1].l, 'w': x[1].w, 't': x[1].t, 'x0': x[1].x0, 'y0': x[1].y0, 'x1': x[1].x1, 'y1': x[1].y1"
#: Frames of captions: the shown words, a blank frame in every nineteenth, some in lower case, and their boxes.
_CAPTIONED = f"""{_SHOWN}, e AS (SELECT video_id, at_ms, confidence, CASE WHEN (at_ms // 500) % 19 = 7 THEN ' ' WHEN video_id % 3 = 0 THEN lower(text) ELSE text END AS text FROM f),
    b AS ({_BOXES.replace('FROM f', 'FROM e')}),
    fr AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM b)"""
_SEGMENTS = f"""{_CAPTIONED},
    li AS (SELECT video_id, list({{'ms': at_ms, 'c': confidence, 'l': lower(flat), 'w': {_CUT.format('lower(flat)')}, 't': text, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'h': text, 'hl': lower(flat), 'hw': {_CUT.format('lower(flat)')}, 'hc': confidence, 'run': 1}} ORDER BY at_ms) AS l FROM fr GROUP BY video_id),
    fo AS (SELECT video_id, list_reduce(list_transform(l, lambda r: [r]), lambda a, x: list_append(a, CASE WHEN NOT {_ALIKE} THEN {{{_ROW}, {_HEAD.format(h='x[1].t', l='x[1].l', w='x[1].w', c='x[1].c')}, 'run': a[-1].run + 1}}
          WHEN x[1].c > a[-1].hc THEN {{{_ROW}, {_HEAD.format(h='x[1].t', l='x[1].l', w='x[1].w', c='x[1].c')}, 'run': a[-1].run}} ELSE {{{_ROW}, {_HEAD.format(h='a[-1].h', l='a[-1].hl', w='a[-1].hw', c='a[-1].hc')}, 'run': a[-1].run}} END)) AS g FROM li),
    un AS (SELECT video_id, unnest(g) AS r FROM fo),
    sg AS (SELECT video_id, r.run AS run, min(r.ms) AS start_ms, max(r.ms) + 500 AS end_ms, arg_max(r.h, r.ms) AS text, avg(r.c) AS confidence, count(*) AS n_frames,
           min(r.x0) FILTER (r.l <> '') AS x0, min(r.y0) FILTER (r.l <> '') AS y0, max(r.x1) FILTER (r.l <> '') AS x1, max(r.y1) FILTER (r.l <> '') AS y1 FROM un GROUP BY ALL)"""


def _captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("at_ms div 500")
    text = F.when(k % 19 == 7, " ").when(F.col("video_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    return _shown(spark, sf_dir).withColumns({"text": text, "x0": 100 + (k * 7) % 13, "y0": 40 + (k * 5) % 29, "x1": 300 + (k * 11) % 17, "y1": 90 + (k * 3) % 19})


@register("caption_segments", with_views(f"WITH {_SEGMENTS} SELECT video_id, start_ms, end_ms, text, round(confidence, 6) AS confidence, n_frames, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM sg", "words"))
def caption_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of alike captions in ten-second blocks, with the boxes around them."""
    return scans.caption_segments(_captioned(spark, sf_dir), 500, block_ms=10_000).withColumn("confidence", F.round("confidence", 6))


@register("burned_in_report", with_views(f"""WITH {_SEGMENTS},
    ne AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM sg WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
    s0 AS (SELECT *, (end_ms - start_ms) / 1000 AS s, {_CUT.format('lower(flat)')} AS words, row_number() OVER v AS i, nullif(regexp_extract(text, '[A-Za-z]'), '') AS first, trim(text) AS bare, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
           (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, CAST(y1 - y0 AS DOUBLE) AS height, (y1 - y0) * (x1 - x0) / greatest(1, length(regexp_replace(flat, '\\s+', '', 'g'))) AS area FROM ne WINDOW v AS (PARTITION BY video_id ORDER BY start_ms)),
    s1 AS (SELECT *, len(string_split(flat, ' ')) / s AS wps, regexp_matches(bare, '[.!?…]$') AS stops, lead(first) OVER v AS nf, lead(i) OVER v IS NOT NULL AS has_next, lag(words) OVER v AS bw, lag(i) OVER (PARTITION BY video_id, flat ORDER BY start_ms) AS seen FROM s0 WINDOW v AS (PARTITION BY video_id ORDER BY start_ms)),
    s2 AS (SELECT *, lag(stops) OVER (PARTITION BY video_id ORDER BY start_ms) AS stopped, array_to_string(bw[-2:], ' ') AS l2, array_to_string(bw[-1:], ' ') AS l1, array_to_string(words[1:2], ' ') AS f2, array_to_string(words[1:1], ' ') AS f1 FROM s1),
    ag AS (SELECT video_id, count(*) AS n, sum(s) AS captioned,
           CASE WHEN sum(capitals) / greatest(1, sum(letters)) >= 0.8 THEN 'all_caps' WHEN bool_or(coalesce(first ~ '[A-Z]', false)) AND NOT bool_or(coalesce(first ~ '[a-z]', false)) THEN 'sentence_case' WHEN NOT bool_or(coalesce(first ~ '[A-Z]', false)) AND bool_or(coalesce(first ~ '[a-z]', false)) THEN 'lowercase' ELSE 'mixed' END AS case_style,
           greatest(0, least(1, greatest(0, least(1, 1 - stddev_pop(wps) / 2)) * (1 - count(*) FILTER (wps < 2 OR wps > 4) / count(wps) * 0.5) * (1 - count(*) FILTER (wps < 1 OR wps > 7) / count(wps)))) AS rhythm,
           greatest(0, 1 - count(*) FILTER (s > 0 AND s < 0.5) / count(*) - count(*) FILTER (s > 0 AND (s < 1 OR s > 7)) / count(*) / 2) AS display, greatest(0, 1 - count(*) FILTER (length(bare) > 45) / count(*)) AS density,
           greatest(0, 1 - (count(*) FILTER (bare ~ '.*[a-z].*' AND nf ~ '[A-Z]' AND regexp_matches(bare, '[A-Za-z0-9]$') AND NOT stops) + count(*) FILTER (regexp_matches(text, '[!?]{{2,}}|\\.{{4,}}'))) / count(*)) AS punctuation,
           count(*) FILTER (NOT coalesce(capitals / nullif(letters, 0) >= 0.8, false)) / count(*) AS not_caps, (count(*) FILTER (first ~ '[a-z]' AND coalesce(stopped, true)) + count(*) FILTER (first IS NOT NULL AND regexp_matches(text, '\\bi\\b'))) / count(*) AS not_sentence,
           avg(abs(cx - 200) / 400) AS off, stddev_pop(cx / 400) AS sx, stddev_pop(cy / 200) AS sy, stddev_pop(height) / avg(height) AS ch, stddev_pop(area) / avg(area) AS ca,
           greatest(0, 1 - (count(*) FILTER (seen < i - 1) + count(*) FILTER (coalesce((l2 <> '' AND l2 = f2) OR (l1 <> '' AND l1 = f1), false)) * 0.5) / count(*)) AS redundancy,
           greatest(0, 1 - (count(*) FILTER (words[-1] IN ('and', 'or', 'but', 'so', 'because', 'then') AND has_next) + count(*) FILTER (regexp_matches(bare, '[A-Za-z0-9]$') AND nf ~ '[a-z]')) / count(*)) AS segmentation FROM s2 GROUP BY video_id),
    fa AS (SELECT video_id, greatest(0, least(1, avg(confidence) - stddev_pop(confidence))) AS confidence, greatest(0, least(1, min(least(x0 / 20, (400 - x1) / 20, y0 / 10, (200 - y1) / 10)))) AS safe_area FROM fr WHERE flat <> '' GROUP BY video_id),
    fl AS (SELECT video_id, count(*) FILTER (NOT b AND b1 AND NOT b2 AND greatest(0, s2 - end_ms) <= 500) AS flicker_events FROM (SELECT video_id, end_ms, trim(text) = '' AS b, lead(trim(text) = '') OVER v AS b1, lead(trim(text) = '', 2) OVER v AS b2, lead(start_ms, 2) OVER v AS s2 FROM sg WINDOW v AS (PARTITION BY video_id ORDER BY start_ms)) GROUP BY video_id),
    jp AS (SELECT video_id, at_ms, lower(flat) AS t, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM fr WHERE flat <> ''),
    jn AS (SELECT *, lag(t) OVER v AS u, lag(x) OVER v AS px, lag(y) OVER v AS py FROM jp WINDOW v AS (PARTITION BY video_id ORDER BY at_ms)),
    jw AS (SELECT *, {_CUT.format('t')} AS a, {_CUT.format('u')} AS c, levenshtein(t, u) AS d FROM jn WHERE u IS NOT NULL),
    jm AS (SELECT video_id, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS moved FROM jw WHERE t = u OR len(list_filter(a, lambda z: list_contains(c, z))) / greatest(len(a), len(c), 1) >= 0.8 OR d <= 2 OR (d <= 6 AND 1 - d / greatest(length(t), length(u)) >= 0.88)),
    jt AS (SELECT video_id, (greatest(0, 1 - avg(moved) / 10) + greatest(0, 1 - quantile_cont(moved, 0.95) / 40)) / 2 AS jitter FROM jm GROUP BY video_id),
    vi AS (SELECT video_id, max(at_ms) + 3000 AS duration_ms FROM fr GROUP BY video_id),
    al AS (SELECT vi.video_id, coalesce(n, 0) AS n_segments, coalesce(rhythm, 1) AS rhythm, coalesce(display, 1) AS display, coalesce(least(captioned, duration_ms / 1000) / (duration_ms / 1000), 0) AS coverage, coalesce(safe_area, 1) AS safe_area, coalesce(density, 1) AS density, coalesce(punctuation, 1) AS punctuation,
           coalesce(greatest(0, 1 - CASE case_style WHEN 'all_caps' THEN not_caps WHEN 'sentence_case' THEN not_sentence ELSE 0 END), 1) AS capitalization, coalesce(greatest(0, 1 - off / 0.1), 1) AS alignment, coalesce((greatest(0, 1 - sx / 0.02) + greatest(0, 1 - sy / 0.02)) / 2, 1) AS placement, coalesce(jitter, 1) AS jitter,
           coalesce((greatest(0, 1 - ch / 0.25) + greatest(0, 1 - ca / 0.4)) / 2, 1) AS style, coalesce(redundancy, 1) AS redundancy, coalesce(segmentation, 1) AS segmentation, coalesce(confidence, 0) AS confidence, coalesce(case_style, 'mixed') AS case_style, coalesce(flicker_events, 0) AS flicker_events
           FROM vi LEFT JOIN ag USING (video_id) LEFT JOIN fa USING (video_id) LEFT JOIN fl USING (video_id) LEFT JOIN jt USING (video_id)),
    ov AS (SELECT *, (0.12 * rhythm + 0.08 * display + 0.12 * coverage + 0.1 * safe_area + 0.06 * density + 0.04 * punctuation + 0.03 * capitalization + 0.06 * alignment + 0.06 * placement + 0.08 * jitter + 0.05 * style + 0.05 * redundancy + 0.06 * segmentation + 0.09 * confidence) / 1.0 AS score FROM al)
    SELECT video_id, n_segments, {', '.join(f'round({c}, 6) AS {c}' for c in _SCORES)}, case_style, flicker_events, score >= 0.75 AND coverage >= 0.6 AND flicker_events <= 1 AS passed FROM ov""", "words"))
def burned_in_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sub-scores of every video's captions; frames and segments, which several parts of the report read, are written once."""
    shown = written(_captioned(spark, sf_dir), "captioned")
    videos = shown.groupBy("video_id").agg((F.max("at_ms") + 3000).alias("duration_ms")).withColumns({"width": F.lit(400), "height": F.lit(200)})
    rows = burned_in.burned_in_report(videos, shown, written(scans.caption_segments(shown, 500, block_ms=10_000), "segments"))
    return rows.withColumns({c: F.round(c, 6) for c in _SCORES})


@register("styled_subtitles", with_views(r"""WITH c AS (SELECT video_id, idx // 6 AS seg, idx, word, start_ms, min(start_ms) OVER g AS s0, max(end_ms) OVER g AS s1, lead(start_ms) OVER (PARTITION BY video_id, idx // 6 ORDER BY idx) AS nxt FROM words WHERE start_ms >= 0 WINDOW g AS (PARTITION BY video_id, idx // 6)),
    l AS (SELECT video_id, seg, any_value(s0) AS s0, any_value(s1) AS s1, list({'w': regexp_replace(word, '[{}]', '', 'g'), 'n': length(word), 's': start_ms, 'nx': nxt} ORDER BY idx) AS ws FROM c GROUP BY ALL),
    p AS (SELECT *, list_reduce(list_prepend([{'at': 0, 'used': 0, 'out': 0}], list_transform(ws, lambda w: [{'at': CAST(0 AS INTEGER), 'used': CAST(w.n AS INTEGER), 'out': 0}])), lambda a, x: list_append(a,
          CASE WHEN a[-1].out = 1 THEN a[-1] WHEN (CASE WHEN a[-1].used = 0 THEN x[1].used ELSE a[-1].used + 1 + x[1].used END) <= 21 THEN {'at': a[-1].at, 'used': CASE WHEN a[-1].used = 0 THEN x[1].used ELSE a[-1].used + 1 + x[1].used END, 'out': 0}
               WHEN a[-1].at + 1 < 2 THEN {'at': a[-1].at + 1, 'used': x[1].used, 'out': 0} ELSE {'at': a[-1].at, 'used': a[-1].used, 'out': 1} END))[2:] AS places FROM l),
    k AS (SELECT *, len(list_filter(places, lambda q: q.out = 0)) AS m FROM p),
    e AS (SELECT video_id, seg, s0, s1, ws, places, m, unnest(range(1, m + 1)) AS i FROM k),
    t AS (SELECT video_id, seg, i - 1 AS event, greatest(s0, ws[i].s) AS a, greatest(greatest(s0, ws[i].s) + 1, CASE WHEN i < m THEN ws[i + 1].s ELSE s1 END) AS b,
          array_to_string(list_transform(range(1, m + 1), lambda j: CASE WHEN j = 1 THEN '' WHEN places[j].at <> places[j - 1].at THEN '\N' ELSE '\h' END || CASE WHEN j = i THEN '{\c&H00FFFFFF\3c&H00000000\bord4\1a&H00&}' ELSE '{\c&H008A8A8A\3c&H00000000\bord4\1a&H00&}' END || ws[j].w || '{\r}'), '') AS x FROM e)
    SELECT video_id, seg, CAST(event AS BIGINT) AS event, printf('Dialogue: 0,%d:%02d:%02d.%02d,%d:%02d:%02d.%02d,Default,', a // 3600000, a // 60000 % 60, a // 1000 % 60, a // 10 % 100, b // 3600000, b // 60000 % 60, b // 1000 % 60, b // 10 % 100) || x AS line FROM t""", "words"))
def styled_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that light up each word of six-word captions."""
    words = views.words(spark, sf_dir).where("start_ms >= 0")
    segs = words.groupBy("video_id", F.expr("idx div 6").alias("seg")).agg(F.min("start_ms").alias("s0"), F.max("end_ms").alias("s1"), F.array_sort(F.collect_list(F.struct("idx", F.struct(F.col("word").alias("text"), "start_ms", "end_ms").alias("w")))).alias("l"))
    lines = S.active_word_events(F.col("s0"), F.col("s1"), F.lit(""), F.transform("l", lambda x: x["w"]), S.Style(chars=21))
    return segs.select("video_id", "seg", F.posexplode(lines).alias("event", "line")).withColumn("event", F.col("event").cast("long"))


@register("stress_gate", with_views("""WITH p AS (SELECT run_id, provider, k // 20 AS severity, 1 - avg(latency) / 100 AS v FROM attempts GROUP BY ALL),
    g AS (SELECT *, CASE WHEN lag(v) OVER w - v > 0.005 THEN 1 ELSE 0 END AS rev, rank() OVER (PARTITION BY run_id, provider ORDER BY severity) AS rs,
          rank() OVER (PARTITION BY run_id, provider ORDER BY v) + (count(*) OVER (PARTITION BY run_id, provider, v) - 1) / 2 AS rv FROM p WINDOW w AS (PARTITION BY run_id, provider ORDER BY severity)),
    s AS (SELECT run_id, provider, count(*) AS n, CAST(sum(rev) AS BIGINT) AS reversals, max(v) - min(v) AS effect, CASE WHEN stddev_pop(rv) > 0 AND count(*) > 1 THEN corr(rs, rv) ELSE 0 END AS spearman FROM g GROUP BY ALL)
    SELECT run_id, provider, n, reversals, round(effect, 6) AS effect, round(spearman, 6) AS spearman, effect >= 0.05 AND (reversals = 0 OR (n >= 4 AND spearman + 1e-9 >= 0.9)) AS passed FROM s""", "attempts"))
def stress_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether defects rise with severity for every run and provider: mean latency as the score that falls."""
    attempts = views.attempts(spark, sf_dir).withColumn("severity", F.expr("k div 20"))
    points = windows.ordered_mean(attempts, ["run_id", "provider", "severity"], "latency", "event_id", "v").withColumn("score", F.col("v") / 100).drop("v")
    rows = windows.stress_gate(points, ["run_id", "provider"], "severity", "score")
    return rows.withColumns({"effect": F.round("effect", 6), "spearman": F.round("spearman", 6)})
