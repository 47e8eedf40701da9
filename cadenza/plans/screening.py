"""Queries on evidence contexts, recognised words and inserted blocks, and visuals at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import screening
from cadenza.plans import views
from cadenza.plans.registry import register
from cadenza.plans.views import with_views
from cadenza.sources.tables import table


@register("evidence_context", """WITH e AS (SELECT doc_id % 60 AS topic_id, doc_id AS item_id, left(text, 40) AS title, source, (doc_id * 37 % 101) / 100 AS relevance, CASE WHEN doc_id % 3 > 0 THEN substr(text, 41, doc_id % 400) END AS summary, 'https://' || lang || '/' || doc_id AS url FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY relevance DESC NULLS LAST, item_id) AS r FROM e),
    i AS (SELECT topic_id, count(*) AS n_items, string_agg('- **' || coalesce(title, '') || '** (' || coalesce(source, '') || ', relevance: ' || CAST(round(relevance * 100, 0) AS BIGINT) || '%)' || CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || '  ' || summary ELSE '' END || chr(10) || '  Source: ' || coalesce(url, ''), chr(10) ORDER BY r) AS items FROM r WHERE r <= 10 GROUP BY topic_id),
    a AS (SELECT item_id % 60 AS topic_id, string_agg('- howto: "' || left(text, 20) || '" (hook: "' || substr(text, 21, 10) || '")', chr(10) ORDER BY item_id) AS angles FROM benchmark GROUP BY item_id % 60),
    w AS (SELECT topic_id, n_items, '## Research Evidence' || chr(10) || chr(10) || 'Use these verified facts in your script:' || chr(10) || chr(10) || items || CASE WHEN angles IS NULL THEN '' ELSE chr(10) || chr(10) || '## Suggested Content Angles' || chr(10) || chr(10) || angles END AS w FROM i LEFT JOIN a USING (topic_id))
    SELECT topic_id, n_items, CASE WHEN length(w) > 2500 THEN left(w, 2450) || chr(10) || chr(10) || '[...truncated for length]' ELSE w END AS context FROM w""")
def evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence of sixty topics, benchmark items as their angles."""
    d = table(spark, sf_dir, "documents")
    evidence = d.select(
        (F.col("doc_id") % 60).alias("topic_id"), F.col("doc_id").alias("item_id"), F.substring("text", 1, 40).alias("title"), "source", (F.col("doc_id") * 37 % 101 / 100).alias("relevance"),
        F.when(F.col("doc_id") % 3 > 0, F.substring(F.col("text"), F.lit(41), (F.col("doc_id") % 400).cast("int"))).alias("summary"), F.concat(F.lit("https://"), "lang", F.lit("/"), "doc_id").alias("url"))
    angles = table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") % 60).alias("topic_id"), F.col("item_id").alias("rank"), F.lit("howto").alias("archetype"), F.substring("text", 1, 20).alias("angle"), F.substring("text", 21, 10).alias("hook"))
    return screening.evidence_context(evidence, angles)


_PRE, _POST = ["", "(", "«", "@", "x)", "##", ""], ["", "!", "…", ")", "+", "%%"]
_ODD = r"regexp_replace(regexp_replace({0}, '\s+', '', 'g'), '[a-zA-Z0-9.,!?''\"\\:-]', '', 'g')"


@register("kept_shown_words", with_views(rf"""WITH s AS (SELECT video_id, idx, {_PRE}[idx % 7 + 1] || CASE idx % 9 WHEN 0 THEN CAST(idx % 3000 AS VARCHAR) WHEN 1 THEN upper(replace(left(word, 3), 'ß', 's')) ELSE word END || {_POST}[idx % 6 + 1] AS text, CASE WHEN idx % 10 > 0 THEN confidence END AS confidence FROM asr_words),
    t AS (SELECT video_id, idx, confidence, trim(regexp_replace(regexp_replace(trim(text), '^[^a-zA-Z0-9@#/]+|[^a-zA-Z0-9!?.,''"@/#:+-]+$', '', 'g'), '\s+', ' ', 'g')) AS t FROM s),
    c AS (SELECT *, length(regexp_replace(t, '\s+', '', 'g')) AS n, length(regexp_replace(t, '[^a-zA-Z0-9]', '', 'g')) AS p, length({_ODD.format('t')}) AS o FROM t)
    SELECT video_id, idx, t AS text, confidence FROM c WHERE n >= 2 AND p / greatest(n, 1) >= 0.4 AND o / greatest(n, 1) <= 0.35 AND regexp_matches(t, '[a-zA-Z0-9]') AND NOT regexp_matches(t, '^[0-9]{{1,4}}\+?$') AND NOT regexp_matches(t, '^[a-zA-Z]?\)[0-9]{{1,4}}\+?$')
      AND NOT (regexp_matches(t, '^[A-Z]{{2,4}}$') AND coalesce(confidence, 0) < 0.8) AND NOT coalesce(confidence < 0.25, false)""", "asr_words"))
def kept_shown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heard words as recognised ones, with signs around them, numbers and capitals among them."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.col("idx") % k + 1).cast("int"))
    word = F.when(F.col("idx") % 9 == 0, (F.col("idx") % 3000).cast("string")).when(F.col("idx") % 9 == 1, F.upper(F.replace(F.substring("word", 1, 3), F.lit("ß"), F.lit("s")))).otherwise(F.col("word"))
    rows = views.asr_words(spark, sf_dir).select("video_id", "idx", F.concat(pick(_PRE, 7), word, pick(_POST, 6)).alias("text"), F.when(F.col("idx") % 10 > 0, F.col("confidence")).alias("confidence"))
    return screening.kept_words(rows)


@register("shown_blocks", rf"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f]+'), lambda x: x <> '') AS ws, turn % 2 = 0 AS generic, CASE WHEN turn % 5 > 0 THEN (turn * 7 % 20) / 100 END AS area, (conv_id * 13 % 100) / 100 AS quality FROM conversations),
    r AS (SELECT *, length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS letters, length(regexp_replace(text, '\s+', '', 'g')) AS n, length({_ODD.format('text')}) AS o, len(list_filter(ws, lambda w: regexp_matches(w, '[a-zA-Z0-9]'))) AS re,
          len(list_filter(range(1, len(ws) + 1), lambda i: regexp_matches(ws[i], '[a-zA-Z0-9]') AND ((i - 1) * 13 % 100) / 100 >= 0.45)) AS sure FROM t)
    SELECT conv_id, turn, CASE WHEN generic THEN letters BETWEEN 24 AND 700 AND re >= 5 AND sure >= 4 AND coalesce(area, 1) >= 0.06 AND quality >= 0.35 AND letters / greatest(n, 1) >= 0.55 AND o / greatest(n, 1) <= 0.2 ELSE letters >= 12 AND re >= 3 AND quality >= 0.2 END AS shown FROM r""")
def shown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the text of inserted blocks, every second one generic."""
    words = F.transform(T.words(F.col("text")), lambda w, i: F.struct(w.alias("text"), (i * 13 % 100 / 100).alias("confidence")))
    kind = F.when(F.col("turn") % 2 == 0, "generic_screenshot").otherwise("chat")
    shown = screening.is_worth_showing(kind, F.col("text"), words, F.when(F.col("turn") % 5 > 0, F.col("turn") * 7 % 20 / 100), F.col("conv_id") * 13 % 100 / 100)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", shown.alias("shown"))


@register("risky_visuals", """WITH v AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'image' END AS kind, CASE page_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'pan' END AS motion, CASE WHEN page_id % 7 > 0 THEN page_id * 31 % 1920 END AS w, CASE WHEN page_id % 11 > 0 THEN page_id * 17 % 1920 END AS h,
      CASE WHEN page_id % 2 = 0 THEN (page_id % 50) / 50 END AS c, CASE WHEN page_id % 5 = 0 THEN (page_id % 30) / 30 END AS s FROM pages)
    SELECT page_id, coalesce(kind = 'image' AND motion = 'none', false) AS still, coalesce(w >= h, false) AS not_portrait, round(greatest(c, s), 6) AS confidence FROM v""")
def risky_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as visuals: stills without motion, clips that are no portraits, and what is known of the match."""
    p = F.col("page_id")
    kind = F.when(p % 4 == 0, "image").when(p % 4 == 1, "video").when(p % 4 == 2, "image")
    motion = F.when(p % 3 == 0, "none").when(p % 3 == 1, "pan")
    return table(spark, sf_dir, "pages").select(
        "page_id", screening.still_without_motion(kind, motion).alias("still"), screening.not_portrait(F.when(p % 7 > 0, p * 31 % 1920), F.when(p % 11 > 0, p * 17 % 1920)).alias("not_portrait"),
        F.round(screening.match_confidence(F.when(p % 2 == 0, p % 50 / 50), F.when(p % 5 == 0, p % 30 / 30)), 6).alias("confidence"))
