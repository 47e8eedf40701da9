"""Queries on rewritten word streams and on blueprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators import blueprint, spec
from cadenza.operators import word_streams as W
from cadenza.plans import views
from cadenza.plans.analytics import _SHOT_SQL, _shots
from cadenza.plans.registry import register
from cadenza.plans.views import with_views

#: Every sixth word is heard in pieces, one of these in turn.
PIECES = [["Str", "uggling"], ["It", "'s"], ["z", "Z"], ["pro", "Gram"], ["Eve", "rything"], ["xq", "risk"], ["R", "isk"], ["Som", "ething"], ["at", "risk"]]
_quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_PIECES = ", ".join(f"[{_quoted(p)}]" for p in PIECES)
_HEARD = f"""p AS (SELECT video_id, idx, start_ms, end_ms, confidence, CASE WHEN idx % 6 = 0 THEN [{_PIECES}][(idx // 6) % {len(PIECES)} + 1] ELSE [word] END AS ws FROM asr_words),
    h AS (SELECT video_id, idx * 2 + k - 1 AS idx, ws[k] AS word, start_ms + (end_ms - start_ms) * (k - 1) // len(ws) AS start_ms, start_ms + (end_ms - start_ms) * k // len(ws) AS end_ms, confidence
          FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM p))"""


def _pairs_sql(name: str, source: str, match: str, word: str, confidence: str) -> str:
    """Words of ``source`` joined with the next one where ``match`` holds: of overlapping matches every second one counts."""
    return f"""{name}0 AS (SELECT *, lead(word) OVER v AS w1, lead(end_ms) OVER v AS e1, lead(confidence) OVER v AS c1, row_number() OVER v AS pos FROM {source} WINDOW v AS (PARTITION BY video_id ORDER BY idx)),
    {name}1 AS (SELECT *, coalesce({match}, false) AS m FROM {name}0),
    {name}2 AS (SELECT *, m AND (pos - coalesce(max(CASE WHEN NOT m THEN pos END) OVER (PARTITION BY video_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS j FROM {name}1),
    {name}3 AS (SELECT *, coalesce(lag(j) OVER (PARTITION BY video_id ORDER BY idx), false) AS gone FROM {name}2),
    {name} AS (SELECT video_id, idx, CASE WHEN j THEN {word} ELSE word END AS word, start_ms, CASE WHEN j THEN e1 ELSE end_ms END AS end_ms, CASE WHEN j THEN {confidence} ELSE confidence END AS confidence FROM {name}3 WHERE NOT gone)"""


_KNOWN = "MAP {" + ", ".join(f"'{a} {b}': '{whole}'" for a, rest in W.SPLIT_WORDS.items() for b, whole in rest.items()) + "}"
_KNOWN_AT = f"{_KNOWN}[word || ' ' || lower(w1)]"
_REPAIRED = f"""{_HEARD}, {_pairs_sql('a', 'h', f"{_KNOWN_AT} IS NOT NULL OR (regexp_matches(word, '^[A-Z][a-z]{{0,2}}$') AND regexp_matches(w1, '^[a-z]{{4,}}$') AND lower(word || w1) IN ({_quoted(W.LIKELY_SPLIT)}))",
    f"coalesce({_KNOWN_AT}, upper(word[1]) || lower(word[2:]) || lower(w1))", f"CASE WHEN {_KNOWN_AT} IS NOT NULL THEN greatest((coalesce(confidence, 1) + coalesce(c1, 1)) / 2, 0.8) ELSE least(coalesce(confidence, 1), coalesce(c1, 1)) END")},
    {_pairs_sql('b', 'a', f"w1 IN ({_quoted(W.CONTRACTIONS)})", "word || w1", "least(coalesce(confidence, 1), coalesce(c1, 1))")},
    c0 AS (SELECT *, CASE WHEN regexp_matches(word, '^[a-zA-Z]$') THEN lower(word) END AS letter FROM b),
    c1 AS (SELECT *, CASE WHEN letter IS NULL OR letter IS DISTINCT FROM lag(letter) OVER (PARTITION BY video_id ORDER BY idx) THEN 1 ELSE 0 END AS fresh FROM c0),
    c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM c1),
    c AS (SELECT video_id, min(idx) AS idx, string_agg(word, '' ORDER BY idx) AS word, arg_min(start_ms, idx) AS start_ms, arg_max(end_ms, idx) AS end_ms, CASE WHEN count(*) = 1 THEN min(confidence) ELSE min(coalesce(confidence, 1)) END AS confidence FROM c2 GROUP BY video_id, run),
    d AS (SELECT * FROM c WHERE NOT (regexp_matches(trim(word), '^[a-zA-Z]$') AND trim(word) NOT IN ({_quoted(W.ONE_LETTER)})) AND NOT (regexp_matches(trim(word), '^[a-zA-Z]{{2}}$') AND lower(trim(word)) NOT IN ({_quoted(W.TWO_LETTERS)}))),
    e0 AS (SELECT *, lag(end_ms) OVER v AS pe, lead(start_ms) OVER v AS ns FROM d WINDOW v AS (PARTITION BY video_id ORDER BY idx)),
    e AS (SELECT video_id, idx, word, confidence, CASE WHEN start_ms < pe THEN (pe + start_ms) / 2 ELSE start_ms END AS start_ms, CASE WHEN ns < end_ms THEN (end_ms + ns) / 2 ELSE end_ms END AS end_ms FROM e0),
    f0 AS (SELECT *, greatest(0, 50 - (end_ms - start_ms)) AS lacks, lead(start_ms) OVER (PARTITION BY video_id ORDER BY idx) AS ns FROM e),
    f1 AS (SELECT *, CASE WHEN lacks > 0 AND ns IS NOT NULL THEN greatest(0, lacks - (ns - end_ms)) ELSE 0 END AS over FROM f0),
    f AS (SELECT *, coalesce(sum(over) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM f1)"""


@register("repaired_hearing", with_views(f"""WITH {_REPAIRED.replace(' AS over FROM', ' AS more FROM').replace('sum(over)', 'sum(more)')}
    SELECT video_id, idx, word, round(start_ms + shift, 3) AS start_ms, round(end_ms + shift + lacks, 3) AS end_ms, round(confidence, 6) AS confidence FROM f""", "asr_words"))
def repaired_hearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heard words, every sixth in pieces, put together and mended."""
    pieces = F.array(*[F.array(*map(F.lit, p)) for p in PIECES])
    ws = F.when(F.col("idx") % 6 == 0, F.element_at(pieces, (F.expr("idx div 6") % len(PIECES) + 1).cast("int"))).otherwise(F.array("word"))
    rows = views.asr_words(spark, sf_dir).withColumn("n", F.size(ws)).select("video_id", "idx", "start_ms", "end_ms", "confidence", "n", F.posexplode(ws).alias("k", "word"))
    at = lambda k: F.expr(f"start_ms + (end_ms - start_ms) * {k} div n")
    heard = rows.select("video_id", (F.col("idx") * 2 + F.col("k")).alias("idx"), "word", at("k").alias("start_ms"), at("(k + 1)").alias("end_ms"), "confidence")
    out = W.repaired_hearing(heard)
    return out.select("video_id", "idx", "word", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), F.round("confidence", 6).alias("confidence"))


#: Signs in turn in place of two words of three.
SIGNS = ["^", "<", "-", ">", "=", "sqrt", "(", "_", "!"]


@register("joined_notation", with_views(f"""WITH s AS (SELECT video_id, idx, CASE WHEN idx % 3 = 0 AND idx % 4 < 3 THEN regexp_replace(word, '[^a-zA-Z0-9]', '', 'g') ELSE {SIGNS}[(idx * idx + video_id) % {len(SIGNS)} + 1] END AS word, start_ms, end_ms FROM words),
    l AS (SELECT *, lead(word) OVER v AS b, lead(word, 2) OVER v AS c, lead(end_ms) OVER v AS e1, lead(end_ms, 2) OVER v AS e2 FROM s WINDOW v AS (PARTITION BY video_id ORDER BY idx)),
    m AS (SELECT *, CASE WHEN lower(word) = 'sqrt' AND b = '(' THEN {{'n': 2, 'w': 'sqrt('}} WHEN b IN ('^', '_') AND regexp_matches(word, '^[a-zA-Z0-9]+$') AND regexp_matches(c, '^[a-zA-Z0-9]+$') THEN {{'n': 3, 'w': word || b || c}}
          WHEN word = '<' AND b = '-' AND c = '>' THEN {{'n': 3, 'w': '<->'}} WHEN (word = '-' AND b = '>') OR (word IN ('<', '>', '!') AND b = '=') THEN {{'n': 2, 'w': word || b}} ELSE {{'n': 1, 'w': word}} END AS m FROM l),
    g AS (SELECT video_id, list_reduce(list_prepend([{{'idx': CAST(-1 AS BIGINT), 'word': '', 's': CAST(0 AS BIGINT), 'e': CAST(0 AS BIGINT), 'free': CAST(0 AS BIGINT), 'kept': false}}], list([{{'idx': idx, 'word': m.w, 's': start_ms, 'e': CASE m.n WHEN 3 THEN e2 WHEN 2 THEN e1 ELSE end_ms END, 'free': CAST(m.n AS BIGINT), 'kept': true}}] ORDER BY idx)),
          lambda a, x: list_append(a, CASE WHEN a[-1].free <= 1 THEN x[1] ELSE {{'idx': x[1].idx, 'word': x[1].word, 's': x[1].s, 'e': x[1].e, 'free': a[-1].free - 1, 'kept': false}} END)) AS g FROM m GROUP BY video_id)
    SELECT video_id, r.idx AS idx, r.word AS word, r.s AS start_ms, r.e AS end_ms FROM (SELECT video_id, unnest(g) AS r FROM g) WHERE r.kept""", "words"))
def joined_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words among signs of formulas that were told apart."""
    sign = F.element_at(F.array(*map(F.lit, SIGNS)), ((F.col("idx") * F.col("idx") + F.col("video_id")) % len(SIGNS) + 1).cast("int"))
    word = F.when((F.col("idx") % 3 == 0) & (F.col("idx") % 4 < 3), F.regexp_replace("word", "[^a-zA-Z0-9]", "")).otherwise(sign)
    return W.join_notation(views.words(spark, sf_dir).withColumn("word", word))


_VIDEOS = f"""{_SHOT_SQL}, d AS (SELECT video_id, max(end_ms) AS d, CASE WHEN count(*) >= 2 THEN min(end_ms) END AS c FROM shots GROUP BY video_id),
    arc AS (SELECT video_id, CASE WHEN d >= 500 THEN greatest(500, least(coalesce(c, CAST(floor(d * 0.2) AS BIGINT)), 3000, d)) ELSE least(coalesce(c, CAST(floor(d * 0.2) AS BIGINT)), 3000, d) END AS hook_end_ms, d FROM d),
    videos AS (SELECT video_id, hook_end_ms, hook_end_ms + 4000 AS escalation_start_ms, least(greatest(hook_end_ms, CAST(floor(d * 0.75) AS BIGINT)), d) AS payoff_start_ms, video_id % 2 = 0 AS has_cta, ['talking_head', 'montage', 'vlog'][video_id % 3 + 1] AS format FROM arc),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) AS shot_id, count(*) OVER (PARTITION BY video_id) AS n FROM shots)"""


@register("scene_slots", with_views(f"""WITH {_VIDEOS},
    cap AS (SELECT video_id, start_ms + 100 AS c0, start_ms + 900 AS c1 FROM numbered WHERE shot_id % 3 = 0), blk AS (SELECT video_id, start_ms + 500 AS b0, end_ms + 700 AS b1 FROM numbered WHERE shot_id % 7 = 0)
    SELECT s.video_id, shot_id, CASE WHEN start_ms < hook_end_ms AND end_ms <= hook_end_ms + 1000 THEN 'hook' WHEN shot_id = n AND has_cta THEN 'cta' WHEN start_ms >= payoff_start_ms - 1000 THEN CASE WHEN shot_id = n THEN 'outro' ELSE 'climax' END
        WHEN start_ms >= escalation_start_ms THEN 'escalation' ELSE 'point' END AS role,
      round(greatest(0.5, seconds * 0.7), 6) AS least_s, round(seconds * 1.3, 6) AS most_s,
      CASE WHEN EXISTS (SELECT 1 FROM blk WHERE blk.video_id = s.video_id AND b0 < end_ms AND b1 > start_ms) THEN 'inserted_content' WHEN format = 'talking_head' THEN 'talking_head' WHEN format = 'montage' THEN 'stock_footage' ELSE 'b_roll' END AS visual_type,
      EXISTS (SELECT 1 FROM cap WHERE cap.video_id = s.video_id AND c0 < end_ms AND c1 > start_ms) AS has_captions,
      CASE WHEN shot_id % 5 > 0 THEN ['static', 'zoom_in', 'pan', 'mixed'][shot_id % 5] END AS camera_motion
    FROM numbered s JOIN videos USING (video_id)""", "cuts"))
def scene_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of all shots between the cuts of an event log."""
    w = Window.partitionBy("video_id")
    shots = _shots(spark, sf_dir).withColumns({"shot_id": F.row_number().over(w.orderBy("start_ms")).cast("long"), "n": F.count("*").over(w)}).withColumn("is_last", F.col("shot_id") == F.col("n"))
    lengths = shots.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"), F.when(F.count("*") >= 2, F.min("end_ms")).alias("first_cut_ms"))
    videos = spec.narrative_arc(lengths).select(
        "video_id", "hook_end_ms", (F.col("hook_end_ms") + 4000).alias("escalation_start_ms"), "payoff_start_ms", (F.col("video_id") % 2 == 0).alias("has_cta"),
        F.element_at(F.array(*map(F.lit, ["talking_head", "montage", "vlog"])), (F.col("video_id") % 3 + 1).cast("int")).alias("format"))
    captions = shots.where("shot_id % 3 = 0").select("video_id", (F.col("start_ms") + 100).alias("start_ms"), (F.col("start_ms") + 900).alias("end_ms"))
    blocks = shots.where("shot_id % 7 = 0").select("video_id", (F.col("start_ms") + 500).alias("start_ms"), (F.col("end_ms") + 700).alias("end_ms"))
    moves = F.element_at(F.array(*map(F.lit, ["static", "zoom_out", "pan_left", "shake"])), (F.col("shot_id") % 5).cast("int"))
    motion = shots.where("shot_id % 5 > 0").select("video_id", "shot_id", moves.alias("motion"))
    rows = blueprint.scene_slots(shots, videos, captions, blocks, motion)
    return rows.withColumns({"least_s": F.round("least_s", 6), "most_s": F.round("most_s", 6)})


@register("blueprint_compliance", with_views("""WITH s AS (SELECT doc_id AS script_id, doc_id % 7 AS blueprint_id, list_transform(scenes, lambda x: len(list_filter(string_split_regex(x, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) / 2.5) AS secs, scenes,
        CASE WHEN doc_id % 3 = 0 THEN 'hook' WHEN doc_id % 3 = 1 THEN ' ' END AS hook, CASE WHEN doc_id % 4 = 0 THEN 'follow' END AS cta FROM scripts),
    b AS (SELECT range AS blueprint_id, range + 1 AS n_slots, 12 * (range + 1)::DOUBLE AS target_s, range * 1.5 AS hook_s, range % 2 = 0 AS has_cta, ['very_fast', 'fast', 'moderate', 'slow', NULL][range % 5 + 1] AS pace FROM range(7)),
    j AS (SELECT *, len(scenes) AS n, coalesce(list_sum(secs), 0) AS s, CASE WHEN len(scenes) > 0 THEN list_sum(secs) / len(scenes) ELSE 0 END AS mean FROM s JOIN b USING (blueprint_id)),
    p AS (SELECT *, abs(s - target_s) / target_s AS ratio, CASE WHEN mean < 1 THEN 1 WHEN mean < 2 THEN 2 WHEN mean < 4 THEN 3 ELSE 4 END AS place, list_position(['very_fast', 'fast', 'moderate', 'slow'], pace) AS wanted FROM j),
    c AS (SELECT script_id, blueprint_id, CASE WHEN n = n_slots THEN 'pass' WHEN abs(n - n_slots) <= 1 THEN 'warn' ELSE 'fail' END AS scene_count, CASE WHEN ratio <= 0.1 THEN 'pass' WHEN ratio <= 0.25 THEN 'warn' ELSE 'fail' END AS duration,
        CASE WHEN NOT has_cta OR coalesce(trim(cta), '') <> '' THEN 'pass' WHEN n > 0 AND len(list_filter(['follow', 'subscribe', 'like', 'comment', 'share', 'check out', 'link'], lambda w: contains(lower(scenes[-1]), w))) > 0 THEN 'warn' ELSE 'fail' END AS cta,
        CASE WHEN hook_s <= 0 OR coalesce(trim(hook), '') <> '' THEN 'pass' WHEN n > 0 AND secs[1] <= hook_s * 2 THEN 'warn' ELSE 'fail' END AS hook,
        CASE WHEN pace IS NULL OR place = wanted THEN 'pass' WHEN abs(place - wanted) <= 1 THEN 'warn' ELSE 'fail' END AS pacing FROM p),
    t AS (SELECT *, [scene_count, duration, cta, hook, pacing] AS l FROM c)
    SELECT script_id, blueprint_id, scene_count, duration, cta, hook, pacing, len(list_filter(l, lambda x: x = 'pass')) AS n_pass, len(list_filter(l, lambda x: x = 'warn')) AS n_warn, len(list_filter(l, lambda x: x = 'fail')) AS n_fail FROM t""", "scripts"))
def blueprint_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scripts against seven blueprints."""
    scenes = F.transform("scenes", lambda x: F.struct(x.alias("text"), F.lit(None).cast("double").alias("duration_s")))
    scripts = views.scripts(spark, sf_dir).select(
        F.col("doc_id").alias("script_id"), (F.col("doc_id") % 7).alias("blueprint_id"), F.when(F.col("doc_id") % 3 == 0, "hook").when(F.col("doc_id") % 3 == 1, " ").alias("hook"),
        F.when(F.col("doc_id") % 4 == 0, "follow").alias("cta"), F.lit(None).cast("double").alias("duration_s"), scenes.alias("scenes"))
    k = F.col("id")
    paces = F.element_at(F.array(*map(F.lit, [*blueprint.PACES, None])), (k % 5 + 1).cast("int"))
    prints = spark.range(7).select(k.alias("blueprint_id"), (k + 1).alias("n_slots"), (12.0 * (k + 1)).alias("target_s"), (k * 1.5).alias("hook_s"), (k % 2 == 0).alias("has_cta"), paces.alias("pace"))
    rows = blueprint.compliance(scripts, prints)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("n_pass", "n_warn", "n_fail")})
