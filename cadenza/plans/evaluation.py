"""Queries on engagement, paging, segments, visual plans, heuristic quality and small report rules."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import captions as C
from cadenza.functions import scores as S
from cadenza.functions import text as T
from cadenza.operators import evaluation as E
from cadenza.operators import retrieval
from cadenza.plans import views
from cadenza.plans.registry import register
from cadenza.plans.views import with_views
from cadenza.sources.tables import table


def _counted(column: str, patterns: tuple[str, ...]) -> str:
    """SQL that counts the patterns found in a column."""
    return " + ".join("CAST(regexp_matches({}, '{}') AS INT)".format(column, p.replace("'", "''")) for p in patterns)


@register("engagement_quality", with_views(f"""WITH sc AS (SELECT video_id, scene_id, string_agg(word, ' ' ORDER BY idx) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM words GROUP BY ALL),
    r AS (SELECT *, (end_ms - start_ms) / 1000 AS length, avg((end_ms - start_ms) / 1000) OVER (PARTITION BY video_id) AS mean_s FROM sc),
    v AS (SELECT video_id, string_split(arg_min(text, scene_id), '.')[1] AS hook, arg_max(text, scene_id) AS cta, arg_min(start_ms, scene_id) / 1000 AS hook_s, arg_max(start_ms, scene_id) / 1000 AS cta_s,
        (arg_max(end_ms, scene_id) - arg_min(start_ms, scene_id)) / 1000 AS total_s, max(mean_s) AS mean_s, count(*) AS n_scenes, count(*) FILTER ({_counted('text', E.NUMBER_PATTERNS)} > 0) AS numbered,
        max(abs(length - mean_s)) AS apart FROM r GROUP BY video_id),
    k AS (SELECT *, len(list_filter(string_split_regex(hook, '\\s+'), lambda x: x <> '')) AS hw, least(100, 50 + 25 * ({_counted('hook', E.HOOK_PATTERNS)})) AS h0, {_counted('cta', E.CTA_PATTERNS)} AS found,
        CASE WHEN total_s > 0 THEN cta_s / total_s ELSE 0 END AS place, CASE WHEN n_scenes < 3 THEN 60 WHEN n_scenes > 10 THEN 80 ELSE 100 END AS flow FROM v),
    s AS (SELECT *, CASE WHEN hook_s <= 3 THEN 100.0::DOUBLE ELSE greatest(0, 100 - (hook_s - 3) * 20) END AS a, CAST(CASE WHEN hw <= 4 THEN least(100, least(100, h0 + 10) + 10) WHEN hw <= 6 THEN least(100, h0 + 10) ELSE h0 END AS DOUBLE) AS b,
        CAST(CASE WHEN found > 0 THEN least(100, 50 + 25 * found) ELSE 0 END AS DOUBLE) AS c, CASE WHEN place >= 0.85 THEN 100.0::DOUBLE ELSE greatest(0, place * 100) END AS d,
        CASE WHEN numbered = 0 THEN 100.0::DOUBLE ELSE least(100, numbered / greatest(3, n_scenes - 2) * 100) END AS e, CAST(CASE WHEN mean_s > 0 AND apart > mean_s * 2 THEN greatest(60, flow - 20) ELSE flow END AS DOUBLE) AS f FROM k)
    SELECT video_id, n_scenes, numbered, round(a, 6) AS hook_timing, round(b, 6) AS hook_engagement, round(c, 6) AS cta_presence, round(d, 6) AS cta_timing, round(e, 6) AS list_structure, round(f, 6) AS progression,
      round(0.2::DOUBLE * a + 0.15::DOUBLE * b + 0.2::DOUBLE * c + 0.1::DOUBLE * d + 0.2::DOUBLE * e + 0.15::DOUBLE * f, 6) AS score FROM s""", "words"))
def engagement_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]))
    scenes = views.words(spark, sf_dir).groupBy("video_id", "scene_id").agg(joined.alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return E.engagement_quality(scenes)


@register("paging_quality", with_views("""WITH l AS (SELECT video_id, idx // 4 AS page, (idx % 4) // 2 AS line, sum(length(word)) + count(*) - 1 AS chars, count(*) AS n, max(idx) AS i, arg_max(word, idx) AS w FROM words GROUP BY ALL),
    p AS (SELECT video_id, page, sum(n) AS n, arg_max(w, i) AS w, sum(chars) AS chars, count(*) AS lines, count(*) > 1 AND min(chars) < max(chars) * 0.5 AS uneven FROM l GROUP BY ALL),
    v AS (SELECT video_id, count(*) AS n_pages, avg(n) AS mw, stddev_pop(n) AS sd, avg(CAST(regexp_matches(w, '[.!?,;:]$') AS DOUBLE)) AS nat, sum(chars) / sum(lines) AS mc, count(*) FILTER (uneven) AS n_uneven FROM p GROUP BY video_id),
    s AS (SELECT *, round(greatest(0, least(1, 0.25::DOUBLE * CASE WHEN mw BETWEEN 3 AND 5 THEN 1 WHEN mw BETWEEN 2 AND 7 THEN 0.6 ELSE 0.2 END + 0.2::DOUBLE * greatest(0, least(1, 1 - sd / 2.5)) + 0.25::DOUBLE * greatest(0, least(1, nat / 0.5))
      + 0.15::DOUBLE * CASE WHEN mc BETWEEN 12 AND 28 THEN 1 WHEN mc BETWEEN 8 AND 34 THEN 0.6 ELSE 0.2 END + 0.15::DOUBLE * greatest(0, least(1, 1 - n_uneven / n_pages / 0.25)))), 6) AS score FROM v)
    SELECT video_id, n_pages, round(mw, 6) AS mean_words, round(sd, 6) AS sd_words, round(nat, 6) AS natural, round(mc, 6) AS mean_chars, n_uneven, score, score >= 0.75 AS passed FROM s""", "words"))
def paging_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four words on two lines."""
    return E.paging_quality(views.words(spark, sf_dir).withColumns({"page": F.expr("idx div 4"), "line": F.expr("idx % 4 div 2")}))


_SEGMENTS = """g AS (SELECT video_id, idx // 5 AS seg, string_agg(word, ' ' ORDER BY idx) AS text, count(*) AS n_words, min(start_ms) AS start_ms, max(end_ms) AS end_ms, avg(confidence) AS confidence FROM asr_words GROUP BY ALL)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heard words in captions of five places."""
    joined = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]))
    return views.asr_words(spark, sf_dir).groupBy("video_id", F.expr("idx div 5").alias("seg")).agg(
        joined.alias("text"), F.count("*").alias("n_words"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.avg("confidence").alias("confidence"))


@register("segment_quality", with_views(f"""WITH {_SEGMENTS}, m AS (SELECT *, greatest(0, end_ms - start_ms) AS ms, length(regexp_replace(text, '\\s+', '', 'g')) AS chars FROM g),
    c AS (SELECT *, CASE WHEN ms > 0 THEN chars / (ms / 1000) END AS cps FROM m),
    s AS (SELECT *, 0.45::DOUBLE * coalesce(CASE WHEN cps <= 18 THEN 1 ELSE 18 / cps END, 0) + 0.25::DOUBLE * CASE WHEN ms >= 700 THEN 1 ELSE ms / 700 END + 0.2::DOUBLE * CASE WHEN n_words <= 7 THEN 1 ELSE 7 / n_words END + 0.1::DOUBLE * CASE WHEN confidence >= 0.5 THEN 1 ELSE confidence / 0.5 END AS s FROM c),
    v AS (SELECT video_id, count(*) AS n_segments, round(coalesce(max(cps), 0), 6) AS max_cps, min(ms) AS shortest_ms, max(n_words) AS most_words, count(*) FILTER (confidence < 0.5) AS doubtful, count(*) FILTER (cps IS NULL OR cps > 18) AS errors,
      floor(round(avg(s) * 1000, 6) + 0.5) / 1000 AS score FROM s GROUP BY video_id)
    SELECT *, errors = 0 AND score >= 0.85 AS passed FROM v""", "asr_words"))
def segment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.segment_quality(_segments(spark, sf_dir))


@register("visual_quality", """WITH a AS (SELECT l_orderkey AS video_id, CASE WHEN l_returnflag = 'R' THEN 'fallback-color' ELSE 'stock' END AS source, CASE WHEN l_linestatus = 'O' THEN 'image' ELSE 'video' END AS asset_type,
      CASE WHEN l_suppkey % 3 = 0 THEN 'none' ELSE 'pan' END AS motion, greatest(CASE WHEN l_partkey % 5 <> 0 THEN l_discount * 10 END, CASE WHEN l_partkey % 4 = 0 THEN l_tax * 12 END) AS sure, l_quantity AS seconds,
      CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS INT) * 20 END AS width, 600 AS height FROM lineitem),
    s AS (SELECT video_id, count(*) AS n, count(*) FILTER (source = 'fallback-color') AS fallbacks, sum(seconds) AS seconds, count(*) FILTER (sure < 0.55) AS doubtful, count(*) FILTER (asset_type = 'image' AND motion = 'none') AS still,
      count(width) AS clips, count(*) FILTER (width >= height) AS wide FROM a GROUP BY video_id),
    r AS (SELECT o_orderkey AS video_id, o_totalprice / 1500 AS target_s, coalesce(n, 0) AS n, coalesce(fallbacks, 0) AS fallbacks, coalesce(seconds, 0) AS seconds, coalesce(doubtful, 0) AS doubtful, coalesce(still, 0) AS still, coalesce(clips, 0) AS clips, coalesce(wide, 0) AS wide
      FROM orders LEFT JOIN s ON video_id = o_orderkey),
    c AS (SELECT *, CASE WHEN n > 0 THEN fallbacks / n ELSE 1 END AS rate, CASE WHEN target_s > 0 THEN greatest(0, least(1, seconds / target_s)) ELSE 1 END AS cover FROM r),
    t AS (SELECT *, floor(round((0.3::DOUBLE * CASE WHEN rate <= 0.25 THEN 1 ELSE greatest(0, least(1, 1 - (rate - 0.25) / 0.75)) END + 0.25::DOUBLE * CASE WHEN cover >= 0.95 THEN 1 ELSE cover / 0.95 END + 0.2::DOUBLE * CASE WHEN n > 0 THEN 1 - doubtful / n ELSE 0 END
      + 0.15::DOUBLE * CASE WHEN clips > 0 THEN 1 - wide / clips ELSE 1 END + 0.1::DOUBLE * CASE WHEN n > 0 THEN 1 - still / n ELSE 0 END) * 1000, 6) + 0.5) / 1000 AS score FROM c)
    SELECT video_id, n, round(rate, 6) AS fallback_rate, round(cover, 6) AS coverage, doubtful, still, wide, score, NOT (n = 0 OR rate > 0.5 OR (target_s > 0 AND cover < 0.95)) AND score >= 0.85 AS passed FROM t""")
def visual_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as visual plans, their lines as scene assets."""
    c = F.col
    assets = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("video_id"), F.when(c("l_returnflag") == "R", "fallback-color").otherwise("stock").alias("source"), F.when(c("l_linestatus") == "O", "image").otherwise("video").alias("asset_type"),
        F.when(c("l_suppkey") % 3 == 0, "none").otherwise("pan").alias("motion"), F.when(c("l_partkey") % 5 != 0, c("l_discount") * 10).alias("llm_confidence"), F.when(c("l_partkey") % 4 == 0, c("l_tax") * 12).alias("similarity"),
        c("l_quantity").alias("seconds"), F.when(c("l_linenumber") % 3 != 0, c("l_quantity").cast("int") * 20).alias("width"), F.lit(600).alias("height"))
    return E.visual_quality(assets, table(spark, sf_dir, "orders").select(c("o_orderkey").alias("video_id"), (c("o_totalprice") / 1500).alias("target_s")))


#: Metrics of the test rows by arithmetic on the id: (name, factor, scale, ids divisible by this lack it).
_METRICS = [(name, 7 + 6 * i, scale, 3 + i % 5) for i, (name, _, scale, _) in enumerate(E.QUALITY_WEIGHTS)]


def _metric_sql(name: str) -> str:
    factor, scale, lack = next(m[1:] for m in _METRICS if m[0] == name)
    return f"CASE WHEN doc_id % {lack} <> 0 THEN (doc_id * {factor}) % 101 / 100::DOUBLE * {scale} END"


def _heuristic_sql() -> str:
    parts = []
    for name, weight, scale, inverted in E.QUALITY_WEIGHTS:
        normal = f"least({name} / {scale}::DOUBLE, 1)"
        parts.append((name, weight, f"(1 - {normal})" if inverted else f"({normal})"))
    parts.append(("lufs", E.LOUDNESS_WEIGHT, "(CASE WHEN lufs IS NOT NULL THEN greatest(0, 1 - abs(lufs + 14) / 20) END)"))
    names = [p[0] for p in parts]
    give = " + ".join(f"coalesce({n} * {w}::DOUBLE, 0)" for n, w, _ in parts)
    total = " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END" for n, w, _ in parts)
    seen = " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in names)
    impact = lambda x: f"CAST(floor(round({x} * 100, 6) + 0.5) AS BIGINT)"
    factor = lambda i, n, shown, x: f"CASE WHEN {n} IS NOT NULL THEN {{'size': -abs({impact(x)}), 'at': {i}, 'text': '{shown}:' || {impact(x)} || ':' || CASE WHEN {n} >= 0.5 THEN 'positive' ELSE 'negative' END}} END"
    shown = [n if n != "lufs" else E.LOUDNESS for n in names]
    factors = [factor(i, n, s, f"({n} * {w}::DOUBLE)") for i, ((n, w, _), s) in enumerate(zip(parts, shown))] + [factor(len(parts), "own", "_intrinsic", "(own * (1 - cover * 0.8::DOUBLE))")]
    raws = ", ".join(f"{_metric_sql(n)} AS {n}" for n in names[:-1])
    defects = ", ".join(f"CASE WHEN {m} {'>' if above else '<'} {bound} THEN '{d}' END" for d, m, bound, above in E.DEFECTS)
    return f"""WITH r AS (SELECT doc_id AS id, {raws}, CASE WHEN doc_id % 4 <> 0 THEN -((doc_id * 29) % 40)::DOUBLE END AS lufs, NULL::DOUBLE AS audioOverlapCount, doc_id % 120 AS seconds, [720, 1080, 1920][doc_id % 3 + 1] AS width,
        [1280, 1920, 1080][doc_id // 3 % 3 + 1] AS height, CASE WHEN doc_id % 7 <> 0 THEN (doc_id * 11) % 100 / 100::DOUBLE END AS sure FROM labels),
      n AS (SELECT id, seconds, width, height, sure, list_filter([{defects}], lambda x: x IS NOT NULL) AS defects, {", ".join(f"{x} AS {n}" for n, _, x in parts)} FROM r),
      b AS (SELECT *, CASE WHEN {total} > 0 THEN ({give}) / ({total}) ELSE 0 END AS repo, ({seen}) / {len(E.QUALITY_WEIGHTS)} AS cover,
        (CASE WHEN seconds BETWEEN 20 AND 60 THEN 25 WHEN seconds BETWEEN 15 AND 90 THEN 18 WHEN seconds >= 10 THEN 8 ELSE 2 END + CASE WHEN width / height < 0.7 THEN 25 WHEN width / height < 1 THEN 15 WHEN width / height < 1.4 THEN 10 ELSE 5 END
         + CASE WHEN width >= 1080 THEN 25 WHEN width >= 720 THEN 15 ELSE 5 END + coalesce(floor(sure * 25 + 0.5), 12)) / 100 AS own FROM n),
      s AS (SELECT *, CAST(least(100, greatest(0, floor(round((repo * (cover * 0.8::DOUBLE) + own * (1 - cover * 0.8::DOUBLE)) * 100, 6) + 0.5))) AS BIGINT) AS score FROM b)
      SELECT id, score, floor(round(least(1, 0.3::DOUBLE + cover * 0.5 + abs(score - 50) / 50 * 0.2) * 100, 6) + 0.5) / 100 AS confidence,
        CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'average' WHEN score >= 20 THEN 'below_average' ELSE 'bad' END AS label, coalesce(array_to_string(defects, ','), '') AS defects,
        array_to_string(list_transform(list_sort(list_filter([{", ".join(factors)}], lambda x: x IS NOT NULL))[1:5], lambda x: x.text), ',') AS factors FROM s"""


@register("heuristic_quality", _heuristic_sql())
def heuristic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled ids as videos, with metrics by arithmetic on the id; some are missing."""
    d = F.col("doc_id")
    pairs = [x for name, factor, scale, lack in _METRICS for x in (F.lit(name), F.when(d % lack != 0, (d * factor) % 101 / F.lit(100.0) * scale))]
    pairs += [F.lit(E.LOUDNESS), F.when(d % 4 != 0, -((d * 29) % 40).cast("double"))]
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    rows = table(spark, sf_dir, "labels").select(
        d.alias("id"), F.create_map(*pairs).alias("metrics"), (d % 120).alias("duration_s"), pick([720, 1080, 1920], d % 3).alias("width"), pick([1280, 1920, 1080], F.floor(d / 3) % 3).alias("height"),
        F.when(d % 7 != 0, (d * 11) % 100 / F.lit(100.0)).alias("ocr_confidence"))
    return E.heuristic_quality(rows)


@register("scene_changes", with_views("""WITH v AS (SELECT video_id, max(cut_ms) AS until FROM cuts GROUP BY video_id), s AS (SELECT video_id, unnest(range(0, until // 5000 + 1)) AS first FROM v),
    c AS (SELECT s.video_id, s.first, count(cut_ms) AS n FROM s LEFT JOIN cuts ON cuts.video_id = s.video_id AND cut_ms BETWEEN s.first * 5000 AND s.first * 5000 + 4500 GROUP BY ALL)
    SELECT video_id, first, first * 5000 AS start_ms, first * 5000 + 4500 AS end_ms, n AS n_points, round(greatest(0, least(1, n / greatest(1, 4.5 / 3))), 6) AS change_score FROM c""", "cuts"))
def scene_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts inside spans of 4.5 seconds, one every five seconds."""
    cuts = views.cuts(spark, sf_dir)
    spans = cuts.groupBy("video_id").agg(F.max("cut_ms").alias("until")).select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("until div 5000"))).alias("first"))
    spans = spans.withColumns({"start_ms": F.col("first") * 5000, "end_ms": F.col("first") * 5000 + 4500})
    return E.points_in_spans(spans, cuts.withColumnRenamed("cut_ms", "at_ms"))


_ORDER_SCORES = "c AS (SELECT l_orderkey AS id, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS id, round(avg(l_tax), 6) AS score FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)"


@register("baseline_check", f"""WITH {_ORDER_SCORES}, d AS (SELECT round(c.score - b.score, 9) AS delta FROM c JOIN b USING (id))
    SELECT count(*) AS n, round(coalesce(least(0, min(delta)), 0), 6) AS worst_delta, count(*) FILTER (delta < -0.01) AS regressed, count(*) FILTER (delta < -0.01) = 0 AS passed FROM d""")
def baseline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean discounts of orders against mean taxes of the lines that were not returned."""
    lines = table(spark, sf_dir, "lineitem")
    mean = lambda rows, c: rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.avg(c), 6).alias("score"))
    return E.baseline_check(mean(lines, "l_discount"), mean(lines.where("l_returnflag <> 'R'"), "l_tax"))


@register("determinism", """SELECT l_orderkey AS id, count(*) AS n, round(max(l_tax) - min(l_tax), 6) AS spread, round(max(l_tax) - min(l_tax), 9) <= 0.02 AS stable FROM lineitem GROUP BY 1""")
def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as repeated runs."""
    return E.determinism(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_tax").alias("score")), 0.02)


@register("cost_guard", """WITH w AS (SELECT l_orderkey AS id, round(coalesce(max(l_extendedprice) FILTER (l_linestatus = 'O'), 0), 6) AS worst FROM lineitem GROUP BY 1) SELECT *, worst > 30000 AS warned, worst > 60000 AS blocked FROM w""")
def cost_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linestatus") == "O", "image").otherwise("video").alias("asset_type"), F.col("l_extendedprice").alias("cost"))
    return E.cost_guard(rows, 30_000, 60_000)


_MOTIONS = ["static", "zoom_in", "zoom_out", "pan_left", "pan_right", "unknown", "shake"]


@register("dominant_motion", f"""WITH m AS (SELECT user_id AS video_id, {_MOTIONS}[event_id * 5 % 7 + 1] AS motion, event_id AS i FROM events), c AS (SELECT video_id, motion, count(*) AS n, min(i) AS seen FROM m GROUP BY ALL),
    t AS (SELECT video_id, arg_min(motion, -n * 1000000000 + seen) AS top, count(*) AS kinds FROM c GROUP BY video_id)
    SELECT video_id, kinds, CASE WHEN top IN ('unknown', 'static') THEN 'static' WHEN top IN ('zoom_in', 'zoom_out') THEN 'zoom_in' WHEN top IN ('pan_left', 'pan_right') THEN 'pan' WHEN kinds >= 3 THEN 'mixed' ELSE 'static' END AS motion FROM t""")
def dominant_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    motion = F.element_at(F.array(*[F.lit(m) for m in _MOTIONS]), (F.col("event_id") * 5 % 7 + 1).cast("int"))
    return E.dominant_motion(table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), motion.alias("motion"), F.col("event_id").alias("at")))


@register("speakers", "SELECT conv_id, count(DISTINCT role) AS n_speakers, array_to_string(list_sort(list_distinct(list(role))), ',') AS speakers FROM conversations GROUP BY conv_id")
def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct speakers of each conversation."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("n_speakers"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("speakers"))


@register("frame_descriptions", with_views("""WITH b AS (SELECT d.video_id, d.frame AS item, round(max(list_cosine_similarity(d.embedding::DOUBLE[], f.embedding::DOUBLE[])), 6) AS best
      FROM frames d JOIN frames f ON d.video_id = f.video_id AND f.frame <> d.frame WHERE d.frame % 20 = 0 GROUP BY ALL)
    SELECT video_id, count(*) AS n, round(avg(best), 6) AS mean, min(best) AS least, round(quantile_cont(best, 0.1), 6) AS p10 FROM b GROUP BY video_id""", "frames"))
def frame_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with ids divisible by 20 as descriptions, against the other frames of their video."""
    frames = views.frames(spark, sf_dir)
    return E.mean_of_best(retrieval.best_of_others(frames, frames.where("frame % 20 = 0")))


@register("keyword_fill", with_views("""WITH s AS (SELECT doc_id AS id, generate_subscripts(scenes, 1) - 1 AS pos, unnest(scenes) AS text FROM scripts)
    SELECT id, CAST(pos AS INT) AS pos, CASE WHEN pos % 3 <> 2 THEN 'kw' || pos ELSE coalesce(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: length(x) > 4)[1], 'abstract') END AS keyword, pos % 3 = 2 AS filled FROM s""", "scripts"))
def keyword_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword answers by position; every third scene has none and takes its first long word."""
    scenes = views.scripts(spark, sf_dir).select(F.col("doc_id").alias("id"), F.posexplode("scenes").alias("pos", "text"))
    answers = scenes.where("pos % 3 <> 2").select("id", "pos", F.concat(F.lit("kw"), F.col("pos").cast("string")).alias("keyword"))
    first = F.get(F.filter(T.words(F.col("text")), lambda w: F.length(w) > 4), 0)
    return E.fill_by_position(scenes, answers, F.coalesce(first, F.lit("abstract")))


@register("priority_order", """SELECT n_name, row_number() OVER (ORDER BY list_position(['JAPAN', 'BRAZIL', 'NATION_3', 'NATION_1'], n_name) NULLS LAST, n_nationkey) AS place FROM nation""")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a priority list first, the rest by key (a table of fixed size)."""
    return E.ordered_by_priority(table(spark, sf_dir, "nation"), "n_name", ["JAPAN", "BRAZIL", "NATION_3", "NATION_1"], F.col("n_nationkey")).select("n_name", "place")


@register("best_evaluation", """SELECT o_custkey, arg_max(o_orderkey, ROW(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey""")
def best_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation that passes first of all, then scores highest, then came first."""
    rank = F.struct((F.col("o_orderstatus") == "F").cast("int"), F.col("o_totalprice"), -F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", rank).alias("best"))


@register("top_tiles", """WITH r AS (SELECT l_orderkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) SELECT l_orderkey, round(avg(p), 6) AS score FROM r WHERE r <= 4 GROUP BY l_orderkey""")
def top_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the four best tile scores of each sample."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc())
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.row_number().over(w).alias("r")).where("r <= 4")
    return rows.groupBy("l_orderkey").agg(F.round(F.avg("l_extendedprice"), 6).alias("score"))


@register("console_order", """WITH k AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS a, CASE WHEN o_totalprice > 150000 THEN 0 ELSE 1 END AS b, o_orderpriority AS label FROM orders)
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY a, b, label, o_orderkey) AS place FROM k""")
def console_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of an account by status rank, metrics rank and label."""
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(status, F.when(F.col("o_totalprice") > 150_000, 0).otherwise(1), "o_orderpriority", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"))


@register("status_counts", """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS captured, count(*) FILTER (o_orderstatus = 'O') AS upcoming, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other,
    array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey) FILTER (o_orderstatus = 'O'), ',') AS open FROM orders GROUP BY o_custkey""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an account by status, and the open ones in the order of their dates."""
    opened = F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "O", F.struct("o_orderdate", "o_orderkey"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("captured"), F.count_if(F.col("o_orderstatus") == "O").alias("upcoming"), F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("other"),
        F.when(F.count_if(F.col("o_orderstatus") == "O") > 0, F.array_join(F.transform(opened, lambda x: x["o_orderkey"].cast("string")), ",")).alias("open"))


@register("due_backfill", """SELECT o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 3 DAY END, o_orderdate + INTERVAL 7 DAY) AS DATE) AS due FROM orders""")
def due_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due dates; where none is noted, the day of publishing and a window of a week."""
    noted = F.when(F.col("o_orderkey") % 3 != 0, F.date_add("o_orderdate", 3))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(noted, F.date_add("o_orderdate", 7)).alias("due"))


@register("time_ranges", """WITH a AS (SELECT max(ts) AS t FROM events), r AS (SELECT * FROM (VALUES ('hour', INTERVAL 1 HOUR), ('day', INTERVAL 1 DAY), ('week', INTERVAL 7 DAY), ('month', INTERVAL 30 DAY), ('year', INTERVAL 365 DAY)) v(name, span))
    SELECT name, count(*) FILTER (ts >= t - span) AS n FROM events, a, r GROUP BY name""")
def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within each relative range of the last one, in one pass."""
    hours = {"hour": 1, "day": 24, "week": 168, "month": 720, "year": 8760}
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("t")).first()["t"]
    counts = events.agg(*[F.count_if(F.col("ts") >= F.lit(last) - F.make_interval(hours=F.lit(h))).alias(name) for name, h in hours.items()])
    return counts.select(F.explode(F.create_map(*[x for name in hours for x in (F.lit(name), F.col(name))])).alias("name", "n"))


@register("timing_confidence", with_views("""WITH h AS (SELECT video_id, count(*) AS heard FROM asr_words GROUP BY 1), s AS (SELECT video_id, count(*) AS script FROM words GROUP BY 1)
    SELECT video_id, round(CASE WHEN video_id % 2 = 0 THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END * (0.5 + 0.5 * least(coalesce(heard, 0) / script, 1)), 6) AS confidence FROM s LEFT JOIN h USING (video_id)""", "asr_words"))
def timing_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of heard timings; even videos come from recognition, odd ones from an estimate."""
    script = views.words(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("script"))
    heard = views.asr_words(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("heard"))
    source = F.when(F.col("video_id") % 2 == 0, "whisper").otherwise("estimation")
    return script.join(heard, "video_id", "left").select("video_id", F.round(E.timing_confidence(source, F.coalesce("heard", F.lit(0)), F.col("script")), 6).alias("confidence"))


@register("source_text_risk", with_views(f"""WITH {_SEGMENTS}, r AS (SELECT video_id AS id, count(*) AS segments, avg(confidence) AS confidence, sum(greatest(0, end_ms - start_ms)) / 1000 AS seconds, sum(greatest(0, end_ms - start_ms)) / max(end_ms) AS coverage, (video_id * 37) % 100 / 100 AS score FROM g GROUP BY video_id)
    SELECT id, concat_ws(',', CASE WHEN coverage >= 0.2 THEN 'coverage' END, CASE WHEN seconds >= 1.5 THEN 'seconds' END, CASE WHEN score >= 0.7 THEN 'score' END, CASE WHEN segments >= 2 THEN 'segments' END, CASE WHEN confidence >= 0.55 THEN 'confidence' END) AS reasons,
      coverage >= 0.2 AND seconds >= 1.5 AND score >= 0.7 AND segments >= 2 AND confidence >= 0.55 AS flagged FROM r""", "asr_words"))
def source_text_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")))
    report = _segments(spark, sf_dir).groupBy(F.col("video_id").alias("id")).agg(
        F.count("*").alias("segments"), F.avg("confidence").alias("confidence"), (shown / 1000).alias("seconds"), (shown / F.max("end_ms")).alias("coverage"))
    return E.source_text_risk(report.withColumn("score", (F.col("id") * 37) % 100 / 100))


@register("spoken_similarity", with_views("""WITH p AS (SELECT w.video_id, w.idx, regexp_replace(lower(w.word), '[^a-z0-9]', '', 'g') || (w.idx % 11) AS a, regexp_replace(lower(a.word), '[^a-z0-9]', '', 'g') || (w.idx % 13) AS b FROM words w JOIN asr_words a USING (video_id, idx)),
    q AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(a, '10', 'ten'), '1', 'one'), '2', 'two'), '3', 'three'), '4', 'four'), '5', 'five'), '6', 'six'), '7', 'seven'), '8', 'eight'), '9', 'nine'), '0', 'zero') AS c,
      replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(b, '10', 'ten'), '1', 'one'), '2', 'two'), '3', 'three'), '4', 'four'), '5', 'five'), '6', 'six'), '7', 'seven'), '8', 'eight'), '9', 'nine'), '0', 'zero') AS d FROM p),
    s AS (SELECT *, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS x, 1 - levenshtein(c, d) / greatest(length(c), length(d)) AS y FROM q)
    SELECT video_id, idx, round(CASE WHEN x >= 0.8 THEN x ELSE greatest(x, y) END, 6) AS similarity FROM s""", "asr_words"))
def spoken_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a number behind them, as written and as heard with another one."""
    a = views.words(spark, sf_dir).select("video_id", "idx", F.concat(T.plain(F.col("word")), (F.col("idx") % 11).cast("string")).alias("a"))
    b = views.asr_words(spark, sf_dir).select("video_id", "idx", F.concat(T.plain(F.col("word")), (F.col("idx") % 13).cast("string")).alias("b"))
    return a.join(b, ["video_id", "idx"]).select("video_id", "idx", F.round(C.spoken_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@register("duplicate_ratio", with_views("""WITH d AS (SELECT run_id, coalesce(abs(latency - lag(latency) OVER v) <= 1.2, false) AS still, row_number() OVER v AS i FROM attempts WINDOW v AS (PARTITION BY run_id ORDER BY ts, event_id)),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY run_id, still ORDER BY i) AS g FROM d), r AS (SELECT run_id, still, g, count(*) AS n FROM g GROUP BY ALL)
    SELECT run_id, round(coalesce(sum(n) FILTER (still AND n >= 3), 0) / sum(n), 6) AS ratio FROM r GROUP BY run_id""", "attempts"))
def duplicate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of samples in runs of three or more that hardly change."""
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    rows = views.attempts(spark, sf_dir).select("run_id", "ts", "event_id", F.coalesce(F.abs(F.col("latency") - F.lag("latency").over(w)) <= 1.2, F.lit(False)).alias("still"))
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy("run_id", "still").orderBy("ts", "event_id"))
    runs = rows.withColumn("g", island).groupBy("run_id", "still", "g").agg(F.count("*").alias("n"))
    return runs.groupBy("run_id").agg(F.round(F.coalesce(F.sum(F.when(F.col("still") & (F.col("n") >= 3), F.col("n"))), F.lit(0)) / F.sum("n"), 6).alias("ratio"))


_TEXT_SQL = "regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')"


@register("caption_escapes", f"""SELECT doc_id, replace(replace(replace(replace({_TEXT_SQL}, '\\', '\\\\'), '{{', '\\{{'), '}}', '\\}}'), chr(10), '\\N') AS ass, regexp_matches({_TEXT_SQL}, '(?i)you won.t believe|destroyed|humiliated|this is disgusting|everyone is wrong') AS rage FROM documents""")
def caption_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts on one line, escaped for styled subtitles, and the rage-bait mark."""
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    return table(spark, sf_dir, "documents").select("doc_id", C.ass_escape(line).alias("ass"), C.rage_bait(line).alias("rage"))


@register("call_costs", """SELECT event_id, round((CAST(floor(value * 10) AS BIGINT) * 0.15::DOUBLE + CAST(floor(value * 3) AS BIGINT) * 0.6::DOUBLE) / 1000000, 9) AS cost, least(250 * pow(2, event_id % 9), 20000) AS backoff, CAST(floor(event_id * 1000 / 24 + 0.5) AS BIGINT) AS frame_ms,
    CAST(floor(event_id * 24 / 1000 + 0.5) AS BIGINT) AS frame, round(greatest(0, least(1, (60 - value) / 60)), 6) AS energy, round(1 / (1 + abs(value - 100) / 50), 6) AS likeness FROM events""")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of hosted calls, waits before the next try, frame times, loudness as energy and nearness to a value."""
    n, value = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        n, F.round(C.llm_cost(F.floor(value * 10).cast("long"), F.floor(value * 3).cast("long"), F.lit(0.15), F.lit(0.6)), 9).alias("cost"), C.backoff_ms(n % 9, 250, 20_000).alias("backoff"),
        C.frame_to_ms(n, 24.0).alias("frame_ms"), C.ms_to_frame(n, 24.0).alias("frame"), F.round(S.energy_of_rms(-value), 6).alias("energy"), F.round(S.difference_score(value, F.lit(100.0), 50.0), 6).alias("likeness"))
