"""Queries on pixels of frames, which are laid out from consecutive embeddings of a video: one row of 64 pixels each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators import frames
from cadenza.plans.registry import register
from cadenza.sources.tables import table

_LINES = "SELECT label AS video_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS line FROM embeddings"
_PIXELS = f"""l AS ({_LINES}), n AS (SELECT video_id, line // {{high}} AS frame, line % {{high}} AS y, embedding, count(*) OVER (PARTITION BY video_id, line // {{high}}) AS c FROM l),
    px AS (SELECT video_id, frame, y, x - 1 AS x, v FROM (SELECT video_id, frame, y, unnest(range(1, 65)) AS x, unnest(CAST(embedding AS DOUBLE[])) AS v FROM n WHERE c = {{high}}))"""
_RGB = f"""WITH {_PIXELS.format(high=8)},
    q AS (SELECT *, CAST(floor((v + 1) * 1000) AS BIGINT) AS k FROM px),
    rgb AS (SELECT video_id, frame, x, y, k % 256 AS r, (k * 7) % 256 AS g, (k * 13) % 256 AS b FROM q),
    m AS (SELECT *, (0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b) / 255 AS luma, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS sat FROM rgb),
    boxes AS (SELECT * FROM (VALUES ('top', 1, 0, 0, 64, 2, 0, 2, 64, 4), ('bottom', 2, 0, 6, 64, 8, 0, 4, 64, 6), ('left', 3, 0, 0, 2, 8, 2, 0, 4, 8), ('right', 4, 62, 0, 64, 8, 60, 0, 62, 8)) t(side, place, x0, y0, x1, y1, u0, w0, u1, w1)),
    s AS (SELECT video_id, frame * 500 AS at_ms, side, place,
          avg(luma) FILTER (x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND (x - x0) % 3 = 0 AND (y - y0) % 3 = 0) AS luma, avg(luma) FILTER (x >= u0 AND x < u1 AND y >= w0 AND y < w1 AND (x - u0) % 3 = 0 AND (y - w0) % 3 = 0) AS luma_inside,
          avg(sat) FILTER (x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND (x - x0) % 3 = 0 AND (y - y0) % 3 = 0) AS saturation, avg(sat) FILTER (x >= u0 AND x < u1 AND y >= w0 AND y < w1 AND (x - u0) % 3 = 0 AND (y - w0) % 3 = 0) AS saturation_inside,
          avg(CASE WHEN luma >= 0.78 THEN 1 ELSE 0 END) FILTER (x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND (x - x0) % 3 = 0 AND (y - y0) % 3 = 0) AS bright,
          avg(CASE WHEN sat >= 0.42 AND luma >= 0.2 THEN 1 ELSE 0 END) FILTER (x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND (x - x0) % 3 = 0 AND (y - y0) % 3 = 0) AS colourful
          FROM m, boxes GROUP BY ALL)"""
_MEASURES = ("luma", "luma_inside", "saturation", "saturation_inside", "bright", "colourful")


def _frames(spark: SparkSession, sf_dir: str, high: int) -> DataFrame:
    """Frames of 64 pixels by ``high`` lines; lines that fill no frame are left out, as in the SQL."""
    line = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("embedding").cast("array<double>").alias("v"), line.alias("line"))
    lines = rows.groupBy("video_id", F.expr(f"line div {high}").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("line", "v"))).alias("lines")).where(F.size("lines") == high)
    return lines.select("video_id", "frame", (F.col("frame") * 500).alias("at_ms"), F.lit(64).alias("width"), F.lit(high).alias("height"), F.flatten(F.transform("lines", lambda x: x["v"])).alias("data"))


def _coloured(grey: DataFrame) -> DataFrame:
    level = F.transform("data", lambda v: F.floor((v + 1) * 1000))
    pixel = lambda k: F.concat(*[F.lpad(F.hex((k * m) % 256), 2, "0") for m in (1, 7, 13)])
    return grey.withColumn("data", F.unhex(F.array_join(F.transform(level, pixel), "")))


@register("edge_strips", f"{_RGB} SELECT video_id, at_ms, side, {', '.join(f'round({c}, 6) AS {c}' for c in _MEASURES)} FROM s")
def edge_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luma, saturation and content of the four sides of every frame."""
    rows = frames.edge_strips(_coloured(_frames(spark, sf_dir, 8)))
    return rows.select("video_id", "at_ms", "side", *[F.round(c, 6).alias(c) for c in _MEASURES])


@register("frame_bounds", f"""{_RGB}, f AS (SELECT video_id, at_ms, place, side, greatest(0, luma_inside - luma) AS d, greatest(bright, colourful) AS e FROM s),
    fl AS (SELECT video_id, list({{'d': d, 'e': e, 'side': side, 'at_ms': at_ms}} ORDER BY at_ms, place) AS l FROM f GROUP BY video_id),
    w AS (SELECT video_id, list_reduce(list_prepend({{'d': 0::DOUBLE, 'e': 0::DOUBLE, 'side': 'top', 'at_ms': 0::BIGINT}}, l),
          lambda a, x: CASE WHEN (x.d > a.d OR x.e > a.e) AND x.d * 0.65 + x.e * 0.35 >= a.d * 0.65 + a.e * 0.35 THEN {{'d': greatest(a.d, x.d), 'e': greatest(a.e, x.e), 'side': x.side, 'at_ms': x.at_ms}} ELSE a END) AS w FROM fl)
    SELECT video_id, round(w.d, 6) AS max_darkening, round(w.e, 6) AS max_edge_content, w.side AS side, w.at_ms AS at_ms, w.d <= 0.12 AND (w.d <= 0.02 OR w.e <= 0.035) AS passed FROM w""")
def frame_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loudest edge of every video, and whether its frames are clean."""
    worst = frames.worst_edges(frames.edge_strips(_coloured(_frames(spark, sf_dir, 8))))
    return worst.select("video_id", F.round("max_darkening", 6).alias("max_darkening"), F.round("max_edge_content", 6).alias("max_edge_content"), "side", "at_ms", "passed")


@register("camera_motion", f"""WITH {_PIXELS.format(high=6)}, v AS (SELECT unnest(range(-4, 5)) AS dx), shifts AS (SELECT a.dx AS dx, b.dx AS dy FROM v a, v b),
    e AS (SELECT a.video_id, a.frame, dx, dy, avg((a.v - b.v) * (a.v - b.v)) AS error FROM px a, shifts JOIN px b ON b.video_id = a.video_id AND b.frame = a.frame + 1 AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY ALL),
    g AS (SELECT video_id, frame, max(error) FILTER (dx = 0 AND dy = 0) AS base, min(error) AS best, arg_min([dx, dy], row_key) AS shift FROM (SELECT *, (error, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 END, dy, dx) AS row_key FROM e) GROUP BY ALL),
    k AS (SELECT *, shift[1] AS dx, shift[2] AS dy, CASE WHEN base > 0 THEN (base - best) / base ELSE 0 END AS gain FROM g),
    m AS (SELECT *, base < 0.0001 OR gain < 0.05 AS still FROM k)
    SELECT video_id, frame, CASE WHEN still THEN 'static' WHEN abs(dx) >= abs(dy) THEN CASE WHEN dx > 0 THEN 'pan_right' ELSE 'pan_left' END ELSE 'tilt' END AS motion,
      round(CASE WHEN still THEN greatest(0.7, 1 - base * 10) ELSE greatest(0.25, least(0.95, 0.4 + gain * 0.6)) END, 6) AS confidence, CAST(dx AS BIGINT) AS dx, CAST(dy AS BIGINT) AS dy, round(best, 6) AS error FROM m""")
def camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion from every frame to the next."""
    rows = frames.camera_motion(_frames(spark, sf_dir, 6))
    return rows.select("video_id", "frame", "motion", F.round("confidence", 6).alias("confidence"), F.col("dx").cast("long").alias("dx"), F.col("dy").cast("long").alias("dy"), F.round("error", 6).alias("error"))


_REGIONS = [("left", 0, 0, 20.5, 6), ("middle", 20.5, 1, 44, 5), ("whole", 0, 0, 64, 6)]


@register("region_activity", f"""WITH {_PIXELS.format(high=6)}, r AS (SELECT * FROM (VALUES ('left', 0, 21, 0, 6), ('middle', 20, 44, 1, 5), ('whole', 0, 64, 0, 6)) t(region, x0, x1, y0, y1)),
    d AS (SELECT a.video_id, a.frame, region, avg((a.v - b.v) * (a.v - b.v)) AS mse FROM px a JOIN px b ON b.video_id = a.video_id AND b.frame = a.frame + 1 AND b.x = a.x AND b.y = a.y, r WHERE a.x >= x0 AND a.x < x1 AND a.y >= y0 AND a.y < y1 GROUP BY ALL),
    g AS (SELECT c.video_id, c.frame, c.x, c.y, CASE WHEN abs(e.v - w.v) + abs(s.v - o.v) > 0.18 THEN 1 ELSE 0 END AS edge FROM px c
          JOIN px e ON e.video_id = c.video_id AND e.frame = c.frame AND e.x = c.x + 1 AND e.y = c.y JOIN px w ON w.video_id = c.video_id AND w.frame = c.frame AND w.x = c.x - 1 AND w.y = c.y
          JOIN px s ON s.video_id = c.video_id AND s.frame = c.frame AND s.x = c.x AND s.y = c.y + 1 JOIN px o ON o.video_id = c.video_id AND o.frame = c.frame AND o.x = c.x AND o.y = c.y - 1),
    h AS (SELECT video_id, frame, region, avg(edge) AS edges FROM g, r WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL)
    SELECT d.video_id, d.frame, d.region, round(mse, 6) AS mse, round(edges, 6) AS edges FROM d JOIN h ON h.video_id = d.video_id AND h.frame = d.frame AND h.region = d.region""")
def region_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference to the next frame and edge density of three regions of every frame."""
    rows = frames.region_activity(_frames(spark, sf_dir, 6), _REGIONS)
    return rows.select("video_id", "frame", "region", F.round("mse", 6).alias("mse"), F.round("edges", 6).alias("edges"))
