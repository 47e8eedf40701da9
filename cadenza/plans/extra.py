"""Further queries: phrase filters, redundancy, evidence search, prompt ranking, asset counts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import text as T
from cadenza.operators import governance, retrieval
from cadenza.plans import views
from cadenza.plans.registry import register
from cadenza.plans.views import with_views
from cadenza.sources.tables import table


@register("filler_phrases", with_views("""WITH n AS (SELECT *, regexp_replace(lower(word), '[^a-z0-9]', '', 'g') AS q, lead(regexp_replace(lower(word), '[^a-z0-9]', '', 'g')) OVER (PARTITION BY video_id ORDER BY idx) AS q1 FROM words),
    s AS (SELECT *, (q IN ('um', 'uh', 'in') AND q1 = 'the') OR (q = 'of' AND q1 = 'the') AS opens FROM n),
    c AS (SELECT *, opens OR coalesce(lag(opens) OVER (PARTITION BY video_id ORDER BY idx), false) AS covered FROM s)
    SELECT video_id, count(*) AS n, count(*) FILTER (covered) AS dropped FROM c GROUP BY video_id""", "words"))
def filler_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by two-word filler phrases, flagged at the phrase's start."""
    w = Window.partitionBy("video_id").orderBy("idx")
    q = T.plain(F.col("word"))
    rows = views.words(spark, sf_dir).withColumn("q", q).withColumn("q1", F.lead("q").over(w))
    opens = F.coalesce((F.col("q").isin("um", "uh", "in", "of")) & (F.col("q1") == "the"), F.lit(False))
    rows = rows.withColumn("opens", opens).withColumn("covered", F.col("opens") | F.coalesce(F.lag("opens").over(w), F.lit(False)))
    return rows.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if("covered").alias("dropped"))


@register("redundant_words", with_views("""WITH r AS (SELECT video_id, lower(word) AS t, idx, lag(idx) OVER (PARTITION BY video_id, lower(word) ORDER BY idx) AS p, lag(lower(word)) OVER (PARTITION BY video_id ORDER BY idx) AS b FROM words)
    SELECT video_id, count(*) FILTER (p < idx - 1) AS again, count(*) FILTER (b = t) AS doubled FROM r GROUP BY video_id""", "words"))
def redundant_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words seen before but not just before, and words said twice running."""
    t = F.lower("word")
    rows = views.words(spark, sf_dir).withColumn("t", t)
    rows = rows.withColumns({"p": F.lag("idx").over(Window.partitionBy("video_id", "t").orderBy("idx")), "b": F.lag("t").over(Window.partitionBy("video_id").orderBy("idx"))})
    return rows.groupBy("video_id").agg(F.count_if(F.col("p") < F.col("idx") - 1).alias("again"), F.count_if(F.col("b") == F.col("t")).alias("doubled"))


@register("transition_continuity", with_views("""WITH s AS (SELECT video_id, scene_id, min(start_ms) AS s0, max(end_ms) AS s1, arg_max(word, idx) AS w1, arg_min(word, idx) AS w0 FROM words GROUP BY ALL),
    n AS (SELECT *, lead(s0) OVER v AS n0, lead(w0) OVER v AS nw FROM s WINDOW v AS (PARTITION BY video_id ORDER BY scene_id))
    SELECT video_id, count(*) AS scenes, bool_and(n0 >= s1) AS forward, count(*) FILTER (NOT regexp_matches(w1, '[.!?]["'')]*$') AND regexp_matches(nw, '^[a-z]')) AS split_sentences FROM n GROUP BY video_id""", "words"))
def transition_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether scenes go forward, and how many sentences run over a scene's end."""
    s = views.words(spark, sf_dir).groupBy("video_id", "scene_id").agg(F.min("start_ms").alias("s0"), F.max("end_ms").alias("s1"), F.max_by("word", "idx").alias("w1"), F.min_by("word", "idx").alias("w0"))
    w = Window.partitionBy("video_id").orderBy("scene_id")
    n = s.withColumns({"n0": F.lead("s0").over(w), "nw": F.lead("w0").over(w)})
    return n.groupBy("video_id").agg(F.count("*").alias("scenes"), F.bool_and(F.col("n0") >= F.col("s1")).alias("forward"), F.count_if(~T.ends_sentence(F.col("w1")) & F.col("nw").rlike("^[a-z]")).alias("split_sentences"))


@register("prompt_ranking", """WITH p AS (SELECT p_partkey AS id, lower(p_name) AS name, lower(p_brand) AS brand, lower(p_type) AS kind FROM part),
    s AS (SELECT id, least(1.0, 0.5 + CASE WHEN name = 'part' THEN 0.3 WHEN contains(name, 'a') THEN 0.2 ELSE 0 END + CASE WHEN contains(brand, '1') THEN 0.15 ELSE 0 END + CASE WHEN contains(kind, 'e') THEN 0.1 ELSE 0 END)::DOUBLE AS score FROM p)
    SELECT id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS place FROM s) WHERE place <= 20""")
def prompt_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty best catalogue entries for a query by name, tag and description matches."""
    name, brand, kind = F.lower("p_name"), F.lower("p_brand"), F.lower("p_type")
    score = F.least(F.lit(1.0), 0.5 + F.when(name == "part", 0.3).when(name.contains("a"), 0.2).otherwise(0.0) + F.when(brand.contains("1"), 0.15).otherwise(0.0) + F.when(kind.contains("e"), 0.1).otherwise(0.0))
    best = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(20)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


@register("asset_counts", """SELECT CASE page_id % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'generated' ELSE 'own' END AS source, count(*) AS n, count(*) FILTER (page_id % 7 = 0) AS fallbacks, round(sum((page_id % 11) * 0.04), 6) AS cost_usd FROM pages GROUP BY 1""")
def asset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets, fallbacks and generation cost by source."""
    k = F.col("page_id")
    source = F.when(k % 3 == 0, "external").when(k % 3 == 1, "generated").otherwise("own").alias("source")
    return table(spark, sf_dir, "pages").groupBy(source).agg(F.count("*").alias("n"), F.count_if(k % 7 == 0).alias("fallbacks"), F.round(F.sum((k % 11) * 0.04), 6).alias("cost_usd"))


@register("media_types", """SELECT CASE WHEN ext IN ('png', 'jpg', 'jpeg', 'webp', 'gif') THEN 'image' WHEN ext IN ('mp4', 'mov', 'webm', 'mkv') THEN 'video' WHEN ext IN ('mp3', 'wav', 'm4a', 'ogg') THEN 'audio' ELSE 'other' END AS kind, count(*) AS n
    FROM (SELECT lower(regexp_extract(url || CASE page_id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.wav' ELSE '' END, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS ext FROM pages) GROUP BY 1""")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    path = F.concat("url", F.when(k == 0, ".PNG").when(k == 1, ".mp4").when(k == 2, ".wav").otherwise(""))
    return table(spark, sf_dir, "pages").groupBy(governance.media_type(path).alias("kind")).agg(F.count("*").alias("n"))


@register("set_difference", """SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished orders and no open ones."""
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).subtract(o.where("o_orderstatus = 'O'").select("o_custkey"))


@register("check_rollup", with_views("SELECT check_id, passed, count(*) AS n FROM checks GROUP BY GROUPING SETS ((check_id, passed), (check_id), ())", "checks"))
def check_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by check, with subtotals and the total."""
    return views.checks(spark, sf_dir).groupingSets([[F.col("check_id"), F.col("passed")], [F.col("check_id")], []], "check_id", "passed").agg(F.count("*").alias("n"))


@register("sliding_windows", with_views("""SELECT w AS window_start, provider, count(*) AS n FROM (SELECT provider, unnest([b - INTERVAL 9 HOUR, b - INTERVAL 6 HOUR, b - INTERVAL 3 HOUR, b]) AS w FROM (SELECT provider, time_bucket(INTERVAL 3 HOUR, ts) AS b FROM attempts)) GROUP BY ALL""", "attempts"))
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-hour windows every three hours."""
    rows = views.attempts(spark, sf_dir).groupBy(F.window("ts", "12 hours", "3 hours"), "provider").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "provider", "n")


@register("evidence_search")
def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best documents for every query item (ids divisible by 20) by hashed bags of words, joined on shared buckets."""
    docs = retrieval.hash_embedding(table(spark, sf_dir, "documents"), "text", "doc_id", 256)
    queries = retrieval.hash_embedding(table(spark, sf_dir, "benchmark").where("item_id % 20 = 0"), "text", "item_id", 256)
    scored = docs.join(queries.withColumnRenamed("value", "q"), "bucket").groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("value") * F.col("q")), 4).alias("score"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id")))
    return scored.withColumn("place", place).where("place <= 5")
