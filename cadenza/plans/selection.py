"""Queries on receipts, check flags and stored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import selection
from cadenza.plans.registry import register
from cadenza.sources.tables import table


@register("published_receipts", """WITH r AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'published' WHEN page_id % 6 = 1 THEN 'draft' END AS status,
      CASE WHEN page_id % 5 = 0 THEN url WHEN page_id % 5 = 1 THEN '  ' END AS u, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 = 1 THEN 'post' END AS p, CASE WHEN page_id % 11 = 0 THEN '2026-01-01' END AS t FROM pages)
    SELECT page_id, coalesce(status = 'published', false) OR coalesce(trim(u) <> '', false) OR coalesce(trim(p) <> '', false) OR coalesce(trim(t) <> '', false) AS published FROM r""")
def published_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    receipts = table(spark, sf_dir, "pages").select(
        "page_id", F.when(k % 6 == 0, "published").when(k % 6 == 1, "draft").alias("status"), F.when(k % 5 == 0, F.col("url")).when(k % 5 == 1, "  ").alias("published_url"),
        F.when(k % 7 == 0, "").when(k % 7 == 1, "post").alias("platform_post_id"), F.when(k % 11 == 0, "2026-01-01").alias("published_at"))
    return receipts.select("page_id", selection.is_published(receipts).alias("published"))


@register("resolved_checks", """WITH l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
    p AS (SELECT * FROM (VALUES (0, 'rate', true), (0, 'captions', true), (1, 'rate', true), (1, 'safety', false)) v(mode, check_id, flag)),
    e AS (SELECT doc_id, 'rate' AS check_id, quality = 1 AS flag FROM l WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'safety', toxic = 0 FROM l WHERE doc_id % 2 = 0)
    SELECT doc_id, check_id, coalesce(e.flag, d.flag) AS enabled FROM (SELECT doc_id, check_id, flag FROM l JOIN p ON p.mode = doc_id % 3) d FULL JOIN e USING (doc_id, check_id) WHERE coalesce(e.flag, d.flag) IS NOT NULL""")
def resolved_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets of two modes (a third has none) under flags given for some runs."""
    k, of = F.col("doc_id"), lambda **flags: F.create_map(*[F.lit(x) for pair in flags.items() for x in pair])
    preset = F.when(k % 3 == 0, of(rate=True, captions=True)).when(k % 3 == 1, of(rate=True, safety=False))
    explicit = F.create_map(F.lit("rate"), F.when(k % 4 == 0, F.col("quality") == 1), F.lit("safety"), F.when(k % 2 == 0, F.col("toxic") == 0))
    runs = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return runs.select("doc_id", F.explode(selection.merged_flags(preset, explicit)).alias("check_id", "enabled"))


@register("imported_runs", """WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS directory, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END AS f FROM orders),
    w AS (SELECT c_custkey AS directory, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 END AS f FROM customer),
    j AS (SELECT w.directory, r.run_id, r.f IS NOT DISTINCT FROM w.f AS fingerprint_matches, row_number() OVER (PARTITION BY w.directory ORDER BY (r.f IS NOT DISTINCT FROM w.f) DESC, created_at DESC, run_id DESC) AS i FROM w JOIN r USING (directory))
    SELECT directory, run_id, fingerprint_matches FROM j WHERE i = 1""")
def imported_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order to reuse for each customer, by date, with a remainder as its fingerprint."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("directory"), F.col("o_orderdate").alias("created_at"), F.when(k % 3 != 0, F.struct((k % 7).alias("size"))).alias("fingerprint"))
    wanted = table(spark, sf_dir, "customer").select(c.alias("directory"), F.when(c % 2 == 0, F.struct((c % 7).alias("size"))).alias("fingerprint"))
    return selection.imported_runs(runs, wanted).drop("fingerprint")
