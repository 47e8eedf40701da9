"""Plain relational queries: filter, join, rollup, window and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.plans.registry import register
from cadenza.sources.tables import table


@register(
    "pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_rows
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-item revenue by return flag and status."""
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.count("*").alias("n_rows"))
    )


@register(
    "order_priority_cube",
    """SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""",
)
def order_priority_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and status with all subtotals."""
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register(
    "nation_revenue",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' GROUP BY n_name""",
)
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of one year by the customer's nation; date and columns reach the scans."""
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= "1996-01-01") & (F.col("o_orderdate") < "1997-01-01"))
    rows = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@register(
    "top_orders",
    """SELECT o_custkey, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""",
)
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three largest orders of every customer."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").withColumn("place", place).where("place <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "place")


@register(
    "sources_excluded",
    """SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 0.03 * (SELECT count(*) FROM documents))""",
)
def sources_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources with under three in a hundred of all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    sizes = d.where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    total = d.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    large = sizes.withColumn("_k", F.lit(1)).join(total, "_k").where(F.col("n") >= 0.03 * F.col("total")).select("source")
    return d.where("source is not null").join(large, "source", "left_anti").select("doc_id", "source")
