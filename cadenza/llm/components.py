"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import forget, write_shared


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; root is the smallest node reachable.

    Each round links every larger neighbour, then every smaller one, to the smallest neighbour of a node, until
    all edges point at a root; rounds grow with the logarithm of a component's width. The minimum of a
    hub's neighbours is pre-aggregated on the map side; its edges then meet it in a join that AQE may split. Each
    round is written to the shared folder, so a lost executor costs one round; the round before it is deleted then. The
    result reads the last round's table, which its ``written_at`` names.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = write_shared(links, "links")
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        before = links
        links = write_shared(small, "links")
        pointing = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        chained = links.join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        settled = not pointing and not chained and _same(before, links)
        forget(before)
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    named = links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    named.written_at = links.written_at
    return named


def _same(before: DataFrame, after: DataFrame) -> bool:
    """Whether two edge tables hold the same edges, by count and a commutative checksum."""
    mark = [F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))]
    return before.agg(*mark).first() == after.agg(*mark).first()
