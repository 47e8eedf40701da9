"""Published receipts, check flags of a mode with overrides, and the stored run of a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_published(receipt: DataFrame) -> Column:
    """Whether a row of receipts ``(status, published_url, platform_post_id, published_at)`` tells of a published post; nulls tell nothing."""
    told = [F.coalesce(F.trim(receipt[c]) != "", F.lit(False)) for c in ("published_url", "platform_post_id", "published_at")]
    return F.coalesce(receipt["status"] == "published", F.lit(False)) | told[0] | told[1] | told[2]


def merged_flags(preset: Column, explicit: Column) -> Column:
    """Flags of a preset map under those of an explicit map; a flag that is null in both is left out, a null map is empty."""
    empty = F.create_map().cast("map<string,boolean>")
    merged = F.map_zip_with(F.coalesce(preset, empty), F.coalesce(explicit, empty), lambda _, a, b: F.coalesce(b, a))
    return F.map_filter(merged, lambda _, flag: flag.isNotNull())


def imported_runs(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (directory, fingerprint) with the run_id to reuse and ``fingerprint_matches``; directories without a run are left out.

    That is the directory's latest run ``(run_id, directory, created_at, fingerprint)`` of an equal fingerprint (a missing one equals
    only a missing one), else its latest run; of equal times the largest run_id. Runs are folded on the map side first, so a directory
    with a third of all runs costs one row a task and fingerprint, and no pairs are made.
    """
    latest = F.max(F.struct("created_at", "run_id"))
    alike = runs.groupBy(F.col("directory").alias("_dir"), F.col("fingerprint").alias("_print")).agg(latest.alias("_alike"))
    newest = alike.groupBy(F.col("_dir").alias("_of")).agg(F.max("_alike").alias("_newest"))
    met = wanted.join(alike, (F.col("directory") == F.col("_dir")) & F.col("fingerprint").eqNullSafe(F.col("_print")), "left")
    met = met.join(newest, F.col("directory") == F.col("_of"))
    run = F.coalesce(F.col("_alike")["run_id"], F.col("_newest")["run_id"])
    return met.select(*[wanted[c] for c in wanted.columns], run.alias("run_id"), F.col("_alike").isNotNull().alias("fingerprint_matches"))
