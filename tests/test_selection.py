"""Receipts, check flags and stored runs on hand-made rows."""

from pyspark.sql import functions as F

from cadenza.operators import selection


def test_is_published(spark):
    rows = [("published", None, None, None), ("draft", " ", "", None), (None, "https://x", None, None), (None, None, None, None), ("draft", None, "7", None), (None, "", None, "2026-01-01")]
    receipts = spark.createDataFrame(rows, "status string, published_url string, platform_post_id string, published_at string")
    assert [r[0] for r in receipts.select(selection.is_published(receipts)).collect()] == [True, False, True, False, True, True]


def test_merged_flags(spark):
    rows = [({"a": True, "b": False}, {"b": True, "c": None}), (None, {"a": False}), ({"a": True}, None), (None, None)]
    df = spark.createDataFrame(rows, "p map<string,boolean>, e map<string,boolean>")
    got = [r[0] for r in df.select(selection.merged_flags(F.col("p"), F.col("e"))).collect()]
    assert got == [{"a": True, "b": True}, {"a": False}, {"a": True}, {}]


def test_imported_runs(spark):
    runs = spark.createDataFrame(
        [(1, "d", 10, (5, 5)), (2, "d", 20, (6, 6)), (3, "d", 20, (7, 7)), (4, "e", 5, None), (5, None, 9, None), (6, "d", 9, (5, 5))],
        "run_id bigint, directory string, created_at bigint, fingerprint struct<size:bigint,mtime:bigint>")
    wanted = spark.createDataFrame(
        [("d", (5, 5)), ("d", None), ("e", None), ("e", (None, None)), ("f", None), (None, None)], "directory string, fingerprint struct<size:bigint,mtime:bigint>")
    got = {(r["directory"], r["fingerprint"] and tuple(r["fingerprint"])): (r["run_id"], r["fingerprint_matches"]) for r in selection.imported_runs(runs, wanted).collect()}
    assert got == {("d", (5, 5)): (1, True), ("d", None): (3, False), ("e", None): (4, True), ("e", (None, None)): (4, False)}
    assert selection.imported_runs(runs.limit(0), wanted).count() == 0
