"""Contexts, kept words and blocks on hand-made rows."""

from pyspark.sql import functions as F

from cadenza.operators import screening as S

EVIDENCE = "topic_id int, item_id int, title string, source string, relevance double, summary string, url string"


def test_context(spark):
    rows = [(1, i, f"t{i}", "s", i / 20, "sum" if i % 2 else None, "u") for i in range(12)] + [(2, 0, "long", None, None, "x" * 3000, None), (2, 1, None, "s", 0.5, "", "u")]
    angles = spark.createDataFrame([(1, 2, "versus", "b", "h"), (1, 1, "howto", "a", None), (9, 1, "x", "y", "z")], "topic_id int, rank int, archetype string, angle string, hook string")
    got = {r["topic_id"]: r for r in S.evidence_context(spark.createDataFrame(rows, EVIDENCE), angles).collect()}
    items = "\n".join(f"- **t{i}** (s, relevance: {i * 5}%)\n" + ("  sum\n" if i % 2 else "") + "  Source: u" for i in range(11, 1, -1))
    assert got[1]["context"] == "## Research Evidence\n\nUse these verified facts in your script:\n\n" + items + '\n\n## Suggested Content Angles\n\n- howto: "a" (hook: "")\n- versus: "b" (hook: "h")'
    assert got[2]["context"].endswith("x\n\n[...truncated for length]") and len(got[2]["context"]) == 2450 + len("\n\n[...truncated for length]")
    assert "- **** (s, relevance: 50%)\n  Source: u\n- **long**" in got[2]["context"] and set(got) == {1, 2} and got[1]["n_items"] == 10


def test_words(spark):
    words = [("  «Hello»…", 0.9), ("12", 0.9), ("x)123", 0.9), ("NEW", 0.7), ("NEW", 0.9), ("USA", None), ("word", None), ("word", 0.2), ("a", 0.9), ("~~~~ab~~c", 0.9), (None, 0.9), ("日本", 0.9), ("@you!", 0.5), ("12345", 0.5)]
    got = [tuple(r) for r in S.kept_words(spark.createDataFrame(words, "text string, confidence double").coalesce(1)).collect()]
    assert got == [("Hello", 0.9), ("NEW", 0.9), ("word", None), ("@you!", 0.5), ("12345", 0.5)]


def test_blocks(spark):
    sure = [("word", 0.9)] * 4 + [("more", None)]
    rows = [
        (1, "generic_screenshot", "these are letters enough for a block", sure, 0.1, 0.5), (2, "generic_screenshot", "these are letters enough for a block", sure, None, 0.5),
        (3, "generic_screenshot", "these are letters enough for a block", sure, 0.01, 0.5), (4, "chat", "twelve letters", sure[:3], 0.0, 0.2), (5, "chat", "twelve letters", sure[:2], 0.0, 0.9), (6, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "id int, kind string, text string, words array<struct<text: string, confidence: double>>, area double, quality double")
    got = {r["id"]: r["k"] for r in frame.select("id", S.is_worth_showing(F.col("kind"), F.col("text"), F.col("words"), F.col("area"), F.col("quality")).alias("k")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}
