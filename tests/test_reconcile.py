"""Reconciling, forced timing, layout and tolerant JSON on hand-made cases."""

import json

from pyspark.sql import functions as F

from cadenza.operators import reconcile as R

S, H = "video_id bigint, idx bigint, word string", "video_id bigint, idx bigint, word string, start_ms bigint, end_ms bigint"


def _pair(spark, script, heard):
    return spark.createDataFrame([(1, i, w) for i, w in enumerate(script)], S), spark.createDataFrame([(1, i, w, 100 * i, 100 * i + 90) for i, w in enumerate(heard)], H)


def _words(df):
    return [r["word"] for r in sorted(df.collect(), key=lambda r: r["idx"])]


def test_reconcile(spark):
    script = "Two robots clean the livingroom, daily!".split()
    heard = "2 robotz clean living room umbrella dayly".split()
    got = R.reconcile(*_pair(spark, script, heard))
    # "the" was not heard, so the walk stands there when "living" comes: it takes the next near word alone.
    assert _words(got) == ["Two", "robots", "clean", "livingroom,", "room", "umbrella", "daily!"]
    joined = R.reconcile(*_pair(spark, ["livingroom,", "daily!"], ["living", "room", "dayly"]))
    assert _words(joined) == ["livingroom,", "daily!"]


def test_forced_timing(spark):
    rows = sorted(R.force_timing(*_pair(spark, "a b c d e".split(), "a d e".split())).collect(), key=lambda r: r["idx"])
    assert [r["word"] for r in rows] == list("abcde") and rows[0]["start_ms"] == 0 and rows[3]["start_ms"] == 100 and rows[4]["end_ms"] == 290
    starts = [r["start_ms"] for r in rows]
    assert starts == sorted(starts) and 90 <= rows[1]["start_ms"] <= rows[2]["start_ms"] <= 100


def test_layout(spark):
    words = [(1, "world", 60.0, 11.0, 90.0, 21.0), (1, "hello", 10.0, 10.0, 50.0, 20.0), (1, "below", 10.0, 40.0, 50.0, 50.0)]
    rows = R.layout_lines(spark.createDataFrame(words, "page_num int, text string, x0 double, y0 double, x1 double, y1 double")).collect()
    assert sorted((r["line"], r["text"], r["x1"]) for r in rows) == [(0, "hello world", 90.0), (1, "below", 50.0)]


def test_json_shapes(spark):
    texts = ['[{"k": 1}, {"k": 2}]', 'log line\n{"keywords": [{"k": 3}]}', '{"k": 4}', "no json", None, "{broken"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, response string")
    assert sorted((r["id"], r["pos"], json.loads(r["item"])["k"]) for r in R.keyword_rows(df).collect()) == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (2, 0, 4)]


def test_fallback_keyword(spark):
    df = spark.createDataFrame([("What will the rocket do",), ("a b",)], "t string")
    assert [r[0] for r in df.select(R.fallback_keyword(F.col("t"))).collect()] == ["rocket", "scene"]
