"""Readers and writers round trip."""

import json

import numpy as np
from pyspark.sql import functions as F

from cadenza.sources import artifacts as A


def test_jsonl_drops_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\nnot json\n{"a": -5, "b": "y"}\n{"a": 2}\n')
    rows = A.read_jsonl(spark, str(tmp_path / "log.jsonl"), "a int, b string", F.col("a") > 0).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(1, "x"), (2, None)]


def test_append_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    for _ in range(2):
        A.append_jsonl(df, str(tmp_path / "out"))
    rows = A.export_rows(A.read_jsonl(spark, str(tmp_path / "out"), "a int, b string"), "2024-01-01T00:00:00Z").collect()
    assert [r["count"] for r in rows] == [2, 2] and json.loads(rows[0]["entry"]) == {"a": 1, "b": "x"}


def test_features_take_the_file_name(spark, tmp_path):
    (tmp_path / "v1.json").write_text('{"videoId": "given", "x": 1}')
    (tmp_path / "v2.json").write_text('{"x": 2}')
    rows = A.read_features(spark, str(tmp_path), "videoId string, x int", "videoId").collect()
    assert sorted((r["videoId"], r["x"]) for r in rows) == [("given", 1), ("v2", 2)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "hi"', "two\nlines"), (None, "x", "y")], "p string, q string, r string")
    A.write_csv(df, str(tmp_path / "c"))
    rows = A.read_csv(spark, str(tmp_path / "c"), "p string, q string, r string").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("a,b", 'say "hi"', "two\nlines"), (None, "x", "y")], key=str)


def test_npy(spark, tmp_path):
    m = np.arange(6, dtype="<f4").reshape(2, 3)
    np.save(tmp_path / "a.npy", m)
    np.save(tmp_path / "b.npy", np.asfortranarray(m.astype("<f8") + 10))
    rows = sorted(A.read_npy(spark, str(tmp_path)).collect(), key=lambda r: (r["path"], r["frame"]))
    assert [list(r["embedding"]) for r in rows] == [[0, 1, 2], [3, 4, 5], [10, 11, 12], [13, 14, 15]]


def test_media_list(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Red-Car_01.mp4").write_bytes(b"12345")
    (tmp_path / "x.txt").write_text("no")
    rows = A.list_media(spark, str(tmp_path), "*.mp4").collect()
    assert len(rows) == 1 and rows[0]["size"] == 5 and rows[0]["tokens"] == ["red", "car", "01", "mp4"]


def test_probe_log(spark):
    lines = ["frame pts_time:1.5 x", "silence_start: 2", "noise", "silence_end: 3.5 | d", "mean_volume: -20.5 dB", "max_volume: -1 dB"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "log_id int, line_no int, line string")
    got = {(r["kind"], r["value"], r["until"]) for r in A.parse_probe_log(df).collect()}
    assert got == {("scene", 1.5, None), ("silence", 2.0, 3.5), ("mean_db", -20.5, None), ("peak_db", -1.0, None)}


def test_ocr_table_and_boxes(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    (tmp_path / "o.tsv").write_text("\n".join([head, "5\t1\t1\t1\t1\t1\t10\t20\t30\t10\t96\tHello", "5\t1\t1\t1\t1\t2\t50\t22\t30\t10\t80\tyou", "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t", "5\t1\t2\t1\t1\t1\t0\t0\t5\t5\t10\tx"]))
    words = A.parse_ocr_table(spark, str(tmp_path / "o.tsv"))
    boxes = {r["block_num"]: r["box"] for r in A.union_boxes(words, ["page_num", "block_num"]).collect()}
    assert tuple(boxes[1]) == (6, 16, 84, 36) and boxes[2] is None


def test_srt_and_markdown(spark):
    df = spark.createDataFrame([(1, 0, 1500, "Hi"), (1, 3_661_001, 3_662_000, "there")], "video_id int, start_ms bigint, end_ms bigint, text string")
    assert A.srt(df).first()["srt"] == "1\n00:00:00,000 --> 00:00:01,500\nHi\n\n2\n01:01:01,001 --> 01:01:02,000\nthere\n"
    assert A.markdown_table(spark.createDataFrame([("a|b", 1)], "x string, y int")).first()["line"] == "| a\\|b | 1 |"


def test_references_and_tokens(spark):
    df = spark.createDataFrame([(1, '{"a": {"path": "x.mp4", "list": [{"url": "http:\\/\\/y"}]}, "other": "path"}')], "id int, doc string")
    assert {(r["key"], r["value"]) for r in A.collect_references(df, "doc", ["path", "url"]).collect()} == {("path", "x.mp4"), ("url", "http://y")}
    seg = spark.createDataFrame([(1, [(" hi", 0.0, 0.2, 0.9), ("[MUSIC]", 0.2, 0.3, 0.9), ("um", 0.3, 0.4, 0.1)])], "video_id int, tokens array<struct<text:string,start:double,end:double,p:double>>")
    assert [r["text"] for r in A.heard_tokens(seg).collect()] == [" hi"]
