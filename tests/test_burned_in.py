"""Caption segments whatever the blocks, and the report on hand-made captions."""

import random
import re

import pytest

from cadenza.operators import burned_in, scans
from cadenza.plans import scans as plans
from cadenza.sources.shared import written

FRAME = "video_id bigint, at_ms bigint, text string, confidence double, x0 double, y0 double, x1 double, y1 double"
VIDEO = "video_id bigint, duration_ms bigint, width int, height int"


def _segments(rows, step):
    out, now = [], None
    for _, at, text, c, *box in sorted(rows, key=lambda r: (r[1], r[2] or "", r[3] or 0.0)):
        text, c = text or "", c or 0.0
        flat = " ".join(text.split()).lower()
        if now is None or not scans.alike_captions(flat, " ".join(now["text"].split()).lower()):
            now = {"start": at, "text": text, "best": c, "all": [], "boxes": []}
            out.append(now)
        if c > now["best"]:
            now["text"], now["best"] = text, c
        now["end"] = at + step
        now["all"].append(c)
        if flat and None not in box:
            now["boxes"].append(box)
    around = lambda b: (min(x[0] for x in b), min(x[1] for x in b), max(x[2] for x in b), max(x[3] for x in b)) if b else (None,) * 4
    return [(s["start"], s["end"], s["text"], round(sum(s["all"]) / len(s["all"]), 9), len(s["all"]), *around(s["boxes"])) for s in out]


@pytest.mark.parametrize("block_ms", [100, 900, 10**9])
def test_segments_by_loop(spark, block_ms):
    rng = random.Random(block_ms)
    rows, text = [], "never gonna give you up"
    for v, n in ((1, 250), (2, 15)):
        for i in range(n):
            if rng.random() < 0.2:
                text = rng.choice(["never gonna give you up", "never gonna let you down", "Never  Gonna", "日本", ""])
            shown = text.replace("gonna", rng.choice(["gonna", "gomna", "gonnna"]))
            box = [None] * 4 if rng.random() < 0.2 else [float(rng.randint(0, 9)), 1.0, float(rng.randint(20, 29)), 5.0]
            rows.append((v, i * 100, rng.choice([shown] * 9 + [None]), rng.choice([None, 0.5, rng.random()]), *box))
    names = "start_ms end_ms text confidence n_frames x0 y0 x1 y1".split()
    got = scans.caption_segments(spark.createDataFrame(rows, FRAME).repartition(3), 100, block_ms).collect()
    for v in (1, 2):
        mine = sorted(tuple(round(r[c], 9) if c == "confidence" else r[c] for c in names) for r in got if r["video_id"] == v)
        assert mine == _segments([r for r in rows if r[0] == v], 100)


def _frames(texts, step=500, box=(100.0, 150.0, 300.0, 170.0), video=1):
    return [(video, i * step, t, 0.9, *box) for i, t in enumerate(texts)]


def _report(spark, frames, videos):
    shown = spark.createDataFrame(frames, FRAME)
    return {r["video_id"]: r for r in burned_in.burned_in_report(spark.createDataFrame(videos, VIDEO), shown, scans.caption_segments(shown, 500)).collect()}


def test_steady_captions_pass(spark):
    row = _report(spark, _frames(["We start here today."] * 3 + ["Then we go on well."] * 3 + ["It ends right there now."] * 3), [(1, 4600, 400, 200)])[1]
    assert row["passed"] and row["n_segments"] == 3 and row["case_style"] == "sentence_case" and row["flicker_events"] == 0
    assert row["jitter"] == row["alignment"] == row["placement"] == row["punctuation"] == row["segmentation"] == 1 and abs(row["coverage"] - 4.5 / 4.6) < 1e-9


def test_faults_are_seen(spark):
    texts = ["THE END IS", " ", "THE END IS", "is near and", "near and so??", "x" * 50, "The End IS", "the end Is"]
    frames = _frames(texts, box=(2.0, 1.0, 60.0, 40.0))
    row = _report(spark, frames, [(1, 60_000, 400, 200)])[1]
    assert not row["passed"] and row["flicker_events"] == 1 and row["coverage"] < 0.2 and row["safe_area"] == 0.1 and row["alignment"] == 0
    assert row["redundancy"] < 1 and row["segmentation"] < 1 and row["density"] < 1 and row["punctuation"] < 1 and row["case_style"] == "mixed"


def test_videos_without_captions(spark):
    rows = _report(spark, [(2, 0, None, None, None, None, None, None), (2, 500, " ", 0.5, 1.0, 1.0, 2.0, 2.0)], [(1, 1000, 400, 200), (2, 0, 400, 200)])
    for r in rows.values():
        assert r["n_segments"] == 0 and r["coverage"] == r["confidence"] == 0 and r["rhythm"] == r["jitter"] == r["safe_area"] == 1 and not r["passed"]
    assert set(rows) == {1, 2}


def test_lines_of_captions(spark):
    """Captions of several lines, blanks that are no spaces, and none of either."""
    frames = _frames(["one\ntwo\nthree\nfour"] * 2 + ["one  \r\n" + "y" * 46] * 2 + ["\t"] * 2 + ["short\tone"] * 2)
    row = _report(spark, frames, [(1, 4600, 400, 200)])[1]
    assert row["n_segments"] == 3 and abs(row["density"] - 1 / 3) < 1e-9


def test_captions_of_reports_are_made_once(spark, sf_dir, monkeypatch):
    made = []
    monkeypatch.setattr(plans, "written", lambda df, name: made.append(name) or written(df, name))
    report = plans.burned_in_report(spark, sf_dir)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert made == ["captioned", "segments"]
    assert "conversations" not in plan and not any("conversations" in f or "scanned" in f for f in report.inputFiles())


def test_words_of_captions_are_cut_once(spark):
    """Neither the words that others are held against, word by word, nor the flat text are made again where they are used."""
    frames = spark.createDataFrame(_frames(["a b c d e"] * 3), FRAME)
    plan = scans.center_jitter(frames)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bsplit\(", plan)) == 1 and plan.count("regexp_replace") == 2
