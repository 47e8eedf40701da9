"""Scans over blocks give the rows of one pass over the whole group, whatever the blocks."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import scans
from cadenza.sources.shared import written

FRAMES = "video_id bigint, at_ms bigint, text string, confidence double"


def _sessions(rows, step):
    out, now = [], None
    for _, at, text, c in sorted(rows, key=lambda r: (r[1], r[2] or "")):
        text = text or ""
        if now is None or not scans.same_shown_text(now[2], text):
            now = [at, at, text, [], 0]
            out.append(now)
        now[1], now[4] = at, now[4] + 1
        now[3] += [c] * (c is not None)
    return [(s, e + step, t, round(sum(c) / len(c), 9) if c else None, n) for s, e, t, c, n in out]


@pytest.mark.parametrize("block_ms", [100, 700, 3_000, 10**9])
def test_text_sessions(spark, block_ms):
    """One long video, texts that drift letter by letter, runs longer than a block."""
    rng = random.Random(block_ms)
    rows, text = [], "abcdefghijklmnopqrst"
    for v, n in ((1, 300), (2, 20), (3, 1)):
        for i in range(n):
            if rng.random() < 0.4:
                at = rng.randrange(len(text))
                text = text[:at] + rng.choice("abcxyz") + text[at + 1 :]
            rows.append((v, i * 100, rng.choice([text] * 12 + [None, "", "Other", "other!"]), rng.choice([None, 0.5, 0.25])))
    got = scans.text_sessions(spark.createDataFrame(rows, FRAMES).repartition(4), 100, block_ms).collect()
    for v in (1, 2, 3):
        mine = sorted((r["start_ms"], r["end_ms"], r["text"], None if r["confidence"] is None else round(r["confidence"], 9), r["n_frames"]) for r in got if r["video_id"] == v)
        assert mine == _sessions([r for r in rows if r[0] == v], 100)


def _drifting(n, seed=5):
    rng = random.Random(seed)
    rows, text = [], "abcdefghijklmnopqrst"
    for i in range(n):
        at = rng.randrange(len(text))
        text = text[:at] + rng.choice("abcxyz") + text[at + 1 :]
        rows.append((1, i * 100, rng.choice([text] * 12 + ["Other"]), rng.choice([None, 0.5])))
    return rows


def test_blocks_are_scanned_once(spark):
    """The state passes from block to block within a task, so no block is scanned for its state first and for its pieces again."""
    scanned = spark.sparkContext.accumulator(0)

    def scan(state, rows):
        scanned.add(1)
        total = len(rows) + int(state or 0)
        return [(total,)], str(total)

    rows = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(60)], "g int, i bigint")
    got = scans.block_scan(rows, ["g"], ["i"], [], F.floor(F.col("i") / 10), scan, "total bigint")
    for _ in range(2):
        assert sorted((r["g"], r["_n"], r["total"]) for r in got.collect()) == [(g, n + 1, 10 * n + 10) for g in (1, 2) for n in range(6)]
    assert scanned.value == 12


@pytest.mark.parametrize("parts", [3, 40])
def test_blocks_of_a_group_in_several_tasks(spark, monkeypatch, parts):
    monkeypatch.setattr(scans, "written", lambda df, name: written(df.repartition(parts) if name == "blocks" else df, name))
    rows = _drifting(200)
    got = scans.text_sessions(spark.createDataFrame(rows, FRAMES), 100, 700).collect()
    mine = sorted((r["start_ms"], r["end_ms"], r["text"], None if r["confidence"] is None else round(r["confidence"], 9), r["n_frames"]) for r in got)
    assert mine == _sessions(rows, 100)


def test_alike_captions_by_plain_distance():
    """What is ruled out by lengths and characters alone is what the distance rules out."""
    rng = random.Random(11)
    for _ in range(3000):
        a = "".join(rng.choice("abcdefgh '") for _ in range(rng.choice([3, 12, 26, 40])))
        b = list(a)
        for _ in range(rng.choice([1, 2, 3, 5, 6, 7])):
            b[rng.randrange(len(b))] = rng.choice(["", "x", "y", "zz", "q"])
        a, b = (" ".join(t.split()) for t in (a, "".join(b)))
        x, y = ([w for w in ("".join(c for c in t if c in "abcdefghqxyz'") for t in s.split(" ")) if w] for s in (a, b))
        longest = max(len(a), len(b), 1)
        d = scans.edit_distance(a, b)
        shared = bool(x and y) and sum(w in y for w in x) / max(len(x), len(y)) >= 0.8
        assert scans.alike_captions(a, b) == (a == b or bool(a and b) and (shared or d <= 2 or d <= 6 and 1 - d / longest >= 0.88))


def test_no_frames(spark):
    assert scans.text_sessions(spark.createDataFrame([], FRAMES), 100).collect() == []
    rows = scans.text_sessions(spark.createDataFrame([(None, 5, "a", None), (None, None, "b", 1.0)], FRAMES), 100).collect()
    assert [tuple(r) for r in rows] == [(None, 5, 105, "a", None, 1)]


@pytest.mark.parametrize("block", [10, 64, 10**6])
def test_thin_by_gap(spark, block):
    rng = random.Random(block)
    rows = [(v, rng.randrange(2000)) for v in (1, 1, 1, 2) for _ in range(150)] + [(3, None), (4, 7)]
    got = {}
    for r in scans.thin_by_gap(spark.createDataFrame(rows, "v bigint, t bigint"), ["v"], "t", 37, block).collect():
        got.setdefault(r["v"], []).append(r["t"])
    want = {}
    for v, t in sorted({r for r in rows if r[1] is not None}):
        if v not in want or t - want[v][-1] >= 37:
            want.setdefault(v, []).append(t)
    assert {v: sorted(ts) for v, ts in got.items()} == want


def test_jitter(spark):
    rows = [(1, 0, "Hello there", 0, 0, 10, 10), (1, 1, "hello  there", 3, 4, 13, 14), (1, 2, None, 0, 0, 0, 0), (1, 3, "hello there!", 3, 4, 13, 14), (1, 4, "something else", 90, 90, 99, 99), (1, 5, "something else", None, 1, 2, 3), (2, 0, " ", 1, 1, 1, 1)]
    got = {r["video_id"]: r for r in scans.center_jitter(spark.createDataFrame(rows, "video_id int, at_ms int, text string, x0 int, y0 int, x1 int, y1 int")).collect()}
    assert (got[1]["n_moves"], got[1]["mean_px"], round(got[1]["p95_px"], 9)) == (2, 2.5, 4.75) and round(got[1]["score"], 6) == round((0.75 + 1 - 4.75 / 40) / 2, 6)
    assert (got[2]["n_moves"], got[2]["score"]) == (0, 1.0)


def test_similar_captions(spark):
    from cadenza.operators.sequences import similar_captions

    pairs = [("a b c d e", "a b c d x"), ("abc", "abd"), ("", ""), ("", "a"), ("hello world", "hello wor1d"), ("completely", "different"), ("The End", "the  end")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(F.col("a"), F.col("b"), scans.similar_shown(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in rows] == [similar_captions(a, b) for a, b in pairs]


def test_edit_distance():
    """Bits against the table, row by row."""
    rng = random.Random(8)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130]))) for _ in range(2))
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        assert scans.edit_distance(a, b) == row[-1]
        assert scans.edit_similarity(a, b) == (1.0 if a == b else 1 - row[-1] / max(len(a), len(b)))
