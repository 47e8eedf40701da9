"""Edge strips, the loudest edge, camera motion and regions on drawn frames and against plain loops."""

import random

import numpy as np
import pytest

from cadenza.operators import frames as P

RGB = "video_id bigint, frame bigint, at_ms bigint, width int, height int, data binary"
GREY = "video_id bigint, frame bigint, at_ms bigint, width int, height int, data array<double>"


def _colour(spark, pictures):
    rows = [(1, i, i * 100, p.shape[1], p.shape[0], bytearray(p.astype(np.uint8).tobytes())) for i, p in enumerate(pictures)]
    return spark.createDataFrame(rows, RGB)


def test_dark_border_and_colour_at_the_edge(spark):
    dark = np.full((60, 80, 3), 200)
    dark[:2], dark[-2:], dark[:, :2], dark[:, -2:] = 20, 20, 20, 20
    loud = np.full((60, 80, 3), 90)
    loud[:2] = (250, 20, 20)
    rows = {(r["at_ms"], r["side"]): r for r in P.edge_strips(_colour(spark, [dark, loud])).collect()}
    assert len(rows) == 8
    for side in P.SIDES:
        assert rows[0, side]["luma_inside"] > rows[0, side]["luma"] + 0.3
    assert rows[100, "top"]["colourful"] == 1 and rows[100, "bottom"]["colourful"] == 0
    worst = P.worst_edges(P.edge_strips(_colour(spark, [dark]))).first()
    assert not worst["passed"] and worst["max_darkening"] > 0.12
    calm = P.worst_edges(P.edge_strips(_colour(spark, [np.full((60, 80, 3), 90)]))).first()
    assert calm["passed"] and calm["side"] == "top" and calm["max_darkening"] == 0


def test_frames_that_do_not_fit(spark):
    good = bytearray(4 * 4 * 3)
    rows = [(1, 0, 0, 4, 4, good), (1, 1, 1, 4, 4, bytearray(5)), (1, 2, 2, None, 4, good), (1, 3, 3, 4, 4, None), (1, 4, 4, 0, 0, bytearray()), (None, 5, 5, 4, 4, good)]
    assert sorted((r["video_id"] is None, r["at_ms"]) for r in P.edge_strips(spark.createDataFrame(rows, RGB)).select("video_id", "at_ms").distinct().collect()) == [(False, 0), (True, 5)]
    assert P.edge_strips(spark.createDataFrame([], RGB)).collect() == []


def _fold(rows):
    d, e, side, at = 0.0, 0.0, "top", rows[0][1]
    for _, t, s, luma, inside, bright, colour in rows:
        x, y = max(0.0, inside - luma), max(bright, colour)
        if (x > d or y > e) and x * 0.65 + y * 0.35 >= d * 0.65 + e * 0.35:
            d, e, side, at = max(d, x), max(e, y), s, t
    return d, e, side, at


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_loudest_edge_by_fold(spark, span, monkeypatch):
    """One video with a third and more of the rows, many ties."""
    monkeypatch.setattr(P, "SPAN", span)
    rng = random.Random(span)
    table = []
    for v, n in ((1, 400), (2, 30), (3, 1), (4, 60)):
        for i in range(n):
            table += [(v, i * 37, s, rng.choice([0.2, 0.5, 0.8]), rng.choice([0.2, 0.5, 0.8, rng.random()]), rng.choice([0.0, 0.1, rng.random()]), rng.choice([0.0, 0.1])) for s in P.SIDES]
    frame = spark.createDataFrame(table, "video_id bigint, at_ms bigint, side string, luma double, luma_inside double, bright double, colourful double").repartition(5)
    got = {r["video_id"]: r for r in P.worst_edges(frame).collect()}
    assert len(got) == 4
    for v, r in got.items():
        assert (r["max_darkening"], r["max_edge_content"], r["side"], r["at_ms"]) == _fold([x for x in table if x[0] == v])


def _shift_loop(a, b):
    h, w = a.shape
    error = lambda dx, dy: np.mean([(a[y, x] - b[y + dy, x + dx]) ** 2 for y in range(h) for x in range(w) if 0 <= x + dx < w and 0 <= y + dy < h] or [np.inf])
    best, at, most = error(0, 0), (0, 0), max(1, min(4, w // 16))
    for dy in range(-most, most + 1):
        for dx in range(-most, most + 1):
            if (dx or dy) and error(dx, dy) < best - 1e-15:
                best, at = error(dx, dy), (dx, dy)
    return best, at


def test_shift_by_loop():
    rng = np.random.default_rng(4)
    for w, h in ((16, 9), (40, 5), (64, 3), (1, 1), (2, 7)):
        a = rng.random((6, h, w))
        b = np.stack([np.roll(x, (k % 3 - 1, k - 2), (0, 1)) for k, x in enumerate(a)])
        b[5] = rng.random((h, w))
        _, best, dx, dy = P.best_shift(a, b)
        for i in range(6):
            least, at = _shift_loop(a[i], b[i])
            assert abs(best[i] - least) < 1e-12 and (dx[i], dy[i]) == at


def test_motion_of_drawn_frames(spark):
    rng = np.random.default_rng(9)
    wide = rng.random((20, 60))
    view = lambda x, y: wide[y : y + 12, x : x + 32].ravel().tolist()
    places = [(10, 4), (10, 4), (8, 4), (10, 4), (10, 5)]
    rows = [(1, i, i, 32, 12, view(x, y)) for i, (x, y) in enumerate(places)] + [(1, 5, 5, 4, 3, [0.5] * 12), (1, 7, 7, 4, 3, [0.5] * 12), (2, 0, 0, 4, 3, None), (2, 1, 1, 4, 3, [0.1] * 12)]
    got = {(r["video_id"], r["frame"]): r for r in P.camera_motion(spark.createDataFrame(rows, GREY)).collect()}
    assert [got[1, i]["motion"] for i in range(5)] == ["static", "pan_right", "pan_left", "tilt", "unknown"]
    assert set(got) == {(1, i) for i in range(5)} and got[1, 1]["dx"] == 2 and got[1, 4]["confidence"] == 0.1


def test_regions_by_loop(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((2, 9, 14))
    rows = [(1, i, i, 14, 9, x.ravel().tolist()) for i, x in enumerate((a, b))]
    regions = [("all", 0, 0, 14, 9), ("part", 2.3, -4, 7.1, 5), ("none", 5, 5, 5, 5), ("out", 20, 20, 30, 30)]
    got = {r["region"]: r for r in P.region_activity(spark.createDataFrame(rows, GREY), regions).collect()}
    assert abs(got["all"]["mse"] - ((a - b) ** 2).mean()) < 1e-12 and abs(got["part"]["mse"] - ((a - b)[0:5, 2:8] ** 2).mean()) < 1e-12
    assert got["none"]["mse"] is None and got["out"]["mse"] is None
    edges = lambda xs, ys: np.mean([abs(a[y, x + 1] - a[y, x - 1]) + abs(a[y + 1, x] - a[y - 1, x]) > 0.18 for y in ys for x in xs])
    assert abs(got["all"]["edges"] - edges(range(1, 13), range(1, 8))) < 1e-12 and abs(got["part"]["edges"] - edges(range(2, 8), range(1, 5))) < 1e-12
