"""Similarity, distances, set joins and ranks by brute force, with small blocks and a hot key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import highlights, retrieval, windows


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(v), int(i), rng.normal(size=5).tolist()) for i, v in enumerate(rng.choice([1, 1, 1, 2, 3, 4], 90))] + [(5, 1000, [0.0] * 5), (5, 1000, [0.0] * 5)]
    return rows, spark.createDataFrame(rows, "video_id bigint, frame bigint, embedding array<double>")


@pytest.mark.parametrize("block", [1, 7, 40, 5000])
def test_video_similarity(vectors, block, monkeypatch):
    """One video holds half of the frames; blocks of one frame up to all."""
    monkeypatch.setattr(retrieval, "BLOCK_FRAMES", block)
    rows, frame = vectors
    frame = frame.limit(30) if block == 1 else frame
    rows = [tuple(r) for r in frame.collect()]
    want = {}
    for a, _, u in rows:
        for b, _, v in rows:
            if a < b:
                size = np.linalg.norm(u) * np.linalg.norm(v)
                want[a, b] = max(want.get((a, b), -2), np.dot(u, v) / size if size else 0.0)
    got = {(r["a"], r["b"]): r["similarity"] for r in retrieval.video_similarity(frame).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("block", [4, 10_000])
def test_novelty_and_order(vectors, block, monkeypatch):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", block)
    rows, frame = vectors
    ids = frame.where("frame < 1000").select(F.col("frame").alias("id"), "embedding")
    got = {r["id"]: r["distance"] for r in retrieval.novelty(ids, ids.where("id % 3 = 0")).collect()}
    known = [np.array(v) for _, i, v in rows if i < 1000 and i % 3 == 0]
    assert all(abs(got[i] - min(np.linalg.norm(np.array(v) - k) for k in known)) < 1e-6 for _, i, v in rows if i < 1000) and len(got) == 90
    order = retrieval.active_order(retrieval.novelty(ids, ids.where("id % 3 = 0")), ids.select("id", (F.col("id") % 7 / 6).alias("uncertainty"))).orderBy("place").collect()
    assert [r["place"] for r in order] == [*range(1, 91)]
    assert [r["id"] for r in order] == sorted(got, key=lambda i: (-round(0.7 * (i % 7 / 6) + 0.3 * got[i] / max(got.values()), 6), i))


@pytest.mark.parametrize("least", [0.1, 0.34, 0.8])
def test_similar_sets(spark, least):
    rng = random.Random(6)
    sets = [(i, sorted({"the", "of"} | {f"w{rng.randint(0, 25)}" for _ in range(rng.randint(0, 9))})) for i in range(70)] + [(70, []), (71, []), (72, None)]
    got = {(r["a"], r["b"]): r["jaccard"] for r in retrieval.similar_sets(spark.createDataFrame(sets, "id bigint, t array<string>"), "id", "t", least).collect()}
    want = {}
    for i, x in sets:
        for j, y in sets:
            if i < j and x and y and (s := len({*x} & {*y}) / len({*x} | {*y})) >= least:
                want[i, j] = round(s, 6)
    assert got == want


def test_rank_table(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.choice([None, 0.5, 1.0, rng.random()])) for _ in range(900)]
    got = {(r["k"], r["v"]): r["rank"] for r in windows.rank_table(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "rank", bands=8).collect()}
    for k in "ab":
        values = sorted(v for g, v in rows if g == k and v is not None)
        for v in set(values):
            assert got[k, v] == values.index(v) + (values.count(v) + 1) / 2
    assert all(v is not None for _, v in got)


def test_snap_at_boundaries(spark):
    words = spark.createDataFrame([(1, 0, "One", 0, 400), (1, 1, "two.", 500, 900), (1, 2, "Three", 1000, 1400), (1, 3, "four", 1500, 1900), (1, 4, "five.", 3000, 3300)], "video_id bigint, idx bigint, word string, start_ms bigint, end_ms bigint")
    spans = spark.createDataFrame([(1, 3, 1500, 1900), (1, 1, 500, 900), (2, 0, 5, 6)], "video_id bigint, first bigint, start_ms bigint, end_ms bigint")
    got = {(r["video_id"], r["first"]): (r["snapped_start"], r["snapped_end"]) for r in highlights.snap(spans, words).collect()}
    assert got == {(1, 3): (1000, 1900), (1, 1): (0, 900), (2, 0): (5, 6)}


def test_mean_in_order(spark):
    """Rows of a group lie in several partitions out of order; the sum still goes by id."""
    rng = random.Random(9)
    rows = [(i % 40, i, rng.choice([None, round(rng.random() * 500, 2)])) for i in range(1200)] + [(99, 5000, None)]
    want = {}
    for k, _, v in rows:
        total, n = want.get(k, (0.0, 0))
        want[k] = (total, n) if v is None else (total + v, n + 1)
    rng.shuffle(rows)
    got = {r["k"]: r["m"] for r in windows.ordered_mean(spark.createDataFrame(rows, "k int, id bigint, v double").repartition(5), ["k"], "v", "id", "m").collect()}
    assert got == {k: total / n if n else None for k, (total, n) in want.items()}




@pytest.mark.parametrize("rows, queries", [(7, 4), (8192, 10_000)])
def test_top_k_and_novelty_read_rows_once(spark, rows, queries, monkeypatch):
    """Equal scores go by id, missing vectors come last, and annotation order computes the distances once."""
    monkeypatch.setattr(retrieval, "INDEX_ROWS", rows)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", queries)
    rng = np.random.default_rng(5)
    held = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(80)] + [(i, None) for i in range(80, 84)]
    ids = spark.createDataFrame(held, "id bigint, embedding array<float>")
    got = retrieval.top_k(ids, ids.where("id % 10 = 0"), 82).collect()
    for q, v in held[::10]:
        score = lambda u: None if u is None or v is None else float(np.dot(u, v))
        want = sorted(((i, score(u)) for i, u in held), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:82]
        assert sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q) == [(n + 1, i, s) for n, (i, s) in enumerate(want)]
    near = {r["id"]: r["distance"] for r in retrieval.novelty(ids, ids.where("id % 40 = 0")).collect()}
    assert len(near) == 84 and near[0] == near[40] == 0 and near[82] is None
    assert retrieval.novelty(ids, ids.where("false")).count() == 0 and retrieval.top_k(ids, ids.where("false"), 3).count() == 0
    plan = lambda df: df._jdf.queryExecution().toString()
    novel = retrieval.novelty(ids, ids.where("id % 40 = 0"))
    assert "NestedLoop" not in plan(novel) + plan(retrieval.top_k(ids, ids, 3)) and "MapInArrow" in plan(novel)
    assert "MapInArrow" not in plan(retrieval.active_order(novel, ids.select("id", F.lit(0.5).alias("uncertainty"))))


def test_exact_mean(spark):
    """Means 0.005 apart stay so however often all rows come and in whatever order; values that decimals do not hold have the ordered mean."""
    small = {2: [52.51, 5.82], 4: [33.43, 24.89]}
    ids = iter(range(10**6))
    rows = [(times, k, next(ids), v) for times in (1, 60) for k, vs in small.items() for _ in range(times) for v in vs]
    kind = "times int, k int, id bigint, v double"
    for order in (rows, rows[::-1]):
        means = windows.exact_mean(spark.createDataFrame(order, kind).repartition(5), ["times", "k"], "v", "id", "m")
        assert {(r["times"], r["k"]): r["m"] for r in means.collect()} == {(t, k): m for t in (1, 60) for k, m in ((2, 29.165), (4, 29.16))}
        fell = means.withColumn("fell", windows.reversals("m", ["times"], ["k"], 0.005)).groupBy("times").agg(F.sum("fell").alias("n"))
        assert {r["times"]: r["n"] for r in fell.collect()} == {1: 0, 60: 0}
    odd = [(1, 1, 0, None), (1, 2, 1, None), (1, 2, 2, 0.1), (1, 2, 3, 0.3), (1, 3, 4, 1e300), (1, 3, 5, 1.0), (1, 4, 6, float("nan")), (1, 4, 7, 1.0), (1, 5, 8, float("inf")), (1, 6, 9, 1e-13), (1, 6, 10, 3e-13), (1, None, 11, 2.0)]
    got = {r["k"]: r["m"] for r in windows.exact_mean(spark.createDataFrame(odd, kind), ["times", "k"], "v", "id", "m").collect()}
    assert np.isnan(got.pop(4)) and got == {1: None, 2: 0.2, 3: 5e299, 5: float("inf"), 6: (1e-13 + 3e-13) / 2, None: 2.0}
