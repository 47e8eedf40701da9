import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions.text import ends_sentence
from cadenza.operators import highlights

KIND = "video_id bigint, idx bigint, word string, start_ms bigint, end_ms bigint"


def made(rng, video, n, disorder):
    """Words with equal ends, long words, and, with ``disorder``, times that run back."""
    at, rows = 0, []
    for i in range(n):
        at += rng.choice([0, 300, 600, 900, 2500])
        s = max(0, at - (rng.choice([0, 0, 0, 45_000]) if disorder else 0))
        e = s + rng.choice([0, 200, 250, 700, 25_000 if disorder else 900])
        rows.append((video, i, rng.choice(["why", "um", "so", "end.", "word", "word", None]), s, e))
    return rows


def brute(spark, rows):
    flags = {(r["video_id"], r["idx"]): bool(r["x"]) for r in spark.createDataFrame(rows, KIND).select("video_id", "idx", ends_sentence(F.col("word")).alias("x")).collect()}
    best = {}
    for v, i, _, s, _ in rows:
        before = [w for x, j, w, _, _ in rows if x == v and j == i - 1]
        if not (not before or before[0] is None or flags[v, i - 1] or i % 8 == 0):
            continue
        ends = [(abs(e - s - 35_000) - 750 * flags[v, j], j) for x, j, _, _, e in rows if x == v and j >= i and 20_000 <= e - s <= 60_000]
        if ends:
            best[v, i] = min(ends)[1]
    return best


@pytest.mark.parametrize("disorder", [False, True])
def test_candidates_are_the_nearest_ends(spark, disorder):
    rng = random.Random(5)
    rows = made(rng, 1, 240, disorder) + made(rng, 2, 130, disorder) + [(3, 0, "alone.", 0, 100)]
    want = brute(spark, rows)
    got = highlights.candidate_spans(spark.createDataFrame(rows, KIND)).select("video_id", "first", "last").collect()
    assert len(got) == len(want) and {(r["video_id"], r["first"]): r["last"] for r in got} == want


def test_words_in_order_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(highlights, "_of_pairs", lambda *_: pytest.fail("pairs of starts and ends were made"))
    assert highlights.candidate_spans(spark.createDataFrame(made(random.Random(6), 1, 200, False), KIND)).count() > 20
