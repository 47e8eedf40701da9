"""Sequential operators on hand-made cases."""

import numpy as np
import pytest

from cadenza.operators import sequences as Q

WORDS = "video_id bigint, idx bigint, word string, start_ms bigint, end_ms bigint, confidence double"


def _words(spark, words, step=400, length=300, video=1):
    rows = [(video, i, w, i * step, i * step + length, 0.5) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, WORDS)


def test_chunks_respect_limits(spark):
    text = "so this is the first sentence here. But now we go on with many more words than fit in one chunk, right?".split()
    rows = sorted(Q.caption_chunks(_words(spark, text)).collect(), key=lambda r: r["chunk"])
    assert " ".join(r["text"] for r in rows) == " ".join(text)
    assert max(r["n_words"] for r in rows) <= 7
    assert all(a["end_ms"] <= b["start_ms"] for a, b in zip(rows, rows[1:]))
    assert any(r["text"].endswith("here.") for r in rows)


def test_chunk_breaks_at_a_pause(spark):
    df = spark.createDataFrame([(1, i, w, s, s + 300, 0.5) for i, (w, s) in enumerate([("one", 0), ("two", 350), ("three", 2000), ("four", 2350)])], WORDS)
    rows = sorted(Q.caption_chunks(df).collect(), key=lambda r: r["chunk"])
    assert [r["text"] for r in rows] == ["one two", "three four"]


def test_pages_wrap_lines(spark):
    rows = sorted(Q.caption_pages(_words(spark, "aaaa bbbb cccc dddd eeee ffff gggg hhhh iiii".split())).collect(), key=lambda r: r["page"])
    assert rows[0]["text"] == "aaaa bbbb cccc dddd eeee\nffff gggg hhhh" and rows[1]["text"] == "iiii"
    rows = sorted(Q.caption_pages(_words(spark, ["Stop.", "Go", "x" * 40, "on"])).collect(), key=lambda r: r["page"])
    assert [r["text"] for r in rows] == ["Stop.", "Go\n" + "x" * 40, "on"]


def test_fragments_chain(spark):
    rows = Q.merge_fragments(_words(spark, ["go", "run", "n", "ing", "the", "end"], 320, 300)).collect()
    assert [r["word"] for r in sorted(rows, key=lambda r: r["idx"])] == ["go", "running", "the", "end"]


def test_segments_end_at_stops(spark):
    rows = sorted(Q.transcript_segments(_words(spark, "a b. c d e f g h i j k l m n".split())).collect(), key=lambda r: r["segment"])
    assert rows[0]["text"] == "a b." and all(r["end_ms"] - r["start_ms"] <= 4000 for r in rows)


def test_overlaps_meet_half_way(spark):
    df = spark.createDataFrame([(1, 0, "a", 0, 500, 1.0), (1, 1, "b", 300, 310, 1.0), (1, 2, "c", 320, 900, 1.0)], WORDS)
    rows = sorted(Q.fix_overlaps(df).collect(), key=lambda r: r["idx"])
    assert [(r["start_ms"], r["end_ms"]) for r in rows] == [(0, 400), (400, 450), (450, 900)]


def test_suppression_by_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(v, int(s), int(s) + 20_000, float(np.round(x, 3)), bool(x > 0.3)) for v in range(5) for s, x in zip(rng.integers(0, 300_000, 40), rng.random(40))]
    got = Q.suppress(spark.createDataFrame(rows, "video_id bigint, start_ms bigint, end_ms bigint, score double, fine boolean"), 3000, 4).collect()
    for v in range(5):
        taken = []
        for _, s, e, x, fine in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[3], r[1])):
            clash = any(not (e + 3000 <= a or b + 3000 <= s) for a, b in taken)
            if fine and not clash and len(taken) < 4:
                taken.append((s, e))
        assert sorted((r["start_ms"], r["end_ms"]) for r in got if r["video_id"] == v and r["accepted"]) == sorted(taken)


@pytest.mark.parametrize("a,b,same", [("Hello world!", "hello, world", True), ("", "x", False), ("abcdefghij klm", "abcdefghij kln", True), ("one two three four five", "one two three four six", True), ("cat", "dogs", False)])
def test_similar_captions(a, b, same):
    assert Q.similar_captions(a, b) is same


def test_sessions_keep_the_best_text(spark):
    rows = [(1, 0, "hello wrld", 0.3), (1, 500, "hello world", 0.9), (1, 1000, "", 0.1), (1, 1500, "next line", 0.5)]
    got = sorted(Q.caption_sessions(spark.createDataFrame(rows, "video_id bigint, at_ms bigint, text string, confidence double")).collect(), key=lambda r: r["start_ms"])
    assert [(r["text"], r["start_ms"], r["end_ms"], r["n_frames"]) for r in got] == [("hello world", 0, 1000, 2), ("next line", 1500, 2000, 1)]


def test_common_subsequence_is_longest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (list(map(str, rng.integers(0, 4, rng.integers(0, 9)))) for _ in range(2))
        pairs = Q.common_subsequence(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_overlays_merge(spark):
    rows = [(1, "SALE", 0, 1000), (1, "sale", 200, 1200), (1, "sale", 5000, 6000), (1, "other", 5100, 5200)]
    got = Q.dedupe_overlays(spark.createDataFrame(rows, "video_id bigint, text string, start_ms bigint, end_ms bigint")).collect()
    assert sorted((r["text"], r["start_ms"], r["end_ms"]) for r in got) == [("SALE", 0, 1200), ("other", 5100, 5200), ("sale", 5000, 6000)]


def test_speech_chunks(spark):
    text = "Short one. " + "word " * 100 + "end. " + "y" * 450
    rows = sorted(Q.speech_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")).collect(), key=lambda r: r["chunk"])
    assert max(len(r["text"]) for r in rows) <= 200 and "".join(r["text"] for r in rows).replace(" ", "") == text.replace(" ", "")
