"""Work that must not grow by repeating itself: what is made once stays made once, and the results are those of plain loops."""

import random
import re

import numpy as np

from cadenza.operators import caption_sync, reconcile, retrieval, screening, sequences
from cadenza.plans import caption_sync as plans
from cadenza.sources.shared import written


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_best_script_word_ahead(monkeypatch):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("ab2x") for _ in range(rng.randint(0, 6)))
    for _ in range(300):
        word, script = make(), [make() for _ in range(rng.randint(0, 16))]
        at = rng.randint(0, 16)
        scored = [(reconcile.word_similarity(word, script[k]), -k) for k in range(at, min(at + reconcile.LOOKAHEAD_SCRIPT, len(script)))]
        best, place = max(scored, default=(0.0, 0))
        found = reconcile._best_ahead(reconcile._forms(word), [reconcile._forms(w) for w in script], at)
        assert found == (best, -place) if best >= reconcile.LEAST else found[0] < reconcile.LEAST
    tried = []
    monkeypatch.setattr(reconcile, "_alike", lambda a, b: tried.append(b) or float(a == b))
    assert reconcile._best_ahead(reconcile._forms("same"), [reconcile._forms(w) for w in ("same", "some", "sane")], 0) == (1.0, 0)
    assert len(tried) == 1


def test_captions_of_unlike_length_are_not_compared(monkeypatch):
    compared = []
    monkeypatch.setattr(sequences, "edit_distance", lambda a, b: compared.append(a) or 3)
    assert not sequences.similar_captions("one two three four", "one two and very many others")
    assert not compared
    assert sequences.similar_captions("one twooo three four five six", "one two three fourr fivee six")
    assert len(compared) == 1


def test_kept_words_are_cleaned_once(spark):
    rows = spark.createDataFrame([("(word)", 0.9), ("12", 0.9), (None, None), ("ABC", 0.5), ("so-so.", None)], "text string, confidence double")
    kept = screening.kept_words(rows)
    assert _plan(kept).count("regexp_replace") <= 6
    assert sorted(r["text"] for r in kept.collect()) == ["so-so.", "word"]


def test_captions_are_cut_into_words_once(spark):
    kind = "video_id bigint, {} bigint, text string, start_ms bigint, end_ms bigint"
    e = spark.createDataFrame([(1, 0, "the the dog runs home", 0, 1000)], kind.format("expected_id"))
    o = spark.createDataFrame([(1, 0, "the dog the home", 100, 900)], kind.format("observed_id"))
    got = caption_sync.match_captions(e, o)
    assert len(re.findall(r"\bsplit\(", _plan(got))) <= 2
    assert round(got.first()["similarity"], 6) == round(2 * 0.8 / 1.8, 6)


def test_repeated_overlays_deal_no_words(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "it", "'tis"]) + str(rng.randint(0, 2)) for _ in range(n))
    overlays = [(v, i, some(rng.randint(0, 4)), at := rng.randint(0, 400_000), at + rng.randint(0, 3000)) for v in (1, 2) for i in range(150)]
    blocks = [(v, i, some(6), at := rng.randint(0, 400_000), at + rng.choice([500, 20_000, 200_000])) for v in (1, 2) for i in range(12)]
    kind = "video_id bigint, {} bigint, text string, start_ms bigint, end_ms bigint"
    got = caption_sync.repeated_overlays(spark.createDataFrame(overlays, kind.format("overlay_id")), spark.createDataFrame(blocks, kind.format("block_id")))
    cut = lambda t: [w for w in (re.sub("^'+|'+$", "", w) for w in re.split("[^a-z0-9']+", t.lower())) if len(w) >= 3]
    want = {(v, i) for v, i, t, a, b in overlays if cut(t) and any(v == x and a < d and c < b and 2 * sum(w in cut(s) for w in cut(t)) >= len(cut(t)) for x, _, s, c, d in blocks)}
    assert {(r["video_id"], r["overlay_id"]) for r in got.collect()} == want and want
    assert _plan(got).count("Generate ") == 2


def test_blocks_of_frames_stay_few(spark, monkeypatch):
    """Every frame is sent once for each block, so blocks grow with the frames only where a block is full."""
    monkeypatch.setattr(retrieval, "BLOCK_FRAMES", 2)
    rng = np.random.default_rng(1)
    frames = spark.createDataFrame([(i % 3, i, [float(x) for x in rng.normal(size=3)]) for i in range(60)], "video_id bigint, frame bigint, embedding array<float>")
    got = retrieval.video_similarity(frames)
    assert "42), 8) as int) AS own" in _plan(got)
    rows = [(r["video_id"], np.array(r["embedding"])) for r in frames.collect()]
    for r in got.collect():
        want = max(u @ v / np.linalg.norm(u) / np.linalg.norm(v) for a, u in rows for b, v in rows if (a, b) == (r["a"], r["b"]))
        assert abs(want - r["similarity"]) < 1e-6


def test_best_of_other_frames(spark, monkeypatch):
    """Items of several blocks; a repeated frame, a zero vector, a missing one, and a video of one frame."""
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 7)
    rng = np.random.default_rng(2)
    rows = [(i % 4, i, [float(x) for x in rng.normal(size=4)]) for i in range(80)] + [(0, 4, [0.5, 1.0, 0.0, 0.0]), (1, 101, [0.0] * 4), (9, 200, [1.0] * 4), (2, 102, None)]
    frames = spark.createDataFrame(rows, "video_id int, frame bigint, embedding array<float>")
    got = {(r["video_id"], r["item"]): r["best"] for r in retrieval.best_of_others(frames, frames.where("frame % 2 = 0")).collect()}
    cosine = lambda u, v: np.dot(u, v) / s if (s := np.linalg.norm(u) * np.linalg.norm(v)) else 0.0
    want = {}
    for v, i, q in rows:
        others = [(j, u) for x, j, u in rows if x == v and j != i]
        if i % 2 == 0 and others:
            want.setdefault((v, i), []).extend(cosine(q, u) for _, u in others if q and u)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - max(w)) < 2e-6 if w else got[k] is None for k, w in want.items())


def test_words_of_reports_are_made_once(spark, sf_dir, monkeypatch):
    made = []
    monkeypatch.setattr(plans, "written", lambda df, name: made.append(name) or written(df, name))
    report = plans.caption_sync_second_look(spark, sf_dir)
    assert made == ["expected", "confidence", "observed", "observed"]
    assert "conversations" not in report._jdf.queryExecution().optimizedPlan().toString() and not any("conversations" in f for f in report.inputFiles())
