"""Caption matches, reports and overlays on hand-made rows and against plain loops."""

import random

from cadenza.operators import caption_sync as C

CAPTION = "video_id bigint, expected_id bigint, text string, start_ms bigint, end_ms bigint"
SHOWN = CAPTION.replace("expected", "observed")
QUALITY = "video_id bigint, coverage double, quality double, confidence double"
EXPECTED = [(1, 0, "I ruined my sister's wedding", 0, 1000), (1, 1, "And somehow she thanked me", 1000, 2400)]


def _report(spark, shown, expected=EXPECTED, quality=((1, 0.9, 0.8, 0.9),)):
    e, o = spark.createDataFrame(expected, CAPTION), spark.createDataFrame(shown, SHOWN)
    matches = C.match_captions(e, o)
    return C.sync_report(e, o, matches, spark.createDataFrame(quality, QUALITY)), matches


def test_close_captions_pass(spark):
    report, matches = _report(spark, [(1, 0, "i ruined my sister wedding", 50, 1100), (1, 1, "And somehow she THANKED me!", 1050, 2300)])
    row = report.first()
    assert row["passed"] and row["match_ratio"] == 1 and row["median_drift_ms"] == 50 and row["issues"] == []
    assert [(m["expected_id"], m["observed_id"], m["start_drift_ms"]) for m in matches.orderBy("expected_id").collect()] == [(0, 0, 50), (1, 1, 50)]


def test_late_captions_fail(spark):
    report, _ = _report(spark, [(1, 0, "I ruined my sister wedding", 950, 2000), (1, 1, "And somehow she thanked me", 1900, 3200)])
    row = report.first()
    assert not row["passed"] and "high-median-drift" in row["issues"] and row["n_matched"] == 2


def test_missing_and_odd_captions(spark):
    report, matches = _report(spark, [(1, 0, None, 0, 900), (1, 1, "", 1000, 2000)], EXPECTED + [(2, 0, None, 0, 1000), (2, 1, "a b c", None, None)], ())
    assert matches.count() == 0
    rows = {r["video_id"]: r for r in report.collect()}
    assert rows[1]["n_observed"] == 2 and "low-match-ratio" in rows[1]["issues"] and "missing-captions" not in rows[1]["issues"]
    assert rows[2]["issues"][0] == "missing-captions" and rows[2]["duration_ratio"] == 0
    assert C.match_captions(spark.createDataFrame([], CAPTION), spark.createDataFrame([], SHOWN)).collect() == []


def test_report_of_another_region(spark):
    bad, _ = _report(spark, [(1, 0, "unlike", 0, 900)])
    good, _ = _report(spark, [(1, 0, "i ruined my sister wedding", 50, 1100), (1, 1, "And somehow she THANKED me!", 1050, 2300)])
    assert [C.better_reports(a, b).select("region", "n_matched").first()[:] for a, b in ((bad, good), (good, bad), (bad, bad))] == [(2, 2), (1, 2), (1, 0)]


def _edits(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def _loop(expected, observed):
    """The best observed caption of each expected one, candidate by candidate."""
    words = lambda t, n=1: [w for w in t.split() if len(w) >= n]
    loose = lambda a, b: a == b or len(a) >= 4 and b.startswith(a[:4]) or len(b) >= 4 and a.startswith(b[:4]) or _edits(a, b) <= 2

    def alike(a, b):
        if not a or not b:
            return 0
        if a == b:
            return 1
        if a in b or b in a:
            return 0.92
        rest, shared = words(b), 0
        for w in words(a):
            if w in rest:
                rest.remove(w)
                shared += 1
        return 2 * shared / (len(words(a)) + len(words(b)))

    out = {}
    for v, i, text, e0, e1 in expected:
        near = [o for o in observed if o[0] == v and o[4] >= max(0, e0 - 500) and o[3] <= e1 + 500]
        seen = lambda texts: (lambda ws: sum(any(loose(w, x) for t in texts for x in words(t, 2)) for w in ws) / len(ws) if ws else 0)(words(text, 2))  # noqa: E731, B023
        evidence, best, first, last = seen([o[2] for o in near]), None, None, None
        for _, j, shown, o0, o1 in near:
            one, like = seen([shown]), alike(text, shown)
            shared = max(0, min(e1, o1) - max(e0, o0)) / max(1, e1 - e0)
            close = max(shared, max(0, 1 - abs(o0 - e0) / 2000))
            if one >= 0.45 or like >= 0.55:
                first, last = min(o0, first if first is not None else o0), max(o1, last if last is not None else o1)
            if max(evidence, one) < 0.55 and like < 0.5 and not (like >= 0.4 and shared >= 0.5):
                continue
            if best is None or one * 0.6 + like * 0.25 + close * 0.15 > best[1]:
                best = (j, max(one, like) * 0.85 + close * 0.15, o0, o1)
        if best and evidence >= 0.55:
            out[v, i] = (best[0], (best[2] if first is None else first) - e0, (best[3] if last is None else last) - e1)
    return out


def test_matches_by_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["river", "rivers", "stone", "stones", "a", "go", "going", "window", "winding", "it's", "seven", "sevens", "blue"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    expected, observed = [], []
    for v in range(6):
        for i in range(25):
            at = i * 1100 + rng.randint(-200, 200)
            expected.append((v, i, say(rng.randint(0, 6)), max(0, at), max(0, at) + rng.randint(0, 1500)))
        for j in range(60):
            shown = expected[-rng.randint(1, 25)][2] if rng.random() < 0.5 else say(rng.randint(0, 7))
            at = rng.randint(0, 28_000)
            observed.append((v, j, shown, at, at + rng.randint(0, 2500)))
    rows = C.match_captions(spark.createDataFrame(expected, CAPTION), spark.createDataFrame(observed, SHOWN)).collect()
    want = _loop(expected, observed)
    assert len(want) > 40 and {(r["video_id"], r["expected_id"]): (r["observed_id"], r["start_drift_ms"], r["end_drift_ms"]) for r in rows} == want


def test_overlays(spark):
    over = spark.createDataFrame([
        (1, 0, "the quick brown", 0, 1000), (1, 1, "quikc brwn fxo jumps over", 0, 1000), (1, 2, "unrelated words here", 0, 1000), (1, 3, "it is", 0, 1000),
        (1, 4, "quick", 9_000, 9_500), (2, 0, "anything", 0, 5), (1, 5, None, 0, 1000)], "video_id bigint, overlay_id bigint, text string, start_ms bigint, end_ms bigint")
    speech = spark.createDataFrame([(1, 0, "Quick brown fox jumps over", 0, 900), (1, 1, "something else", 900, 2000)], "video_id bigint, speech_id bigint, text string, start_ms bigint, end_ms bigint")
    got = {(r["video_id"], r["overlay_id"]): (r["speech_id"], r["supported"]) for r in C.supported_overlays(over, speech).collect()}
    assert got == {(1, 0): (0, True), (1, 1): (0, True), (1, 2): (0, False), (1, 3): (0, False), (1, 4): (None, False), (2, 0): (None, True), (1, 5): (0, False)}
    blocks = speech.withColumnRenamed("speech_id", "block_id")
    assert sorted(r["overlay_id"] for r in C.repeated_overlays(over, blocks).collect()) == [0]


def test_mean_similarity_does_not_show_the_order_of_its_sum(spark):
    """Ten times 0.92 and 118 times 0.7 are 0.7171875 on average, whose sixth decimal rounds up; partial sums in some orders fall below."""
    expected = spark.createDataFrame([(v, i, "x", 0, 1) for v in range(8) for i in range(128)], CAPTION)
    shown = spark.createDataFrame([], SHOWN)
    rng = random.Random(4)
    rows = []
    for v in range(8):
        values = [0.92] * 10 + [0.7] * 118
        rng.shuffle(values)
        rows += [(v, 0, 1, 0, s) for s in values]
    matches = spark.createDataFrame(rows, "video_id bigint, expected_start_ms bigint, expected_end_ms bigint, start_drift_ms bigint, similarity double").repartition(7)
    got = {r["mean_similarity"] for r in C.sync_report(expected, shown, matches, spark.createDataFrame([], QUALITY)).collect()}
    assert got == {0.7171875}
