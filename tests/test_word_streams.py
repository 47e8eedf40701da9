"""Repairs of recognised words and notation against loops over the words."""

import random

from cadenza.operators import word_streams as W

WORD = "video_id bigint, idx bigint, word string, start_ms double, end_ms double, confidence double"


def _loop(words):
    """All repairs of one video's (idx, word, start, end, confidence), one after the other."""
    one = lambda c: 1.0 if c is None else c

    def pairs(rows, match):
        out, i = [], 0
        while i < len(rows):
            found = match(rows[i], rows[i + 1]) if i + 1 < len(rows) else None
            out.append(found or rows[i])
            i += 2 if found else 1
        return out

    def split(a, b):
        if a[1] is None or b[1] is None:
            return None
        whole = W.SPLIT_WORDS.get(a[1], {}).get(b[1].lower())
        if whole:
            return (a[0], whole, a[2], b[3], max((one(a[4]) + one(b[4])) / 2, 0.8))
        short = len(a[1]) <= 3 and a[1][:1].isupper() and a[1].isascii() and a[1].isalpha() and (len(a[1]) == 1 or a[1][1:].islower())
        if short and b[1].isascii() and b[1].isalpha() and b[1].islower() and len(b[1]) >= 4 and (a[1] + b[1]).lower() in W.LIKELY_SPLIT:
            return (a[0], a[1][0].upper() + a[1][1:].lower() + b[1].lower(), a[2], b[3], min(one(a[4]), one(b[4])))
        return None

    rows = pairs(words, split)
    rows = pairs(rows, lambda a, b: (a[0], a[1] + b[1], a[2], b[3], min(one(a[4]), one(b[4]))) if b[1] in W.CONTRACTIONS and a[1] is not None else None)
    out, i = [], 0
    while i < len(rows):
        j, letter = i + 1, rows[i][1]
        if letter is not None and len(letter) == 1 and letter.isascii() and letter.isalpha():
            while j < len(rows) and rows[j][1] is not None and rows[j][1].lower() == letter.lower():
                j += 1
        run = rows[i:j]
        out.append(run[0] if len(run) == 1 else (run[0][0], "".join(r[1] for r in run), run[0][2], run[-1][3], min(one(r[4]) for r in run)))
        i = j
    keep = lambda t: not (t.isascii() and t.isalpha() and (len(t) == 1 and t not in W.ONE_LETTER or len(t) == 2 and t.lower() not in W.TWO_LETTERS))
    rows = [list(r) for r in out if keep((r[1] or "").strip())]
    for a, b in zip(rows, rows[1:]):
        if b[2] < a[3]:
            a[3] = b[2] = (a[3] + b[2]) / 2
    shift = 0.0
    for i, r in enumerate(rows):
        r[2], r[3] = r[2] + shift, r[3] + shift
        lacks = 50 - (r[3] - r[2])
        if lacks > 0:
            gap = rows[i + 1][2] + shift - r[3] if i + 1 < len(rows) else lacks
            r[3] += lacks
            shift += max(0, lacks - gap)
    return [(i, w, round(s, 6), round(e, 6), c) for i, w, s, e, c in rows]


def test_repairs_by_loop(spark):
    rng = random.Random(8)
    parts = ["Str", "uggling", "ong", "It", "'s", "'s", "z", "Z", "z", "a", "h", "pro", "GRAM", "Eve", "Som", "ething", "xy", "go", "hello", "r", "isk", "at", "risk", "b", "", None, "日", "A"]
    table, at = [], {}
    for v, n in ((1, 500), (2, 90), (3, 1), (4, 2)):
        at = 0.0
        for i in range(n):
            at += rng.choice([0, 5, 40, 300])
            table.append((v, i, rng.choice(parts), at, at + rng.choice([0, 10, 60, 200]), rng.choice([None, 0.5, 0.9])))
    got = {}
    for r in W.repaired_hearing(spark.createDataFrame(table, WORD).repartition(3)).collect():
        got.setdefault(r["video_id"], []).append((r["idx"], r["word"], round(r["start_ms"], 6), round(r["end_ms"], 6), r["confidence"]))
    want = {v: _loop([r[1:] for r in table if r[0] == v]) for v in (1, 2, 3, 4)}
    for v, rows in want.items():
        wrong = [(a, b) for a, b in zip(sorted(got.get(v, [])), rows) if a != b]
        assert not wrong, wrong[:3]
        assert len(got.get(v, [])) == len(rows)
    assert W.repaired_hearing(spark.createDataFrame([], WORD)).collect() == []


def test_notation_by_loop(spark):
    rng = random.Random(3)
    parts = ["x", "^", "2", "_", "<", "-", ">", "=", "!", "sqrt", "SQRT", "(", "and", "é", None]
    table = [(v, i, rng.choice(parts), i * 10, i * 10 + 9) for v in (1, 2) for i in range(600)]

    def loop(words):
        alike = lambda t: t is not None and t.isascii() and t.isalnum()
        out, i = [], 0
        while i < len(words):
            a, b, c = (words[i + k][1] if i + k < len(words) else None for k in range(3))
            if a is not None and a.lower() == "sqrt" and b == "(":
                n, w = 2, "sqrt("
            elif b in ("^", "_") and alike(a) and alike(c):
                n, w = 3, a + b + c
            elif (a, b, c) == ("<", "-", ">"):
                n, w = 3, "<->"
            else:
                n, w = (2, W.SIGNS[a, b]) if (a, b) in W.SIGNS else (1, a)
            out.append((words[i][0], w, words[i][2], words[i + n - 1][3]))
            i += n
        return out

    rows = W.join_notation(spark.createDataFrame(table, "video_id bigint, idx bigint, word string, start_ms bigint, end_ms bigint")).collect()
    for v in (1, 2):
        assert sorted(tuple(r)[1:] for r in rows if r["video_id"] == v) == loop([r[1:] for r in table if r[0] == v])
