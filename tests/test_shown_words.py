"""Appearances of words by a loop over frames, and references in nested JSON."""

import json
import random
import re
from collections import Counter

from cadenza.operators import shown_words as W
from cadenza.sources import artifacts


def _loop(text):
    base = (text or "").split()
    words = dict.fromkeys(base)
    for i in range(len(base)):
        whole = ""
        for k in range(3):
            if i + k >= len(base) or not re.search("[a-zA-Z]", base[i + k]):
                break
            whole += base[i + k]
            if k and len(whole) >= 5:
                words[whole] = None
    out = Counter()
    for w in words:
        tokens = {re.sub("[^a-z0-9]", "", w.lower())} - {""}
        tokens |= {name for name, p in (("plus", "[+＋]"), ("minus", "[-−]"), ("equals", "[=≈]"), ("times", "[*×]"), ("over", "[/÷]"), ("to", "->|→"), ("sqrt", "√|(?i:sqrt)")) if re.fullmatch(p, w)}
        if m := re.fullmatch("([0-9]+)[°º]", w):
            tokens |= {m[1], "degrees"}
        elif re.search("[°º]", w):
            tokens.add("degrees")
        out.update(t for t in tokens if (len(t) >= 2 or t in "aixyz" or t.isdigit()) and not re.fullmatch("[0-9]{4,}", t))
    return out


def test_appearances_by_loop(spark):
    rng = random.Random(4)
    parts = ["multip", "lying", "dist", "rib", "ute", "+", "->", "→", "30°", "°", "12345", "123", "7", "A", "b", "x", "SQRT", "√", "Hello", "hello", "hello!", "é", "日本", "1b", "-", "\n", "  "]
    frames = [(v, t, rng.choice([None, "", " "] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))] * 9), rng.choice([0.2, 0.3, 0.9, None])) for v in (1, 2) for t in range(150)]
    got = {}
    for r in W.word_appearances(spark.createDataFrame(frames, "video_id bigint, at_ms bigint, text string, confidence double")).collect():
        got.setdefault((r["video_id"], r["at_ms"]), Counter())[r["word"]] = r["n"]
    want = {(v, t): _loop(text) for v, t, text, c in frames if c is not None and c >= 0.3}
    assert got == {k: c for k, c in want.items() if c}


def test_references_of_any_depth(spark):
    deep = {"ref": "a", "list": [[{"ref": "b", "other": {"source_ref": "c\"\n", "ref": 5}}], "ref", {"ref": ["d", {"ref": "e"}]}], "x": {"ref": None, "ref2": "no"}, "again": {"ref": "a"}}
    rows = [(1, json.dumps(deep), "k"), (2, "not json {\"ref\": \"z\"", "k"), (3, None, "k"), (4, '["ref"]', "k"), (5, '"ref"', "k"), (None, '{"ref": "n"}', None)]
    made = artifacts.collect_references(spark.createDataFrame(rows, "id int, doc string, `a b.c` string"), "doc", ["ref", "source_ref"])
    assert made.columns == ["id", "a b.c", "key", "value"]
    assert {tuple(r) for r in made.collect()} == {(1, "k", "ref", "a"), (1, "k", "ref", "b"), (1, "k", "source_ref", 'c"\n'), (1, "k", "ref", "e"), (None, None, "ref", "n")}
    assert artifacts.collect_references(spark.createDataFrame([], "id int, doc string"), "doc", ["ref"]).collect() == []
