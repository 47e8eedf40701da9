"""Styled subtitle lines against loops over words."""

import random
import re

from pyspark.sql import functions as F

from cadenza.functions import styled_subtitles as S


def _time(ms):
    c = ms // 10
    return f"{c // 360000}:{c // 6000 % 60:02d}:{c // 100 % 60:02d}.{c % 100:02d}"


def _escape(t):
    return re.sub("[{}]", "", re.sub("\r\n?", "\n", t).strip()).replace("\n", "\\N")


def _wrap(text, chars, most):
    lines = []
    for p, paragraph in enumerate(re.sub("\r\n?", "\n", text).strip().split("\n")):
        words = paragraph.split()
        if p and words and lines and len(lines) < most:
            lines.append(words.pop(0))
        for w in words:
            if not lines:
                lines.append(w)
            elif len(f"{lines[-1]} {w}") <= chars:
                lines[-1] += f" {w}"
            elif len(lines) >= most:
                lines[-1] = (lines[-1] + ("" if lines[-1].endswith("...") else "..."))[:chars]
                break
            else:
                lines.append(w)
    return lines


def _karaoke(start, end, text, words, style):
    if not words:
        return [f"Dialogue: 0,{_time(start)},{_time(end)},Default,{style.position}{_escape(text)}"]
    kept, line, used = [], 0, 0
    for w in words:
        n = len(w[0]) if used == 0 else used + 1 + len(w[0])
        if n > style.most_chars and line + 1 < style.most_lines:
            line, used = line + 1, len(w[0])
        elif n <= style.most_chars or line + 1 < style.most_lines:
            used = n
        else:
            break
        kept.append((w, line))
    out = []
    for i, (w, _) in enumerate(kept):
        s = max(start, w[1])
        e = max(s + 1, kept[i + 1][0][1] if i + 1 < len(kept) else end)
        parts = ""
        for k, (o, at) in enumerate(kept):
            parts += "" if k == 0 else "\\N" if at != kept[k - 1][1] else "\\h"
            colour = style.primary if k == i else style.secondary
            parts += f"{{\\c{colour}\\3c{style.outline_colour}\\bord{style.edge}\\1a&H00&}}" + _escape(o[0]).replace(" ", "\\h") + "{\\r}"
        out.append(f"Dialogue: 0,{_time(s)},{_time(e)},Default,{style.position}{parts}")
    return out


def test_events_by_loop(spark):
    rng = random.Random(5)
    styles = [S.Style(), S.Style(chars=9, lines=3, x=10, y=5000), S.Style(size=20, lines=0, primary="&H1", outline=99)]
    vocabulary = ["a", "word", "longer", "extraordinarily", "{x}", "two words", "é👍🏽"]
    rows = []
    for i in range(150):
        words = [(rng.choice(vocabulary), 1000 * i + 100 * k, 1000 * i + 100 * k + 90) for k in range(rng.randint(0, 9))]
        text = rng.choice([" ", "\n", "\r\n", " \n "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))
        rows.append((i, 1000 * i + 50, 1000 * i + 990, text, words))
    frame = spark.createDataFrame(rows, "i int, start_ms bigint, end_ms bigint, text string, words array<struct<text: string, start_ms: bigint, end_ms: bigint>>")
    cols = [F.col(c) for c in ("start_ms", "end_ms", "text")]
    for style in styles:
        got = frame.select("i", S.plain_event(*cols, style).alias("p"), S.active_word_events(*cols, F.col("words"), style).alias("k")).orderBy("i").collect()
        for r, (i, s, e, text, words) in zip(got, rows):
            assert r["k"] == _karaoke(s, e, text, words, style)
            assert r["p"] == f"Dialogue: 0,{_time(s)},{_time(e)},Default,{style.position}" + "\\N".join(map(_escape, _wrap(text, style.most_chars, style.most_lines)))


def test_header():
    head = S.Style(size=500, left=0, shadow=-3).header()
    assert head[0] == "[Script Info]" and head[-1].startswith("Format: Layer") and ",72,&H00FFFFFF," in head[7] and head[7].endswith(",1,4,0,2,96,96,380,1")


def test_lines_are_placed_once_a_caption(spark):
    """Lines and texts of a caption's words are values, not expressions that every word of every event works out again."""
    words = spark.sql("SELECT 1 AS id, array(named_struct('text', 'one', 'start_ms', 0L, 'end_ms', 5L), named_struct('text', 'two', 'start_ms', 5L, 'end_ms', 9L)) AS w")
    events = words.select(S.active_word_events(F.lit(0), F.lit(9), F.lit(""), F.col("w"), S.Style(chars=21)).alias("e"))
    assert events._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert [e.count("&H00FFFFFF") for e in events.first()["e"]] == [1, 1]


def test_features_are_written_before_the_fit(spark):
    from cadenza.plans import registry

    files = registry.queries()["quality_model"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/features-" in f for f in files)
