"""Script and hearing reconciled, layout lines of recognised words, and tolerant JSON."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.captions import SPOKEN
from cadenza.operators.scans import edit_distance
from cadenza.operators.sequences import by_group, common_subsequence

LOOKAHEAD_COMPOUND = 3
LOOKAHEAD_SCRIPT = 12
LEAST = 0.6


def _plain(word: str) -> str:
    return re.sub(r"[^a-z0-9]", "", word.lower())


def _spoken(word: str) -> str:
    """Digits as words, ten before one, so that "2" and "two" agree."""
    for digits, name in SPOKEN.items():
        word = word.replace(digits, name)
    return word


@lru_cache(maxsize=1 << 16)
def _forms(word: str) -> tuple[str, str]:
    """A word's letters and digits as written and as spoken."""
    plain = _plain(word)
    return plain, _spoken(plain)


def _edit_similarity(a: str, b: str) -> float:
    return 1 - edit_distance(a, b) / max(len(a), len(b)) if a and b else float(a == b)


def _most_alike(a: str, b: str) -> float:
    """What the lengths alone let two words reach."""
    return min(len(a), len(b)) / max(len(a), len(b)) if a and b else float(a == b)


@lru_cache(maxsize=1 << 18)
def _alike(a: tuple[str, str], b: tuple[str, str]) -> float:
    return max(_edit_similarity(x, y) for x, y in zip(a, b))


def word_similarity(a: str, b: str) -> float:
    """Edit similarity as written or as spoken, whichever is greater."""
    return _alike(_forms(a), _forms(b))


def _best_ahead(word: tuple[str, str], script: list[tuple[str, str]], at: int) -> tuple[float, int]:
    """Greatest similarity of ``LEAST`` or more among the next script words, and the first place that has it; 0 if there is none."""
    best, place = 0.0, 0
    for k in range(at, min(at + LOOKAHEAD_SCRIPT, len(script))):
        # The slack keeps a bound that rounds otherwise than the similarity from hiding it.
        bound = max(_most_alike(x, y) for x, y in zip(word, script[k])) + 1e-9
        if bound > best and bound >= LEAST and (found := _alike(word, script[k])) > best:
            best, place = found, k
            if best == 1.0:
                break
    return best, place


def _reconciled(heard: list[dict], script: list[str]) -> list[tuple[str, int, int]]:
    """Heard words in the script's spelling, in order: several heard words may be one script word, near script words may be skipped."""
    out: list[tuple[str, int, int]] = []
    said, written = [_forms(w["word"]) for w in heard], [_forms(w) for w in script]
    at = i = 0
    while i < len(heard):
        here = heard[i]
        joined = None
        if at < len(script):
            for n in range(LOOKAHEAD_COMPOUND, 1, -1):
                part = heard[i : i + n]
                if len(part) == n and "".join(w for w, _ in said[i : i + n]) == written[at][0]:
                    joined = part
                    break
        if joined:
            out.append((script[at], joined[0]["start_ms"], joined[-1]["end_ms"]))
            at, i = at + 1, i + len(joined)
            continue
        best, place = _best_ahead(said[i], written, at)
        if best >= LEAST:
            at = place + 1
            out.append((script[place], here["start_ms"], here["end_ms"]))
        else:
            out.append((here["word"], here["start_ms"], here["end_ms"]))
        i += 1
    return out


def _cogrouped(script: DataFrame, heard: DataFrame, make) -> DataFrame:
    """One script and one hearing per video through ``make(heard rows, script words)``."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = make(b.sort_values("idx").to_dict("records"), a.sort_values("idx")["word"].tolist())
        return pd.DataFrame([(key[0], i, *r) for i, r in enumerate(rows)], columns=["video_id", "idx", "word", "start_ms", "end_ms"])

    left = script.select("video_id", "idx", "word").groupBy("video_id")
    right = heard.select("video_id", "idx", "word", "start_ms", "end_ms").groupBy("video_id")
    return left.cogroup(right).applyInPandas(run, "video_id bigint, idx bigint, word string, start_ms bigint, end_ms bigint")


def reconcile(script: DataFrame, heard: DataFrame) -> DataFrame:
    """Heard words with the script's spelling where they match it in order: video_id, idx, word, start_ms, end_ms."""
    return _cogrouped(script, heard, _reconciled)


def _forced(heard: list[dict], script: list[str]) -> Iterable[tuple[str, int, int]]:
    pairs = dict(common_subsequence([_plain(w) for w in script], [_plain(w["word"]) for w in heard]))
    anchors = [(i, heard[j]["start_ms"], heard[j]["end_ms"]) for i, j in sorted(pairs.items())]
    first, last = (heard[0]["start_ms"], heard[-1]["end_ms"]) if heard else (0, 0)
    bounds = [(-1, first, first), *anchors, (len(script), last, last)]
    before = first
    for (i, _, free), (k, until, _) in zip(bounds, bounds[1:]):
        missing = k - i - 1
        for n in range(missing):
            room = max(until - free, 0)
            start, end = max(free + room * n // missing, before), max(free + room * (n + 1) // missing, before)
            yield script[i + 1 + n], start, end
            before = start
        if k < len(script):
            start = max(until, before)
            yield script[k], start, max(heard[pairs[k]]["end_ms"], start)
            before = start


def force_timing(script: DataFrame, heard: DataFrame) -> DataFrame:
    """Every script word with a time: its hearing's where they align, else an even share of the time between; starts never fall."""
    return _cogrouped(script, heard, lambda rows, words: list(_forced(rows, words)))


def layout_lines(words: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """Recognised words as lines in reading order: page_num, line, text, x0, y0, x1, y1.

    A word joins the line whose running mean centre is within ``tolerance`` of the word's height; else it opens one.
    """

    def lines(rows: list[dict]) -> Iterable[tuple]:
        open_lines: list[list[dict]] = []
        for r in rows:
            middle, height = (r["y0"] + r["y1"]) / 2, max(r["y1"] - r["y0"], 1)
            near = [(abs(middle - sum((w["y0"] + w["y1"]) / 2 for w in line) / len(line)), i) for i, line in enumerate(open_lines)]
            off, i = min(near, default=(float("inf"), -1))
            if off <= tolerance * height:
                open_lines[i].append(r)
            else:
                open_lines.append([r])
        for i, line in enumerate(sorted(open_lines, key=lambda x: min(w["y0"] for w in x))):
            line.sort(key=lambda w: w["x0"])
            yield i, " ".join(w["text"] for w in line), *(float(f(w[c] for w in line)) for f, c in ((min, "x0"), (min, "y0"), (max, "x1"), (max, "y1")))

    schema = "page_num int, line int, text string, x0 double, y0 double, x1 double, y1 double"
    return by_group(words, ["page_num"], ["y0", "x0"], schema, lines)


def json_payload(text: Column) -> Column:
    """The first JSON object or array that ends a text, after any noise; null when there is none that parses."""
    found = F.regexp_extract(text, r"(?s)([{\[].*[}\]])\s*$", 1)
    return F.when(F.try_parse_json(found).isNotNull(), F.nullif(found, F.lit("")))


def keyword_rows(responses: DataFrame, text: str = "response") -> DataFrame:
    """Model answers of any accepted shape as rows: a list, a list under keywords, scenes, result or data, or one object.

    Output: the columns of ``responses`` but the text, then pos and item (JSON text). Answers without JSON give no rows.
    """
    payload = json_payload(F.col(text))
    paths = [F.get_json_object(payload, f"$.{k}") for k in ("keywords", "scenes", "result", "data")]
    inner = F.coalesce(*[F.when(p.startswith("["), p) for p in paths], payload)
    items = F.when(inner.startswith("["), F.from_json(inner, "array<string>")).otherwise(F.array(inner))
    kept = [c for c in responses.columns if c != text]
    return responses.where(payload.isNotNull()).select(*kept, F.posexplode(items).alias("pos", "item"))


def fallback_keyword(text: Column) -> Column:
    """The first word of four letters or more that is no stop word, else ``scene``."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{4,})"), F.lit(1))
    useful = F.filter(tokens, lambda t: ~t.isin("this", "that", "with", "from", "they", "were", "have", "your", "what", "when", "will"))
    return F.coalesce(F.try_element_at(useful, F.lit(1)), F.lit("scene"))
