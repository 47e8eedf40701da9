"""Operators whose decisions depend on earlier ones: one ordered group at a time through a grouped Arrow map.

Groups are videos, so a group's size is bounded by a video's length; Spark deals the groups out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from cadenza.operators.scans import edit_distance
from cadenza.operators.subsequence import common_subsequence

_SENTENCE = re.compile(r"[.!?][\"')]*$")
_STRONG = re.compile(r"[!?:;]$")
# Words that open a new thought, short words that stay apart, and word endings heard as words.
PIVOTS = {"but", "so", "because", "however", "then", "now", "instead", "actually", "plus", "yet"}
STAY_APART = {"a", "an", "as", "at", "be", "by", "do", "go", "he", "if", "in", "is", "it", "me", "my", "no", "of", "on", "or", "so", "to", "up", "us", "we"}
SUFFIXES = {"ing", "ed", "er", "est", "ly", "tion", "ment", "ness", "ful", "less"}


def by_group(df: DataFrame, keys: list[str], order: list[str], schema: str, make: Callable[[list[dict]], Iterable[tuple]]) -> DataFrame:
    """Apply ``make`` to each group's rows in order; it yields tuples for the columns after the keys."""
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = make(rows.sort_values(order, kind="stable").to_dict("records"))
        return pd.DataFrame([(*key, *m) for m in made], columns=columns)

    return df.groupBy(*keys).applyInPandas(run, schema)


@dataclass
class Group:
    """Consecutive timed words."""

    words: list[str] = field(default_factory=list)
    start: int = 0
    end: int = 0

    @classmethod
    def of(cls, row: dict) -> Group:
        return cls([row["word"]], row["start_ms"], row["end_ms"])

    def add(self, row: dict) -> None:
        self.words.append(row["word"])
        self.end = row["end_ms"]

    @property
    def chars(self) -> int:
        return sum(len(w.strip()) for w in self.words) + len(self.words) - 1

    @property
    def text(self) -> str:
        return " ".join(self.words)


@dataclass(frozen=True)
class ChunkRules:
    """Limits of caption chunks."""

    least: int = 2
    target: int = 5
    most: int = 7
    words_per_minute: float = 180.0
    chars_per_second: float = 15.0
    short_ms: float = 800.0
    long_ms: float = 1100.0
    pause_ms: float = 300.0
    short_words: int = 2

    def needed_ms(self, group: Group) -> float:
        """Time on screen that a group's words and characters need."""
        n = len(group.words)
        floor = self.short_ms if n <= self.short_words else self.long_ms
        return max(floor, n * 60_000 / self.words_per_minute, group.chars * 1000 / self.chars_per_second)

    def break_reason(self, now: Group, before: str, row: dict) -> str | None:
        """Why the next word opens a new chunk, the first rule that applies; None if it does not."""
        n, gap = len(now.words), row["start_ms"] - now.end
        sentence, strong = bool(_SENTENCE.search(before)), bool(_STRONG.search(before))
        pivot = row["word"].lower().strip(".,!?") in PIVOTS
        long_enough = now.end - now.start >= self.needed_ms(now)
        pace = (now.chars + 1 + len(row["word"])) * 1000 / max(row["end_ms"] - now.start, 1)
        hint = sentence or strong or before.lower().strip(".,!?") in PIVOTS or gap >= 0.6 * self.pause_ms
        rules = (
            ("max-words", n >= self.most), ("pause-gap", gap >= self.pause_ms), ("pace-limit", n >= self.least and pace > 1.25 * self.chars_per_second),
            ("sentence-end", n >= self.least and sentence), ("pivot", long_enough and pivot and n >= self.least),
            ("punch", long_enough and strong and n <= self.short_words), ("soft-hint", long_enough and n >= self.target and hint),
        )
        return next((name for name, holds in rules if holds), None)


def _joinable(left: Group, right: Group, rules: ChunkRules) -> bool:
    both = Group(left.words + right.words, left.start, right.end)
    ended = _SENTENCE.search(left.words[-1]) or _STRONG.search(left.words[-1])
    pace = both.chars * 1000 / max(both.end - both.start, 1)
    return right.start - left.end < rules.pause_ms and not ended and len(both.words) <= rules.most and pace <= 1.25 * rules.chars_per_second


def _chunks(rows: list[dict], rules: ChunkRules) -> list[Group]:
    groups: list[Group] = []
    for i, row in enumerate(rows):
        reason = rules.break_reason(groups[-1], groups[-1].words[-1], row) if groups else "start"
        orphan = reason not in (None, "start", "max-words") and i == len(rows) - 1 and len(groups[-1].words) < rules.most
        if reason and not orphan:
            groups.append(Group.of(row))
        else:
            groups[-1].add(row)
    merged: list[Group] = []
    queue = groups[::-1]
    while queue:
        now = queue.pop()
        while queue and now.end - now.start < rules.needed_ms(now) and _joinable(now, queue[-1], rules):
            after = queue.pop()
            now = Group(now.words + after.words, now.start, after.end)
        if merged and now.end - now.start < rules.needed_ms(now) and _joinable(merged[-1], now, rules):
            last = merged.pop()
            now = Group(last.words + now.words, last.start, now.end)
        merged.append(now)
    # A chunk stays on screen as long as it needs, but not into the next.
    for now, after in zip(merged, [*merged[1:], None]):
        wanted = now.start + int(rules.needed_ms(now))
        now.end = max(now.end, wanted if after is None else min(wanted, after.start))
    return merged


def caption_chunks(words: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Caption chunks of each video: video_id, chunk, n_words, text, start_ms, end_ms."""
    schema = "video_id bigint, chunk bigint, n_words bigint, text string, start_ms bigint, end_ms bigint"
    return by_group(words, ["video_id"], ["idx"], schema, lambda rows: [(i, len(g.words), g.text, g.start, g.end) for i, g in enumerate(_chunks(rows, rules))])


def caption_pages(words: DataFrame, line_chars: int = 25, lines: int = 2, gap_ms: int = 1000, most: int = 8) -> DataFrame:
    """Caption pages of each video: lines of at most ``line_chars`` (longer words alone), pages of at most ``lines``.

    A page also ends at a long gap, at ``most`` words and after a sentence.
    """

    def pages(rows: list[dict]) -> Iterable[tuple]:
        out: list[tuple[Group, list[list[str]]]] = []
        before: dict | None = None
        for row in rows:
            word = row["word"]
            if out and before is not None:
                page, text = out[-1]
                new_line = len(" ".join([*text[-1], word.strip()])) > line_chars
                full = new_line and len(text) >= lines
                if not (full or row["start_ms"] - before["end_ms"] > gap_ms or len(page.words) >= most or _SENTENCE.search(before["word"])):
                    page.add(row)
                    text.append([word]) if new_line else text[-1].append(word)
                    before = row
                    continue
            out.append((Group.of(row), [[word]]))
            before = row
        for i, (page, text) in enumerate(out):
            yield i, len(page.words), len(text), "\n".join(" ".join(t) for t in text), page.start, page.end

    schema = "video_id bigint, page bigint, n_words bigint, n_lines bigint, text string, start_ms bigint, end_ms bigint"
    return by_group(words, ["video_id"], ["idx"], schema, pages)


def _is_fragment(before: str, word: str, gap: int) -> bool:
    """Whether a word continues the one before: letters only, hardly a gap, and short or a word ending."""
    if not (before.isascii() and before.isalpha() and word.isascii() and word.isalpha()) or not -50 <= gap <= 120:
        return False
    a, b = before.lower(), word.lower()
    return min(len(a), len(b)) <= 1 or (len(a) <= 2 and len(b) <= 4 and a not in STAY_APART) or b in SUFFIXES


def merge_fragments(words: DataFrame) -> DataFrame:
    """Words with fragments merged into the word before (chains too): video_id, idx, word, start_ms, end_ms, confidence."""

    def merge(rows: list[dict]) -> Iterable[tuple]:
        kept: list[list] = []
        for r in rows:
            if kept and _is_fragment(kept[-1][0], r["word"], r["start_ms"] - kept[-1][2]):
                last = kept[-1]
                kept[-1] = [last[0] + r["word"], last[1], max(last[2], r["end_ms"]), (last[3] + r["confidence"]) / 2]
            else:
                kept.append([r["word"], r["start_ms"], r["end_ms"], r["confidence"]])
        return [(i, *k) for i, k in enumerate(kept)]

    return by_group(words, ["video_id"], ["start_ms", "end_ms", "idx"], "video_id bigint, idx bigint, word string, start_ms bigint, end_ms bigint, confidence double", merge)


def transcript_segments(words: DataFrame, most_ms: int = 4000) -> DataFrame:
    """Segments of at most four seconds that also end at ``. ? !``: text, times and mean confidence."""

    def segments(rows: list[dict]) -> Iterable[tuple]:
        out: list[tuple[Group, list[float]]] = []
        closed = True
        for r in rows:
            fresh = closed or r["end_ms"] - out[-1][0].start > most_ms
            if fresh:
                out.append((Group.of(r), [r["confidence"]]))
                closed = False
            else:
                group, heard = out[-1]
                end = max(group.end, r["end_ms"])
                group.add(r)
                group.end = end
                heard.append(r["confidence"])
                closed = r["word"].strip().endswith((".", "?", "!"))
        return [(i, g.text, g.start, g.end, round(sum(c) / len(c), 6)) for i, (g, c) in enumerate(out)]

    return by_group(words, ["video_id"], ["start_ms", "end_ms", "idx"], "video_id bigint, segment bigint, text string, start_ms bigint, end_ms bigint, confidence double", segments)


def fix_overlaps(words: DataFrame, least_ms: int = 50) -> DataFrame:
    """Overlapping neighbours meet at their midpoint; words shorter than ``least_ms`` are stretched and push the next one on."""

    def fix(rows: list[dict]) -> Iterable[tuple]:
        out: list[list] = []
        for r in rows:
            start, end = r["start_ms"], r["end_ms"]
            if out and start < out[-1][2]:
                start = out[-1][2] = max((start + out[-1][2]) // 2, out[-1][1])
            out.append([r["word"], start, max(end, start)])
        pushed = 0
        for w in out:
            w[1] = max(w[1], pushed)
            w[2] = pushed = max(w[2], w[1] + least_ms)
        return [(i, *w) for i, w in enumerate(out)]

    return by_group(words, ["video_id"], ["idx"], "video_id bigint, idx bigint, word string, start_ms bigint, end_ms bigint", fix)


def suppress(candidates: DataFrame, gap_ms: int = 3000, most: int = 5) -> DataFrame:
    """Greedy choice of ranked spans: a span is rejected when it overlaps or crowds one accepted before it.

    Input: video_id, start_ms, end_ms, score, fine (whether it passes on its own). Output adds rank, accepted, reason.
    """

    def choose(rows: list[dict]) -> Iterable[tuple]:
        accepted: list[tuple[int, int]] = []
        for rank, r in enumerate(sorted(rows, key=lambda r: (-r["score"], r["start_ms"])), 1):
            near = any(r["start_ms"] < e + gap_ms and r["end_ms"] > s - gap_ms for s, e in accepted)
            reason = "too-close" if near else None if r["fine"] else "low-score"
            take = reason is None and len(accepted) < most
            if take:
                accepted.append((r["start_ms"], r["end_ms"]))
            yield rank, r["start_ms"], r["end_ms"], r["score"], take, reason or (None if take else "enough")

    schema = "video_id bigint, rank bigint, start_ms bigint, end_ms bigint, score double, accepted boolean, reason string"
    return by_group(candidates, ["video_id"], ["start_ms"], schema, choose)


@lru_cache(maxsize=1 << 14)
def _caption_words(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[a-z0-9']+", text.lower()))


def similar_captions(a: str, b: str) -> bool:
    """Equal, sharing 0.8 of their words, two edits apart, or six at 0.88 similarity."""
    x, y = _caption_words(a), _caption_words(b)
    if x == y:
        return True
    if not x or not y:
        return False
    others = set(y)
    if sum(w in others for w in x) / max(len(x), len(y)) >= 0.8:
        return True
    a, b = " ".join(x), " ".join(y)
    if abs(len(a) - len(b)) > 6:
        return False
    d = edit_distance(a, b)
    return d <= 2 or (d <= 6 and 1 - d / max(len(a), len(b)) >= 0.88)


def caption_sessions(frames: DataFrame, step_ms: int = 500) -> DataFrame:
    """Runs of similar frames become caption segments; the most confident text so far stands for a run.

    Input: video_id, at_ms, text, confidence. Runs of blank text are left out.
    """

    def sessions(rows: list[dict]) -> Iterable[tuple]:
        runs: list[dict] = []
        for r in rows:
            if runs and similar_captions(r["text"], runs[-1]["text"]):
                run = runs[-1]
                run["end"], run["n"], run["sum"] = r["at_ms"], run["n"] + 1, run["sum"] + r["confidence"]
                if r["confidence"] > run["best"]:
                    run["best"], run["text"] = r["confidence"], r["text"]
            else:
                runs.append({"text": r["text"], "start": r["at_ms"], "end": r["at_ms"], "n": 1, "sum": r["confidence"], "best": r["confidence"]})
        shown = [r for r in runs if r["text"].strip()]
        return [(i, r["text"], r["start"], r["end"] + step_ms, r["n"], round(r["sum"] / r["n"], 6)) for i, r in enumerate(shown)]

    schema = "video_id bigint, segment bigint, text string, start_ms bigint, end_ms bigint, n_frames bigint, confidence double"
    return by_group(frames, ["video_id"], ["at_ms"], schema, sessions)


def align(script: DataFrame, heard: DataFrame) -> DataFrame:
    """Script words paired with heard words by longest common subsequence: video_id, script_idx, heard_idx."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("idx"), b.sort_values("idx")
        plain = lambda x: [re.sub(r"[^a-z0-9]", "", w.lower()) for w in x["word"]]
        x, y = a["idx"].tolist(), b["idx"].tolist()
        rows = [(key[0], x[i], y[j]) for i, j in common_subsequence(plain(a), plain(b))]
        return pd.DataFrame(rows, columns=["video_id", "script_idx", "heard_idx"])

    keyed = script.select("video_id", "idx", "word").groupBy("video_id"), heard.select("video_id", "idx", "word").groupBy("video_id")
    return keyed[0].cogroup(keyed[1]).applyInPandas(run, "video_id bigint, script_idx bigint, heard_idx bigint")


def dedupe_overlays(overlays: DataFrame, ratio: float = 0.6) -> DataFrame:
    """Overlays with the same text as the one last kept, and overlapping it by ``ratio`` of the shorter, are merged into it."""

    def dedupe(rows: list[dict]) -> Iterable[tuple]:
        kept: list[list] = []
        for r in rows:
            text, start, end = r["text"], r["start_ms"], r["end_ms"]
            if kept and kept[-1][0].lower() == text.lower():
                last = kept[-1]
                shared = max(0, min(last[2], end) - max(last[1], start))
                if shared >= ratio * max(1, min(last[2] - last[1], end - start)):
                    last[1], last[2] = min(last[1], start), max(last[2], end)
                    continue
            kept.append([text, start, end])
        return [(i, *k) for i, k in enumerate(kept)]

    return by_group(overlays, ["video_id"], ["start_ms", "end_ms"], "video_id bigint, overlay bigint, text string, start_ms bigint, end_ms bigint", dedupe)


def speech_chunks(texts: DataFrame, most: int = 200) -> DataFrame:
    """Texts cut for speech synthesis at sentence ends, else at blanks, else anywhere: doc_id, chunk, text."""

    def pieces(text: str) -> Iterable[str]:
        held = ""
        for sentence in re.split(r"(?<=[.!?])\s+", text.strip()):
            units = [sentence] if len(sentence) <= most else sentence.split()
            for unit in (u[k : k + most] for u in units for k in range(0, max(len(u), 1), most)):
                if held and len(held) + 1 + len(unit) > most:
                    yield held
                    held = unit
                else:
                    held = f"{held} {unit}".strip()
        if held:
            yield held

    def run(batches):
        for b in batches:
            rows = [(i, k, p) for i, t in zip(b["doc_id"], b["text"]) for k, p in enumerate(pieces(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text"])

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id bigint, chunk bigint, text string")
