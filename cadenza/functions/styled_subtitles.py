"""Lines of styled subtitle files (ASS): style, wrapping, and frames that light up the word under way, as column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import ass_time

# Size of the picture that positions refer to, and the margins that stay free.
WIDTH, HEIGHT = 1080, 1920
LEFT, RIGHT, TOP, BOTTOM = 96, 96, 220, 380
HEAD = [
    "[Script Info]", "ScriptType: v4.00+", f"PlayResX: {WIDTH}", f"PlayResY: {HEIGHT}", "", "[V4+ Styles]",
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
]
EVENTS = ["", "[Events]", "Format: Layer, Start, End, Style, Text"]


def _held(value: float, low: float, high: float) -> float:
    return min(high, max(low, value))


@dataclass(frozen=True)
class Style:
    """How captions look. Sizes, margins and positions are held to what fits the picture when they are used."""

    font: str = "Arial"
    size: int = 72
    primary: str = "&H00FFFFFF"
    secondary: str = "&H008A8A8A"
    outline_colour: str = "&H00000000"
    back: str = "&H64000000"
    border: int = 1
    outline: int = 4
    shadow: int = 0
    alignment: int = 2
    left: int = 80
    right: int = 80
    vertical: int = 220
    x: int = 0
    y: int = 0
    chars: int = 0
    lines: int = 2

    @property
    def most_chars(self) -> int:
        """Characters of a line: as given, else what the width holds, 18 to 30."""
        size = _held(self.size, 28, 72)
        return self.chars if self.chars > 0 else int(_held((WIDTH - LEFT - RIGHT) // max(1.0, size * 0.58), 18, 30))

    @property
    def most_lines(self) -> int:
        return int(_held(self.lines, 1, 3))

    @property
    def edge(self) -> int:
        return int(_held(self.outline, 0, 20))

    @property
    def position(self) -> str:
        if self.x <= 0 or self.y <= 0:
            return ""
        return f"{{\\pos({int(_held(self.x, LEFT, WIDTH - RIGHT))},{int(_held(self.y, TOP, HEIGHT - BOTTOM))})}}"

    def header(self) -> list[str]:
        """The file's lines before its events."""
        border = 3 if self.border == 3 else 1
        margins = f"{max(self.left, LEFT)},{max(self.right, RIGHT)},{max(self.vertical, BOTTOM)}"
        style = f"Style: Default,{self.font},{int(_held(self.size, 28, 72))},{self.primary},{self.secondary},{self.outline_colour},{self.back},1,0,0,0,100,100,0,0,{border},{self.edge},{int(_held(self.shadow, 0, 20))},{self.alignment},{margins},1"
        return [*HEAD, style, *EVENTS]


def escaped(text: Column) -> Column:
    """Trimmed text without braces, line breaks as \\N."""
    return F.replace(F.regexp_replace(F.trim(F.regexp_replace(text, "\r\n?", "\n")), "[{}]", ""), F.lit("\n"), F.lit("\\N"))


def wrapped(text: Column, style: Style) -> Column:
    """The lines of a caption: words are added while they fit, line breaks of the text open a line while there is one left, and a text too long for the last one ends with an ellipsis."""
    paragraphs = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    words = F.flatten(F.transform(paragraphs, lambda p, i: F.transform(F.filter(F.split(p, "\\s+"), lambda w: w != ""), lambda w, k: F.struct(i.alias("p"), k.alias("k"), w.alias("w")))))
    state = lambda lines, closed: F.named_struct(F.lit("lines"), lines, F.lit("closed"), closed)

    def add(acc: Column, x: Column) -> Column:
        lines, n = acc["lines"], F.size(acc["lines"])
        now = F.get(lines, n - 1)
        joined = F.concat(now, F.lit(" "), x["w"])
        put = lambda line: F.concat(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(line))
        more = state(F.concat(lines, F.array(x["w"])), acc["closed"])
        cut = F.left(F.when(now.endswith("..."), now).otherwise(F.concat(now, F.lit("..."))), F.lit(style.most_chars))
        return (
            F.when(x["p"] == acc["closed"], acc).when(n == 0, more).when((x["p"] > 0) & (x["k"] == 0) & (n < style.most_lines), more)
            .when(F.length(joined) <= style.most_chars, state(put(joined), acc["closed"])).when(n >= style.most_lines, state(put(cut), x["p"])).otherwise(more)
        )

    return F.aggregate(words, state(F.array().cast("array<string>"), F.lit(-1)), add, lambda acc: acc["lines"])


def dialogue(start_ms: Column, end_ms: Column, text: Column, style: Style) -> Column:
    """One event line."""
    return F.concat(F.lit("Dialogue: 0,"), ass_time(start_ms), F.lit(","), ass_time(end_ms), F.lit(f",Default,{style.position}"), text)


def plain_event(start_ms: Column, end_ms: Column, text: Column, style: Style) -> Column:
    lines = F.transform(wrapped(text, style), escaped)
    return dialogue(start_ms, end_ms, F.array_join(lines, "\\N"), style)


def active_word_events(start_ms: Column, end_ms: Column, text: Column, words: Column, style: Style) -> Column:
    """An event for every word of a caption (``words``: array<struct<text, start_ms, end_ms>>), which shows all of them and lights up the one under way.

    Words that fit no line are left out. An event lasts until the next word begins, a millisecond at least. A caption without words is one plain event.
    """
    state = lambda lines, used, closed: F.named_struct(F.lit("lines"), lines, F.lit("used"), used, F.lit("closed"), closed)

    def place(acc: Column, w: Column) -> Column:
        lines, n = acc["lines"], F.size(acc["lines"])
        at = F.coalesce(F.get(lines, n - 1), F.lit(0))
        size = F.length(w["text"])
        longer = F.when(acc["used"] == 0, size).otherwise(acc["used"] + 1 + size)
        here, below = state(F.concat(lines, F.array(at)), longer, acc["closed"]), state(F.concat(lines, F.array(at + 1)), size, acc["closed"])
        return F.when(acc["closed"], acc).when((longer > style.most_chars) & (at + 1 < style.most_lines), below).when(longer <= style.most_chars, here).otherwise(state(lines, acc["used"], F.lit(True)))

    # The line of every word that is shown.
    lines = F.aggregate(words, state(F.array().cast("array<int>"), F.lit(0), F.lit(False)), place, lambda acc: acc["lines"])
    tag = lambda colour: f"{{\\c{colour}\\3c{style.outline_colour}\\bord{style.edge}\\1a&H00&}}"
    # Once for a caption, not again for every word of every event: a lambda's argument is a value.
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def parts(lines: Column) -> Column:
        between = lambda k: F.when(k == 0, "").when(F.get(lines, k) != F.get(lines, k - 1), "\\N").otherwise("\\h")
        text = lambda w: F.replace(escaped(w["text"]), F.lit(" "), F.lit("\\h"))
        return F.transform(F.slice(words, F.lit(1), F.size(lines)), lambda w, k: F.struct(w["start_ms"].alias("at"), between(k).alias("before"), text(w).alias("text")))

    def frames(shown: Column) -> Column:
        def frame(word: Column, i: Column) -> Column:
            part = lambda other, k: F.concat(other["before"], F.when(k == i, tag(style.primary)).otherwise(tag(style.secondary)), other["text"], F.lit("{\\r}"))
            start = F.greatest(start_ms, word["at"])
            end = F.greatest(start + 1, F.coalesce(F.get(shown, i + 1)["at"], end_ms))
            return dialogue(start, end, F.array_join(F.transform(shown, part), ""), style)

        return F.transform(shown, frame)

    lit = bound(lines, lambda placed: bound(parts(placed), frames))
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, lit).otherwise(F.array(dialogue(start_ms, end_ms, escaped(F.coalesce(text, F.lit(""))), style)))
