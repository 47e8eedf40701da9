"""Scans in order that carry a small state, over blocks of a group, so that one group may span any number of tasks.

A group's rows are cut into blocks of bounded length (say a minute of frames). A task scans the blocks it holds once, in order, and hands the state from each to the
next of its group; a block whose forerunner lies in another task is scanned as if the group began with it. Then the blocks whose entry differs from the state before
them are scanned again from there, until all agree. The state is all that passes from block to block, and a scan forgets its start as soon as it
meets a boundary that does not depend on it, so few rounds are needed; at worst a group takes as many rounds as the blocks behind a border of tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.sources.shared import forget, written

#: A scan takes the state (None at a group's beginning) and a block's rows in order, each a tuple of the columns it was asked for; it gives tuples of pieces and the state behind them.
Scan = Callable[[str | None, list[tuple]], tuple[list[tuple], str | None]]
#: Blocks that a task turns into Python values at once.
BLOCKS_AT_ONCE = 256


def block_scan(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], block: Column, scan: Scan, pieces: str) -> DataFrame:
    """The pieces (columns of the DDL ``pieces``) that ``scan`` gives for every group of ``rows``, with the keys, the block's number ``_n`` and ``_piece``, its place in the block.

    ``block`` must not fall as the ``order`` rises, and bound the rows of a block. Rows with null keys form groups of their own; ties in order are taken in the
    order of ``columns``. A scan's rows hold ``order`` and then ``columns``. The state is a string.
    """
    row = F.struct(*order, *[c for c in columns if c not in order])
    cut = rows.groupBy(*keys, block.alias("_block")).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    cut = written(cut.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_block")).cast("long")).drop("_block"), "blocks")
    names = [*keys, "_n"]
    fields = [p.strip().split(" ") for p in pieces.split(",")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    columns_out, kinds = [f[0] for f in fields], [types[f[1]] for f in fields]
    scanned = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*names).schema)
    scanned += f", _entry string, _exit string, _pieces array<struct<{', '.join(f'{n}: {t}' for n, t in fields)}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scans each block from its ``_entry``, or, without that column, from the state behind the block before it."""
        last, state = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                part = batch.slice(start, BLOCKS_AT_ONCE)
                lists = part.column("_rows")
                sizes, values = lists.value_lengths().to_pylist(), zip(*(c.to_pylist() for c in lists.flatten().flatten()))
                own = [part.column(n) for n in names]
                given = part.column("_entry").to_pylist() if "_entry" in part.schema.names else None
                entries, exits, ends, made = [], [], [0], []
                for i, (n, *group) in enumerate(zip(own[-1].to_pylist(), *(c.to_pylist() for c in own[:-1]))):
                    entry = given[i] if given else state if last == (n - 1, group) else None
                    found, state = scan(entry, list(islice(values, sizes[i])))
                    last = (n, group)
                    made += found
                    entries.append(entry)
                    exits.append(state)
                    ends.append(len(made))
                arrays = [pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * len(kinds), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(entries, pa.string()), pa.array(exits, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, columns_out))],
                    [*names, "_entry", "_exit", "_pieces"])

    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    first = written(cut.mapInArrow(run, scanned), "scanned")
    ready = first
    states = first.select(*names, "_entry", "_exit")
    before = Window.partitionBy(*keys).orderBy("_n")
    rounds = 0
    while True:
        entered = states.withColumn("_want", F.lag("_exit").over(before))
        stale = entered.where(~F.col("_want").eqNullSafe(F.col("_entry")))
        if not stale.take(1):
            break
        again = cut.alias("c").join(stale.alias("s"), same("c", "s")).select("c.*", F.col("s._want").alias("_entry"))
        # The state at the end is found again only for these; the others keep theirs.
        redone = again.mapInArrow(run, scanned)
        merged = entered.alias("s").join(redone.alias("r"), same("s", "r"), "left").select(
            *[F.col(f"s.{n}").alias(n) for n in names], F.col("s._want").alias("_entry"), F.when(F.col("r._n").isNotNull(), F.col("r._exit")).otherwise(F.col("s._exit")).alias("_exit"))
        old, states = states, written(merged, "states")
        if rounds:
            forget(old)
        rounds += 1
    if rounds:
        other = first.alias("f").join(states.alias("s"), same("f", "s")).where(~F.col("f._entry").eqNullSafe(F.col("s._entry")))
        other = written(other.select(*[F.col(f"s.{n}").alias(n) for n in names], F.col("s._entry").alias("_entry")), "moved")
        again = cut.alias("c").join(other.alias("s"), same("c", "s")).select("c.*", "s._entry").mapInArrow(run, scanned)
        ready = first.alias("f").join(other.alias("s"), same("f", "s"), "left_anti").unionByName(again)
    return ready.select(*names, F.posexplode("_pieces").alias("_piece", "_p")).select(*names, "_piece", *[F.col(f"_p.{c}").alias(c) for c in columns_out])


def edit_distance(a: str, b: str) -> int:
    """Least insertions, deletions and replacements from ``a`` to ``b``: a column of the distance table is two whole numbers, whose bits say where it rises and falls."""
    if not a or not b:
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        level = ((same & up) + up ^ up) | same
        rise, fall = down | every & ~(level | up), up & level
        distance += (rise & top > 0) - (fall & top > 0)
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(same | down | rise)) & every, rise & (same | down) & every
    return distance


def edit_similarity(a: str, b: str) -> float:
    """1 - edit distance / longer length."""
    return 1.0 if a == b else 1 - edit_distance(a, b) / max(len(a), len(b))


def same_shown_text(a: str, b: str, least: float = 0.9) -> bool:
    """Whether two recognised texts are the same letters and digits, or ``least`` alike by edit distance."""
    plain = lambda t: re.sub("[^a-z0-9]", "", t.lower())
    if plain(a) == plain(b):
        return True
    # The lengths alone bound the similarity.
    return min(len(a), len(b)) >= least * max(len(a), len(b)) and edit_similarity(a, b) >= least


def text_sessions(frames: DataFrame, step_ms: int, block_ms: int = 60_000) -> DataFrame:
    """Runs of frames whose text is that of the run's first frame: video_id, start_ms, end_ms, text, confidence, n_frames.

    ``frames``: video_id, at_ms, text, confidence. A frame goes on with a run if it is the same as the run's first text, 0.9 by edit distance. A run ends a step behind its
    last frame; its confidence is the mean of those that are known (null if none). Null texts count as empty, empty texts form runs too; frames without a time are left out,
    of frames at the same time the smaller text comes first.
    """
    rows = frames.where("at_ms is not null").select("video_id", "at_ms", F.coalesce("text", F.lit("")).alias("text"), "confidence")

    def scan(state: str | None, block: list[tuple]) -> tuple[list[tuple], str | None]:
        made: list[list] = []
        for at, text, confidence in block:
            if state is None or not same_shown_text(state, text):
                state = text
                made.append([False, at, at, state, 0.0, 0, 0])
            elif not made:
                made.append([True, at, at, state, 0.0, 0, 0])
            now = made[-1]
            now[2] = at
            now[6] += 1
            if confidence is not None:
                now[4] += confidence
                now[5] += 1
        return [tuple(m) for m in made], state

    pieces = block_scan(rows, ["video_id"], ["at_ms"], ["text", "confidence"], F.floor(F.col("at_ms") / block_ms), scan, "goes_on boolean, first bigint, last bigint, text string, total double, n_known bigint, n bigint")
    run = F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(Window.partitionBy("video_id").orderBy("_n", "_piece"))
    whole = pieces.withColumn("_run", run).groupBy("video_id", "_run").agg(
        F.min("first").alias("start_ms"), (F.max("last") + step_ms).alias("end_ms"), F.min_by("text", F.struct("_n", "_piece")).alias("text"),
        F.sum("total").alias("t"), F.sum("n_known").alias("k"), F.sum("n").alias("n_frames"))
    return whole.select("video_id", "start_ms", "end_ms", "text", F.when(F.col("k") > 0, F.col("t") / F.col("k")).alias("confidence"), "n_frames")


def thin_by_gap(times: DataFrame, keys: list[str], time: str, gap: int, block: int) -> DataFrame:
    """Times of each group that lie ``gap`` or more behind the last one kept; the first is kept. Null times go; equal times come once at most."""

    def scan(state: str | None, rows: list[tuple]) -> tuple[list[tuple], str | None]:
        made, last = [], None if state is None else int(state)
        for (at,) in rows:
            if last is None or at - last >= gap:
                last = at
                made.append((last,))
        return made, None if last is None else str(last)

    distinct = times.where(F.col(time).isNotNull()).select(*keys, F.col(time).cast("long").alias(time)).distinct()
    return block_scan(distinct, keys, [time], [], F.floor(F.col(time) / block), scan, f"{time} bigint").select(*keys, time)


def flat_caption(text: Column) -> Column:
    """Single blanks, none at the edges, in lower case; null gives an empty text."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " ")))


def caption_words(flat: Column) -> Column:
    """Words of a flat caption that keep letters, digits or apostrophes."""
    return F.filter(F.split(F.regexp_replace(flat, "[^a-z0-9' ]+", ""), " "), lambda w: w != "")


def similar_shown(a: Column, b: Column, x: Column | None = None, y: Column | None = None) -> Column:
    """Whether two captions are alike: equal but for case and blanks, 0.8 of their words shared, two edits apart, or six at 0.88 similarity.

    ``x`` and ``y``, where given, are the words of ``a`` and ``b``, which then must be flat; as columns of their own they are cut once, not again for every word they are held against.
    """
    if x is None or y is None:
        a, b = flat_caption(a), flat_caption(b)
        x, y = caption_words(a), caption_words(b)
    shared = F.size(F.filter(x, lambda w: F.array_contains(y, w))) / F.greatest(F.size(x), F.size(y), F.lit(1))
    d = F.levenshtein(a, b, 6)
    near = (d >= 0) & ((d <= 2) | (1 - d / F.greatest(F.length(a), F.length(b), F.lit(1)) >= 0.88))
    return (a == b) | ((a != "") & (b != "") & ((shared >= 0.8) | near))


def center_jitter(frames: DataFrame, most_mean: float = 10.0, most_p95: float = 40.0) -> DataFrame:
    """How far a caption's centre moves between neighbouring frames that show it: video_id, n_moves, mean_px, p95_px, score.

    ``frames``: video_id, at_ms, text, x0, y0, x1, y1. Frames without text or box are left out before neighbours are taken. The percentile is read off
    ranks between two rows, so no video's moves are gathered. Score: mean of 1 - mean / 10 px and 1 - p95 / 40 px, each from 0 to 1; videos without moves score 1.
    """
    boxes = ["x0", "y0", "x1", "y1"]
    rows = frames.where(F.trim(F.coalesce("text", F.lit(""))) != "").dropna(subset=boxes)
    w = Window.partitionBy("video_id").orderBy("at_ms", "text", *boxes)
    # Texts are shuffled as they are and cut into words behind the shuffle, each once.
    rows = rows.select("video_id", "at_ms", "text", *boxes).repartition("video_id").withColumn("flat", flat_caption(F.col("text"))).withColumn("words", caption_words(F.col("flat")))
    here = F.struct("flat", "words", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    rows = rows.select("video_id", here.alias("a"), F.lag(here).over(w).alias("b"))
    moved = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    moves = rows.select("video_id", F.when(F.col("b").isNotNull() & similar_shown(F.col("a.flat"), F.col("b.flat"), F.col("a.words"), F.col("b.words")), moved).alias("px"))
    # Equal moves fold into counts, whose running sums are ranks.
    counts = moves.where("px is not null").groupBy("video_id", "px").agg(F.count("*").alias("n"))
    ranked = counts.withColumns({"upto": F.sum("n").over(Window.partitionBy("video_id").orderBy("px")), "all": F.sum("n").over(Window.partitionBy("video_id"))})
    place = 0.95 * (F.col("all") - 1)
    holds = lambda rank: (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n"))
    stats = ranked.groupBy("video_id").agg(
        F.max("all").alias("n_moves"), (F.sum(F.col("px") * F.col("n")) / F.max("all")).alias("mean_px"), F.max(place - F.floor(place)).alias("part"),
        F.max(F.when(holds(F.floor(place)), F.col("px"))).alias("low"), F.max(F.when(holds(F.ceil(place)), F.col("px"))).alias("high"))
    p95 = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    known = frames.select("video_id").distinct().join(stats, "video_id", "left").select("video_id", F.coalesce("n_moves", F.lit(0)).alias("n_moves"), F.coalesce("mean_px", F.lit(0.0)).alias("mean_px"), F.coalesce(p95, F.lit(0.0)).alias("p95_px"))
    return known.withColumn("score", (unit(1 - F.col("mean_px") / most_mean) + unit(1 - F.col("p95_px") / most_p95)) / 2)


@lru_cache(maxsize=256)
def _caption_forms(flat: str) -> tuple[list[str], frozenset[str]]:
    """The cleaned words of a caption, and the characters in it."""
    return [w for w in re.sub("[^a-z0-9' ]", "", flat).split(" ") if w], frozenset(flat)


def alike_captions(a: str, b: str) -> bool:
    """``similar_shown`` of two texts whose blanks are single and whose case is folded."""
    if a == b:
        return True
    if not a or not b:
        return False
    (x, p), (y, q) = _caption_forms(a), _caption_forms(b)
    if x and y and sum(w in y for w in x) / max(len(x), len(y)) >= 0.8:
        return True
    longest = max(len(a), len(b))
    # Three edits or more count only where they leave 0.88; a character that the other text lacks takes an edit at least.
    most = 6 if 1 - 3 / longest >= 0.88 else 2
    if abs(len(a) - len(b)) > most or len(p - q) > most or len(q - p) > most:
        return False
    apart = edit_distance(a, b)
    return apart <= 2 or (apart <= 6 and 1 - apart / longest >= 0.88)


def caption_segments(frames: DataFrame, step_ms: int, block_ms: int = 60_000) -> DataFrame:
    """Runs of frames with alike text: video_id, start_ms, end_ms, text, confidence, n_frames, and the box x0, y0, x1, y1 around all of them.

    ``frames``: video_id, at_ms, text, confidence, x0, y0, x1, y1. A frame goes on with a run if its text is alike to the run's most confident text so far, which stands for the
    run. A run ends a step behind its last frame. Blank runs come too, with an empty box; unknown confidences count as 0, null texts as empty, and frames without a time are left out.
    """
    box = ["x0", "y0", "x1", "y1"]
    rows = frames.where("at_ms is not null").select("video_id", "at_ms", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *[F.col(c).cast("double").alias(c) for c in box])

    def scan(state: str | None, block: list[tuple]) -> tuple[list[tuple], str | None]:
        made: list[list] = []
        now = json.loads(state) if state is not None else None
        for at, text, confidence, x0, y0, x1, y1 in block:
            flat = " ".join(text.split()).lower()
            if now is None or not alike_captions(flat, now[2]):
                now = [text, confidence, flat]
                made.append([False, at, at, 0.0, 0, None, None, None, None, None])
            elif not made:
                made.append([True, at, at, 0.0, 0, None, None, None, None, None])
            if confidence > now[1]:
                now = [text, confidence, flat]
            run = made[-1]
            run[2], run[3], run[4], run[5] = at, run[3] + confidence, run[4] + 1, now[0]
            if flat and None not in (x0, y0, x1, y1):
                run[6:] = (x0, y0, x1, y1) if run[6] is None else (min(run[6], x0), min(run[7], y0), max(run[8], x1), max(run[9], y1))
        return [tuple(m) for m in made], None if now is None else json.dumps(now)

    ddl = "goes_on boolean, first bigint, last bigint, total double, n bigint, text string, x0 double, y0 double, x1 double, y1 double"
    pieces = block_scan(rows, ["video_id"], ["at_ms"], ["text", "confidence", *box], F.floor(F.col("at_ms") / block_ms), scan, ddl)
    run = F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(Window.partitionBy("video_id").orderBy("_n", "_piece"))
    whole = pieces.withColumn("_run", run).groupBy("video_id", "_run").agg(
        F.min("first").alias("start_ms"), (F.max("last") + step_ms).alias("end_ms"), F.max_by("text", F.struct("_n", "_piece")).alias("text"), (F.sum("total") / F.sum("n")).alias("confidence"), F.sum("n").alias("n_frames"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return whole.drop("_run")
