"""Pixels of sampled frames: edge strips, camera motion, region difference and edge density, each a numpy pass over Arrow batches.

Frames carry ``video_id``, ``frame`` (its number), ``at_ms``, ``width``, ``height`` and ``data``: for colour frames a binary of RGB bytes by rows, for
grey ones an array of floats from 0 to 1. Frames whose data do not fit their size, or that lack one of these, give no rows. Frames are
handled alone or in pairs of neighbours, so no video has to fit one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIDES = ["top", "bottom", "left", "right"]
# Width of the strip, what counts as bright and colourful, and the limits of the gate.
BORDER_RATIO, BRIGHT, CHROMA, SAMPLE_STEP = 0.01, 0.78, 0.42, 3
MAX_DARKENING, MAX_EDGE_CONTENT = 0.12, 0.035
EDGE = 0.18
#: Values of one block of frames, some 60 MB with what is computed from them.
BLOCK_VALUES = 1 << 20
#: Frames of a video whose running maximum is found together.
SPAN = 1000


def _blocks(sizes: list[tuple[int, int]], channels: int) -> Iterator[tuple[tuple[int, int], list[int]]]:
    """Frames of equal size, by number, in blocks of bounded memory."""
    by_size: dict[tuple[int, int], list[int]] = {}
    for i, size in enumerate(sizes):
        by_size.setdefault(size, []).append(i)
    for (w, h), rows in by_size.items():
        step = max(1, BLOCK_VALUES // max(1, w * h * channels))
        for at in range(0, len(rows), step):
            yield (w, h), rows[at : at + step]


def _slices(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of a few megabytes, which bounds what is copied at once."""
    for batch in batches:
        step = max(1, int(batch.num_rows * (4 << 20) / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step).select(columns)


# -- edges of colour frames


def luma_and_saturation(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Luma by the 709 weights and (max - min) / max, both from 0 to 1, over the last axis of RGB values."""
    rgb = rgb.astype(np.float64)
    top = rgb.max(-1)
    luma = (0.2126 * rgb[..., 0] + 0.7152 * rgb[..., 1] + 0.0722 * rgb[..., 2]) / 255
    return luma, np.divide(top - rgb.min(-1), top, out=np.zeros_like(top), where=top > 0)


def strips(w: int, h: int, px: int) -> dict[str, tuple[tuple[int, int, int, int], tuple[int, int, int, int]]]:
    """For each side the outer strip and the one inside it, as x0, y0, x1, y1 within the frame."""
    boxes = {
        "top": ((0, 0, w, px), (0, px, w, 2 * px)), "bottom": ((0, h - px, w, h), (0, h - 2 * px, w, h - px)),
        "left": ((0, 0, px, h), (px, 0, 2 * px, h)), "right": ((w - px, 0, w, h), (w - 2 * px, 0, w - px, h)),
    }
    fit = lambda b: (min(max(b[0], 0), w - 1), min(max(b[1], 0), h - 1), min(max(b[2], 0), w), min(max(b[3], 0), h))
    return {side: (fit(a), fit(b)) for side, (a, b) in boxes.items()}


def edge_strips(frames: DataFrame, border_ratio: float = BORDER_RATIO, bright: float = BRIGHT, chroma: float = CHROMA, step: int = SAMPLE_STEP) -> DataFrame:
    """Four rows for each colour frame: mean luma and saturation of a side's strip and of the one inside it, and the strip's share of bright and of colourful pixels.

    Every ``step``-th pixel of a strip counts, both ways. The strip is ``border_ratio`` of the shorter side wide, two pixels at least.
    """
    out = "video_id bigint, at_ms bigint, side string, luma double, luma_inside double, saturation double, saturation_inside double, bright double, colourful double, border_px int"
    columns = ["video_id", "at_ms", "width", "height", "data"]

    def share(values: np.ndarray) -> np.ndarray:
        flat = values.reshape(len(values), -1)
        return flat.mean(1) if flat.shape[1] else np.zeros(len(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, columns):
            video, at, w, h, data = (c.to_pylist() for c in batch.columns)
            fits = [i for i, d in enumerate(data) if d is not None and w[i] and h[i] and w[i] > 0 and h[i] > 0 and len(d) == w[i] * h[i] * 3]
            for (wide, high), rows in _blocks([(w[i], h[i]) for i in fits], 3):
                rows = [fits[i] for i in rows]
                pixels = np.stack([np.frombuffer(data[i], np.uint8).reshape(high, wide, 3) for i in rows])
                luma, saturation = luma_and_saturation(pixels)
                px = max(2, int(min(wide, high) * border_ratio))
                for side, boxes in strips(wide, high, px).items():
                    (l0, s0), (l1, s1) = (tuple(v[:, y0:y1:step, x0:x1:step] for v in (luma, saturation)) for x0, y0, x1, y1 in boxes)
                    values = [share(l0), share(l1), share(s0), share(s1), share(l0 >= bright), share((s0 >= chroma) & (l0 >= 0.2))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([video[i] for i in rows], pa.int64()), pa.array([at[i] for i in rows], pa.int64()), pa.array([side] * len(rows)),
                        *(pa.array(v, pa.float64()) for v in values), pa.array([px] * len(rows), pa.int32())], [f.split(" ")[0] for f in out.split(", ")])

    return frames.select(*columns).mapInArrow(run, out)


def worst_edges(sides: DataFrame) -> DataFrame:
    """For each video the loudest darkening and edge content over its frames in time order, where they were last raised, and whether the frame passes.

    ``sides``: video_id, at_ms, side, luma, luma_inside, bright, colourful. A row is taken if it raises either maximum and its score (0.65 darkening,
    0.35 content) is not below that of the maxima so far; both maxima then take their larger value. Such a row's score is not below
    any earlier one's, so only rows that hold a running maximum are folded: maxima of spans of a thousand frames come first, then the rows.
    Videos without rows do not come; equal times are told in the order of the sides. Null metrics count as 0.
    """
    darkening = F.greatest(F.lit(0.0), F.coalesce(F.col("luma_inside") - F.col("luma"), F.lit(0.0)))
    content = F.greatest(F.coalesce("bright", F.lit(0.0)), F.coalesce("colourful", F.lit(0.0)))
    place = F.array_position(F.array(*map(F.lit, SIDES)), F.col("side")).cast("int")
    rows = sides.select("video_id", "at_ms", "side", place.alias("place"), darkening.alias("d"), content.alias("e")).withColumn("score", F.col("d") * 0.65 + F.col("e") * 0.35)
    rows = rows.withColumn("span", F.floor(F.col("at_ms") / (SPAN * 40)))
    tops = rows.groupBy("video_id", "span").agg(F.max("score").alias("top"), F.min("at_ms").alias("first"))
    by_span = Window.partitionBy("video_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumns({"before": F.max("top").over(by_span), "earlier": F.min("first").over(by_span)})
    inside = Window.partitionBy("video_id", "span").orderBy("at_ms", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("running", F.max("score").over(inside)).join(tops.select("video_id", "span", "before", "first", "earlier"), ["video_id", "span"])
    record = (F.col("score") > 0) & (F.col("score") >= F.coalesce("running", F.lit(0.0))) & (F.col("score") >= F.coalesce("before", F.lit(0.0)))
    held = rows.where(record).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("at_ms", "place", "side", "d", "e"))).alias("rows"))
    videos = tops.groupBy("video_id").agg(F.min("first").alias("t0"))
    score = lambda a: a["d"] * 0.65 + a["e"] * 0.35
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("e"), F.lit("top").alias("side"), F.col("t0").alias("at_ms"))

    def take(acc: Column, x: Column) -> Column:
        raised = F.struct(F.greatest(acc["d"], x["d"]).alias("d"), F.greatest(acc["e"], x["e"]).alias("e"), x["side"].alias("side"), x["at_ms"].alias("at_ms"))
        return F.when(((x["d"] > acc["d"]) | (x["e"] > acc["e"])) & (score(x) >= score(acc)), raised).otherwise(acc)

    none = F.array().cast("array<struct<at_ms:bigint,place:int,side:string,d:double,e:double>>")
    folded = videos.join(held, "video_id", "left").select("video_id", F.aggregate(F.coalesce("rows", none), zero, take).alias("w"))
    d, e = F.col("w.d"), F.col("w.e")
    # Without a dark strip, content at the edge is meant to be there.
    dark = d > min(0.02, MAX_DARKENING * 0.25)
    return folded.select(
        "video_id", d.alias("max_darkening"), e.alias("max_edge_content"), F.col("w.side").alias("side"), F.col("w.at_ms").alias("at_ms"),
        ((d <= MAX_DARKENING) & (~dark | (e <= MAX_EDGE_CONTENT))).alias("passed"))


# -- motion and regions of grey frames


def neighbours(frames: DataFrame) -> DataFrame:
    """Grey frames with the ``data`` and size of the next one, which has the next number: an equi join on video and number, so that no video is one group."""
    after = frames.select("video_id", (F.col("frame") - 1).alias("frame"), F.col("width").alias("next_width"), F.col("height").alias("next_height"), F.col("data").alias("next_data"))
    return frames.select("video_id", "frame", "width", "height", "data").join(after, ["video_id", "frame"])


def _grey(batches: Iterator[pa.RecordBatch], pair: bool) -> Iterator[tuple[pa.RecordBatch, list[int], tuple[int, int], Callable[[], list[np.ndarray]]]]:
    """Batch, rows, size and pixels of frames of equal size; pairs of unlike sizes come with the size (0, 0)."""
    names = ["video_id", "frame", "width", "height", "data"] + ["next_width", "next_height", "next_data"] * pair
    for batch in _slices(batches, names):
        get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        w, h = get["width"].to_pylist(), get["height"].to_pylist()
        good = lambda d, i: d.is_valid and w[i] and h[i] and w[i] > 0 and h[i] > 0 and len(d) == w[i] * h[i] and d.values.null_count == 0
        fits = [i for i in range(len(w)) if good(get["data"][i], i)]
        sizes = [(w[i], h[i]) for i in fits]
        if pair:
            nw, nh = get["next_width"].to_pylist(), get["next_height"].to_pylist()
            sizes = [(x if (nw[i], nh[i]) == x and good(get["next_data"][i], i) else (0, 0)) for i, x in zip(fits, sizes)]
        for (wide, high), rows in _blocks(sizes, 2):
            rows = [fits[i] for i in rows]

            def pixels(rows=rows, wide=wide, high=high, get=get) -> list[np.ndarray]:
                return [np.stack([get[n][i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(high, wide) for i in rows]) for n in (["data", "next_data"] if pair else ["data"])]

            yield batch, rows, (wide, high), pixels


def integral(values: np.ndarray) -> np.ndarray:
    """Sums of all rectangles from the top left corner, over the last two axes, with a row and a column of zeros in front."""
    return np.pad(values, [(0, 0)] * (values.ndim - 2) + [(1, 0), (1, 0)]).cumsum(-1).cumsum(-2)


def box_sum(table: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    return table[..., y1, x1] - table[..., y0, x1] - table[..., y1, x0] + table[..., y0, x0]


def best_shift(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of frames the mean squared error without a shift, the least one over all shifts of up to a sixteenth of the width (1 to 4 pixels), and its dx and dy.

    Of equal errors no shift, then the first by rows, is taken. The sums of both frames over the common part give a floor for a shift's error, as the
    difference of the means squared and that of the norms; only pairs whose floor is below their best are measured.
    """
    n, h, w = a.shape
    sums = [integral(x) for x in (a, b, a * a, b * b)]
    base = ((a - b) ** 2).mean((1, 2))
    best, dx_best, dy_best = base.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    most = max(1, min(4, w // 16))
    for dy in range(-most, most + 1):
        for dx in range(-most, most + 1):
            count = (w - abs(dx)) * (h - abs(dy))
            if (dx == 0 and dy == 0) or abs(dx) >= w or abs(dy) >= h:
                continue
            left = max(0, -dx), max(0, -dy), min(w, w - dx), min(h, h - dy)
            right = left[0] + dx, left[1] + dy, left[2] + dx, left[3] + dy
            sa, sb, qa, qb = (box_sum(t, *box) for t, box in zip(sums, (left, right, left, right)))
            floor = np.maximum(((sa - sb) / count) ** 2, (np.sqrt(np.maximum(qa, 0)) - np.sqrt(np.maximum(qb, 0))) ** 2 / count)
            open_ = np.flatnonzero(floor * (1 - 1e-9) - 1e-12 < best)
            if len(open_):
                error = ((a[open_, left[1] : left[3], left[0] : left[2]] - b[open_, right[1] : right[3], right[0] : right[2]]) ** 2).mean((1, 2))
                better = error < best[open_]
                rows = open_[better]
                best[rows], dx_best[rows], dy_best[rows] = error[better], dx, dy
    return base, best, dx_best, dy_best


def camera_motion(frames: DataFrame) -> DataFrame:
    """Motion from each grey frame to the next: static, pan_left, pan_right, tilt or unknown, with confidence, shift and error.

    Static if the error is below 1e-4 or a shift takes off less than a twentieth; else the longer way of the best shift says. Neighbours of unlike sizes are unknown.
    """
    out = "video_id bigint, frame bigint, motion string, confidence double, dx int, dy int, error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, (w, _), pixels in _grey(batches, True):
            ids = [pa.array([batch.column(c)[i].as_py() for i in rows], pa.int64()) for c in (0, 1)]
            if not w:
                made = [["unknown"] * len(rows), [0.1] * len(rows), [0] * len(rows), [0] * len(rows), [None] * len(rows)]
            else:
                base, best, dx, dy = best_shift(*pixels())
                gain = np.divide(base - best, base, out=np.zeros_like(base), where=base > 0)
                still = (base < 1e-4) | (gain < 0.05)
                moved = np.where(np.abs(dx) >= np.abs(dy), np.where(dx > 0, "pan_right", "pan_left"), "tilt")
                confidence = np.where(still, np.maximum(0.7, 1 - base * 10), np.clip(0.4 + gain * 0.6, 0.25, 0.95))
                made = [np.where(still, "static", moved), confidence, dx, dy, best]
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(list(m), k) for m, k in zip(made, kinds))], [f.split(" ")[0] for f in out.split(", ")])

    return neighbours(frames).mapInArrow(run, out)


def region_activity(frames: DataFrame, regions: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """For each grey frame that has a next one and each region (name, x0, y0, x1, y1, in pixels): mean squared difference to the next frame (``mse``) and share of edge pixels (``edges``).

    One summed-area table of differences and one of edge marks answer all regions of a frame. An empty region has no ``mse``; edges need a pixel around
    them, so frames below 3 by 3 and empty regions have 0. Neighbours of unlike sizes have no ``mse`` and no ``edges``.
    """
    out = "video_id bigint, frame bigint, region string, mse double, edges double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, (w, h), pixels in _grey(batches, True):
            ids = [pa.array([batch.column(c)[i].as_py() for i in rows], pa.int64()) for c in (0, 1)]
            if w:
                a, b = pixels()
                difference = integral((a - b) ** 2)
                mark = np.zeros_like(a)
                if w >= 3 and h >= 3:
                    mark[:, 1:-1, 1:-1] = np.abs(a[:, 1:-1, 2:] - a[:, 1:-1, :-2]) + np.abs(a[:, 2:, 1:-1] - a[:, :-2, 1:-1]) > EDGE
                marks = integral(mark)
            for name, *box in regions:
                mse = edges = [None] * len(rows)
                if w:
                    low, high = (lambda v, a, b: int(min(b, max(a, np.floor(v))))), (lambda v, a, b: int(min(b, max(a, np.ceil(v)))))
                    x0, y0, x1, y1 = low(box[0], 0, w), low(box[1], 0, h), high(box[2], 0, w), high(box[3], 0, h)
                    if x1 > x0 and y1 > y0:
                        mse = box_sum(difference, x0, y0, x1, y1) / ((x1 - x0) * (y1 - y0))
                    edges = np.zeros(len(rows))
                    if w >= 3 and h >= 3:
                        x0, y0, x1, y1 = low(box[0], 1, w - 2), low(box[1], 1, h - 2), high(box[2], 1, w - 1), high(box[3], 1, h - 1)
                        if x1 > x0 and y1 > y0:
                            edges = box_sum(marks, x0, y0, x1, y1) / ((x1 - x0) * (y1 - y0))
                yield pa.RecordBatch.from_arrays([*ids, pa.array([name] * len(rows)), pa.array(list(mse), pa.float64()), pa.array(list(edges), pa.float64())], ["video_id", "frame", "region", "mse", "edges"])

    return neighbours(frames).mapInArrow(run, out)
