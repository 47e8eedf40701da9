"""Similarity search, near-duplicates and diversity over embeddings."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.functions import text as T
from cadenza.sources.shared import written

#: Query rows of one block, which meets the blocks of the index in a task each.
BROADCAST_ROWS = 10_000
#: Rows of one block that meets the query blocks, and the least number of such blocks.
INDEX_ROWS, INDEX_BLOCKS = 8192, 32
#: Numbers of one piece of a table of scores, which stays in a core's cache.
_PIECE = 1 << 17
#: Frames of one block of the pairwise comparison: few while that gives no more than ``SMALL_BLOCKS`` blocks, many beyond, as every frame is sent once for each block.
BLOCK_FRAMES, SMALL_BLOCKS, MOST_FRAMES = 2048, 8, 16_384
#: Numbers of one piece of a product of two blocks.
_PRODUCT = 1 << 22


def _meet(index: DataFrame, queries: DataFrame, work: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """Rows that ``work`` gives for each pair of a block of ``index`` and one of ``queries``, both (id, v): a task holds one pair at a time.

    Every index row is sent once for each block of ``BROADCAST_ROWS`` queries and every query once for each block of index rows, so that no side is passed whole to a task. The rows
    of a block come in the order of their ids.
    """
    n_index, n_queries = index.count(), queries.count()
    rows, columns = max(INDEX_BLOCKS, -(-n_index // INDEX_ROWS)), max(1, -(-n_queries // BROADCAST_ROWS))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select("id", "v", block(rows).alias("own"), every(columns).alias("other")).select((F.col("own") * columns + F.col("other")).alias("pair"), F.lit(False).alias("second"), "id", "v")
    right = queries.select("id", "v", block(columns).alias("own"), every(rows).alias("other")).select((F.col("other") * columns + F.col("own")).alias("pair"), F.lit(True).alias("second"), "id", "v")

    def both(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cut = int(np.count_nonzero(~table.column("second").to_numpy()))
        if 0 < cut < len(table):
            yield from work(table.slice(0, cut), table.slice(cut))

    placed = left.unionByName(right).repartition(min(2 * rows * columns, 4096), "pair").sortWithinPartitions("pair", "second", "id")
    return placed.mapInArrow(lambda batches: _by_pair(batches, both), kind)


def _by_pair(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``work`` gives for the rows of each pair of blocks; the first column names the pair, and its rows follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        pair = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)] if len(pair) else []
        for low, high in itertools.pairwise(edges):
            if held and held[-1].column(0)[0] != batch.column(0)[low]:
                yield from work(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield from work(pa.Table.from_batches(held))


def _matrix(table: pa.Table) -> np.ndarray:
    """Vectors of equal length as rows of doubles; a missing vector or number is NaN."""
    lists = table.column("v").combine_chunks()
    known = lists.is_valid().to_numpy(zero_copy_only=False)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = int(size.max(initial=0)) if known.any() else 1
    if (size[known] != width).any():
        raise ValueError("vectors of different lengths")
    out = np.full((len(lists), width), np.nan)
    out[known] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(known.sum()), width)
    return out


def _pieces(q: np.ndarray, v: np.ndarray, differ: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Inner products, or squared distances if ``differ``, of the rows of ``q`` with all of ``v``, some rows at a time: first row, scores.

    Terms are added number by number, as a loop over the vectors does, so that sums agree with it to the last bit.
    """
    known = ~np.isnan(q).all(axis=1), ~np.isnan(v).all(axis=1)
    if q.shape[1] != v.shape[1] and q.shape[1] and v.shape[1] and known[0].any() and known[1].any():
        raise ValueError("vectors of different lengths")
    columns, step = np.ascontiguousarray(v.T), max(1, _PIECE // max(1, len(v)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        total, term = np.zeros((len(part), len(v))), np.empty((len(part), len(v)))
        for x, y in zip(part.T, columns):
            if differ:
                np.subtract(x[:, None], y, out=term)
                np.multiply(term, term, out=term)
            else:
                np.multiply(x[:, None], y, out=term)
            total += term
        yield at, total


def top_k(index: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """The ``k`` best index rows of every query by inner product, rounded to six decimals (ties by id): query_id, id, score, rank.

    A stated query set meets all index rows, block by block; a pair of blocks gives ``k`` rows a query at most. Missing vectors score null and come last.
    """
    base = index.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    asked = queries.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))

    def best(rows: pa.Table, wanted: pa.Table) -> Iterator[pa.RecordBatch]:
        v, ids, names = _matrix(rows), rows.column("id").combine_chunks(), wanted.column("id").combine_chunks()
        for at, raw in _pieces(_matrix(wanted), v, differ=False):
            score = np.where(np.isnan(raw), -np.inf, np.copysign(np.floor(np.abs(raw) * 1e6 + 0.5), raw) / 1e6 + 0.0)
            least = min(k, len(v))
            bound = -np.partition(-score, least - 1, axis=1)[:, least - 1 : least]
            above, equal = score > bound, score == bound
            # Of equals the first, as rows lie in the order of their ids.
            q, i = np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= least - above.sum(axis=1, keepdims=True))))
            found = score[q, i]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q + at)), ids.take(pa.array(i)), pa.array(found, mask=np.isneginf(found))], names=["query_id", "id", "score"])

    name, own = asked.schema["id"].dataType.simpleString(), base.schema["id"].dataType.simpleString()
    if name != own:
        raise ValueError("ids of queries and index differ in type")
    found = _meet(base, asked, best, f"query_id {name}, id {own}, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hash_embedding(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """Sparse hashed bag of words: key, bucket, value; each document's values have length one."""
    tokens = docs.select(key, F.explode(T.words(F.lower(F.col(text)))).alias("token"))
    counts = tokens.groupBy(key, F.pmod(T.fnv1a32(F.col("token")), F.lit(size)).alias("bucket")).agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)).cast("double"))
    return counts.select(key, "bucket", F.round(F.col("n") / length, 6).alias("value"))


def video_similarity(frames: DataFrame) -> DataFrame:
    """(a, b, similarity): greatest cosine between frames of two videos, a < b. All pairs of videos are the result itself.

    Frames are dealt in blocks of ``BLOCK_FRAMES`` to ``MOST_FRAMES``, whatever their video; each pair of blocks meets in one task, which multiplies unit
    vectors and keeps one number for each pair of videos, and the greatest of these is taken over the pairs of blocks. A task holds two blocks, however long a video is.
    """
    n = frames.count()
    blocks = max(1, math.ceil(n / MOST_FRAMES), min(SMALL_BLOCKS, math.ceil(n / BLOCK_FRAMES)))
    # As stored: doubles are made in the task.
    vector = F.col("embedding")
    # By content, so that the frames of one video spread over all blocks.
    own = F.pmod(F.xxhash64("video_id", vector), F.lit(blocks)).cast("int")
    dealt = frames.select("video_id", vector.alias("v"), own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = dealt.select((F.least("own", "other") * blocks + F.greatest("own", "other")).alias("pair"), (F.col("own") > F.col("other")).alias("second"), (F.col("own") != F.col("other")).alias("mixed"), "video_id", "v")

    kind = f"a {frames.schema['video_id'].dataType.simpleString()}, b {frames.schema['video_id'].dataType.simpleString()}, similarity double"
    dealt = placed.repartition(min(blocks * (blocks + 1), 4096), "pair").sortWithinPartitions("pair", "second", "video_id")
    met = dealt.mapInArrow(lambda batches: _by_pair(batches, _greatest), kind)
    return met.groupBy("a", "b").agg(F.round(F.max("similarity"), 6).alias("similarity"))


def _greatest(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Greatest cosine of each two videos between the two blocks of a pair, or within the one block; rows are sorted by block and video."""
    lists = table.column("v").combine_chunks()
    v = lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    ids = table.column("video_id").combine_chunks().to_numpy(zero_copy_only=False)
    cut = int(np.count_nonzero(~table.column("second").to_numpy())) if table.column("mixed")[0].as_py() else 0
    left, right = (slice(0, cut), slice(cut, len(v))) if cut else (slice(0, len(v)),) * 2
    names, first = np.unique(ids[right], return_index=True)
    own, start = np.unique(ids[left], return_index=True)
    if not len(names) or not len(own):
        return
    others_of_block = v[right]
    step = max(1, _PRODUCT // len(others_of_block))
    for name, low, high in zip(own, start, np.append(start[1:], left.stop - left.start)):
        most = np.full(len(others_of_block), -np.inf)
        for at in range(low, high, step):
            np.maximum(most, (v[left][at : min(at + step, high)] @ others_of_block.T).max(axis=0), out=most)
        best = np.maximum.reduceat(most, first)
        # Within a block every two videos meet twice; between blocks either may have the smaller id.
        others = np.flatnonzero(names != name) if cut else np.flatnonzero(names > name)
        if len(others):
            mine, theirs = np.full(len(others), name), names[others]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine, theirs)), pa.array(np.maximum(mine, theirs)), pa.array(best[others])], names=["a", "b", "similarity"])


def best_of_others(frames: DataFrame, items: DataFrame) -> DataFrame:
    """(video_id, item, best): greatest cosine of each item (video_id, frame, embedding) to the other frames of its video, rounded to six decimals; zero vectors are 0 to all, missing ones count for none.

    Items meet the frames block by block. In both the rows of a video lie together, and only these are multiplied; a pair of blocks gives one number for each of its items.
    """
    named = lambda rows: rows.where("video_id IS NOT NULL AND frame IS NOT NULL").select(F.struct("video_id", "frame").alias("id"), F.col("embedding").alias("v"))

    def greatest(rows: pa.Table, wanted: pa.Table) -> Iterator[pa.RecordBatch]:
        (videos, frame), (asked, item) = ([x.to_numpy(zero_copy_only=False) for x in t.column("id").combine_chunks().flatten()] for t in (rows, wanted))
        v, q = _matrix(rows), _matrix(wanted)
        for name in np.unique(asked):
            here, mine = np.flatnonzero(videos == name), np.flatnonzero(asked == name)
            if not len(here):
                continue
            lengths, columns = np.sqrt(_own_products(v[here])), v[here]
            for at, products in _pieces(q[mine], columns, differ=False):
                part = mine[at : at + len(products)]
                size = np.sqrt(_own_products(q[part]))[:, None] * lengths
                score = np.divide(products, size, out=np.zeros_like(products), where=size != 0)
                other = item[part][:, None] != frame[here]
                found, known = other.any(axis=1), other & ~np.isnan(score)
                most = pa.array(np.where(known, score, -np.inf).max(axis=1)[found], mask=~known.any(axis=1)[found])
                yield pa.RecordBatch.from_arrays([pa.array(asked[part][found]), pa.array(item[part][found]), most], names=["video_id", "item", "best"])

    kinds = [frames.schema[c].dataType.simpleString() for c in ("video_id", "frame")]
    met = _meet(named(frames), named(items), greatest, f"video_id {kinds[0]}, item {kinds[1]}, best double")
    return met.groupBy("video_id", "item").agg(F.round(F.max("best"), 6).alias("best"))


def _own_products(v: np.ndarray) -> np.ndarray:
    """Inner product of each row with itself, added number by number."""
    total = np.zeros(len(v))
    for x in v.T:
        total += x * x
    return total


def diversity(similarity: DataFrame, duplicate: float = 0.95) -> DataFrame:
    """Diversity of a set of videos: 1 - mean pair similarity, limited to [0, 1], and the number of duplicate pairs."""
    mean = F.avg("similarity")
    return similarity.agg(F.round(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean)), F.lit(1.0)), 6).alias("diversity"), F.count_if(F.col("similarity") > duplicate).alias("duplicates"))


def novelty(rows: DataFrame, labelled: DataFrame, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """Smallest euclidean distance of each row to a labelled set: id, distance. Without a labelled row there is no result.

    The set meets the rows block by block; a pair of blocks gives one number for each of its rows. A row without a vector has no distance, a labelled one without counts for none.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    known = labelled.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))

    def least(rows: pa.Table, near: pa.Table) -> Iterator[pa.RecordBatch]:
        v = _matrix(rows)
        best = np.full(len(v), np.inf)
        for _, squares in _pieces(_matrix(near), v, differ=True):
            np.fmin(best, np.fmin.reduce(squares, axis=0), out=best)
        yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), pa.array(np.sqrt(best), mask=np.isinf(best))], names=["id", "d"])

    met = _meet(base, known, least, f"id {base.schema['id'].dataType.simpleString()}, d double")
    return met.groupBy("id").agg(F.round(F.min("d"), 6).alias("distance"))


def active_order(novel: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Rows for annotation, the most wanted first: id, quality_uncertainty, diversity, priority, place.

    ``novel``: id, distance (to the labelled set); ``uncertain``: id, uncertainty from 0 to 1. Priority is 0.7 uncertainty and 0.3 diversity, the distance over the greatest
    one (0 if all are 0). Rows without an uncertainty count as certain. Places come from bands of the priority, so no task sorts all rows. The distances are written
    once, as their maximum, the sizes of the bands and the rows each read them.
    """
    novel = written(novel.select("id", "distance"), "novel")
    top = novel.agg(F.max("distance").alias("_top"))
    rows = novel.join(uncertain.groupBy("id").agg(F.max("uncertainty").alias("u")), "id", "left").join(F.broadcast(top), F.lit(True))
    spread = F.when(F.col("_top") > 0, F.col("distance") / F.col("_top")).otherwise(0.0)
    rows = rows.select("id", F.coalesce("u", F.lit(0.0)).alias("quality_uncertainty"), spread.alias("diversity"))
    rows = rows.withColumn("priority", F.round(0.7 * F.col("quality_uncertainty") + 0.3 * F.col("diversity"), 6))
    rows = rows.withColumn("_band", F.floor(F.col("priority") * 256))
    # At most 257 bands.
    sizes = rows.groupBy("_band").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_band").orderBy(F.desc("priority"), "id"))
    return rows.withColumn("_r", inside).join(F.broadcast(sizes), "_band").select("id", "quality_uncertainty", "diversity", "priority", (F.col("_before") + F.col("_r")).alias("place"))


def similar_sets(rows: DataFrame, key: str, items: str, least: float) -> DataFrame:
    """(a, b, jaccard): all pairs of rows, a < b, whose sets reach a Jaccard similarity of ``least``; ``items`` is an array without repeats.

    Items are ordered by how many sets hold them, the rarest first. Two sets of sizes n and m that reach the similarity share an item among the first n - ceil(least n) + 1 of the
    one and as many of the other, so only these meet, and an item that almost all sets hold stands behind. Candidates whose sizes are too
    unlike are left out, and the sets decide. Empty sets are similar to nothing.
    """
    held = rows.select(F.col(key).alias("_key"), F.size(items).alias("_n"), F.explode(items).alias("_item"))
    common = held.groupBy("_item").agg(F.count("*").alias("_df"))
    rare = held.join(common, "_item").withColumn("_place", F.row_number().over(Window.partitionBy("_key").orderBy("_df", "_item")))
    # The tolerance keeps a product like 0.1 * 30 from being rounded up.
    first = rare.where(F.col("_place") <= F.col("_n") - F.ceil(least * F.col("_n") - 1e-9) + 1).select("_key", "_n", "_item")
    a, b = (first.select(F.col("_key").alias(k), F.col("_n").alias(f"n_{k}"), "_item") for k in "ab")
    sizes = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9
    pairs = a.join(b, "_item").where((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct()
    x, y = (rows.select(F.col(key).alias(k), F.col(items).alias(f"_{k}")) for k in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    jaccard = both / (F.size("_a") + F.size("_b") - both)
    return pairs.join(x, "a").join(y, "b").where(jaccard >= least).select("a", "b", F.round(jaccard, 6).alias("jaccard"))
