"""Links between near copies: buckets propose, exact Jaccard similarity of the shingle sets confirms.

``rep`` stands for all texts of one shingle set, so exact copies are folded before anything is compared. Every member is first tried
against the smallest ``rep`` it shares a bucket with, its vantage point: one pair a member, which connects a group of copies however
large. Only buckets whose members are still not all connected go on, with their sets, to tasks that compare them exactly: codes within a
radius are candidates, the sets decide, pairs already connected are left out, and only links that connect something come back. So no pair
that shares a bucket and lies within the radius stays untried unless its ends are connected, and nobody writes out the pairs of a group.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import forget, may_meet, text_batches, text_of, write_shared
from cadenza.llm.components import connected_components

#: Shingles of a bucket in one piece (8 MB); larger buckets are dealt in pairs of pieces.
PIECE_SHINGLES = 1 << 20
_BLOCK = 256
_AHEAD = 64

Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def rep_of(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a sorted set of shingle hashes."""
    value = xxhash.xxh64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >> 63 else value


def band_keys(signature: Column, bands: int, width: int) -> Column:
    """One key for each band of ``width`` bytes of a binary signature."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring(signature, 1 + i * width, width)) for i in range(bands)])


def shared_buckets(rows: DataFrame, keys: Column, more: DataFrame | None = None) -> DataFrame:
    """``(bucket, rep, leader)``, each once, of all buckets that more than one ``rep`` shares; leader is the smallest.

    Buckets are those of the rows' ``keys`` and of ``more``, a table of ``(bucket, rep)``.

    Rows are folded to the ends of each bucket before the shuffle, so that the many buckets of a single rep cost one record; of all others
    a bit map of the shared buckets lets through what has to meet them.
    """
    dealt = rows.select(F.explode(keys).alias("bucket"), "rep")
    dealt = dealt if more is None else dealt.union(more.select("bucket", "rep"))
    ends = dealt.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("_last")).where("leader < _last")
    ends = write_shared(ends.select("bucket", "leader"), "leaders")
    met = may_meet(dealt, F.col("bucket"), ends.select("bucket")).where("_may").select("bucket", "rep").distinct()
    buckets = write_shared(met.join(ends, "bucket").select("bucket", "rep", "leader"), "buckets")
    forget(ends)
    return buckets


def needed_of(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``(rep, name)`` of every ``rep`` in a shared bucket, with the ``name`` of one of its texts in ``rows``."""
    wanted = may_meet(rows.select("rep", "name"), F.col("rep"), shared.select("rep").distinct()).where("_may").groupBy("rep").agg(F.min("name").alias("name"))
    return write_shared(wanted.join(shared.select("rep").distinct(), "rep", "left_semi"), "needed")


def text_name() -> Column:
    """64-bit name of a row's text; null counts as empty."""
    return F.xxhash64(text_of())


def sets_of(documents: DataFrame, needed: DataFrame, shingles: Callable[[str], np.ndarray], code: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``(rep, size, shingles, code)`` of every ``rep`` in ``needed``, each once, from the texts of ``documents``; ``code`` is made from the shingles.

    Only texts of the names in ``needed`` are cut into shingles again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches):
            found = [shingles(text) for text in dict.fromkeys(texts)]
            if found:
                columns = [
                    pa.array([rep_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int32()),
                    pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array([code(s).tobytes() for s in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "size", "shingles", "code"])

    chosen = may_meet(documents.select(text_of().alias("text")), text_name(), needed.select("name")).where("_may").select("text")
    made = chosen.mapInArrow(run, "rep bigint, size int, shingles array<bigint>, code binary")
    return write_shared(made.dropDuplicates(["rep"]).join(needed.select("rep"), "rep", "left_semi"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The written pairs ``(a, b)`` whose sets have at least this Jaccard similarity; only sets that a pair names are shuffled."""
    side = lambda name: may_meet(sets, F.col("rep"), pairs.select(name).distinct()).where("_may").select(F.col("rep").alias(name), F.col("shingles").alias(f"_{name}"))
    both = F.size(F.array_intersect("_a", "_b"))
    near = both / F.greatest(F.size("_a") + F.size("_b") - both, F.lit(1)) >= similarity
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b")


def confirmed_links(shared: DataFrame, sets: DataFrame, distance: Distance, kind: str, radius: int, similarity: float) -> DataFrame:
    """Confirmed links ``(a, b)`` that connect the members of all buckets; the sets' binary ``code`` is of numpy type ``kind``."""
    nearest = shared.where("rep <> leader").groupBy("rep").agg(F.min("leader").alias("a")).select("a", F.col("rep").alias("b"))
    nearest = write_shared(nearest, "nearest")
    sizes = lambda name: sets.select(F.col("rep").alias(name), F.col("size").alias(f"_size_{name}"))
    # The similarity is at most the smaller size by the larger.
    like = F.least("_size_a", "_size_b") >= similarity * F.greatest("_size_a", "_size_b") - 1e-9
    pairs = write_shared(nearest.join(sizes("a"), "a").join(sizes("b"), "b").where(like).select("a", "b"), "pairs")
    links = write_shared(confirmed(pairs, sets, similarity), "links")
    forget(pairs)
    roots = connected_components(links)
    grouped = shared.join(roots, F.col("rep") == F.col("node"), "left").join(nearest, F.col("rep") == F.col("b"), "left")
    tried = (F.col("rep") == F.col("leader")) | (F.col("a") == F.col("leader"))
    members = write_shared(grouped.select("bucket", "rep", F.coalesce("root", "rep").alias("group"), F.coalesce(tried, F.lit(False)).alias("tried")), "members")
    forget(nearest, roots)
    facts = members.groupBy("bucket").agg(
        F.min("group").alias("_low"), F.max("group").alias("_high"), F.count("*").alias("_n"), F.bool_and("tried").alias("_tried"),
        F.bit_xor(F.xxhash64("rep")).alias("_set"), F.min("rep").alias("_first"))
    # A pair that was tried is done, and of buckets with the same members one is enough.
    still = facts.where("_low < _high and not (_n = 2 and _tried)").groupBy("_n", "_set", "_first").agg(F.min("bucket").alias("bucket")).select("bucket")
    rest = write_shared(members.join(still, "bucket").select("bucket", "rep", "group"), "open")
    forget(members)
    pieces = rest.join(sets.select("rep", "size"), "rep").groupBy("bucket").agg(F.ceil(F.sum("size") / PIECE_SHINGLES).cast("int").alias("_pieces"))
    wanted = may_meet(sets, F.col("rep"), rest.select("rep").distinct()).where("_may").select("rep", "code", "shingles")
    dealt = rest.join(pieces, "bucket").join(wanted, "rep")
    found = write_shared(links.union(bucket_links(dealt, distance, kind, radius, similarity)), "links")
    forget(links, rest)
    return found


def bucket_links(rest: DataFrame, distance: Distance, kind: str, radius: int, similarity: float) -> DataFrame:
    """``(a, b)``: confirmed links between members of a bucket that were in different groups, as many as connect them.

    Buckets stream through a task one after another; large ones come in pairs of pieces, so a task holds two pieces at most.
    """
    count = F.greatest(F.col("_pieces"), F.lit(1))
    dealt = rest.withColumn("own", F.pmod(F.xxhash64("rep"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    shard = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    placed = dealt.select(shard.alias("shard"), "own", (F.col("own") == F.col("other")).alias("whole"), "rep", "group", "code", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches):
            own, rep, group = (table.column(n).to_numpy() for n in ("own", "rep", "group"))
            codes = np.array([np.frombuffer(c, kind) for c in table.column("code").to_pylist()])
            lists = table.column("shingles").combine_chunks()
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            side = np.arange(len(own)) if table.column("whole")[0].as_py() else own
            found = list(spanning_pairs(codes, flat, ends, group, side, distance, radius, similarity))
            if found:
                at = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(rep[at].min(axis=1)), pa.array(rep[at].max(axis=1))], names=["a", "b"])

    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a bigint, b bigint")


def spanning_pairs(
    codes: np.ndarray, flat: np.ndarray, ends: np.ndarray, group: np.ndarray, side: np.ndarray, distance: Distance, radius: int, similarity: float
) -> Iterator[tuple[int, int]]:
    """Index pairs of members whose sets reach the similarity, of different ``side``, as many as connect their groups.

    Set k is ``flat[ends[k]:ends[k + 1]]``. Codes are put in the order of their distance to a vantage point: by the triangle inequality a
    code's neighbours lie in the shell within the radius of its own distance, and nothing outside is compared.
    """
    sizes = np.diff(ends)
    names, terms = np.unique(flat, return_inverse=True)
    held = np.zeros(len(names), bool)
    label = np.unique(group, return_inverse=True)[1]
    to_vantage = distance(codes[:1], codes)[0].astype(np.int64)
    order = np.argsort(to_vantage, kind="stable")
    shells = to_vantage[order]
    for at in range(0, len(order), _BLOCK):
        block = order[at : at + _BLOCK]
        # Each pair once: with members at or after the block in the order.
        near = order[at : np.searchsorted(shells, shells[at + len(block) - 1] + radius, "right")]
        apart = distance(codes[block], codes[near])
        for i, own in enumerate(block.tolist()):
            wanted = np.flatnonzero((apart[i] <= radius) & (side[near] != side[own]) & (label[near] != label[own]))
            wanted = near[wanted[np.argsort(apart[i][wanted], kind="stable")]]
            wanted = wanted[np.minimum(sizes[wanted], sizes[own]) >= similarity * np.maximum(sizes[wanted], sizes[own]) - 1e-9]
            if not len(wanted):
                continue
            mine = terms[ends[own] : ends[own + 1]]
            held[mine] = True
            while len(wanted):
                some, wanted = wanted[:_AHEAD], wanted[_AHEAD:]
                both = np.array([np.count_nonzero(held[terms[ends[j] : ends[j + 1]]]) for j in some.tolist()])
                for j in some[both / np.maximum(sizes[some] + sizes[own] - both, 1) >= similarity].tolist():
                    if label[j] != label[own]:
                        label[label == label[j]] = label[own]
                        yield own, j
                wanted = wanted[label[wanted] != label[own]]
            held[mine] = False


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``shard`` (first column) of sorted batches as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for start, end in itertools.pairwise(edges):
            part = batch.slice(start, end - start)
            if held and held[-1].column(0)[0] != part.column(0)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
