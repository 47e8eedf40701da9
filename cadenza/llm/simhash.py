"""SimHash near-duplicates: exact pairs within a Hamming radius from vantage-point shards.

A plain vantage-point tree cannot prune on uniform 64-bit codes at radius 4: distances to any
point crowd around 32, so every query would cross most boundaries. The root level therefore
uses partial distances: of ``blocks`` bit blocks, two codes within radius r agree in at least
``blocks`` - r of them, so a code is sent to one shard for each choice of that many blocks, the shards at
distance zero on those blocks. Inside, vantage-point trees partition a shard by Hamming distance; a code
outside a ball but within r of its boundary also visits the inside (triangle inequality). A shard too large for one task is
split the same way, level by level, in Spark. Every link is found in some leaf; leaves report each
member's smallest linked code as spanning links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import add_columns, col, keep_ranked, row_mark, row_rank, write_shared
from cadenza.llm.components import connected_components

BITS = 64
RADIUS = 4
SHARD_ROWS = 4096
LEAF_ROWS = 256
_BLOCK = 1 << 14


def words_of(text: str) -> list[bytes]:
    """UTF-8 words of a text with A-Z in lower case; blanks are space and the characters 9 to 13, as in bytes.split."""
    return text.encode().lower().split()


def fingerprint(text: str, size: int = 4) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without words.

    Bit b is set if more than half of the shingles' XXH64 values (UTF-8, seed 42) have it set.
    """
    words = words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return digest(b" ".join(words), 42)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        some = words[at : min(at + _BLOCK, n) + size - 1]
        joined = map(b" ".join, zip(*(some[k:] for k in range(size))))
        hashes = np.fromiter((digest(s, 42) for s in joined), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(documents: DataFrame, size: int = 4, text: str = "text") -> DataFrame:
    """``documents`` with ``fingerprint bigint``; null texts count as empty (fingerprint 0)."""

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        made = np.fromiter((fingerprint(t, size) for t in texts), np.uint64, len(texts))
        return [pa.array(made.view(np.int64), pa.int64())]

    return add_columns(documents, "fingerprint bigint", make, text)


def block_masks(blocks: int) -> list[int]:
    """Masks that cut the 64 bits into ``blocks`` nearly equal runs."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in itertools.pairwise(edges)]


def blocks_for(codes: int, radius: int = RADIUS) -> int:
    """Number of blocks at which random codes leave at most about ``SHARD_ROWS`` in a shard; exact for any choice."""
    blocks = radius + 1
    while codes >> (BITS * (blocks - radius) // blocks) > SHARD_ROWS // 2 and blocks < 2 * radius:
        blocks += 1
    return blocks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def vantage_shards(codes: DataFrame, radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS, levels: int = 12) -> DataFrame:
    """Rows ``(shard, code, home)``: each pair of codes within the radius meets in a shard with one at home.

    ``codes`` holds distinct ``code``. A shard of more than ``shard_rows`` home codes is split by the distance to one of
    its codes at the median; codes outside within ``radius`` of the boundary, and visitors whose ball crosses it,
    are sent to both sides. Splitting stops when no shard is too large, no split separates any, or after
    ``levels``; leaves compare in bounded blocks, so a shard left large is still exact.
    """
    chosen = blocks or blocks_for(codes.count(), radius)
    masks = block_masks(chosen)
    wanted = [sum(part) for part in itertools.combinations(masks, chosen - radius)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("code").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(wanted)])
    # Home and visitor are both needed only after a split: before it everyone is at home.
    rows = codes.select(F.explode(keys).alias("shard"), "code").withColumn("home", F.lit(True))
    done = None
    for level in range(levels):
        sizes = rows.where("home").groupBy("shard").agg(
            F.count("*").alias("n"), F.min(F.struct(F.xxhash64("code", F.lit(level)), "code"))["code"].alias("vantage")
        ).where(F.col("n") > shard_rows)
        sizes = write_shared(sizes, "large")
        if not sizes.take(1):
            break
        far = rows.join(sizes, "shard").withColumn("d", _distance(F.col("code"), F.col("vantage")))
        cut = far.where("home").groupBy("shard").agg(F.percentile_approx("d", 0.5, 1000).alias("cut"), F.max("d").alias("top"))
        # The ball must leave something outside.
        cut = write_shared(cut.select("shard", F.when(F.col("cut") < F.col("top"), F.col("cut")).otherwise(F.col("top") - 1).alias("cut")).where("cut >= 0"), "cuts")
        small = rows.join(cut, "shard", "left_anti")
        split = far.join(cut, "shard")
        inside = F.col("d") <= F.col("cut")
        sides = F.array_compact(F.array(
            F.when(inside | (F.col("d") <= F.col("cut") + radius), F.struct(F.xxhash64("shard", F.lit(2 * level)).alias("shard"), (inside & F.col("home")).alias("home"))),
            F.when(~inside | (~F.col("home") & (F.col("d") > F.col("cut") - radius)), F.struct(F.xxhash64("shard", F.lit(2 * level + 1)).alias("shard"), (~inside & F.col("home")).alias("home"))),
        ))
        pieces = split.select(F.explode(sides).alias("side"), "code").select("side.shard", "code", "side.home")
        done = small if done is None else done.union(small)
        rows = write_shared(pieces, "pieces")
    return rows if done is None else done.union(rows)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= radius


def _leaf_links(home: np.ndarray, visitors: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Spanning links of a leaf: each reached code with the code it was reached from.

    A breadth-first walk takes every reached code out of the rest, so a dense leaf costs little more
    than its size; blocks bound the memory.
    """
    everyone = np.concatenate([home, visitors])
    rest = np.arange(len(everyone))
    at_home = len(home)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.full(len(rest), -1, np.int64)
            step = max(1, (1 << 20) // len(rest))
            for at in range(0, len(front), step):
                part = front[at : at + step]
                near = _near(everyone[part], everyone[rest], radius)
                # Two visitors meet at home elsewhere.
                near &= (part < at_home)[:, None] | (rest < at_home)[None, :]
                hit = near.any(axis=0) & (reached < 0)
                reached[hit] = part[near[:, hit].argmax(axis=0)]
            got = reached >= 0
            yield from zip(everyone[reached[got]].tolist(), everyone[rest[got]].tolist())
            front, rest = rest[got], rest[~got]


def tree_links(home: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, leaf: int = LEAF_ROWS) -> Iterator[tuple[int, int]]:
    """Links of one shard by a vantage-point tree over its home codes."""
    todo = [(home, visitors)]
    while todo:
        home, visitors = todo.pop()
        if len(home) > leaf:
            vantage = home[len(home) // 2]
            d, v = np.bitwise_count(home ^ vantage).astype(np.int16), np.bitwise_count(visitors ^ vantage).astype(np.int16)
            cut = int(np.median(d))
            if cut >= d.max():
                cut = int(d.max()) - 1
            inside = d <= cut
            # Worth it only while the boundary stays thin; a dense ball is walked as a leaf.
            edge = int((~inside & (d <= cut + radius)).sum())
            if inside.any() and edge < 0.5 * (~inside).sum():
                todo.append((home[inside], np.concatenate([home[~inside & (d <= cut + radius)], visitors[v <= cut + radius]])))
                todo.append((home[~inside], visitors[v > cut - radius]))
                continue
        if len(home):
            yield from _leaf_links(home, visitors, radius)


def shard_links(shards: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)`` spanning links between codes of the same shard; whole shards meet in a task, streamed one after another."""
    placed = shards.repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            shard, code, home = (np.concatenate(x) for x in zip(*parts))
            edges = np.flatnonzero(np.diff(shard)) + 1
            found: list[tuple[int, int]] = []
            for low, high in itertools.pairwise([0, *edges.tolist(), len(shard)]):
                if high - low > 1:
                    own, at_home = code[low:high], home[low:high]
                    found.extend(tree_links(own[at_home], own[~at_home], radius))
            if found:
                a, b = np.array(found, np.uint64).T
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.copy().view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, code = (np.array(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            home = batch.column(2).to_numpy(zero_copy_only=False)
            last = np.searchsorted(shard, shard[-1])
            if held and shard[0] == shard[-1] == held[-1][0][-1]:
                held.append((shard, code.view(np.uint64), home))
                continue
            # Everything before the batch's last shard is complete.
            held.append((shard[:last], code[:last].view(np.uint64), home[:last]))
            yield from flush(held)
            held = [(shard[last:], code[last:].view(np.uint64), home[last:])]
        if held:
            yield from flush(held)

    return placed.select("shard", "code", "home").mapInArrow(run, "a bigint, b bigint")


def code_components(codes: DataFrame, radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(code, root)`` of all distinct ``code``; root is a code that stands for the component."""
    links = shard_links(vantage_shards(codes, radius, blocks, shard_rows), radius)
    roots = connected_components(links)
    return codes.join(roots, codes["code"] == roots["node"], "left").select("code", F.coalesce("root", "code").alias("root"))


def components(documents: DataFrame, radius: int = RADIUS, size: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest
    doc_id reachable. Null and empty texts share fingerprint zero and link like others. Null ids sort last:
    a component's id is null only if all its ids are. Repeated rows each give a row, extra columns are
    ignored and an empty table gives no rows. Documents of one fingerprint are pre-aggregated before
    anything is compared, so copies are never expanded.
    """
    marked = write_shared(with_fingerprints(documents.select(col("doc_id"), col("text")), size).select("doc_id", "fingerprint"), "fingerprints")
    codes = write_shared(marked.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("first")), "codes")
    roots = code_components(codes.select("code"), radius)
    ids = codes.join(roots, "code")
    least = ids.groupBy("root").agg(F.min("first").alias("component_id"))
    # One record a fingerprint: the document side may be hot, and AQE can split it in this join.
    named = write_shared(ids.join(least, "root").select(F.col("code").alias("fingerprint"), "component_id"), "named")
    joined = marked.join(named, "fingerprint")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, radius: int = RADIUS, size: int = 4) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest doc_id and then text hash (of repeated ids one row).

    All columns pass through. Each component whose ids are all null keeps one row.
    """
    slim = write_shared(with_fingerprints(documents.select(col("doc_id"), col("text"), row_mark().alias("mark")), size).drop("text"), "fingerprints")
    codes = write_shared(slim.groupBy(F.col("fingerprint").alias("code")).agg(F.min(row_rank(F.col("mark"))).alias("first")), "codes")
    roots = codes.join(code_components(codes.select("code"), radius), "code")
    return keep_ranked(documents, slim.select("doc_id", "mark"), write_shared(roots.groupBy("root").agg(F.min("first").alias("first")), "kept"))
