"""MinHash fingerprints: universal hash permutations over word shingles, banded and verified in Spark.

Signature bands of ``BAND_ROWS`` minima are joined in Spark: two texts at similarity 0.8 share one of ``BANDS`` with a chance of
0.998. Candidates count only if the exact Jaccard similarity of their shingles confirms them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.llm.common import add_columns, col, forget, pieces, text_of, write_shared
from cadenza.llm.components import connected_components
from cadenza.llm.verified_links import band_keys, confirmed_links, needed_of, rep_of, sets_of, shared_buckets, text_name
from cadenza.llm.word_hashes import word_hashes

PERMUTATIONS = 128
SHINGLE = 5
BANDS, BAND_ROWS = 21, 6
SIMILARITY = 0.8
#: Differing minima beyond which a pair is not tried: at similarity 0.8 about 26 of 128 differ, with a deviation of 4.5.
RADIUS = 48
_BLOCK = 512


def permutations(n: int = PERMUTATIONS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the universal family x -> a x + b mod 2**64."""
    rng = np.random.default_rng(seed)
    top = np.iinfo(np.uint64).max
    return rng.integers(0, top, n, np.uint64, endpoint=True) | np.uint64(1), rng.integers(0, top, n, np.uint64, endpoint=True)


class MinHasher:
    """Signatures of texts under one set of permutations."""

    def __init__(self, n: int = PERMUTATIONS, size: int = SHINGLE):
        self.a, self.b = (x[:, None] for x in permutations(n))
        self.n, self.size = n, size

    def shingles(self, text: str) -> np.ndarray:
        """Distinct 64-bit shingle hashes: ``size`` words each, or the whole text when it has fewer."""
        hashes = np.concatenate([h for h, _ in word_hashes([text])])
        if not len(hashes):
            return hashes
        size = min(self.size, len(hashes))
        n = len(hashes) - size + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(size):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """16 mixed bits of the minimum under every permutation; all ones without shingles.

        The smallest of many hashes has its high bits near zero in every text, so the bits kept are those of its mixture.
        """
        if not len(shingles):
            return np.full(self.n, 0xFFFF, np.uint16)
        low = np.full(self.n, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), _BLOCK):
            hashed = self.a * shingles[None, at : at + _BLOCK] + self.b
            np.minimum(low, hashed.min(axis=1), out=low)
        low ^= low >> np.uint64(32)
        return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)

    def signature(self, text: str) -> np.ndarray:
        """Minima of a whole text."""
        return self.minima(self.shingles(text))


_HASHERS: dict[tuple[int, int], MinHasher] = {}


def hasher(n: int = PERMUTATIONS, size: int = SHINGLE) -> MinHasher:
    """One hasher for each Python worker and setting."""
    return _HASHERS.setdefault((n, size), MinHasher(n, size))


def with_signatures(documents: DataFrame, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """``documents`` with ``signature binary`` (two little-endian bytes for each permutation); null texts count as empty."""

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        return [pa.array([hasher(size=size).signature(t).tobytes() for t in texts], pa.binary())]

    return add_columns(documents, "signature binary", make, text)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of permutations with equal minima, an estimate of the Jaccard similarity."""
    return float((a == b).mean())


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing minima of each signature of ``a`` and each of ``b``."""
    apart = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        apart += a[:, k][:, None] != b[:, k][None, :]
    return apart


def _classes(documents: DataFrame, rows: DataFrame, similarity: float, size: int) -> DataFrame:
    """``(rep, class_id, links)`` of every rep that several rows or linked texts share; ``rows`` have doc_id, rep, the text's name and binary ``signature``."""
    shared = shared_buckets(rows, band_keys(F.col("signature"), BANDS, 2 * BAND_ROWS))
    needed = needed_of(rows, shared)
    sets = sets_of(documents, needed, hasher(size=size).shingles, hasher(size=size).minima)
    found = confirmed_links(shared, sets, differing, "uint16", RADIUS, similarity)
    forget(shared, needed, sets)
    links = write_shared(found.distinct(), "links")
    forget(found)
    roots = connected_components(links)
    folded = rows.groupBy("rep").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n"))
    ids = folded.join(roots, folded["rep"] == roots["node"], "left").where("_n > 1 or root is not null")
    ids = write_shared(ids.select("rep", "first", F.coalesce("root", "rep").alias("root")), "folded")
    forget(roots)
    least = ids.groupBy("root").agg(F.min("first").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    named = ids.join(least, "root").select("rep", "class_id").join(degree, "rep", "left")
    classes = write_shared(named.select("rep", "class_id", F.coalesce("links", F.lit(0)).alias("links")), "classes")
    forget(links, ids)
    return classes


def _with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with class_id and links; a row alone in its class names the class."""
    found = classes.withColumn("_found", F.lit(True))
    joined = rows.join(found, "rep", "left")
    return joined.withColumn("class_id", F.when(F.col("_found"), F.col("class_id")).otherwise(F.col("doc_id"))).withColumn("links", F.coalesce("links", F.lit(0))).drop("_found")


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """doc_id, class_id and links of every document; class_id is the smallest doc_id reachable.

    Texts of one shingle set are first folded into one representative. Signature bands are joined in Spark and every candidate is
    verified (``verified_links``). ``links`` counts the confirmed partners that connect the class, not all pairs. Null texts
    count as empty, null ids sort last (a class whose ids are all null has a null id), repeated rows give a row each.
    """

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        maker = hasher(size=size)
        found = [maker.shingles(t) for t in texts]
        return [pa.array([rep_of(s) for s in found], pa.int64()), pa.array([maker.minima(s).tobytes() for s in found], pa.binary())]

    slim = add_columns(documents.select(col("doc_id"), col("text"), text_name().alias("name")), "rep bigint, signature binary", make)
    rows = write_shared(slim.drop("text"), "members")
    return _with_classes(rows, _classes(documents, rows, similarity, size)).select("doc_id", "class_id", "links")


def _ordered(documents: DataFrame) -> DataFrame:
    """Slim rows in descending doc_id order over range partitions; the text is packed before it is shuffled.

    Ties of doc_id (and null ids, which come last) are ordered by a hash of the text; rows equal in both
    are told apart by their place in the input, so that no value gathers in one task.
    """

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        pack = zstandard.ZstdCompressor(level=3).compress
        return [pa.array([pack(t.encode()) for t in texts], pa.binary())]

    slim = documents.select(col("doc_id"), text_of().alias("text"))
    packed = add_columns(slim, "packed binary", make).select("doc_id", F.xxhash64("text").alias("_tie"), F.monotonically_increasing_id().alias("_place"), "packed")
    keys = [F.col("doc_id").desc_nulls_last(), F.col("_tie"), F.col("_place")]
    # Range partitions grow with the input: as many as its splits, or the session's setting where that is more.
    tasks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), packed.rdd.getNumPartitions())
    return packed.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("doc_id", F.col("_tie").alias("name"), "packed", F.spark_partition_id().alias("part"))


PAIR = "doc_id bigint, name bigint, n_chars bigint, edited_sha256 string, rep bigint, signature binary, edited binary, near_edited double, near_next double"
ENDS = "part int, first binary, last binary"
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}


Known = tuple[int, str, int, np.ndarray]


def _known(name: int, text: str) -> Known:
    """A text with its name, rep and signature."""
    shingles = hasher().shingles(text)
    return name, text, rep_of(shingles), hasher().minima(shingles)


def _pair(doc_id: int | None, own: Known, after: Known) -> tuple:
    """A document's digest given the text that follows it."""
    name, text, rep, own_signature = own
    half = len(text) // 2
    edited = text[: len(text) - half] + after[1][:half]
    signature = hasher().signature(edited)
    return (
        doc_id, name, len(text), hashlib.sha256(edited.encode()).hexdigest(), rep, own_signature.astype(">u2").tobytes(), signature.astype(">u2").tobytes(),
        likeness(own_signature, signature), likeness(own_signature, after[3]),
    )


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all rows of a sorted partition but the last, and one row with the partition's first and last text."""
    unpack = zstandard.ZstdDecompressor().decompress
    before, first, blank = None, None, (None,) * 7
    for batch in pieces(batches):
        rows = []
        for doc_id, name, packed, part in zip(*(c.to_pylist() for c in batch.columns)):
            known = _known(name, unpack(packed).decode())
            if before is not None:
                rows.append((*_pair(*before, known), None, None, None))
            first = first or (part, packed)
            before, last = (doc_id, known), (doc_id, name, packed)
        if rows:
            yield _batch(rows, f"{PAIR}, {ENDS}")
    if first is not None:
        yield _batch([(*last[:2], *blank, *first, last[2])], f"{PAIR}, {ENDS}")


def fingerprint_digest(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Fingerprint of every text and of its edited text, whose last half is the start of the next document; and its near-duplicate class.

    Next is by descending doc_id (ties by a hash of the text), after the last comes the first. Null texts
    count as empty, repeated rows each give a row, extra columns are ignored, an empty table gives
    no rows. Texts are shuffled once, packed, into sorted range partitions; each task pairs neighbours as it
    streams. Only the first and last text of a partition meet those of others, in a join of one row a partition.
    ``class_id`` and ``links`` come from the fingerprints' bands, joined and verified as in ``near_duplicates``.
    """
    found = write_shared(_ordered(documents).mapInArrow(_neighbours, f"{PAIR}, {ENDS}"), "neighbours")
    ends = found.where("part is not null")
    everywhere = Window.orderBy("part")
    # Partition numbers only: one small row for each task.
    order = ends.select("part", F.coalesce(F.lead("part").over(everywhere), F.first("part").over(everywhere)).alias("after"))
    heads = ends.select(F.col("part").alias("after"), F.col("first").alias("head"))
    edges = ends.select("part", "doc_id", "name", "last").join(order, "part").join(heads, "after").select("doc_id", "name", "last", "head")

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in pieces(batches):
            rows = []
            for doc_id, name, last, head in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(_pair(doc_id, _known(name, unpack(last).decode()), _known(0, unpack(head).decode())))
            yield _batch(rows, PAIR)

    inner = found.where("part is null").drop("part", "first", "last")
    pairs = inner.union(write_shared(edges.mapInArrow(join_ends, PAIR), "edges"))
    classes = _classes(documents, pairs.select("doc_id", "rep", "name", "signature"), similarity, SHINGLE)
    return _with_classes(pairs, classes).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("signature")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"),
        "near_edited", "near_next", "class_id", "links",
    )
