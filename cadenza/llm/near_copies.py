"""SimHash near-dedup at a similarity of 0.8 or more over five-word shingles: vantage-point shards, links verified exactly.

Operator 8's fingerprints meet in its vantage-point shards (``simhash.vantage_shards``): all codes within 4 of 64 bits are linked, exactly,
and what is so linked is compared. The rest of this page is on the pairs beyond that radius.

Two texts whose shingle sets have a Jaccard similarity of 0.8 differ in about 15 % of their SimHash bits, some 10 of 64:
far outside what shards for 4 bits of 64 find. Here a fingerprint has 256 bits, and distances rank the candidates: at
similarity 0.8 two texts are about 39 bits apart, unrelated ones 128, and ``RADIUS`` lies many deviations from both.

Partial distances alone would need shards whose number grows with the data, so the root shards of these are those of texts that agree in a
band of shingle minima: a fixed number of shards a text, at any size, that two texts at similarity 0.8 share with a chance of 0.998
and at 0.9 of 0.9999999. Inside a shard, all members are measured against a vantage point; shells around it bound what else has to be
compared (triangle inequality); and each link counts only if the exact Jaccard similarity of the two texts reaches 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import add_columns, col, forget, keep_ranked, row_mark, row_rank, write_shared
from cadenza.llm.components import connected_components
from cadenza.llm.minhash import BANDS, BAND_ROWS, SIMILARITY, hasher
from cadenza.llm.simhash import fingerprint, shard_links, vantage_shards
from cadenza.llm.verified_links import band_keys, confirmed_links, needed_of, rep_of, sets_of, shared_buckets, text_name

WORDS = 4
BITS = 64 * WORDS
RADIUS = 68
SHINGLE = 5
_BLOCK = 4096


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """256-bit SimHash (four unsigned words) over distinct shingle hashes; zeros without any.

    A bit is set if more than half of the shingles' mixed hashes have it set.
    """
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), _BLOCK):
        part = shingles[at : at + _BLOCK]
        mixed = np.empty((len(part), WORDS), np.uint64)
        for k in range(WORDS):
            x = part + np.uint64(((k + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed[:, k] = x ^ (x >> np.uint64(31))
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.uint64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each code of ``a`` and each of ``b``."""
    apart = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        apart += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    return apart


def with_reps(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``documents`` with ``rep bigint`` (its shingle set), ``signature binary`` (minima for the root shards) and ``fingerprint bigint`` (operator 8's); null texts count as empty."""

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        maker = hasher(size=size)
        found = [maker.shingles(t) for t in texts]
        return [
            pa.array([rep_of(s) for s in found], pa.int64()), pa.array([maker.minima(s).tobytes() for s in found], pa.binary()),
            pa.array(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64), pa.int64()),
        ]

    return add_columns(documents, "rep bigint, signature binary, fingerprint bigint", make)


def linked_buckets(rows: DataFrame) -> DataFrame:
    """``(bucket, rep)``: one bucket for all texts whose SimHash fingerprints are linked, from vantage-point shards."""
    codes = write_shared(rows.select(F.col("fingerprint").alias("code")).distinct(), "codes")
    roots = connected_components(shard_links(vantage_shards(codes)))
    forget(codes)
    named = rows.select("fingerprint", "rep").distinct().join(roots, F.col("fingerprint") == F.col("node"), "left")
    buckets = write_shared(named.select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fingerprint")).alias("bucket"), "rep"), "linked")
    forget(roots)
    return buckets


def rep_roots(documents: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``(node, root)`` of every ``rep`` that has a near copy; ``rows`` are the documents' rep, text name, signature and fingerprint."""
    linked = linked_buckets(rows)
    shared = shared_buckets(rows, band_keys(F.col("signature"), BANDS, 2 * BAND_ROWS), linked)
    forget(linked)
    needed = needed_of(rows, shared)
    sets = sets_of(documents, needed, hasher(size=size).shingles, wide_fingerprint)
    links = confirmed_links(shared, sets, hamming, "uint64", radius, similarity)
    forget(shared, needed, sets)
    roots = connected_components(links)
    forget(links)
    return roots


def keep_first(documents: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``documents`` with one row of each group of near copies: that of the smallest doc_id and then text hash (of repeated ids one row).

    Groups are the components of verified links, between texts that SimHash fingerprints link or that share a band. Null and empty texts form one group. Null ids come last: each group whose ids are
    all null keeps one row. All columns pass through; an empty table gives no rows. Texts of one shingle set are folded first.
    """
    slim = with_reps(documents.select(col("doc_id"), col("text"), row_mark().alias("mark"), text_name().alias("name")), size).drop("text")
    rows = write_shared(slim, "reps")
    folded = rows.groupBy("rep").agg(F.min(row_rank(F.col("mark"))).alias("first"))
    roots = rep_roots(documents, rows, similarity, radius, size)
    grouped = folded.join(roots, folded["rep"] == roots["node"], "left").groupBy(F.coalesce("root", "rep").alias("root")).agg(F.min("first").alias("first"))
    first = write_shared(grouped, "kept")
    forget(roots)
    kept = keep_ranked(documents, rows.select("doc_id", "mark"), first)
    forget(rows, first)
    return kept
