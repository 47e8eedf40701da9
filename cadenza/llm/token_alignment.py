"""Alignment of the tokens that two tokenizers give to one text, by elementary intervals of its bytes.

The ends of both token rows cut a text into elementary intervals: their union, sorted. The owner of an
interval in either row is the first token that ends at or behind the interval's end, found by binary search,
so each interval is one overlap of two tokens. Where both owners end with the interval, a group closes; the
tokens that end there make up a product, and the product's pairs are the links. No token is empty, so each
factor is one token.

Corpus statistics of linked id pairs are a Spark table that grows with the corpus. The most frequent pairs,
at most ``HOT_PAIRS``, are sent to all tasks; what a document holds of the others is joined by pair. Both
ways give the same sums.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from cadenza.llm.common import add_columns, col, write_shared
from cadenza.llm.sentencepiece_codec import BYTE, MARK, read_model
from cadenza.llm.word_bpe import byte_letters

#: Bound of the pair table that is broadcast, some 17 bytes a pair.
HOT_PAIRS = 1 << 19
#: An id pair is one number: the A id above so many bits for the B id.
B_BITS = 20
NO_TOKENS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
#: Fixed value: how a byte-level tokenizer of this kind cuts a text before its merges.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Alignment(NamedTuple):
    """Overlaps by elementary interval (its end and both owners), the overlaps that close a group, and the group of each token."""

    ends: np.ndarray
    a: np.ndarray
    b: np.ndarray
    closing: np.ndarray
    group_of_a: np.ndarray
    group_of_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Alignment of two token rows over the same bytes, from the ascending ends of their tokens."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    closing = np.flatnonzero((ends_a[a] == ends) & (ends_b[b] == ends)) if len(ends) else np.empty(0, np.int64)
    # A token belongs to the first group that closes at or behind its end.
    shared = ends[closing]
    return Alignment(ends, a, b, closing, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b))


class TokenPair:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, byte_spec: bytes, piece_model: bytes):
        file = json.loads(byte_spec)
        cut, merges = file["pre_tokenizer"], file["model"]["merges"]
        if file["normalizer"] or cut != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("a byte-level tokenizer without normaliser is needed")
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items()}
        joined = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges)
        made = [vocab[bytes(byte[c] for c in m)] for m in joined]
        if made != sorted(made):
            raise ValueError("merges must come in the order of their ids")
        self.a = tiktoken.Encoding("byte-level", pat_str=CUT, mergeable_ranks=vocab, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        spec = model_pb2.ModelProto()
        spec.ParseFromString(piece_model)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = t
        self.bytes_b = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() for p in spec.pieces]
        if not all(self.bytes_b) or len(self.bytes_b) >= 1 << B_BITS:
            raise ValueError("every piece needs bytes, and an id below the bound")
        self.size_a, self.size_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # Decimal ids with what may follow them: , within a group, | behind its A ids, ; behind its B ids.
        top = max(len(self.bytes_a), len(self.bytes_b))
        self.shown = np.array([f"{i}{mark}" for mark in ",|;" for i in range(top)], object)
        self.top = top

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B for each text; none for both where the text is empty or the tokens' bytes differ from it."""
        kept_a, kept_b = [], []
        none = np.empty(0, np.int64)
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = " " + text
            data = whole.encode()
            a = self.a.encode_to_numpy(whole, disallowed_special=()).astype(np.int64) if text else none
            if text and b"".join([self.bytes_b[i] for i in b]) == data and b"".join([self.bytes_a[i] for i in a.tolist()]) == data:
                kept_a.append(a)
                kept_b.append(np.array(b, np.int64))
            else:
                kept_a.append(none)
                kept_b.append(none)
        return kept_a, kept_b

    def digests(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """For each text (n_a, n_b, n_groups, n_links, groups_sha256); then each text's number of linked pairs, and of all texts end to end the pairs, and how often each is linked."""
        rows_a, rows_b = self.encode(texts)
        n_a, n_b = (np.array([len(r) for r in rows], np.int64) for rows in (rows_a, rows_b))
        a, b = np.concatenate([*rows_a, np.empty(0, np.int64)]), np.concatenate([*rows_b, np.empty(0, np.int64)])
        # Both rows of a text cover the same bytes, so the texts laid end to end align as one; every text's end is shared.
        found = align(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        link_a, link_b = found.a[found.closing], found.b[found.closing]
        text_of_link = np.repeat(np.arange(len(texts)), n_a)[link_a]
        n_groups = np.bincount(text_of_link, minlength=len(texts))
        # Places of the tokens when each group's A ids stand before its B ids.
        first_a, first_b = np.append(0, link_a + 1), np.append(0, link_b + 1)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + first_b[found.group_of_a]] = a + self.top * np.isin(np.arange(len(a)), link_a, assume_unique=True)
        order[np.arange(len(b)) + first_a[found.group_of_b + 1]] = b + 2 * self.top * np.isin(np.arange(len(b)), link_b, assume_unique=True)
        shown, ends = self.shown[order].tolist(), np.cumsum(n_a + n_b).tolist()
        hashes = [hashlib.sha256("".join(shown[start:end])[:-1].encode()).hexdigest() if end > start else "" for start, end in zip([0, *ends], ends)]
        key = text_of_link << 44 | a[link_a] << B_BITS | b[link_b]
        pairs, times = np.unique(key, return_counts=True)
        n_pairs = np.bincount(pairs >> 44, minlength=len(texts))
        rows = [*zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_groups.tolist(), hashes)]
        return rows, n_pairs, pairs & ((1 << 44) - 1), times

    def groups(self, text: str) -> list[tuple[list[int], list[int]]]:
        """The groups of one text, each with its A and its B ids."""
        (a,), (b,) = self.encode([text])
        found = align(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        return [(a[found.group_of_a == g].tolist(), b[found.group_of_b == g].tolist()) for g in range(len(found.closing))]


_PAIRS: dict[str, TokenPair] = {}


def pair_of(byte_spec: bytes, piece_model: bytes) -> TokenPair:
    """One pair of tokenizers for each pair of files and Python worker."""
    key = hashlib.sha256(byte_spec).hexdigest() + hashlib.sha256(piece_model).hexdigest()
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = TokenPair(byte_spec, piece_model)
    return _PAIRS[key]


def link_documents(documents: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """``documents`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, and the distinct linked ``pairs`` with their ``times``.

    A pair is ``a << 20 | b``. Null and empty texts, and texts that a tokenizer does not keep byte for byte, have no tokens:
    zeros, an empty hash and empty arrays. Columns of these names are replaced, others pass through; repeated
    rows come out alike and an empty table gives no rows. The two files (some 3 MB at any corpus) are broadcast.
    """
    spark = documents.sparkSession
    files = spark.sparkContext.broadcast((read_model(spark, byte_path), read_model(spark, piece_path)))

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        rows, n_pairs, pairs, times = pair_of(*files.value).digests(texts)
        columns = [*zip(*rows)] or [(), (), (), (), ()]
        ends = pa.array(np.cumsum([0, *n_pairs]), pa.int32())
        made = [pa.array(c, kind) for c, kind in zip(columns, [pa.int64()] * 4 + [pa.string()])]
        return [*made, pa.ListArray.from_arrays(ends, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))]

    return add_columns(documents, NO_TOKENS, make, text)


def group_documents(documents: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """``documents`` with ``token_groups``: for each group its A ids ``a`` and B ids ``b``. Texts without tokens have none; a column of this name is replaced."""
    spark = documents.sparkSession
    files = spark.sparkContext.broadcast((read_model(spark, byte_path), read_model(spark, piece_path)))
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        both = pair_of(*files.value)
        return [pa.array([[{"a": a, "b": b} for a, b in both.groups(t)] for t in texts], kind)]

    return add_columns(documents, "token_groups array<struct<a: array<int>, b: array<int>>>", make, text)


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair``, its ``links`` in the whole corpus and ``best``: whether no other pair of its B id has more."""
    counted = write_shared(linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("links")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    # One row for each id of B's vocabulary at most.
    most = counted.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counted.join(F.broadcast(most), b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def hot_pairs(counts: DataFrame, limit: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int | None]:
    """Pairs, links and best marks of the most frequent pairs, ``limit`` at most, and the number of links from which on a pair is among them (None: all are)."""
    bucket = F.floor(F.log2("links") * 8)
    rows = counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("links").alias("least")).orderBy(F.desc("bucket")).collect()
    least, total = None, 0
    for r in rows:
        total += r["n"]
        if total > limit:
            break
        least = r["least"]
    every = total <= limit
    if least is None:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)), (None if every else 1 << 62)
    table = counts.where(F.col("links") >= least).toArrow()
    pairs = table["pair"].to_numpy()
    order = np.argsort(pairs)
    return (pairs[order], table["links"].to_numpy()[order], table["best"].to_numpy()[order]), None if every else least


def alignment_digest(documents: DataFrame, byte_path: str, piece_path: str, hot: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``documents``.

    ``n_best`` counts the links whose pair has the most links of all pairs of its B id, ties included;
    ``count_sum`` sums over links their pair's number of links in the corpus. Rows without tokens have zeros.
    """
    spark = documents.sparkSession
    linked = write_shared(link_documents(documents.select(col("doc_id"), col("text")), byte_path, piece_path).drop("text"), "linked")
    counts = write_shared(pair_counts(linked), "pair_counts")
    table, least = hot_pairs(counts, hot)
    sent = spark.sparkContext.broadcast(table)

    def make(batch: pa.RecordBatch, _: list[str]) -> list[pa.Array]:
        pairs, links, best = sent.value
        own = batch.column(batch.schema.get_field_index("pairs"))
        sizes = np.diff(own.offsets.to_numpy())
        key, times = own.flatten().to_numpy(), batch.column(batch.schema.get_field_index("times")).flatten().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
        known = pairs[at] == key if len(pairs) else np.zeros(len(key), bool)
        row = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda values: np.add.reduceat(np.append(values, 0), np.append(0, np.cumsum(sizes))[:-1]) * (sizes > 0) if len(sizes) else values
        n, good = (links[at], best[at]) if len(pairs) else (np.zeros(len(key), np.int64), np.zeros(len(key), bool))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row[~known], minlength=len(sizes)))), pa.int32())
        return [
            pa.array(add(times * good * known), pa.int64()), pa.array(add(times * n * known), pa.int64()),
            pa.ListArray.from_arrays(ends, pa.array(key[~known], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times[~known], pa.int64())),
        ]

    digest = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    summed = add_columns(linked, "n_best bigint, count_sum bigint, rest array<bigint>, rest_times array<bigint>", make, None)
    if least is None:
        return summed.select(digest)
    summed = write_shared(summed.drop("pairs", "times"), "summed")
    # Texts with the same groups have the same pairs, so each hash's pairs meet the counts once.
    once = summed.where("size(rest) > 0").groupBy("groups_sha256").agg(F.first("rest").alias("rest"), F.first("rest_times").alias("times"))
    rare = once.select(F.col("groups_sha256").alias("_of"), F.explode(F.arrays_zip("rest", "times")).alias("p")).select("_of", F.col("p.rest").alias("pair"), F.col("p.times").alias("times"))
    more = rare.join(counts.where(F.col("links") < least), "pair").groupBy("_of").agg(
        F.sum(F.col("times") * F.col("links")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    rest = summed.where("size(rest) > 0").join(more, F.col("groups_sha256") == F.col("_of"))
    rest = rest.withColumns({"n_best": F.col("n_best") + F.col("_best"), "count_sum": F.col("count_sum") + F.col("_sum")})
    return summed.where("size(rest) = 0").select(digest).union(rest.select(digest))
