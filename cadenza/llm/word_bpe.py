"""Byte-pair encoding with word ends, by concatenating the encodings of halves.

A text is cut into words, and every word is encoded by its merges in order of rank, ties from the left.
Short words are lanes of numpy arrays: each step merges the best pair of every lane. A word longer than
``LEAF`` symbols is the leaves of a tree: all leaves of all long words are lanes of one call, and the two
halves of every inner node are joined level by level. A join re-encodes a window of the last tokens of the
left half and the first of the right one. The encoding of the whole is the left half up to the window, the
window's tokens, and the right half behind it, as soon as the window begins with the left half's own token
and ends with the right half's own: merges that stop at a token's edge on one side of that token and on its
other side stop there in the joint text as well. Until both sides agree, the window doubles; at the latest
it is both halves.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from cadenza.llm.common import add_columns, col
from cadenza.llm.sentencepiece_codec import read_model

WORD_END = "</w>"
LEAF = 64
#: Lanes up to so many symbols; beyond, a heap holds the pairs of one run.
WIDEST = 512
#: Cells of one block of lanes, some 20 MB with its links.
CELLS = 1 << 20
#: Bounds of a worker's memo, two generations of some 20 MB: words of up to LONG_WORD characters.
MEMO_WORDS = 80_000
LONG_WORD = 200
NO_RANK = np.int32(2**31 - 1)

#: What the tokenizer file must say for this codec to be the right one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    shown = set(prints)
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordCodec:
    """Encoder and decoder of one BPE file with word ends, byte letters and lower-case words."""

    def __init__(self, spec: bytes):
        file = json.loads(spec)
        model, cut = file["model"], file["pre_tokenizer"]["pretokenizers"]
        plain = model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not any(model.get(k) for k in ("unk_token", "dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        split = cut[0]["type"] == "Split" and cut[0]["pattern"] == {"Regex": WORDS} and cut[0]["invert"] and cut[0]["behavior"] == "Removed"
        letters_only = [c["type"] for c in cut] == ["Split", "ByteLevel"] and not (cut[1]["add_prefix_space"] or cut[1]["use_regex"])
        added = file["added_tokens"]
        raw = not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        if not (plain and split and letters_only and raw and file["normalizer"] == NORMALIZER and file["decoder"] is None and file["post_processor"] is None):
            raise ValueError("a lower-casing BPE with word ends and byte letters is needed")
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in added}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.letter = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.last_letter = np.array([vocab[c + WORD_END] for c in byte_letters()], np.int32)
        size = max(self.tokens) + 1
        #: Symbols that each token covers.
        self.span = np.ones(size, np.int64)
        for token, i in vocab.items():
            self.span[i] = len(token.removesuffix(WORD_END))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**62))
        self.ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int32)[order], NO_RANK)
        self.made = np.append(np.array([m for _, m in self.merges.values()], np.int32)[order], np.int32(0))
        self.word = regex.compile(WORDS)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.strange = strange_characters()
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.cutter = pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)
        #: Words with their ids and tokens: two generations, the older one dropped as the younger is full.
        self._young: dict[str, tuple[bytes, str]] = {}
        self._old: dict[str, tuple[bytes, str]] = {}

    # -- runs of symbols

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK if they don't merge) and merged symbol of pairs; a symbol below zero merges with nothing."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at = np.where((left >= 0) & (right >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key), at, len(self.keys) - 1)
        return self.ranks[at], self.made[at]

    def lanes(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of runs of symbols laid end to end, and how many each run has; every step merges each lane's pair of least rank, the leftmost of equal ones."""
        counts = np.zeros(len(sizes), np.int64)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        ordered = sizes[order]
        at, parts = int(np.searchsorted(ordered, 0, "right")), []
        while at < len(order):
            # Runs of at most half as much again in one block, so that little of it is padding.
            top = int(np.searchsorted(ordered, ordered[at] * 3 // 2 + 2, "right"))
            width = int(ordered[top - 1])
            some = order[at : min(top, at + max(1, CELLS // (width + 2)))]
            at += len(some)
            block = np.full((len(some), width + 2), -1, np.int32)
            block[:, 1:-1][np.arange(width) < sizes[some][:, None]] = flat[_ranges(starts[some], sizes[some])]
            tokens, counts[some] = self._merge_block(block)
            parts.append((some, tokens))
        out = np.empty(int(counts.sum()), np.int32)
        ends = np.cumsum(counts)
        for some, tokens in parts:
            out[_ranges((ends - counts)[some], counts[some])] = tokens
        return out, counts

    def _merge_block(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = symbols.shape
        following = np.tile(np.minimum(np.arange(width, dtype=np.int32) + 1, width - 1), (n, 1))
        before = np.tile(np.maximum(np.arange(width, dtype=np.int32) - 1, 0), (n, 1))
        rank = np.full((n, width), NO_RANK, np.int32)
        merged = np.zeros((n, width), np.int32)
        rank[:, :-1], merged[:, :-1] = self._look(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(n)
        while len(rows):
            p = rank[rows].argmin(1)
            going = rank[rows, p] != NO_RANK
            rows, p = rows[going], p[going]
            q = following[rows, p]
            behind, ahead = following[rows, q], before[rows, p]
            symbols[rows, p] = merged[rows, p]
            symbols[rows, q] = -1
            rank[rows, q] = NO_RANK
            following[rows, p] = behind
            before[rows, behind] = p
            rank[rows, p], merged[rows, p] = self._look(symbols[rows, p], symbols[rows, behind])
            rank[rows, ahead], merged[rows, ahead] = self._look(symbols[rows, ahead], symbols[rows, p])
        alive = symbols >= 0
        return symbols[alive], alive.sum(1)

    def by_heap(self, run: np.ndarray) -> np.ndarray:
        """Tokens of one long run, its pairs in a heap of (rank, place)."""
        symbols, get = run.tolist(), self.merges.get
        n = len(symbols)
        following, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(found[0], i, a, b) for i, (a, b) in enumerate(pairwise(symbols)) if (found := get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, p, a, b = heapq.heappop(heap)
            q = following[p]
            if symbols[p] != a or q >= n or symbols[q] != b:
                continue
            symbols[p], symbols[q] = get((a, b))[1], -1
            following[p] = behind = following[q]
            if behind < n:
                before[behind] = p
                if found := get((symbols[p], symbols[behind])):
                    heapq.heappush(heap, (found[0], p, symbols[p], symbols[behind]))
            ahead = before[p]
            if ahead >= 0 and (found := get((symbols[ahead], symbols[p]))):
                heapq.heappush(heap, (found[0], ahead, symbols[ahead], symbols[p]))
        return np.array([s for s in symbols if s >= 0], np.int32)

    def runs(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Tokens of runs of any length, without a tree."""
        short = [r for r in runs if len(r) <= WIDEST]
        made = iter(_split(*self.lanes(np.concatenate(short), np.array([len(r) for r in short])))) if short else iter(())
        return [next(made) if len(r) <= WIDEST else self.by_heap(r) for r in runs]

    # -- the tree

    def joined(self, halves: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Tokens of each joint text, from (its symbols, the length of its left half, tokens of left and right half)."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(halves)
        still, width = [*range(len(halves))], 1
        while still:
            windows = []
            for k in still:
                symbols, middle, left, right = halves[k]
                start, end = middle - int(self.span[left[-width:]].sum()), middle + int(self.span[right[:width]].sum())
                windows.append(symbols[start:end])
            apart = []
            for k, tokens in zip(still, self.runs(windows)):
                _, _, left, right = halves[k]
                i, j = min(width, len(left)), min(width, len(right))
                if (i == len(left) or tokens[0] == left[-i]) and (j == len(right) or tokens[-1] == right[j - 1]):
                    out[k] = np.concatenate([left[: len(left) - i], tokens, right[j:]])
                else:
                    apart.append(k)
            still, width = apart, width * 2
        return out

    def trees(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """Tokens of long words: leaves together, then the joins of all words level by level."""
        cut = [[(a, min(a + LEAF, len(w))) for a in range(0, len(w), LEAF)] for w in words]
        sizes = np.array([b - a for parts in cut for a, b in parts], np.int64)
        leaves = iter(_split(*self.lanes(np.concatenate(words), sizes)))
        nodes = [[(a, b, next(leaves)) for a, b in parts] for parts in cut]
        while any(len(row) > 1 for row in nodes):
            pairs = [(w[a:end], b - a, left, right) for w, row in zip(words, nodes) for (a, b, left), (_, end, right) in zip(row[::2], row[1::2])]
            done = iter(self.joined(pairs))
            nodes = [[(a, end, next(done)) for (a, _, _), (_, end, _) in zip(row[::2], row[1::2])] + (row[-1:] if len(row) % 2 else []) for row in nodes]
        return [row[0][2] for row in nodes]

    # -- texts

    def encode_words(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        """For each word, none of them empty, its ids as bytes and its tokens between spaces."""
        coded = [w.encode() for w in words]
        sizes = np.array([len(b) for b in coded], np.int64)
        data = np.frombuffer(b"".join(coded), np.uint8)
        flat, ends = self.letter[data], np.cumsum(sizes)
        flat[ends - 1] = self.last_letter[data[ends - 1]]
        long = sizes > LEAF
        short = flat[_ranges((ends - sizes)[~long], sizes[~long])]
        tokens, counts = self.lanes(short, sizes[~long])
        made: dict[str, tuple[bytes, str]] = {}
        ids, shown, at = tokens.astype("<u4").tobytes(), [self.tokens[i] for i in tokens.tolist()], 0
        for k, n in zip(np.flatnonzero(~long).tolist(), counts.tolist()):
            made[words[k]] = ids[4 * at : 4 * (at + n)], " ".join(shown[at : at + n])
            at += n
        at = np.flatnonzero(long)
        for k, own in zip(at.tolist(), self.trees([flat[ends[k] - sizes[k] : ends[k]] for k in at]) if len(at) else ()):
            made[words[k]] = own.astype("<u4").tobytes(), " ".join([self.tokens[i] for i in own.tolist()])
        return made

    def cut(self, text: str) -> list[str]:
        """Words and added tokens of a text in order. White space only parts words, so runs of it need no joining."""
        if self.special is None or "<" not in text:
            return self._words(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            if self.strange[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
                return [w for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))]
            text = unicodedata.normalize("NFC", text)
        # A final sigma is lower-cased like any other.
        lower = "σ".join([part.lower() for part in text.split("Σ")]) if "Σ" in text else text.lower()
        return self.word.findall(lower)

    def digests(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers and the decoded text."""
        cut = [self.cut(t) for t in texts]
        known, new = {}, []
        for word in set().union(*cut):
            found = self._young.get(word) or self._old.get(word)
            if found:
                known[word] = found
            else:
                new.append(word)
        known |= self.encode_words([w for w in new if w not in self.added]) if new else {}
        known |= {w: (np.array([self.added[w]], "<u4").tobytes(), w) for w in new if w in self.added}
        out = []
        for words in cut:
            ids, shown = zip(*[known[w] for w in words]) if words else ((), ())
            out.append((b"".join(ids), " ".join(shown)))
        if len(known) <= MEMO_WORDS:
            self._young.update((w, r) for w, r in known.items() if len(w) <= LONG_WORD)
        if len(self._young) > MEMO_WORDS:
            self._young, self._old = {}, self._young
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without added tokens of its own."""
        return np.frombuffer(self.digests([text])[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens between spaces, as a file without a decoder has it; ids outside the vocabulary are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _split(flat: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def strange_characters() -> np.ndarray:
    """By code point, the characters on which Python's tables and the tokenizer library's may differ.

    They follow different editions of Unicode: what Python does not know, and what composes otherwise.
    """
    compose, known = normalizers.NFC(), unicodedata.normalize
    strange = np.zeros(sys.maxunicode + 1, bool)
    for i in (*range(0xD800), *range(0xE000, len(strange))):
        c = chr(i)
        composes = unicodedata.combining(c) or unicodedata.decomposition(c)
        strange[i] = unicodedata.category(c) == "Cn" or composes and any(compose.normalize_str(p) != known("NFC", p) for p in (f"a{c}\u0301", f"a\u0345{c}"))
    return strange


_CODECS: dict[str, WordCodec] = {}


def codec_of(spec: bytes) -> WordCodec:
    """One codec for each file and Python worker."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = WordCodec(spec)
    return _CODECS[key]


def encode_documents(documents: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """``documents`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, unless left out, ``ids array<int>``.

    Null and empty texts give no ids, and the hashes of nothing. Columns of these names are replaced, others
    pass through; repeated rows are encoded alike and an empty table gives no rows. The file's bytes (some
    2 MB at any corpus) are broadcast. A text is encoded whole by the task that holds its row.
    """
    spark = documents.sparkSession
    spec = spark.sparkContext.broadcast(read_model(spark, path))

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        rows = codec_of(spec.value).digests(texts)
        made = [
            pa.array([len(r[0]) // 4 for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string()),
            pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
        ]
        if with_ids:
            values = np.frombuffer(b"".join([r[0] for r in rows]), "<u4").astype(np.int32)
            made.append(pa.ListArray.from_arrays(np.cumsum([0, *[len(r[0]) // 4 for r in rows]], dtype=np.int32), pa.array(values)))
        return made

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return add_columns(documents, added, make, text)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded string`` from an array of ids; a null array decodes to the empty text."""
    spark = encoded.sparkSession
    spec = spark.sparkContext.broadcast(read_model(spark, path))

    def make(batch: pa.RecordBatch, _: list[str]) -> list[pa.Array]:
        codec = codec_of(spec.value)
        return [pa.array([codec.decode(r or []) for r in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.string())]

    return add_columns(encoded, "decoded string", make, None)


def token_digest(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``documents``; null texts count as empty."""
    rows = encode_documents(documents.select(col("doc_id"), col("text")), path, with_ids=False)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
