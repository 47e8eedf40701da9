"""SentencePiece BPE encoding through a table of each prefix's unique last token.

In a byte-pair encoding every run of tokens is itself the encoding of the text it covers.
So each prefix of a text has one last token, and a token that an automaton finds at a
position is that last token exactly if it is compatible with the last token of the prefix
before it: encoding the two tokens' joint text gives back the pair. A scan from left to
right fills the table; the ids are then read backwards from its end.

No piece of the vocabulary holds a word mark after another character, so no token crosses into a
new word and each word (a run of marks and what follows) is encoded on its own. Words that
repeat are looked up in a bounded memo.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from cadenza.llm.common import add_columns, col

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Bounds of a worker's memos, some 30 MB each: words with their encoding, and pairs of tokens.
MEMO_WORDS = 60_000
MEMO_PAIRS = 150_000
LONG_WORD = 200


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes, read by Spark when only Spark's readers know the path."""
    if "://" in path and not path.startswith("file://"):
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path.removeprefix("file://"), "rb") as file:
        return file.read()


class PrefixTableCodec:
    """Encoder and decoder of one BPE model with byte fallback."""

    def __init__(self, model: bytes):
        spec = model_pb2.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("the model's normaliser must only mark spaces and add a leading one")
        self.pieces = [p.piece for p in spec.pieces]
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type == CONTROL}
        self.unknown = {i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN}
        self.unk_surface = spec.trainer_spec.unk_surface
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses into a new word")
        self.spaced = [p.replace(MARK, " ") for p in self.pieces]
        self.shown = {p: (str(i), self.spaced[i]) for p, i in self.ids.items()}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, tuple[int, str, str]] = {}
        self._spines()
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # Lone characters are the scan's last resort; a piece that merges do not reach is never a token.
            if len(piece) > 1 and piece in self.last_merge:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()

    def _merge(self, symbols: list[str]) -> tuple[list[str], tuple[str, str]]:
        """The merges of a few characters in order of score, ties from the left, and the last pair merged."""
        pair = ("", "")
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.score.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            pair = symbols[at], symbols[at + 1]
            symbols[at : at + 2] = [pair[0] + pair[1]]
        return symbols, pair

    def _spines(self) -> None:
        """For each reachable piece its last merge, and the pieces along its left and right edge.

        A spine lists each edge piece with the score of the merge that takes it in. It stands only
        where scores never rise from parts to whole, so that merges happen in the order of their scores.
        """
        self.last_merge: dict[str, tuple[str, str]] = {}
        self.left: dict[str, list[tuple[str, float]]] = {}
        self.right: dict[str, list[tuple[str, float]]] = {}
        nothing = float("-inf")
        for piece in sorted(self.ids, key=len):
            if len(piece) == 1:
                self.last_merge[piece] = (piece, "")
                self.left[piece] = self.right[piece] = [(piece, nothing)]
                continue
            symbols, (a, b) = self._merge([*piece])
            if symbols != [piece]:
                continue
            self.last_merge[piece] = (a, b)
            own = self.score[piece]
            plain = MARK not in piece[1:] and a in self.left and b in self.left
            if plain and all(own <= self.score[x] for x in (a, b) if len(x) > 1):
                self.left[piece] = [*self.left[a][:-1], (a, own), (piece, nothing)]
                self.right[piece] = [*self.right[b][:-1], (b, own), (piece, nothing)]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart when their joint text is encoded."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            lone = [(left, float("-inf"))] if len(left) == 1 else None, [(right, float("-inf"))] if len(right) == 1 else None
            before, after = self.right.get(left) or lone[0], self.left.get(right) or lone[1]
            if before and after:
                known = self._stay_apart(before, after)
            else:
                known = self._merge([*left, *right])[0] == [left, right]
            self._pairs[left, right] = known
        return known

    def _stay_apart(self, before: list[tuple[str, float]], after: list[tuple[str, float]]) -> bool:
        """Walk both edges in the order of their merges; they join if their joint piece ever comes first."""
        i = j = 0
        while True:
            (x, x_next), (y, y_next) = before[i], after[j]
            joint = self.score.get(x + y)
            # Equal scores go to the pair further left: the left edge's own merge, then the joint, then the right edge's.
            if joint is not None and joint > x_next and joint >= y_next:
                return False
            if x_next == y_next == float("-inf"):
                return True
            if x_next >= y_next:
                i += 1
            else:
                j += 1

    def split(self, word: str) -> list[str]:
        """Tokens of one word by its prefix table; a character outside the vocabulary stands for itself."""
        # last[i] is the last token of the first i characters; a lone character is the token of last resort.
        last = ["", *word]
        open_at = [True] * (len(word) + 1)
        known = self._pairs.get
        for end, (token, size) in self.automaton.iter(word):
            end += 1
            if open_at[end]:
                start = end - size
                if not start:
                    last[end], open_at[end] = token, False
                else:
                    apart = known((last[start], token))
                    if apart or (apart is None and self.compatible(last[start], token)):
                        last[end], open_at[end] = token, False
        out, at = [], len(word)
        while at:
            token = last[at]
            out.append(token)
            at -= len(token)
        return out[::-1]

    def encode_word(self, word: str) -> tuple[int, str, str]:
        """Number of ids of a word, the ids joined by commas, and their decoded text (marks as spaces)."""
        tokens = self.split(word)
        try:
            shown = [self.shown[t] for t in tokens]
            made = len(shown), ",".join([x[0] for x in shown]), "".join([x[1] for x in shown])
        except KeyError:
            # A word starts with a mark, so no byte run spans two words and each decodes on its own.
            ids = [i for t in tokens for i in ([self.ids[t]] if t in self.ids else [self.byte_id[b] for b in t.encode()])]
            made = len(ids), ",".join(map(str, ids)), self.decode(ids, first=False)
        if len(word) <= LONG_WORD:
            if len(self._words) >= MEMO_WORDS:
                self._words.clear()
            self._words[word] = made
        return made

    def words(self, text: str) -> list[str]:
        """The marked text cut before each run of marks."""
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the text decoded from them."""
        known, encode = self._words.get, self.encode_word
        words = [known(w) or encode(w) for w in self.words(text)]
        if not words:
            return 0, "", ""
        return sum([w[0] for w in words]), ",".join([w[1] for w in words]), "".join([w[2] for w in words])[1:]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin or end ids."""
        joined = self.digest(text)[1]
        return [int(i) for i in joined.split(",")] if joined else []

    def decode(self, ids: Iterable[int], first: bool = True) -> str:
        """Text of ids: marks become spaces, the first mark goes, byte runs become UTF-8 (bad bytes U+FFFD)."""
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(utf8_or_replacement(bytes(run)))
                run.clear()
                first = False
            if i in self.silent:
                continue
            piece = self.unk_surface if i in self.unknown else self.pieces[i]
            if first and piece.startswith(MARK):
                piece = piece[1:]
            first = False
            parts.append(piece.replace(MARK, " "))
        if run:
            parts.append(utf8_or_replacement(bytes(run)))
        return "".join(parts)


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def utf8_or_replacement(data: bytes) -> str:
    """UTF-8 text in which every byte that starts no character becomes one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_CODECS: dict[str, PrefixTableCodec] = {}


def codec_of(model: bytes) -> PrefixTableCodec:
    """One codec for each model and Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PrefixTableCodec(model)
    return _CODECS[key]


def encode_documents(documents: DataFrame, model_path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """``documents`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, unless left out, ``ids array<int>``.

    Null texts count as empty and give no ids. Columns of these names are replaced, others pass
    through; repeated rows are encoded alike and an empty table gives no rows. The model's bytes
    (a fixed file of about 0.5 MB) are broadcast.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, model_path))

    def make(_: pa.RecordBatch, texts: list[str]) -> list[pa.Array]:
        codec = codec_of(model.value)
        rows = [codec.digest(t) for t in texts]
        made = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
            pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string()),
        ]
        if with_ids:
            flat = ",".join([r[1] for r in rows if r[1]])
            values = np.array(flat.split(",") if flat else [], np.int32)
            made.append(pa.ListArray.from_arrays(np.cumsum([0, *[r[0] for r in rows]], dtype=np.int32), pa.array(values)))
        return made

    added = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return add_columns(documents, added, make, text)


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded string`` from an array of ids; a null array decodes to the empty text."""
    spark = encoded.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, model_path))

    def make(batch: pa.RecordBatch, _: list[str]) -> list[pa.Array]:
        codec = codec_of(model.value)
        rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        return [pa.array([codec.decode(r or ()) for r in rows], pa.string())]

    return add_columns(encoded, "decoded string", make, None)


def token_digest(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    rows = encode_documents(documents.select(col("doc_id"), col("text")), model_path, with_ids=False)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
