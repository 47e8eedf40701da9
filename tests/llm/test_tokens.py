"""The word-end BPE codec, the alignment of two tokenizers and the fill-in-middle transformation against brute force and the libraries."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cadenza.llm import fill_in_middle, token_alignment, word_bpe
from cadenza.llm.entry import BYTE_BPE, PIECE_MODEL, WORD_BPE

sha = lambda data: hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
ODD = ["", " ", "a", "<|endoftext|>", "x<|startoftext|><|endoftext|>y", "<|ENDOFTEXT|>", "it's IT'S 'Ll", "ΑΣ Σ", "İstanbul ﬁ é ́e", "日本語の文字列", "▁▁ a▁b", "\x00\x01\x02\x85 ", "👍🏽👩‍👩‍👧", "1234567 a1b2",
       "\U00010d50 Ᲊ a՘b", "á࢙ͅ", "tab\tnew\n\r\n  line ", "�", "<0x41>", "Ġhello</w>"]


@pytest.fixture(scope="module")
def word_codec():
    return word_bpe.WordCodec(open(WORD_BPE, "rb").read())


@pytest.fixture(scope="module")
def word_library():
    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    library.no_padding()
    return library


def _same_as_library(codec, library, texts):
    for text, (ids, shown), theirs in zip(texts, codec.digests(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.ids, text[:80]
        assert shown == library.decode(theirs.ids, skip_special_tokens=False) == codec.decode(theirs.ids)


def test_bpe_of_odd_texts(word_codec, word_library):
    rng = random.Random(3)
    parts = [*ODD, "lorem", "aab", "THE", "ing", " ", "\n", "é", "!?", "aaaaaaa"]
    _same_as_library(word_codec, word_library, [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(4000))])


def test_bpe_of_every_character(word_codec, word_library):
    points = [chr(i) for i in range(0, 0x20000) if not 0xD800 <= i < 0xE000]
    _same_as_library(word_codec, word_library, [f"a{c}b" for c in points])


@pytest.mark.parametrize("leaf", [2, 5, 64])
def test_tree_of_long_words(word_codec, word_library, leaf, monkeypatch):
    """Words far longer than a leaf: repeats that shift, random letters, other scripts."""
    monkeypatch.setattr(word_bpe, "LEAF", leaf)
    rng = random.Random(leaf)
    word_codec._young, word_codec._old = {}, {}
    texts = ["a" * n for n in (1, 63, 64, 65, 127, 129, 5001)] + ["ab" * 3000 + "c", "!" * 3000, "-=" * 999 + "-"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 2500))) for letters in ("ab", "etaoinshr", "日本語中文", "é", ["ing", "the", "tion", "ever"]) for _ in range(20)]
    _same_as_library(word_codec, word_library, texts)


def test_bpe_documents(spark, documents, word_library):
    rows = {r["doc_id"]: r for r in word_bpe.token_digest(documents, WORD_BPE).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    assert rows.keys() == texts.keys()
    for i, theirs in zip(texts, word_library.encode_batch([*texts.values()], add_special_tokens=False)):
        assert rows[i]["n_tokens"] == len(theirs.ids)
        assert rows[i]["ids_sha256"] == sha(np.array(theirs.ids, "<u4").tobytes())
        assert rows[i]["decoded_sha256"] == sha(word_library.decode(theirs.ids, skip_special_tokens=False))


def test_bpe_round_trip(spark, odd, clashing):
    rows = word_bpe.decode_documents(word_bpe.encode_documents(clashing(odd), WORD_BPE), WORD_BPE).collect()
    assert len(rows) == 10 and all(sha(r["decoded"]) == r["decoded_sha256"] and len(r["ids"]) == r["n_tokens"] for r in rows)
    assert [r["ids"] for r in rows if not r["text"]] == [[], []]


# -- alignment

def _brute_alignment(texts):
    """Digest rows by plain loops over the libraries' tokens."""
    library = Tokenizer.from_file(BYTE_BPE)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    letters = {c: b for b, c in enumerate(word_bpe.byte_letters())}
    counts, made = Counter(), []
    for text in texts:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := pieces.id_to_piece(i)) and pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            made.append(None)
            continue
        by_end = defaultdict(lambda: [None, None])
        for side, ids, data in ((0, a, bytes_a), (1, b, bytes_b)):
            at = 0
            for i, token in zip(ids, data):
                at += len(token)
                by_end[at][side] = i
        groups, links, now = [], [], ([], [])
        for end in sorted(by_end):
            x, y = by_end[end]
            now[0].extend([x] * (x is not None))
            now[1].extend([y] * (y is not None))
            if x is not None and y is not None:
                groups.append(now)
                links.append((x, y))
                now = ([], [])
        counts.update(links)
        made.append((len(a), len(b), groups, links))
    best = Counter()
    for (x, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = m
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha(shown)))
    return out


@pytest.mark.parametrize("hot", [0, 300, 1 << 19])
def test_alignment_of_documents(spark, documents, hot):
    """All pairs sent, some sent and the others joined, all joined."""
    extra = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(ODD)] + [(-100, None), (None, "no id"), (None, "no id"), (-101, "no id")], "doc_id bigint, text string")
    both = documents.select("doc_id", "text").unionByName(extra)
    ids, texts = zip(*[(r["doc_id"], r["text"] or "") for r in both.collect()])
    expected = Counter((i, *row) for i, row in zip(ids, _brute_alignment(texts)))
    rows = token_alignment.alignment_digest(both, BYTE_BPE, PIECE_MODEL, hot).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert Counter(tuple(r) for r in rows) == expected


def test_overlaps():
    found = token_alignment.align(np.array([2, 5, 6, 9]), np.array([3, 6, 9]))
    assert found.ends.tolist() == [2, 3, 5, 6, 9] and found.a.tolist() == [0, 1, 1, 2, 3] and found.b.tolist() == [0, 0, 1, 1, 2]
    assert found.closing.tolist() == [3, 4] and found.group_of_a.tolist() == [0, 0, 0, 1] and found.group_of_b.tolist() == [0, 0, 1]
    assert token_alignment.align(np.array([], np.int64), np.array([], np.int64)).closing.tolist() == []


def test_groups_and_odd_rows(spark, odd, empty, clashing):
    rows = token_alignment.group_documents(clashing(odd), BYTE_BPE, PIECE_MODEL).collect()
    digests = {r["text"]: r["groups_sha256"] for r in token_alignment.link_documents(clashing(odd), BYTE_BPE, PIECE_MODEL).collect()}
    for r in rows:
        shown = ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in r["token_groups"])
        assert digests[r["text"]] == (sha(shown) if shown else "")
    assert token_alignment.alignment_digest(empty, BYTE_BPE, PIECE_MODEL).collect() == []


# -- fill in middle

def _brute_middle(doc_id, text, seed=42, rate=50, spm=80):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"{seed}:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return len(units), form, len(p), len(m), sha(out), sha(text)


def test_fill_in_middle(spark):
    rng = random.Random(5)
    parts = ["\x01", "\x02", "\x020", "\x021", "0", "1", " ", "  ", "\n", "\x0b", "a", "bé", "👍🏽", "<P", ">", "<", "<S>", "\x85", "　"]
    rows = [(None if i % 50 == 0 else i, None if i % 97 == 0 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(3000)]
    rows += [(-1, " \n " * 50_000), (-2, "word " * 100_000), (-2, "word " * 100_000)]
    made = fill_in_middle.transform_digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(tuple(r) for r in made) == Counter((i, *_brute_middle(i, t or "")) for i, t in rows)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_odd_rows(spark, odd, empty, clashing):
    assert fill_in_middle.transform_digest(empty).collect() == []
    rows = fill_in_middle.transform(clashing(odd), rate=100).collect()
    assert len(rows) == 10 and "a b.c" in rows[0].asDict()
    for r in rows:
        text = r["text"] or ""
        assert (r["form"] == "plain" and r["output"] == text) or r["prefix"] + r["middle"] + r["suffix"] == text
