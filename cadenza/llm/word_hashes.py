"""64-bit hashes of all words of many texts at once, in numpy.

The hash of a word is a polynomial in its bytes, read off as a difference of running sums, so the cost is a
few array operations a byte and no Python step a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
PIECE_CHARS = 1 << 18
#: Powers kept by a worker; a longer string, which is rare, gets its own for the time of its hashing.
KEPT_POWERS = 1 << 20
BLANKS = "\t\n\v\f\r "
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each; no more than ``KEPT_POWERS`` stay in memory."""
    kept = _POWERS.get("both")
    if kept is not None and len(kept[0]) >= n:
        return kept
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= KEPT_POWERS:
        _POWERS["both"] = (made[0], made[1])
    return made[0], made[1]


def _hash(joined: str, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte starts of the words of one string; with ``prefix`` only so many first bytes of a word count."""
    data = np.frombuffer(joined.encode(), np.uint8)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _BLANK[data]
    turns = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = turns[::2], turns[1::2]
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    mixed = (sums[ends] - sums[starts]) * down[starts]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return mixed, starts


def _pieces(text: str) -> Iterator[str]:
    """A text cut at blanks into pieces of about ``PIECE_CHARS``; a word longer than that stays whole in a longer piece."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = max(text.rfind(blank, at + 1, at + PIECE_CHARS) for blank in BLANKS)
        if cut < 0:
            later = [found for blank in BLANKS if (found := text.find(blank, at + PIECE_CHARS)) >= 0]
            if not later:
                break
            cut = min(later)
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[str], chars: int = PIECE_CHARS, prefix: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text numbers) of the words in order, in blocks of whole texts of about ``chars`` characters.

    Words are separated by ASCII blanks and lower-cased; a text beyond the block size comes in a block of its own.
    With ``prefix`` the hash is that of each word's first bytes.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        some = [t.lower() for t in texts[at:end]]
        if end - at == 1:
            parts = [_hash(p, prefix)[0] for p in _pieces(some[0])]
            hashes = np.concatenate(parts)
            yield hashes, np.full(len(hashes), at)
        else:
            hashes, starts = _hash("\n".join(some), prefix)
            lengths = [len(t.encode()) + 1 if not t.isascii() else len(t) + 1 for t in some]
            bounds = np.cumsum(lengths)
            yield hashes, at + np.searchsorted(bounds, starts, side="right")
        at = end
