"""Longest common subsequence of two word lists by whole rows of bits, in memory that grows with the root of the table.

Row i of the usual table of lengths is one integer: bit j is 0 where the length grows from column j to j + 1, so the number of zero bits below a
column is the length there, and the next row takes an addition and a few bitwise steps on whole integers. The walk back needs the rows from the last
to the first: every s-th is kept, s about the root of their number, and the s rows behind it are made again when the walk gets there.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from math import isqrt

#: Bytes of the masks kept of words that come often.
MASK_BYTES = 64 << 20


class _Rows:
    """Rows of the table for a list of heard words."""

    def __init__(self, heard: list[str]):
        self.width = len(heard)
        self.full = (1 << self.width) - 1
        self.places: dict[str, list[int]] = {}
        for j, word in enumerate(heard):
            self.places.setdefault(word, []).append(j)
        self.kept: OrderedDict[str, int] = OrderedDict()
        self.most = max(16, MASK_BYTES // (self.width // 8 + 64))

    def mask(self, word: str) -> int:
        """Bits of the places where a heard word is ``word``."""
        found = self.kept.get(word)
        if found is None:
            bits = bytearray(self.width // 8 + 1)
            for j in self.places[word]:
                bits[j >> 3] |= 1 << (j & 7)
            found = self.kept[word] = int.from_bytes(bits, "little")
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        else:
            self.kept.move_to_end(word)
        return found

    def following(self, row: int, word: str) -> int:
        if word not in self.places:
            return row
        met = row & self.mask(word)
        return ((row + met) | (row - met)) & self.full

    def length(self, row: int, column: int) -> int:
        """Length of the common subsequence with the first ``column`` heard words."""
        return column - (row & ((1 << column) - 1)).bit_count()


def common_subsequence(script: list[str], heard: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, ascending; the walk back from the ends takes a match, else drops a script word where that loses nothing, else a heard word."""
    if not script or not heard:
        return []
    rows = _Rows(heard)
    step = isqrt(len(script)) + 1
    saved, row = [], rows.full
    for i, word in enumerate(script):
        if i % step == 0:
            saved.append(row)
        row = rows.following(row, word)
    pairs, i, j = [], len(script), len(heard)
    left = rows.length(row, j)
    block: list[int] = []
    start = len(script)
    while i and left:
        if i - 1 < start:
            # Rows start to i - 1 of the table, each before its word of the script.
            start = (i - 1) // step * step
            block = [saved[start // step]]
            for word in script[start : i - 1]:
                block.append(rows.following(block[-1], word))
        word, above = script[i - 1], block[i - 1 - start]
        if heard[j - 1] != word:
            if rows.length(above, j) == left:
                i -= 1
                continue
            # The script word adds to the length, so it is heard at or before this place: words behind its last hearing go.
            j = rows.places[word][bisect_right(rows.places[word], j - 1) - 1] + 1
        pairs.append((i - 1, j - 1))
        i, j, left = i - 1, j - 1, left - 1
    return pairs[::-1]
