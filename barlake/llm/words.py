"""Words, word hashes and word windows of Arrow text columns, computed on whole byte buffers with numpy.

A *slice* is a run of consecutive rows of one Arrow batch of about
``SLICE_BYTES`` of text (a longer text is a slice of its own, whole).  A byte
table maps every byte to its normalised form, or to 0 where it separates
words.  Word hashes are 64-bit polynomial hashes from one running sum over the
slice, so no Python loop touches single words.  Hashes only select; whatever
must be exact is compared on the words themselves by the callers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import SPACE_BYTES

SLICE_BYTES = 1 << 20

#: Odd 64-bit multipliers (any odd numbers serve).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_MASK = (1 << 64) - 1


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """Byte -> normalised byte; separators (and the zero byte, if it is one) -> 0."""
    table = np.arange(256, dtype=np.uint16)
    if lower:
        table[ord("A"):ord("Z") + 1] += 32
    table[table == 0] = 256                       # a zero byte that belongs to a word is no separator
    table[list(separators)] = 0
    return table


#: Words between white space, unchanged and with A-Z lower-cased.
SPACED = byte_table(SPACE_BYTES, lower=False)
SPACED_LOWER = byte_table(SPACE_BYTES, lower=True)
#: Runs of a-z (A-Z lower-cased), 0-9 and non-ASCII bytes.
ALNUM_LOWER = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


class Slice(NamedTuple):
    row: int              # first row in the batch
    data: np.ndarray      # uint8, the texts one after the other
    offsets: np.ndarray   # int64, n + 1


class Words(NamedTuple):
    start: np.ndarray     # byte of each word's begin in the slice
    end: np.ndarray
    first: np.ndarray     # per text, its first word; n + 1
    hashes: tuple[np.ndarray, ...]   # one array of 64-bit hashes per base

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(column: pa.Array, target: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow string column (null counts as empty) in slices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + target, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield Slice(row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept up to a slice's usual length."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: nearby inputs get unrelated outputs."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(s: Slice, table: np.ndarray, bases: int = 1) -> Words:
    """Every word of every text of the slice."""
    n = len(s.data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(s.offsets), np.int64), tuple(np.zeros(0, np.uint64) for _ in range(bases)))
    values = table[s.data]
    inside = values != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = s.offsets[:-1][s.offsets[:-1] < n]       # a word never runs on into the next text
    begins[at] = inside[at]
    at = s.offsets[1:][s.offsets[1:] > 0] - 1
    ends[at] = inside[at]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = []
    for base in BASES[:bases]:
        up, down = _powers(base, n)
        terms = values * up[:n]
        total = np.cumsum(terms, dtype=np.uint64)
        hashes.append(mixed((total[end - 1] - total[start] + terms[start]) * down[start]))
    return Words(start, end, np.searchsorted(start, s.offsets), tuple(hashes))


def windows(h: np.ndarray, k: int, base: int = WINDOW_BASES[0]) -> np.ndarray:
    """Hash of each run of k word hashes (across text borders too: see ``fits``); empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= np.uint64(base)
        acc += h[j:j + n]
    return mixed(acc)


def fits(first: np.ndarray, k: int) -> np.ndarray:
    """True where a run of k words that begins at this word stays in its text; one entry per window of ``windows``."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= ends
