"""Vectorised word kernels over the UTF-8 bytes of Arrow text columns.

Everything here works on numpy views of a text column's own buffers: no Python string is made for a row.  Hashes are
polynomials over 64-bit wrapped integers, taken as differences of prefix sums, so one pass prices every word and every
window of words of a block of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MASK = (1 << 64) - 1
BYTE_BASE, WORD_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BLOCK_BYTES = 1 << 20

#: Bytes that belong to a word: all but the six ASCII spaces.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, lower-case letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(BYTE_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n, modulo 2**64 (base is odd, so it has an inverse)."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if size <= 8 * BLOCK_BYTES:
            _powers[base] = have
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading zero."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The hash of each values[start:end], the same wherever it stands."""
    return (sums[ends] - sums[starts]) * powers(base, len(sums))[1][starts]


def text_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its row offsets; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes each; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


class Block:
    """The words of a run of rows.  starts, ends: byte offsets; first: index of each row's first word, with an end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kept: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = kept[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        sums = prefix(BYTE_VALUES[self.data], BYTE_BASE)
        lengths = (self.ends - self.starts).astype(U)
        return mix(between(sums, self.starts, self.ends, BYTE_BASE) + lengths)

    def rows(self) -> np.ndarray:
        """The row, within the block, of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def room(self) -> np.ndarray:
        """How many words of its row start at each word, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))


def text_blocks(column: pa.Array, kept: np.ndarray, lower: bool = False) -> Iterator[tuple[int, Block]]:
    """Blocks of a text column with the index of their first row."""
    data, offsets = text_rows(column)
    for at, to in row_blocks(offsets):
        yield at, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], kept, lower)


def window_starts(block: Block, width: int) -> np.ndarray:
    """Words at which a window of so many words of one row starts."""
    return np.flatnonzero(block.room() >= width)
