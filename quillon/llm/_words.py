"""Words and word windows of Arrow string columns, hashed with whole-array operations.

A word is a maximal run of bytes other than 20 and 09 to 0D. These are ASCII, so working on
UTF-8 bytes gives the same words as working on code points. Nothing here loops over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of the polynomial hashes: over bytes, and two independent ones over words.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9
#: Text that is hashed at once; temporaries take some 60 bytes for each byte of it.
BLOCK = 2_000_000
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, BLOCK // 4), base, _U)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if len(have) <= 2 * BLOCK:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK):
    """Row ranges of at most limit bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more entry at the end)."""
    space = _IS_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = BYTE_BASE) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its 8-byte pieces, each mixed with its place, mixed with the length. Seeds give unlike hashes."""
    if not len(starts):
        return np.zeros(0, _U)
    size = ends - starts
    pieces = (size + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    at = np.repeat(starts, pieces) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    piece = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))[at]
    over = np.maximum(8 - (np.repeat(ends, pieces) - at), 0).astype(_U) * _U(8)
    piece = mix(((piece << over) >> over) ^ ((place.astype(_U) + _U(1)) * _U(seed)))
    return mix(np.add.reduceat(piece, first) + size.astype(_U) * _U(seed) + _U(seed >> 7))


def hash_windows(w: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp: the hash of every k consecutive words, from one running polynomial over the words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.empty(len(w) + 1, _U)
    total[0] = 0
    np.cumsum(w * powers(base, len(w)), out=total[1:])
    return mix((total[k:] - total[:n]) * powers(inverse(base), n))


def windows_in_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of all words in a row, those within one document: their first word and their document's row."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row]
    return at, row
