"""Pairs of texts with a difflib ratio above a threshold, told from many pairs at once with numpy.

The ratio counts the characters of common blocks in order, so it is at most that of a longest common subsequence, which is at most that of the
characters both texts have. Only pairs that pass both bounds are given to difflib; no pair above the threshold is lost."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np

# Numbers held at once: counts of characters, words of bit sets.
_COUNTS, _WORDS = 8_000_000, 65_536
_CLASSES = 255


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and how many each text has."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.array([len(t) for t in texts], dtype=np.int64)


def _counts(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many characters of each of 64 classes a text has."""
    row = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    return np.bincount(row * 64 + (codes & 63), minlength=64 * len(sizes)).reshape(-1, 64).astype(np.int32 if sizes.max(initial=0) > 65_000 else np.uint16)


def _blocks(rows: np.ndarray, each: int) -> Iterator[np.ndarray]:
    for at in range(0, len(rows), max(1, each)):
        yield rows[at : at + max(1, each)]


def _common(a: np.ndarray, a_sizes: np.ndarray, bits: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences, a row of classes `a` with the text `b` of `bits` (words, text, class), longest rows first: a bit set of places of each text, a step a character."""
    words, _, classes = bits.shape
    flat, base = bits.reshape(words, -1), b * classes
    v = np.full((words, len(b)), ~np.uint64(0))
    active = np.searchsorted(-a_sizes, -np.arange(a.shape[1]), side="left")
    for t, n in enumerate(active):
        if n == 0:
            break
        at, carry = base[:n] + a[:n, t], None
        for w in range(words):
            p, old = flat[w].take(at), v[w, :n]
            u = old & p
            s = old + u
            over = s < u
            if carry is not None:
                s += carry
                over |= s < carry
            carry = over.astype(np.uint64)
            v[w, :n] = s | (old & ~p)
    return 64 * words - np.bitwise_count(v).sum(axis=0, dtype=np.int64)


def _bits(codes: np.ndarray, sizes: np.ndarray, classes: int) -> np.ndarray:
    """(word, text, class): at which places a text has a character of the class."""
    out = np.zeros((-(-int(sizes.max()) // 64), len(sizes), classes), dtype=np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    np.bitwise_or.at(out, (place // 64, row, codes), np.left_shift(np.uint64(1), (place % 64).astype(np.uint64)))
    return out


def above(left: list[str], right: list[str], threshold: float) -> list[tuple[int, int, float]]:
    """(i, j, ratio) of all pairs left[i], right[j] of which SequenceMatcher(None, left[i], right[j]).ratio() is at least the threshold."""
    out: list[tuple[int, int, float]] = []
    if not left or not right:
        return out
    b_codes, b_sizes = _codes(right)
    alphabet = np.unique(b_codes)
    # Class 0: characters that no right text has. Many characters share classes, which only raises the bound.
    classes = min(len(alphabet), _CLASSES) + 1

    def classed(codes: np.ndarray) -> np.ndarray:
        if not len(alphabet):
            return np.zeros(len(codes), dtype=np.uint8)
        at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
        return np.where(alphabet[at] == codes, at % _CLASSES + 1, 0).astype(np.uint8)

    b_starts, b_classes, b_counts = np.cumsum(b_sizes) - b_sizes, classed(b_codes), _counts(b_codes, b_sizes).T
    by_size, shortest = np.argsort(b_sizes, kind="stable"), threshold / (2 - threshold)
    b_by_size = b_sizes[by_size]
    order = np.argsort([len(t) for t in left], kind="stable")
    for part in _blocks(order, min(_COUNTS // len(right), 100_000)):
        a_codes, a_sizes = _codes([left[i] for i in part])
        near, counts = [], _counts(a_codes, a_sizes).T
        # Both sides lie by length: some texts at once meet the stretch of right texts that is of like length.
        for i in _blocks(np.arange(len(part)), 256):
            lo, hi = np.searchsorted(b_by_size, [a_sizes[i[0]] * shortest - 1, a_sizes[i[-1]] / shortest + 1])
            j = by_size[lo:hi]
            both = np.zeros((len(i), len(j)), dtype=np.int64 if a_sizes[i[-1]] > 65_000 else np.uint16)
            for k in np.flatnonzero(b_counts[:, j].any(axis=1)):
                both += np.minimum(counts[k, i][:, None], b_counts[k, j][None, :]).astype(both.dtype, copy=False)
            x, y = np.nonzero(2.0 * both + 1e-6 >= threshold * (a_sizes[i][:, None] + b_sizes[j][None, :]))
            near.append(np.column_stack([i[x], j[y]]))
        pairs = np.concatenate(near)
        if not len(pairs):
            continue
        a_starts, a_classes = np.cumsum(a_sizes) - a_sizes, classed(a_codes)
        # Right texts by length, as many at once as have small bit sets.
        for b in _blocks(np.unique(pairs[:, 1])[np.argsort(b_sizes[np.unique(pairs[:, 1])], kind="stable")], 4_000_000 // (classes * max(1, -(-int(b_sizes.max()) // 64)))):
            slot = np.full(len(right), -1)
            slot[b] = np.arange(len(b))
            own = pairs[slot[pairs[:, 1]] >= 0]
            own = own[np.argsort(-a_sizes[own[:, 0]], kind="stable")]
            if b_sizes[b].max() == 0:
                good = own
            else:
                bits = _bits(np.concatenate([b_classes[b_starts[j] : b_starts[j] + b_sizes[j]] for j in b]), b_sizes[b], classes)
                good = []
                for some in _blocks(own, _WORDS // len(bits)):
                    n = a_sizes[some[:, 0]]
                    places = np.arange(int(n[0]))
                    inside = places[None, :] < n[:, None]
                    rows = np.where(inside, a_classes[np.where(inside, a_starts[some[:, 0]][:, None] + places, 0)] if len(a_classes) else 0, 0)
                    shared = _common(rows, n, bits, slot[some[:, 1]])
                    good.append(some[2 * shared + 1e-6 >= threshold * (n + b_sizes[some[:, 1]])])
                good = np.concatenate(good) if good else own
            for i, j in good:
                ratio = difflib.SequenceMatcher(None, left[part[i]], right[j]).ratio()
                if ratio >= threshold:
                    out.append((int(part[i]), int(j), ratio))
    return out
