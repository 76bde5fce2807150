"""Suffix arrays by induced sorting, in numpy: each step handles a whole run of suffixes at once."""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(True where the suffix is smaller than the next one, leftmost positions of such runs).

    The end of the string counts as smaller than every byte, so the last suffix is larger than the next.
    """
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int16) - s[:-1])
    step[-1] = -1
    # a run of equal bytes is as the byte behind it
    at = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, lms


def _deal(pred: np.ndarray, first: np.ndarray, waiting: list[list[np.ndarray]]) -> None:
    """Append each suffix of ``pred`` to the bucket of its first byte, in order."""
    order = np.argsort(first, kind="stable")
    pred, first = pred[order], first[order]
    edges = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]).tolist() + [len(first)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        waiting[first[a]].append(pred[a:b])


def induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes, sorted as far as the order of the ``leftmost`` ones (sorted by first byte at least) tells.

    Left to right, each larger-type suffix is put behind the suffix that follows it; right to left, each
    smaller-type one.  A bucket is a first byte; within it suffixes that start with a run of that byte come
    in waves.  Every suffix is looked at once in each direction.
    """
    if not len(s):
        return np.zeros(0, np.int64)
    starts = np.searchsorted(s[leftmost], np.arange(257))
    empty = np.zeros(0, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[s[-1]].append(np.array([len(s) - 1]))
    larger: list[np.ndarray] = [empty] * 256
    for c in range(256):
        done = []
        wave = np.concatenate(waiting[c]) if waiting[c] else empty
        while len(wave):
            done.append(wave)
            pred = wave[wave > 0] - 1
            wave = pred[s[pred] == c]
        larger[c] = np.concatenate(done) if done else empty
        both = np.concatenate([larger[c], leftmost[starts[c] : starts[c + 1]]])
        pred = both[both > 0] - 1
        first = s[pred]
        if (up := first > c).any():
            _deal(pred[up], first[up], waiting)
    waiting = [[] for _ in range(256)]
    out: list[np.ndarray] = [empty] * 256
    for c in range(255, -1, -1):
        done = []
        wave = np.concatenate(waiting[c]) if waiting[c] else empty
        while len(wave):
            done.append(wave)
            pred = wave[wave > 0] - 1
            wave = pred[s[pred] == c]
        small = np.concatenate(done) if done else empty
        out[c] = np.concatenate([larger[c], small[::-1]])
        both = np.concatenate([small, larger[c][::-1]])
        pred = both[both > 0] - 1
        first = s[pred]
        if (down := first < c).any():
            _deal(pred[down], first[down], waiting)
    return np.concatenate(out)


def _names(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Number of each leftmost-smaller substring (to the next such position, inclusive), equal for equal ones."""
    ends = np.r_[lms[1:] + 1, len(s)]
    size = (ends - lms)[order]
    a, b = lms[order[:-1]], lms[order[1:]]
    same = (size[1:] == size[:-1]) & (s[a] == s[b])
    at = np.flatnonzero(same)
    k = 1
    while len(at):  # the substrings are a few bytes long
        at = at[size[at] > k]
        differ = s[a[at] + k] != s[b[at] + k]
        same[at[differ]] = False
        at = at[~differ]
        k += 1
    # the last substring ends with the end of the string, which no other one has
    same &= (order[:-1] != len(lms) - 1) & (order[1:] != len(lms) - 1)
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(np.r_[0, ~same])
    return names


def _by_pairs(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of ``names`` by doubling: pairs of names get names until all differ or ``depth`` is reached."""
    spanned = 1
    while names.max() < len(names) - 1 and spanned < len(names) and (depth is None or spanned < depth):
        following = np.zeros(len(names), np.int64)
        following[:-spanned] = names[spanned:] + 1
        names = np.unique(names * (len(names) + 1) + following, return_inverse=True)[1]
        spanned *= 2
    return np.argsort(names, kind="stable")


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of the bytes ``s``; with ``depth``, suffixes equal so far may stand in any order.

    Leftmost-smaller substrings are sorted by inducing from their first bytes, then named in order.  Unless
    the names tell all of them apart, the string of names is sorted in the same way, one level down: each name
    is written with as many bytes as the largest one needs, highest first, so that this is a string of bytes
    again, in which the suffixes that start at a name stand in the order of the names' suffixes.  From the sorted
    leftmost suffixes all others are induced.  Such positions stand at every third byte or so: with up to 65536
    names a level has two thirds of the bytes above it, and all levels together are linear.  Only a
    string of names that isn't shorter by a fifth (more names, or a zigzag of bytes) is sorted by pairs.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    smaller, lms = classify(s)
    if len(lms) > 1:
        rough = induce(s, smaller, lms[np.argsort(s[lms], kind="stable")])
        place = np.full(n, -1, np.int64)
        place[lms] = np.arange(len(lms))
        order = place[rough]
        order = order[order >= 0]
        names = _names(s, lms, order)
        most = int(names.max())
        if most < len(lms) - 1:
            width = max(1, (most.bit_length() + 7) // 8)
            if width * len(lms) > n * 4 // 5:
                order = _by_pairs(names, None if depth is None else depth // 2 + 1)  # a name goes on by two bytes at least
            else:
                digits = names.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].ravel()
                below = suffix_array(digits, None if depth is None else width * (depth // 2 + 1))
                order = below[below % width == 0] // width
        lms = lms[order]
    return induce(s, smaller, lms)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each position, bytes shared with the suffix before it in ``sa`` (at most ``most``).

    Compared in text order, eight bytes at a time for all positions that still agree.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.r_[s, np.zeros(most + 8, np.uint8)]
    words = np.ndarray((n + most,), "<u8", padded, strides=(1,))
    shared = np.zeros(n, np.int64)
    at = np.flatnonzero(before >= 0)
    k = 0
    while len(at) and k < most:
        differ = words[at + k] ^ words[before[at] + k]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
        shared[at] += same.astype(np.int64)
        at = at[same == 8]
        k += 8
    limit = n - np.maximum(np.arange(n), before)
    return np.minimum(np.minimum(shared, most), limit)
