"""Suffix sorting by difference cover, in numpy, for the text of one task."""

from __future__ import annotations

import numpy as np


def _pack(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Triples of names below 2**21 as numbers in their order."""
    return (s[at] << np.uint64(42)) | (s[at + 1] << np.uint64(21)) | s[at + 2]


def suffix_array(text: np.ndarray, enough: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` (names from 0 to 2**21 - 4) in the order of their first ``enough`` names at least.

    The suffixes at positions that are not multiples of three are sorted first: by their triples, whose ranks are names of a
    string two thirds as long, and by recursion on that string unless the names differ already or cover ``enough``. The
    others follow from them by one name and a rank, and both orders are merged.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.zeros(n + 4, np.uint64)
    s[:n] = text + np.uint64(1)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    packed = _pack(s, sample)
    order = np.argsort(packed)
    name = np.empty(len(sample), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(packed[order][1:] != packed[order][:-1])])
    if enough > 3 and name[order[-1]] + 1 < len(sample):
        inner = suffix_array(name.astype(np.uint64), -(-enough // 3))
        name[inner] = np.arange(len(inner))
        order = inner
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = name + 1
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort((s[zero] << np.uint64(32)) | rank[zero + 1].astype(np.uint64))]
    # where each of the others goes among the sample: those at 1 and at 2 modulo 3 are each in the order of a key of their own
    key_one = lambda i: (s[i] << np.uint64(32)) | rank[i + 1].astype(np.uint64)
    key_two = lambda i: (s[i] << np.uint64(43)) | (s[i + 1] << np.uint64(22)) | rank[i + 2].astype(np.uint64)
    ones, twos = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    low = np.searchsorted(key_one(ones), key_one(zero)) + np.searchsorted(key_two(twos), key_two(zero))
    out = np.empty(n, np.int64)
    # suffixes equal in what was compared may come in any order, so the searches may cross
    where = np.maximum.accumulate(low) + np.arange(len(zero)) if len(zero) else low
    rest = np.ones(n, bool)
    rest[where] = False
    out[where], out[rest] = zero, sorted_sample
    return out


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in suffix order, and the class of each: those with equal prefixes of ``length`` bytes share a number.

    Every start has ``length`` bytes of text after it. Neighbours in the suffix order are compared byte by byte.
    """
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text.astype(np.uint64), length)
    order = order[wanted[order]]
    same = np.ones(len(order) - 1, bool)
    for k in range(length):  # most neighbours differ early, so few are left soon
        at = np.flatnonzero(same) if k else np.arange(len(same))
        if not len(at):
            break
        same[at] = text[order[at] + k] == text[order[at + 1] + k]
    return order, np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
