"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

from sitelore.llm.common import keys64, mix

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEED = 1009


def _word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the number of the first word of each text (and the end)."""
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~WHITE[body]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    start[heads] = inside[heads]
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    length = np.add.reduceat(inside, starts, dtype=np.int64)
    place = np.flatnonzero(inside)
    within = np.arange(len(place)) - np.repeat(np.cumsum(length) - length, length)
    table = keys64(int(length.max()), _SEED)
    value = (LOWER[body[place]].astype(np.uint64) + np.uint64(1)) * table[within]
    words = np.add.reduceat(value, np.cumsum(length) - length)
    return mix(words + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first


def shingle_sets(body: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the offsets of the texts.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case.  A text with fewer
    than ``words`` words has all of them as its one shingle, a text without words has none.
    """
    texts = len(offsets) - 1
    w, first = _word_hashes(body, offsets)
    count = np.diff(first)
    weight = keys64(words, _SEED + 1)
    total = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for k in range(words):
        total += w[k : k + len(total)] * weight[k]
    total = mix(total + np.uint64(words))
    per = np.maximum(0, count - words + 1)
    ends = np.cumsum(per)
    index = np.arange(int(ends[-1]) if texts else 0) + np.repeat(first[:-1] - (ends - per), per)
    full = total[index]
    short = np.flatnonzero((count > 0) & (count < words))
    sets, sizes, at = [], np.zeros(texts, np.int64), 0
    whole = {}
    for t in short.tolist():
        a, m = int(first[t]), int(count[t])
        whole[t] = mix((w[a : a + m] * weight[:m]).sum(dtype=np.uint64, keepdims=True) + np.uint64(m))
    for t, m in enumerate(per.tolist()):
        if m:
            part = full[at : at + m]
            part.sort()
            at += m
            if m > 1:
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        elif t in whole:
            part = whole[t]
        else:
            continue
        sets.append(part)
        sizes[t] = len(part)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))
