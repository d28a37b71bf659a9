"""Simple-8b: runs of small integers in 64-bit words.

The upper 4 bits of a word select how many ids share its lower 60 bits.  Selector 0 is the escape: the
next word holds one id of more than 60 bits as it is.  Ids come in blocks of ``BLOCK``; a word never
crosses a block, and the end of each block in words is kept, so any block can be read by itself and
many at once without a loop over words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
#: Ids in a word by selector; bits of each.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)


#: Bits of each number below 65,536.
_SMALL = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if not len(ids) or ids.max() < 1 << 16:
        return _SMALL[ids.astype(np.uint16)]
    out = np.zeros(len(ids), np.uint8)
    for part in range(4):
        digits = _SMALL[((ids >> np.uint64(16 * part)) & np.uint64(0xFFFF)).astype(np.uint16)]
        out = np.where(digits > 0, digits + np.uint8(16 * part), out)
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, end of each block in words, and the places of the raw words after escapes."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = np.arange(n)
    end = np.minimum((here // BLOCK + 1) * BLOCK, n)
    # the selector with the most ids that fits from each place on; a block's end counts as fitting
    need = _widths(ids)
    blocks = -(-n // BLOCK)
    wide = np.zeros((blocks, BLOCK + int(COUNTS.max())), np.uint8)
    wide[:, :BLOCK] = np.pad(need, (0, blocks * BLOCK - n)).reshape(blocks, BLOCK)
    selector = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        fits = wide <= BITS[s]
        count, span = int(COUNTS[s]), 1
        while span < count:  # fits[i] says that the next ``span`` ids fit
            more = min(span, count - span)
            fits = fits[:, :-more] & fits[:, more:]
            span += more
        fits = fits[:, :BLOCK]
        if not fits.any():
            break  # the next selectors need more ids that are smaller still
        selector[fits] = s
    selector = selector.ravel()
    # follow the words of all blocks side by side
    place = np.arange(0, n, BLOCK)
    stop = np.minimum(place + BLOCK, n)
    order, starts = np.arange(len(place)), []
    while len(place):
        starts.append(place)
        place = place + COUNTS[selector[place]]
        more = place < stop
        place, stop = place[more], stop[more]
    starts = np.sort(np.concatenate(starts))
    chosen = selector[starts]
    width = 1 + (chosen == 0)
    at = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for s in np.unique(chosen):
        pick = chosen == s
        first, where = starts[pick], at[pick]
        if s == 0:
            words[where + 1] = ids[first]
            continue
        last = end[first]
        value = np.full(len(first), np.uint64(s) << np.uint64(60))
        for k in range(int(COUNTS[s])):
            i = first + k
            inside = i < last
            value |= np.where(inside, ids[np.minimum(i, n - 1)], np.uint64(0)) << np.uint64(k * BITS[s])
        words[where] = value
    ends = np.append(at[np.searchsorted(starts, np.arange(BLOCK, n, BLOCK))], len(words))
    return words, ends, at[chosen == 0] + 1


def decode(words: np.ndarray, ends: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """All ``n`` ids of ``encode``'s words."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    plain = np.ones(len(words), bool)
    plain[raw] = False
    at = np.flatnonzero(plain)
    selector = (words[at] >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    first = np.searchsorted(at, np.concatenate(([0], ends[:-1])))  # first word of each block
    before = np.concatenate(([0], np.cumsum(counts)))
    block = np.repeat(np.arange(len(ends)), np.diff(np.append(first, len(at))))
    start = before[:-1] - before[first][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selector):
        pick = selector == s
        place, last = start[pick], stop[pick]
        if s == 0:
            out[place] = words[at[pick] + 1]
            continue
        value, mask = words[at[pick]], (np.uint64(1) << np.uint64(BITS[s])) - np.uint64(1)
        for k in range(int(COUNTS[s])):
            inside = place + k < last
            out[(place + k)[inside]] = (value[inside] >> np.uint64(k * BITS[s])) & mask
    return out


def decode_block(words: np.ndarray, ends: np.ndarray, raw: np.ndarray, n: int, block: int) -> np.ndarray:
    """The ids of one block, reading its words only."""
    a, b = (int(ends[block - 1]) if block else 0), int(ends[block])
    inside = raw[(raw >= a) & (raw < b)] - a
    return decode(words[a:b], np.array([b - a]), inside, min(BLOCK, n - block * BLOCK))
