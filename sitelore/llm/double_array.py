"""Double-array tries over numbered symbols: built once, walked by numpy for all positions of a text at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sitelore.llm.common import ragged

#: Bases tried at once when the children of a node look for room.
TRIED = 8192
#: Children up to which the nodes of a level try random bases together, in groups by these numbers, and rounds of that.
FEW, ROUNDS = (32, 16, 8, 4, 2, 1, 0), 200


@dataclass
class DoubleArray:
    """``base[state] + symbol`` is the next state where ``check`` of that place is ``state``; the root is 0.

    ``accepts`` is the number of the phrase that ends in a state, -1 elsewhere.
    """

    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states, -1 where a state has no such child; symbols below 0 are in no phrase."""
        to = self.base[states] + symbols
        there = (symbols >= 0) & (to < len(self.check))
        to = np.where(there, to, 0)
        return np.where(there & (self.check[to] == states), to, -1)


def build(phrases: list[tuple[int, ...]]) -> DoubleArray:
    """The trie of some phrases, each a tuple of symbols from 0 on."""
    lengths = np.array([len(p) for p in phrases], np.int64)
    return build_flat(np.array([s for p in phrases for s in p], np.int64), lengths)


def build_flat(symbols: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """The trie of some phrases, given as all their symbols from 0 on, one phrase after another; its size is a few places a phrase.

    The nodes of a level with most children are placed first, each at the first base where all its
    children find room, in a part of the table of their own.  Those with few children try random bases in a part
    that is at most half full, all at once: of those that find room, the ones that got all of their places stay.
    """
    starts, wide = np.cumsum(lengths) - lengths, int(symbols.max(initial=-1)) + 1
    node = np.zeros(len(lengths), np.int64)
    levels = []  # parents as numbers of the level above, symbols: the nodes of a level in order of both
    node_of = []
    for depth in range(int(lengths.max(initial=0))):
        own = np.flatnonzero(lengths > depth)
        keys, at = np.unique(node[own] * wide + symbols[starts[own] + depth], return_inverse=True)
        node[own] = at
        levels.append(np.divmod(keys, max(1, wide)))
        node_of.append((own, at))
    total = sum(len(p) for p, _ in levels)
    counts = [np.bincount(p) for p, _ in levels]
    dense = wide + 2 * sum(int(n[n > FEW[0]].sum()) for n in counts)
    size = dense + 2 * total + wide + 64
    base, check = np.zeros(size, np.int32), np.full(size, -2, np.int32)
    check[0] = -1
    ends = []
    rng = np.random.default_rng(1)

    def search(own: np.ndarray, low: int) -> int:
        """The first base from ``low`` on with room for some children, -1 if there is none."""
        for first in range(low, size - wide, TRIED):
            tried = np.arange(first, min(first + TRIED, size - wide))
            # bases are thinned out by the first children before all are looked at, some bases at a time
            for some in (own[:1], own[1:4], own[4:16], own[16:64]):
                tried = tried[(check[tried[:, None] + some[None, :]] == -2).all(axis=1)]
            step = max(1, (1 << 18) // len(own))
            for i in range(0, len(tried), step):
                free = (check[tried[i : i + step, None] + own[None, :]] == -2).all(axis=1)
                if free.any():
                    return int(tried[i + np.argmax(free)])
        return -1

    states, low = np.zeros(1, np.int64), 0
    for depth, (parent, symbol) in enumerate(levels):
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        many = np.diff(np.append(first, len(parent)))
        owners = states[parent[first]]
        left = np.argsort(-many, kind="stable")
        alone = int((many > FEW[0]).sum())
        queue = left[:alone].tolist()
        for least in FEW[1:]:
            some = left[alone:][many[left[alone:]] > least]
            alone += len(some)
            for _ in range(ROUNDS):
                if not len(some):
                    break
                bases = rng.integers(dense, size - wide, len(some))
                n = many[some]
                at = np.repeat(bases, n) + symbol[ragged(first[some], n)]
                edges = np.cumsum(n) - n
                room = np.logical_and.reduceat(check[at] == -2, edges)
                who = np.repeat(np.arange(len(some)), n)
                own = np.repeat(room, n)
                at, who = at[own], who[own]
                check[at] = -3 - who  # of several nodes that want a place, one is written last
                lost = np.unique(who[check[at] != -3 - who])
                room[lost] = False
                won = room[who]
                check[at[~won]] = -2
                check[at[won]] = owners[some][who[won]]
                base[owners[some[room]]] = bases[room]
                some = some[~room]
            queue += some.tolist()
        for k in queue:
            own = symbol[first[k] : first[k] + many[k]]
            while (found := search(own, low)) < 0:
                more = wide + size // 4
                base = np.concatenate((base, np.zeros(more, np.int32)))
                check = np.concatenate((check, np.full(more, -2, np.int32)))
                size += more
            base[owners[k]] = found
            check[found + own] = owners[k]
            low = max(low, found - 4 * TRIED)  # what lies before is nearly full
        states = base[states[parent]] + symbol
        own, at = node_of[depth]
        last = lengths[own] == depth + 1
        ends.append((states[at[last]], own[last]))
    size = int(np.flatnonzero(check != -2)[-1]) + 1
    accepts = np.full(size, -1, np.int32)
    for at, number in ends:
        accepts[at] = number
    return DoubleArray(base[:size].copy(), check[:size].copy(), accepts)


def count_phrases(trie: DoubleArray, symbols: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """How often each state is met, over all positions; ``left`` says how many words a piece has from there.

    All positions start at the root and take one symbol a level; those without a next state drop out.
    """
    ends = []
    at, states = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
    for depth in range(longest):
        alive = left[at] > depth
        at, states = at[alive], states[alive]
        states = trie.step(states, symbols[at + depth])
        alive = states >= 0
        at, states = at[alive], states[alive]
        if not len(at):
            break
        ends.append(states[trie.accepts[states] >= 0])
    return np.bincount(np.concatenate(ends) if ends else np.zeros(0, np.int64), minlength=len(trie.check))
