"""A run-length index of a text: its Burrows-Wheeler transform in runs, with the
suffix positions at run heads and at the run ends before them.

For a position p, phi(p) is the position one row above p's in suffix order, and the
match of p is the common prefix of the two. Both follow from the samples alone: if p
isn't sampled, its row and the one above continue one run, so phi(p) = phi(p - 1) + 1
and the match is one shorter. So the matching statistics of all positions stream
from as many numbers as there are runs, which in a repetitive text are few.
"""

from __future__ import annotations

import numpy as np


PACKED = 7


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order; ``left`` counts the symbols before the end
    of a position's part, which is a 0 there. Suffixes end with their part; equal
    ones go by position. Seven symbols are compared at once, then twice as many each
    time, and only positions that aren't alone yet are sorted again."""
    n = len(symbols)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate([symbols, np.zeros(PACKED, np.int64)])
    for k in range(PACKED):
        ahead = padded[k:k + n]
        key = key << 9 | np.where(alive, ahead, 0)
        alive &= ahead != 0
    rank, group, width = np.zeros(n, np.int64), np.arange(n), PACKED
    longest = int(left.max(initial=0))
    while True:
        # place of each group's first row; a position's rank is its group's place
        by_key = np.argsort(key)
        group, key = group[by_key], key[by_key]
        old = rank[group]
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        slot = old + np.arange(len(old)) - np.maximum.accumulate(np.where(new_old, np.arange(len(old)), 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        rank[group] = slot[first]
        alone = new & np.concatenate([new[1:], [True]])
        group = group[~alone]
        if not len(group):
            break
        if width > longest:
            key = rank[group] * (n + 1) + group
            longest, width = n, n       # equal to their ends: by position, and done
        else:
            after = np.where(left[group] >= width, rank[np.minimum(group + width, n - 1)] + 1, 0)
            key = rank[group] * (n + 1) + after
            width *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class RunIndex:
    def __init__(self, parts: list[bytes]):
        """``parts`` are joined, each closed by a symbol of its own."""
        text = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8).astype(np.int64) + 1
        self.starts = np.cumsum([0] + [len(p) + 1 for p in parts])
        ends = self.starts[1:] - 1
        text[ends] = 0
        self.size = len(text)
        order = suffix_order(text, np.repeat(ends, np.diff(self.starts)) - np.arange(self.size))
        text[ends] = -np.arange(len(parts)) - 1                # ends differ from each other
        last = text[order - 1]                                 # the transform
        heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.n_runs = len(heads)
        # samples by position: a run's head, the end of the run above it, their match
        head, above = order[heads[1:]], order[heads[1:] - 1]
        by_place = np.argsort(head)
        self.head, self.above = head[by_place], above[by_place]
        self.match = self._common(text, self.head, self.above)
        self.top = int(order[0])                               # has no row above

    @staticmethod
    def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found, alive, depth = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(alive):
            x, y = a[alive] + depth, b[alive] + depth
            ok = (x < len(text)) & (y < len(text))
            ok[ok] = text[x[ok]] == text[y[ok]]
            alive = alive[ok]
            depth += 1
            found[alive] = depth
        return found

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(phi, match) of every position; the first row's has no match."""
        places = np.arange(self.size)
        k = np.searchsorted(self.head, places, "right") - 1
        known = k >= 0
        phi, match = places.copy(), np.zeros(self.size, np.int64)
        since = places[known] - self.head[k[known]]
        phi[known] = self.above[k[known]] + since
        match[known] = np.maximum(self.match[k[known]] - since, 0)
        match[self.top] = 0
        return phi, match

    def later_matches(self, length: int) -> np.ndarray:
        """Whether the ``length`` symbols at each position also start at an earlier one."""
        phi, match = self.matching_statistics()
        # rows that share ``length`` symbols are neighbours: follow phi to their top
        up = np.where(match >= length, phi, np.arange(self.size))
        while True:
            further = up[up]
            if np.array_equal(further, up):
                break
            up = further
        first = np.full(self.size, self.size)
        np.minimum.at(first, up, np.arange(self.size))
        return first[up] < np.arange(self.size)
