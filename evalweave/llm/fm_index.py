"""FM-index over segments of symbols: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many suffix positions one is kept.
SAMPLING = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of symbols in which each 0 ends a segment and is unlike all others, later ones being larger. Prefix doubling, going on
    only with suffixes that are still tied."""
    ends = s == 0
    rank = np.where(ends, np.cumsum(ends) - 1, s + int(ends.sum())).astype(np.int64)
    n, step = len(s), 1
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank[order], order)
    open_ = np.flatnonzero(_tied(rank, order))
    while len(open_):
        # places in the order that are tied: sort them by (rank, rank of what follows)
        at = order[open_]
        follows = rank[np.minimum(at + step, n - 1)]  # a tie can't reach past the last end
        key = rank[at] * (n + 1) + follows
        by = np.argsort(key, kind="stable")
        order[open_] = at[by]
        k = key[by]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        # a group's rank is the place of its first
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        step *= 2
        open_ = open_[_tied(rank, order)[open_]]
    return order


def _ranks(sorted_keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


def _tied(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    r = rank[order]
    same = r[1:] == r[:-1]
    return np.concatenate((same, [False])) | np.concatenate(([False], same))


class FMIndex:
    """Over s, symbols above 0 with a 0 behind each segment."""

    def __init__(self, s: np.ndarray):
        sa = suffix_array(s)
        self.last = s[sa - 1]  # of the first suffix: the last end
        self.starts = np.zeros(int(s.max()) + 2, np.int64)
        np.cumsum(np.bincount(s, minlength=len(self.starts) - 1), out=self.starts[1:])
        # suffixes at the start of a segment are kept too, so no walk crosses an end
        kept = (sa % SAMPLING == 0) | (self.last == 0)
        self.kept, self.kept_before, self.positions = kept, np.concatenate(([0], np.cumsum(kept))), sa[kept]
        self.levels = []
        now = self.last
        for bit in range(max(1, int(s.max()).bit_length()) - 1, -1, -1):
            ones = (now >> bit & 1).astype(bool)
            zeros = np.concatenate(([0], np.cumsum(~ones)))
            self.levels.append((bit, zeros, int(zeros[-1])))
            now = np.concatenate((now[~ones], now[ones]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before place i of the transform."""
        low = np.zeros_like(i)
        for bit, zeros, all_zeros in self.levels:
            one = (c >> bit & 1).astype(bool)
            low, i = np.where(one, all_zeros + low - zeros[low], zeros[low]), np.where(one, all_zeros + i - zeros[i], zeros[i])
        return i - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places [low, high) of each row of patterns, all of one length, by backward search."""
        c = patterns[:, -1]
        known = c < len(self.starts) - 1
        c = np.where(known, c, 0)
        low, high = np.where(known, self.starts[c], 0), np.where(known, self.starts[c + 1], 0)
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = patterns[live, k]
            known = c < len(self.starts) - 1
            c = np.where(known, c, 0)
            base = self.starts[c]
            low[live], high[live] = np.where(known, base + self.rank(c, low[live]), 0), np.where(known, base + self.rank(c, high[live]), 0)
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in s of the suffixes at these places, walking back to one that is kept."""
        places, steps = places.copy(), np.zeros(len(places), np.int64)
        todo = np.flatnonzero(~self.kept[places])
        while len(todo):
            c = self.last[places[todo]]
            places[todo] = self.starts[c] + self.rank(c, places[todo])
            steps[todo] += 1
            todo = todo[~self.kept[places[todo]]]
        return self.positions[self.kept_before[places]] + steps
