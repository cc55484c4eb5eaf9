"""An FM-index over a sequence of small numbers: a wavelet matrix over the Burrows-Wheeler transform, and sampled positions.

All steps take arrays of queries, so that many patterns are searched at once. Symbol 0 separates runs: no pattern holds it, and no
walk crosses it, as the first position of each run is sampled.
"""

from __future__ import annotations

import numpy as np

#: Every so many positions of a run, the position is kept.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, each separator being a symbol of its own; by prefix doubling, of what isn't settled only."""
    n = len(text)
    first = text.astype(np.int64) + n
    gaps = np.flatnonzero(text == 0)
    first[gaps] = np.arange(len(gaps))
    order = np.argsort(first, kind="stable")
    value = first[order]
    starts = np.concatenate([[True], value[1:] != value[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    ends = np.concatenate([starts[1:], [True]])
    loose = order[~(starts & ends)]  # in groups of equal rank, in order of rank
    k = 1
    while len(loose):
        after = loose + k
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        mine = rank[loose]
        by = np.lexsort((nxt, mine))
        loose, mine, nxt = loose[by], mine[by], nxt[by]
        fresh = np.concatenate([[True], mine[1:] != mine[:-1]])
        split = fresh | np.concatenate([[True], nxt[1:] != nxt[:-1]])
        at = np.arange(len(loose))
        group = np.maximum.accumulate(np.where(fresh, at, 0))
        place = mine + np.maximum.accumulate(np.where(split, at, 0)) - group
        order[mine + at - group] = loose
        rank[loose] = place
        last = np.concatenate([split[1:], [True]])
        loose = loose[~(split & last)]
        k *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray):
        """text: numbers, with a 0 after each run."""
        n = len(text)
        order = suffix_array(text)
        self.size = n
        self.bwt = text[order - 1]
        top = int(text.max(initial=0))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.levels = []
        symbols, part, begin = np.arange(top + 1), self.bwt, np.zeros(top + 1, np.int64)
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (part >> bit) & 1
            count = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            zeros = n - int(count[-1])
            self.levels.append((bit, count, zeros))
            begin = np.where((symbols >> bit) & 1, zeros + count[begin], begin - count[begin])
            part = np.concatenate([part[ones == 0], part[ones == 1]])
        self.begin = begin
        gap = text == 0
        start = np.maximum.accumulate(np.where(np.concatenate([[True], gap[:-1]]), np.arange(n), 0))
        kept = ((np.arange(n) - start) % SAMPLE == 0)[order]
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.kept = order[kept]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often symbol occurs in the first `row` rows of the transform."""
        for bit, count, zeros in self.levels:
            ones = count[row]
            row = np.where((symbol >> bit) & 1, zeros + ones, row - ones)
        return row - self.begin[symbol]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: a row a pattern, at its right end. Gives the rows of suffixes [low, high) that begin with it."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1]):
            live = live[(length[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            c = patterns[live, -1 - step]
            known = c < len(self.begin)
            low[live[~known]] = high[live[~known]] = 0
            live, c = live[known], c[known]
            both = self.rank(np.concatenate([c, c]), np.concatenate([low[live], high[live]])) + np.tile(self.before[c], 2)
            low[live], high[live] = both[: len(c)], both[len(c) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while True:
            walk = np.flatnonzero(self.kept_rank[rows + 1] == self.kept_rank[rows])
            if not len(walk):
                return self.kept[self.kept_rank[rows]] + steps
            c = self.bwt[rows[walk]]
            rows[walk] = self.before[c] + self.rank(c, rows[walk])
            steps[walk] += 1
