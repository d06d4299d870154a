"""An R-tree over count vectors, searched for pairs that may overlap enough."""

from __future__ import annotations

import numpy as np

#: Children of a node.
FANOUT = 16
#: Cells of the arrays made at once.
_WORK = 4_000_000


class CountTree:
    """Points are vectors of counts with the size of their set, packed bottom-up.

    A node keeps the largest count of each coordinate below it and the range of sizes. Two sets
    share at most the sum over coordinates of the smaller count, and for nodes of the smaller
    of both maxima; where that is less than the sets must share, no pair below can be similar.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray) -> None:
        self.order = self._packed(counts, sizes)
        tops, low, high = counts[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(tops, low, high)]
        while len(tops) > FANOUT:
            starts = np.arange(0, len(tops), FANOUT)
            tops = np.maximum.reduceat(tops, starts)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((tops, low, high))

    @staticmethod
    def _packed(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """An order in which neighbours are alike: halved along the widest coordinate or size."""
        done, todo = [], [np.arange(len(sizes))]
        while todo:
            rows = todo.pop()
            if len(rows) <= FANOUT:
                done.append(rows)
                continue
            values = np.column_stack([counts[rows], sizes[rows]]).astype(np.float64)
            axis = values.std(0).argmax()
            rows = rows[np.argsort(values[:, axis], kind="stable")]
            half = FANOUT * max(1, len(rows) // (2 * FANOUT))
            todo += [rows[half:], rows[:half]]
        return np.concatenate(done) if done else np.zeros(0, np.int64)

    def _possible(self, level: int, x: np.ndarray, y: np.ndarray, threshold) -> tuple[np.ndarray, np.ndarray]:
        tops, low, high = self.levels[level]
        keep = []
        step = max(1, _WORK // max(1, tops.shape[1]))
        for at in range(0, len(x), step):
            i, j = x[at : at + step], y[at : at + step]
            need = threshold.shared(low[i], low[j])
            fits = (np.minimum(high[i], high[j]) >= need)
            overlap = np.zeros(len(i), np.int64)
            overlap[fits] = np.minimum(tops[i[fits]], tops[j[fits]]).sum(1)
            keep.append(fits & (overlap >= need))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        return x[keep], y[keep]

    def pairs(self, threshold) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows that the bound does not rule out, each once."""
        level = len(self.levels) - 1
        n = len(self.levels[level][0])
        x, y = np.triu_indices(n)
        x, y = self._possible(level, x, y, threshold)
        while level:
            level -= 1
            n = len(self.levels[level][0])
            found = []
            step = max(1, _WORK // FANOUT**2)
            offsets_x, offsets_y = np.divmod(np.arange(FANOUT**2), FANOUT)
            for at in range(0, len(x), step):
                i = (x[at : at + step, None] * FANOUT + offsets_x).ravel()
                j = (y[at : at + step, None] * FANOUT + offsets_y).ravel()
                real = (i < n) & (j < n) & (i <= j)
                found.append(self._possible(level, i[real], j[real], threshold))
            x = np.concatenate([f[0] for f in found]) if found else x[:0]
            y = np.concatenate([f[1] for f in found]) if found else y[:0]
        apart = x != y
        return self.order[x[apart]], self.order[y[apart]]
