"""The k best of many, kept inside a task."""

from __future__ import annotations

import numpy as np

from .ranking import ROUND, SMALL, SMALL_ROUND


def comparable(score: np.ndarray) -> np.ndarray:
    """As ``ranking.comparable``."""
    small = np.abs(score) < SMALL
    out = np.round(score, ROUND)
    if small.any():
        out[small] = np.round(score[small], SMALL_ROUND)
    return out


#: Scores that tie when rounded are no further apart.
MARGIN = 2 * 10.0**-ROUND


class BestK:
    """The k best items of each of ``n`` queries so far; ties go to the lesser id. With
    ``positive`` only scores above 0 count."""

    def __init__(self, n: int, k: int, positive: bool = False):
        self.n, self.k, self.positive, self.waiting = n, k, positive, 0
        self.limit = np.full(n, -np.inf)  # of each query: k items at least are as good
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, scores: np.ndarray, first: int = 0) -> None:
        """``scores``: queries (from number ``first``) x ids. Of each row only what reaches the limit is
        kept: the k-th best among the maxima of sets of columns, now or before, which is passed once and
        without rounding."""
        n, width = scores.shape
        limit = self.limit[first : first + n]
        size = max(1, min(16, width // (4 * self.k)))
        columns = width // size
        if columns >= self.k:
            best = scores[:, :columns].copy()
            for i in range(1, size):
                np.maximum(best, scores[:, i * columns : (i + 1) * columns], out=best)
            np.fmax(limit, np.partition(best, columns - self.k, axis=1)[:, columns - self.k], out=limit)
        least = limit - MARGIN
        if self.positive:
            least = np.maximum(least, np.nextafter(0.0, 1.0))
        row, col = np.divmod(np.flatnonzero(scores >= least[:, None]), width)
        self.parts.append((row + first, scores[row, col], ids[col]))
        self.waiting += len(row)
        if self.waiting > 3 * self.n * self.k + 100_000:
            row, score, ids = self.result()
            self.parts, self.waiting = [(row, score, ids)], len(row)
            last = np.flatnonzero(np.r_[np.diff(row) != 0, np.ones(min(1, len(row)), bool)])
            full = last[np.diff(np.r_[-1, last]) == self.k]
            self.limit[row[full]] = np.fmax(self.limit[row[full]], score[full])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, scores and ids, in order, at most k a query."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        row, score, ids = (np.concatenate(x) for x in zip(*self.parts))
        rounded = comparable(score)
        # an id's place among the ids; each is compared once, not once a hit
        place = {i: n for n, i in enumerate(sorted(set(ids.tolist())))}
        by_id = np.fromiter(map(place.__getitem__, ids.tolist()), np.int64, len(ids))
        order = np.lexsort((by_id, -rounded, row))
        row = row[order]
        first = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
        order, row = order[place < self.k], row[place < self.k]
        return row, score[order], ids[order]
