"""A BK-tree over reference entries under the edit distance of Levenshtein, a true metric.

Nodes hold one entry; a child hangs on the edge of its distance to its parent. By the
triangle inequality a search within ``t`` of a node at distance ``d`` needs only the
edges from ``d - t`` to ``d + t``, so every entry within the threshold is found. The
frontier of a level is measured at once: distances are computed for arrays of entries
by the bit-vector method, one machine word per entry.
"""

from __future__ import annotations

import numpy as np

_WORD = 63  # letters of an entry that fit the bit vectors
_A = ord("A")


class BKTree:
    """Entries are texts of the letters A to Z; longer ones than a machine word are measured plainly."""

    def __init__(self, entries: list[str]):
        self.entries = entries
        self.sizes = np.array([len(e) for e in entries], dtype=np.int64)
        self.masks = np.zeros((len(entries), 26), dtype=np.uint64)
        for row, entry in enumerate(entries):
            if len(entry) <= _WORD:
                for place, letter in enumerate(entry):
                    self.masks[row, ord(letter) - _A] |= np.uint64(1 << place)
        self.long = self.sizes > _WORD
        self._build()

    def distances(self, query: str, rows: np.ndarray) -> np.ndarray:
        """Edit distance of ``query`` to each entry in ``rows``."""
        sizes = self.sizes[rows]
        one = np.uint64(1)
        full = (one << np.minimum(sizes, _WORD).astype(np.uint64)) - one
        last = np.where(sizes > 0, one << np.clip(sizes - 1, 0, _WORD - 1).astype(np.uint64), np.uint64(0))
        plus, minus, score = full.copy(), np.zeros_like(full), sizes.copy()
        masks = self.masks[rows]
        for letter in query:
            equal = masks[:, ord(letter) - _A]
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | ~(horizontal | plus), plus & horizontal
            score += ((up & last) != 0).astype(np.int64) - ((down & last) != 0)
            up, down = (up << one) | one, down << one
            plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        score = np.where(sizes == 0, len(query), score)
        if self.long[rows].any():
            for k in np.flatnonzero(self.long[rows]):
                score[k] = plain_distance(query, self.entries[rows[k]])
        return score

    def _build(self) -> None:
        n = len(self.entries)
        self.children: list[list[int]] = [[] for _ in range(n)]
        edge = np.zeros(n, dtype=np.int64)
        todo = [np.arange(n)] if n else []
        while todo:
            group = todo.pop()
            root, rest = group[0], group[1:]
            if not len(rest):
                continue
            far = self.distances(self.entries[root], rest)
            for d in np.unique(far):
                below = rest[far == d]
                self.children[root].append(int(below[0]))
                edge[below[0]] = d
                todo.append(below)
        counts = np.array([len(c) for c in self.children], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(counts)])
        self.child = np.array([c for cs in self.children for c in cs], dtype=np.int64)
        self.edge = edge[self.child] if len(self.child) else np.zeros(0, dtype=np.int64)
        del self.children

    def search(self, query: str, within: int) -> list[tuple[int, int]]:
        """(distance, row) of every entry within the threshold, nearest first."""
        if not self.entries:
            return []
        found: list[tuple[int, int]] = []
        front = np.array([0])
        while len(front):
            far = self.distances(query, front)
            near = far <= within
            found += zip(far[near].tolist(), front[near].tolist())
            starts, ends = self.start[front], self.start[front + 1]
            sizes = ends - starts
            total = int(sizes.sum())
            if not total:
                break
            at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)
            keep = np.abs(self.edge[at] - np.repeat(far, sizes)) <= within
            front = self.child[at[keep]]
        return sorted(found)


def plain_distance(a: str, b: str) -> int:
    """Levenshtein's distance, row by row."""
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]
