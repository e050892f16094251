"""Roots of a bounded set of nodes under links that arrive in bulk."""

from __future__ import annotations

import numpy as np


class Forest:
    """Numbered nodes; ``parent`` leads to the smallest node that links reach."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
                self.parent = up
            a, b = self.parent[i], self.parent[j]
            if not (apart := a != b).any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
