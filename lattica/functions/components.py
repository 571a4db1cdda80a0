"""Connected components by labels: each node's label is the smallest node that it is known to reach."""

from __future__ import annotations

import numpy as np


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Links a[k] with b[k]; label[x] = x at first, and the smallest node of x's component after all links are in."""
    while True:
        a, b = label[a], label[b]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
