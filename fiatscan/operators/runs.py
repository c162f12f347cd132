"""Connected parts of masks as runs of pixels along rows: joined, named and measured without visiting pixels one by one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .grid import ragged


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n things linked by pairs (a, b), the least thing that each is linked with, directly or not."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return label


@dataclass
class Runs:
    """Runs in order of row, then start; `end` is the first pixel after a run. part: from 0, in order of the parts' first pixels."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    part: np.ndarray
    count: int


def runs_of(mask: np.ndarray) -> Runs:
    """The 4-connected parts of a mask of rows; nothing wraps from one row's end to the next one's start."""
    height, width = mask.shape
    edge = np.zeros((height, width + 2), np.int8)
    edge[:, 1:-1] = mask
    step = np.diff(edge, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    line = row * (width + 1)
    low = np.searchsorted(line + end, line - (width + 1) + start, "right")  # first run above that ends behind this one's start
    n = np.maximum(0, np.searchsorted(line + start, line - (width + 1) + end, "left") - low)
    label = united(len(row), np.repeat(np.arange(len(row)), n), np.repeat(low, n) + ragged(n))
    first, part = np.unique(label, return_inverse=True)
    return Runs(row, start, end, part, len(first))


def painted(runs: Runs, shape: tuple[int, int]) -> np.ndarray:
    """Labels from 1 of all pixels, 0 outside."""
    out = np.zeros(shape, np.int64)
    size = runs.end - runs.start
    out[np.repeat(runs.row, size), np.repeat(runs.start, size) + ragged(size)] = np.repeat(runs.part + 1, size)
    return out


MEASURES = ("area", "sum_x", "sum_y", "min_x", "min_y", "max_x", "max_y")


def measured(runs: Runs) -> dict[str, np.ndarray]:
    """Sums and extremes of each part; those of pieces of a part add up to its own."""
    size = runs.end - runs.start
    add = lambda v: np.bincount(runs.part, v, runs.count).astype(np.int64)  # noqa: E731  exact below 2**53
    out = {"area": add(size), "sum_x": add(size * (runs.start + runs.end - 1) / 2), "sum_y": add(size * runs.row)}
    for name, f, v, begin in (("min_x", np.minimum, runs.start, np.iinfo(np.int64).max), ("min_y", np.minimum, runs.row, np.iinfo(np.int64).max), ("max_x", np.maximum, runs.end - 1, -1), ("max_y", np.maximum, runs.row, -1)):
        out[name] = np.full(runs.count, begin, np.int64)
        f.at(out[name], runs.part, v)
    return out


def firsts(runs: Runs) -> np.ndarray:
    """The first run of each part."""
    out = np.full(runs.count, len(runs.part))
    np.minimum.at(out, runs.part, np.arange(len(runs.part)))
    return out
