"""Weighted SimHash of sliding windows, and a multi-index that finds all within a Hamming radius."""

from __future__ import annotations

import numpy as np

from strandloom.llm.letters import SIZE

WINDOW, STEP = 16, 4  # trigrams in a window, and between the starts of a page's windows
BITS, BLOCKS = 64, 4  # fingerprints within BLOCKS - 1 bits agree in at least one block
RADIUS = BLOCKS - 1
TOP_WEIGHT = 7  # a lane of the packed sums holds WINDOW * TOP_WEIGHT in 8 bits


def weights(counts: np.ndarray) -> np.ndarray:
    """Shingle weights 1..TOP_WEIGHT from how rare they are in the corpus."""
    share = (counts + 1) / (counts.sum() + len(counts))
    rarity = -np.log(share)
    low, high = -np.log(0.02), -np.log(1e-6)
    return np.clip(np.round(1 + (TOP_WEIGHT - 1) * (rarity - low) / (high - low)), 1, TOP_WEIGHT).astype(np.uint8)


def lanes(weight: np.ndarray) -> np.ndarray:
    """For every shingle its weight in the lanes of its hash's set bits: 8 lanes to a 64-bit word."""
    x = np.arange(SIZE**3, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):  # splitmix64
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(bits * weight[:, None]).view(np.uint64)


def window_prints(shingles: np.ndarray, table: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows that start at every STEP-th shingle."""
    n = len(shingles) // STEP
    k = WINDOW // STEP
    if n < k:
        return np.empty(0, dtype=np.uint64)
    s = shingles[: n * STEP].reshape(n, STEP)
    sums = table[s[:, 0]]
    total = weight[s[:, 0]].astype(np.uint16)
    for j in range(1, STEP):
        sums += table[s[:, j]]
        total += weight[s[:, j]]
    m = n - k + 1
    window, whole = sums[:m].copy(), total[:m].copy()
    for j in range(1, k):
        window += sums[j : j + m]
        whole += total[j : j + m]
    half = (whole >> 1).astype(np.uint8)
    set_bits = window.view(np.uint8).reshape(m, BITS) > half[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()


class MultiIndex:
    """Block tables over fingerprints; ``near`` returns every pair within RADIUS bits."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        keys = prints.view(np.uint16).reshape(-1, BLOCKS)
        self.order = [np.argsort(keys[:, b], kind="stable").astype(np.int32) for b in range(BLOCKS)]
        self.ordered = [prints[order] for order in self.order]
        self.starts = [
            np.concatenate(([0], np.cumsum(np.bincount(keys[:, b], minlength=1 << 16)))) for b in range(BLOCKS)
        ]

    def near(self, prints: np.ndarray, chunk: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
        mine, theirs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(prints), chunk):
            part = prints[at : at + chunk]
            keys = part.view(np.uint16).reshape(-1, BLOCKS)
            for b in range(BLOCKS):
                first = self.starts[b][keys[:, b]]
                n = self.starts[b][keys[:, b].astype(np.int32) + 1] - first
                stop = np.cumsum(n)
                place = np.repeat(first - (stop - n), n)
                place += np.arange(len(place))
                differ = np.repeat(part, n) ^ self.ordered[b][place]
                close = np.flatnonzero(np.bitwise_count(differ) <= RADIUS)
                # what agrees in an earlier block has been found there
                blocks = differ[close].view(np.uint16).reshape(-1, BLOCKS)
                close = close[(blocks[:, :b] != 0).all(axis=1)]
                mine.append(np.searchsorted(stop, close, side="right") + at)
                theirs.append(self.order[b][place[close]])
        return np.concatenate(mine), np.concatenate(theirs)


def weighted_overlap(one: np.ndarray, other: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingle sets in the rows of two equal-shaped arrays."""

    if not len(one):
        return np.empty(0)

    def distinct(columns: np.ndarray) -> np.ndarray:
        again = np.zeros(columns.shape, dtype=bool)
        for d in range(1, len(columns)):
            again[d:] |= columns[d:] == columns[:-d]
        return ~again

    # by columns, so that what is compared lies together
    one, other = np.ascontiguousarray(one.T), np.ascontiguousarray(other.T)
    common = np.zeros(one.shape, dtype=bool)
    for column in other:
        common |= one == column
    a, b = distinct(one) * weight[one], distinct(other) * weight[other]
    shared = (common * a).sum(axis=0)
    return shared / np.maximum(a.sum(axis=0) + b.sum(axis=0, dtype=np.int64) - shared, 1)
