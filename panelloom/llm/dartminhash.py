"""DartMinHash signatures of weighted sets, vectorised over many sets.

Each element owns a region: its weight on one axis, rank from 0 on on the other. Darts fall into it as a Poisson process of
unit density, placed by hashes of the element alone, so equal elements get equal darts in whatever set. A dart has an identity,
a rank and one of k coordinates; a set looks at the darts under its weight up to a rank at which about k ln k + 2k are seen, and
keeps the earliest of each coordinate. Two sets agree in a coordinate with probability sum(min) / sum(max) of their weights.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

#: Ranks are visited in layers from 0 to FIRST, then each up to FACTOR times the last bound.
FIRST, FACTOR = 2.0**-8, 4.0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def salt(n: int) -> np.uint64:
    return np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


@cache
def poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2... events."""
    n = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
    return np.cumsum(np.exp(n * math.log(mean) - mean - np.array([math.lgamma(i + 1.0) for i in n])))


def darts(elements: np.ndarray, cover: np.ndarray | None, sets: np.ndarray, upto: np.ndarray, k: int):
    """(set, coordinate, rank, identity) of the darts under each set's rank bound."""
    found = []
    layer, low, high = 1, 0.0, FIRST
    while True:
        here = np.flatnonzero(upto[sets] > low)
        if not len(here):
            break
        own = elements[here]
        n = np.searchsorted(poisson(high - low), unit(mix(own + salt(layer))), side="right")
        some = np.flatnonzero(n)
        n = n[some]
        at = np.repeat(here[some], n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(mix(elements[at] + salt(layer * 131 + 7)) + nth.astype(np.uint64) * salt(3))
        rank = low + (high - low) * unit(mix(dart + salt(5)))
        in_set = sets[at]
        seen = rank <= upto[in_set]
        if cover is not None:
            seen &= unit(mix(dart + salt(11))) < cover[at]
        seen = np.flatnonzero(seen)
        dart = dart[seen]
        found.append((in_set[seen], (mix(dart + salt(13)) % np.uint64(k)).astype(np.int64), rank[seen], dart))
        layer, low, high = layer + 1, high, high * FACTOR
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each element as cells of one unit of its weight: whose each cell is, the cells' own hashes, and how far they are covered."""
    n = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, mix(elements[at] + nth.astype(np.uint64) * salt(17)), np.minimum(1.0, weights[at] - nth)


def signatures(elements: np.ndarray, sets: np.ndarray, n_sets: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """An (n_sets, k) matrix of dart identities. elements: 64-bit hashes; sets: whose they are, ascending, none empty.

    A weight over 1 is laid out as cells of one unit, each with darts of its own, of which the last may be covered in part.
    """
    elements, cover = elements.astype(np.uint64), None
    total = np.bincount(sets, minlength=n_sets).astype(float)
    if weights is not None:
        total = np.bincount(sets, weights=weights, minlength=n_sets)
        at, elements, cover = cells(elements, weights)
        sets = sets[at]
    out = np.zeros((n_sets, k), np.uint64)
    upto = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-12), 0.0)
    while len(elements):
        own, coordinate, rank, dart = darts(elements, cover, sets, upto, k)
        filled = np.zeros(n_sets * k, bool)
        slot = own * k + coordinate
        latest_first = np.argsort(-rank, kind="stable")
        flat = np.zeros(n_sets * k, np.uint64)
        flat[slot[latest_first]] = dart[latest_first]  # the earliest is written last
        filled[slot] = True
        whole = filled.reshape(n_sets, k).all(axis=1)
        done = whole & (upto > 0)
        out[done] = flat.reshape(n_sets, k)[done]
        upto = np.where(done, 0.0, upto * 2)
        left = upto[sets] > 0
        elements, sets = elements[left], sets[left]
        cover = cover[left] if cover is not None else None
    return out
