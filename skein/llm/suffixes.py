"""Suffix arrays by induced sorting, whole runs of a type at a time in numpy, and permuted common prefixes.

A suffix is smaller or larger than the one after it. The leftmost smaller suffixes (those
after a larger one) are sorted first; the larger ones follow from them, and the smaller ones
from the larger ones. A larger suffix is a run of larger places that ends at a leftmost
smaller one, so its order is that of the run's symbols and then of that end's rank; runs are
short, and all of them are ordered together, in rounds that double how much of a run counts.
"""

from __future__ import annotations

import numpy as np


def _is_small(text: np.ndarray) -> np.ndarray:
    """True where the suffix is less than the next one (S-type); the last symbol, least and single, is."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[following] > 0, True)


def _ends(flag: np.ndarray) -> np.ndarray:
    """For each place the next one, itself included, where flag holds."""
    n = len(flag)
    return np.minimum.accumulate(np.where(flag, np.arange(n), n - 1)[::-1])[::-1]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of values, which of them in order begin a new value, and for each in order how many are less."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(first)
    return order, first, np.repeat(at, np.diff(np.append(at, len(values))))


def _induce(symbol: np.ndarray, run: np.ndarray, end: np.ndarray, seeds: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Ranks of the runs' places among all runs' places and seeds; places of equal symbols up to ends of equal rank share one.

    symbol: twice each symbol, and 1 more for a smaller suffix. run: places of one type; end:
    for every place the seed that ends its run. seeds have ranks already.
    """
    key = np.zeros(len(symbol), np.int64)
    items = np.concatenate([run, seeds])
    ends = end[items]
    ends[len(run) :] = seeds
    of_seed = np.zeros(len(symbol), np.int64)
    of_seed[seeds] = rank + 1
    bits, low = int(symbol.max()).bit_length(), int(rank.max(initial=0) + 1).bit_length()
    reach = max(1, min(8, (63 - low) // bits))  # as many symbols as a number holds count at once
    packed = symbol[items]
    for j in range(1, reach):
        packed = (packed << bits) | symbol[np.minimum(items + j, ends)]
    order, _, place = _numbered((packed << low) | np.where(ends - items < reach, of_seed[ends], 0))
    key[items[order]] = place
    total = len(items) + 1
    live = run
    while True:
        live = live[end[live] - live >= reach]  # what ends sooner has told all
        if not len(live):
            return key[run]
        order, first, place = _numbered(key[live] * total + key[np.minimum(live + reach, end[live])])
        live = live[order]
        was = key[live]
        group = np.flatnonzero(np.concatenate([[True], was[1:] != was[:-1]]))
        key[live] = was + place - np.repeat(group, np.diff(np.append(group, len(live))))
        alone = first & np.append(first[1:], True)
        live = live[~alone]
        reach *= 2


def _ranks(symbol: np.ndarray, small: np.ndarray, lms: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Larger places, and the ranks of these and then of all smaller places, from ranks of the leftmost smaller ones."""
    large = np.flatnonzero(~small)
    of_large = _induce(symbol, large, _ends(small), lms, seeds)
    below = np.flatnonzero(small[:-1])
    of_small = _induce(symbol, below, _ends(~small), large, of_large)
    return large, of_large, np.append(of_small, -1)  # the last symbol's suffix is the least of all


def _in_order(places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """places by their ranks, which are distinct."""
    out = np.full(int(rank.max(initial=-1)) + 2, -1, np.int64)
    out[rank + 1] = places
    return out[out >= 0]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. text: whole numbers, the last a 0 that occurs nowhere else."""
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    text = text.astype(np.int64)
    small = _is_small(text)
    symbol = text * 2 + small
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    smaller = np.flatnonzero(small)
    # with ends that tell their symbol alone, the ranks of the leftmost smaller places are names of the substrings there
    names = _ranks(symbol, small, lms, np.zeros(len(lms), np.int64))[2][np.searchsorted(smaller, lms)]
    order, first, _ = _numbered(names)
    reduced = np.empty(len(lms), np.int64)
    reduced[order] = np.cumsum(first) - 1
    if not first.all():
        order = suffix_array(reduced)
        reduced[order] = np.arange(len(lms))
    large, of_large, of_small = _ranks(symbol, small, lms, reduced)
    # of each symbol the larger suffixes come first
    count = np.bincount(symbol, minlength=int(symbol.max()) + 1)
    start = np.cumsum(count) - count
    out = np.empty(n, np.int64)
    for ordered in (_in_order(large, of_large), _in_order(smaller, of_small)):
        own = symbol[ordered]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[start[own] + np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))] = ordered
    return out


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of text, how much its suffix shares with the one before it in order, and that one (-1 for the first).

    Only where the symbols before the two differ are they compared, four symbols a step;
    each other place shares one symbol less than the place before it.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    inner = (i > 0) & (before > 0)
    reducible = np.zeros(n, bool)
    reducible[inner] = text[i[inner] - 1] == text[before[inner] - 1]
    fresh = np.flatnonzero(~reducible & (before >= 0))
    padded = np.concatenate([text.astype("<u2"), np.zeros(4, "<u2")])
    padded[n : n + 4] = [65535, 65534, 65533, 65532]
    lanes = np.ndarray(n, dtype="<u8", buffer=padded.data, strides=(2,))
    shared = np.zeros(n, np.int64)
    live, at = fresh, 0
    while len(live):
        x, y = live + at, before[live] + at
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        differ = lanes[x] ^ lanes[y]
        same = differ == 0
        part = differ[~same]
        shared[live[~same]] = at + np.where(part & np.uint64(0xFFFF), 0, np.where(part & np.uint64(0xFFFFFFFF), 1, np.where(part & np.uint64(0xFFFFFFFFFFFF), 2, 3)))
        live = live[same]
        shared[live] = at + 4
        at += 4
    last = np.maximum.accumulate(np.where(reducible, -1, i))
    return np.maximum(shared[last] - (i - last), 0), before
