"""Words of many texts at once: limits and 64-bit hashes by numpy, without a Python loop over words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUE = mix(np.arange(101, 357, dtype=np.uint64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


@dataclass
class Words:
    doc: np.ndarray  # number of the text
    start: np.ndarray  # byte limits in the joined texts
    end: np.ndarray
    hash: np.ndarray


def white_space() -> np.ndarray:
    """Table: is the byte part of a word of ``[^\\x20\\x09-\\x0D]+``?"""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def words(data: np.ndarray, at: np.ndarray, part_of_word: np.ndarray, folded: np.ndarray) -> Words:
    """data: texts end to end; at: their n+1 limits; folded: data as it is to be compared."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    inside = part_of_word[data]
    before = np.r_[False, inside[:-1]]
    limits = at[(at > 0) & (at < n)]
    before[limits] = False
    after = np.r_[inside[1:], False]
    after[limits - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = powers_up_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[folded] * power[:n], out=sums[1:])
    raw = (sums[end] - sums[start]) * inverse[start]
    return Words(np.searchsorted(at, start, "right") - 1, start, end, mix(raw + (end - start).astype(np.uint64)))
