"""Vectorised views of many texts at once: code points, runs, words and their hashes."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Unicode's White_Space characters.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


@cache
def classes() -> np.ndarray:
    """The class of each code point: white space, letter, number or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for m in re.finditer(r"[^\W_]", every):
        kind = unicodedata.category(m[0])[0]
        table[m.start()] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    table[WHITE] = SPACE
    return table


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """Texts joined by spaces, their code points, and where each text starts (one more entry: the end)."""
    whole = " ".join(texts) + " "
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=starts[1:])
    return whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), starts


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse, modulo 2**64."""
    if multiplier not in _tables or len(_tables[multiplier][0]) < n:
        grown = []
        for base in (multiplier, pow(multiplier, -1, 1 << 64)):
            p = np.full(n + n // 2, base, np.uint64)
            p[0] = 1
            grown.append(np.multiply.accumulate(p))
        _tables[multiplier] = (grown[0], grown[1])
    return _tables[multiplier]


def span_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray, multiplier: int = _M1) -> np.ndarray:
    """A 64-bit polynomial hash of each of the spans; they are in order, don't overlap and end before cp does."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(multiplier, len(cp))
    bounds = np.empty(2 * len(start), np.int64)
    bounds[::2], bounds[1::2] = start, end
    weighted = (cp + np.uint32(1)) * power[: len(cp)]
    return mixed(np.add.reduceat(weighted, bounds)[::2] * inverse[start])


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[i], start[i] + 1, ... of each of the spans, one after another."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


def white_words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs without white space."""
    solid = classes()[cp] != SPACE
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def alnum_words(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of letters and numbers."""
    c = classes()[cp]
    solid = (c == LETTER) | (c == NUMBER)
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]
