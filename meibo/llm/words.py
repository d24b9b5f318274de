"""Words of a text as 64-bit hashes, by whole-array arithmetic.

A word is a run of letters and digits, compared in lower case, character by character, so that
places in the lowered text are places in the text. Hashes are equal for equal words; different
words agree with a chance of about 2^-64.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Characters handled at once; a piece ends between words.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is part of a word, and its lower-case form if that is one character."""
    part = np.zeros(0x110000, dtype=bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        part[code] = char.isalnum()
        low = char.lower()
        if len(low) == 1:
            lower[code] = ord(low)
    return part, lower


_powers: list[np.ndarray] = []


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < size:
        inverse = pow(BASE, -1, 1 << 64)
        size = max(size, 1 << 16)
        _powers[:] = [
            np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b, dtype=np.uint64), dtype=np.uint64)))
            for b in (BASE, inverse)
        ]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def pieces(text: str):
    """(offset, part) of a text; no word is cut."""
    start, size = 0, len(text)
    while start < size:
        end = min(size, start + PIECE)
        while end < size and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
        yield start, text[start:end]
        start = end


def _piece_words(text: str, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    part, lower = _tables()
    codes = code_points(text)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = part[codes]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((lower[codes].astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
    heads = []
    for size in prefixes:
        cut = np.minimum(starts + size, ends)
        head = mix((sums[cut] - sums[starts]) * inverse[starts]) ^ np.uint64(size)
        heads.append(np.where(ends - starts > size, head, np.uint64(0)))
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts, ends, *heads


def words(text: str | None, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash, start and end of every word of the whole text.

    For each size in ``prefixes`` also the hash of the word's first characters, or 0 for a word
    that is not longer.
    """
    found = [(h, s + at, e + at, *x) for at, piece in pieces(text or "") for h, s, e, *x in [_piece_words(piece, prefixes)]]
    if not found:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, *[np.zeros(0, np.uint64) for _ in prefixes]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE) + hashes[k : k + n]
    return mix(total)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted different runs of ``size`` words; a shorter text has one run of all its words, an empty one none."""
    hashes = words(text)[0]
    return np.unique(grams(hashes, min(size, len(hashes))) if len(hashes) else hashes)
