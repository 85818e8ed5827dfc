"""Word runs, their hashes and shingles for whole blocks of texts, with numpy.

A word is a run of bytes outside 0x20 and 0x09-0x0D. These are ASCII, so that byte runs of UTF-8
are exactly the runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes of text handled by one pass of numpy; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything that separates letters and digits; bytes from 0x80 on belong to letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[0x80:] = NO_LETTER[ord("a"):ord("z") + 1] = NO_LETTER[ord("A"):ord("Z") + 1] = NO_LETTER[ord("0"):ord("9") + 1] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
#: Random values of each byte at each of the first places of a run; those of later places are drawn from them.
_PLACES = 64
_PLACED = np.random.default_rng(11).integers(0, 2**64, (_PLACES, 256), dtype=np.uint64)
_STEP = np.random.default_rng(7).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word; distinct inputs stay distinct."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    n, inverse = 1 << bits, pow(_BASE, -1, 1 << 64)
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(inverse)
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(20, int(n - 1).bit_length()))
    return up[:n], down[:n]


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about `limit` bytes with the position of the first; null counts as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


class Runs:
    """The runs of one block: start and end in `data`, and for each text the range of its runs."""

    def __init__(self, texts: list[bytes], separator: np.ndarray = SPACE):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_end = np.cumsum(lengths + 1) - 1
        self.text_start = self.text_end - lengths
        gap = separator[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.searchsorted(self.start, self.text_end)
        self.count = self.last - self.first

    def hashes(self, lower: bool = True) -> np.ndarray:
        return run_hashes(self.data, self.start, self.end, lower)


def rolling_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of data[start:end] for each pair, from prefix sums: as cheap for overlapping pairs.

    Good for choosing places only: modulo 2**64 there are long byte strings that differ and hash alike.
    """
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
        value = (sums[end] - sums[start]) * down[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair: the sum of a random value for each byte and place.

    No place's value follows from another's, so that no pattern of bytes makes different runs hash alike.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = (end - start).astype(np.int64)
    total, live = np.zeros(len(start), np.uint64), np.flatnonzero(size)
    with np.errstate(over="ignore"):
        for place in range(_PLACES):  # most runs are short: few are left after some places
            if not len(live):
                break
            byte = data.take(start[live] + place)
            total[live] += _PLACED[place].take(_FOLD.take(byte) if lower else byte)
            live = live[size[live] > place + 1]
        if len(live):
            _add_far(total, live, data, start, size, lower)
        return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _add_far(total: np.ndarray, long: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, lower: bool) -> None:
    """Add the values of the places from _PLACES on of the long runs."""
    count = size[long] - _PLACES
    stop = np.cumsum(count)
    place = np.arange(stop[-1]) - np.repeat(stop - count, count) + _PLACES
    byte = data[np.repeat(start[long], count) + place]
    value = _PLACED[place & (_PLACES - 1), _FOLD[byte] if lower else byte]
    value = mix(value + mix((place // _PLACES).astype(np.uint64)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    total[long] += sums[stop] - sums[stop - count]


def shingles(runs: Runs, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `size` successive words of each text, sorted, and the bounds of the texts.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    word = runs.hashes()
    parts, bounds = [], np.zeros(len(runs.first) + 1, np.int64)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(word) - size + 1), np.uint64)
        for k in range(size):
            whole += word[k:k + len(whole)] * _STEP[k]
        whole = mix(whole)
        for i, (a, b) in enumerate(zip(runs.first.tolist(), runs.last.tolist(), strict=True)):
            if b - a >= size:
                part = distinct(whole[a:b - size + 1])
            elif b > a:
                part = mix(((word[a:b] * _STEP[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a))[None])
            else:
                part = word[:0]
            parts.append(part)
            bounds[i + 1] = bounds[i] + len(part)
    return (np.concatenate(parts) if parts else word[:0]), bounds


def sums_by_text(runs: Runs, values: np.ndarray) -> np.ndarray:
    """Sum of a value per byte over each text."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[runs.text_end] - total[runs.text_start]
