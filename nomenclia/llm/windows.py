"""Words, and hashes of runs of words, for whole batches of texts at once.

A word's hash is a polynomial of its bytes modulo 2^64 with a table of values,
so that one pass over the bytes hashes all words; a run's hash is built from
those of runs half as long. ``salt`` gives an independent second hash.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Bytes that are hashed at a time, which bounds memory for very long texts.
PIECE = 1 << 19
BASE, STEP = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _values(salt: int) -> np.ndarray:
    """One value for each byte."""
    return mixed(mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP)) + np.uint64(salt))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the words at ``starts`` to ``ends`` of ``data``."""
    power, inverse = _powers(max(PIECE, 1 << (len(data) + 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values(salt)[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes], salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, texts end to end, and the number of words of each text."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    blank = SPACE[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    last = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    lengths = np.diff(np.searchsorted(starts, last), prepend=0)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        # Whole words of about PIECE bytes, one word at least.
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
        first = starts[at]
        out[at:to] = _hashed(data[first : ends[to - 1]], starts[at:to] - first, ends[at:to] - first, salt)
        at = to
    return out, lengths


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each place on, by doubling; max(0, n - length + 1) of them."""
    have, size = hashes, 1
    while size < length:
        step = min(size, length - size)
        n = max(0, len(have) - step)
        have = mixed(have[:n] * np.uint64(STEP) + have[len(have) - n :])
        size += step
    return have


def slide(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or largest) of each ``width`` values in a row."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out
