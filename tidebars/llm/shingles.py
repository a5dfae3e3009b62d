"""Word shingles of texts as 64-bit hashes, many texts at a time in numpy."""
from __future__ import annotations

import numpy as np

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20240901).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words (a fixed invertible mix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    solid = ~_IS_SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(size)))))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    inside = joined[solid]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTES[inside] * powers(int(lengths.max()))[place], first)
        return mixed(sums + lengths.astype(np.uint64)), counts


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``k`` words, sorted; fewer words are one shingle, none are none.

    A-Z are lower-cased; words are runs of bytes other than white space (blank, tab to carriage return).
    """
    hashes, counts = words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    with np.errstate(over="ignore"):
        ks = powers(k + 1, np.uint64(0xD6E8FEB86659FD93))
        rolled = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
        for i in range(k):
            rolled += hashes[i:len(hashes) - k + 1 + i] * ks[i + 1]
        rolled = mixed(rolled)
        out, at = [], 0
        for n in counts.tolist():
            if n >= k:
                out.append(np.unique(rolled[at:at + n - k + 1]))
            elif n:
                short = (hashes[at:at + n] * ks[1:n + 1]).sum(dtype=np.uint64) + np.uint64(n)
                out.append(mixed(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out
