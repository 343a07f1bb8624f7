"""Words, shingles and hashes of whole Arrow text columns, without a loop over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from affiche.llm.shared import SPACES

#: Bytes of text worked on at once; a longer document is worked on alone.
CHUNK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15 | 3)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
VALUES = np.random.default_rng(20260301).integers(1, 1 << 64, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd step and of its inverse, modulo 2**64; those for ``CHUNK`` bytes are kept."""
    size = max(n, CHUNK)
    if size > CHUNK or not _powers:
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        made = {}
        for name, base in (("up", _STEP), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made[name] = np.cumprod(steps, dtype=np.uint64)
        if size > CHUNK:  # one very long text, not worth holding on to
            return made["up"][:n], made["down"][:n]
        _powers.update(made)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the offsets between them; null is empty."""
    texts = pa.array([], pa.large_string()) if texts is None else texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``size`` bytes, at least one document each."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high
        low = high


class Words:
    """Words of some documents: where each starts and ends, its document and its hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        space = _IS_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        start, end = ~space, ~space
        if n:
            start[1:] &= space[:-1] | first[1:n]
            end[:-1] &= space[1:] | first[1:n]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.n_docs = len(offsets) - 1
        self.hash = np.zeros(0, np.uint64)
        if len(self.start):
            up, down = powers(n)
            value = VALUES[_LOWER] if lower else VALUES.copy()
            value[_IS_SPACE] = 0
            sums = np.add.reduceat(value[data] * up, self.start)
            self.hash = mix(sums * down[self.start])
        #: Words of each document, and the place of its first one.
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all n-word windows inside one document, and the windows' hashes."""
        m = len(self.start) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(m, np.uint64)
        for k in range(n):
            total = total * _STEP + self.hash[k : k + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, mix(total[at])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [start, start + length), end to end."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or ends[-1] == 0:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of the given length that begins at one of the starts."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.minimum(starts, n), 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:n]) > 0
