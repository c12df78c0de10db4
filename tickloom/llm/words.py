"""Word and word-window hashes of text columns, in numpy.

Words are the runs of bytes outside space and 0x09-0x0D. The hash of a word is a polynomial of
its bytes modulo 2**64 (from prefix sums, so that a whole column takes a few array operations),
finished by a mixing step. Such polynomials fail for certain long words (those of the Thue-Morse
sequence from some hundred bytes on), so that words of more than ``LONG`` bytes have a keyed BLAKE2
digest instead. The hash of a window is a polynomial of its words' hashes, mixed again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from tickloom.llm.common import text_buffer

_SLICE = 1 << 18
LONG = 64
_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x + _U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Family:
    """Byte values and powers of one hash function."""

    def __init__(self, seed: int, lower: bool):
        table = mix(np.arange(256, dtype=_U), 1000 + seed) | _U(1)
        if lower:
            table[65:91] = table[97:123]
        self.table, self.lower, self.seed = table, lower, seed
        self.base = (0x2545F4914F6CDD1D + 2 * 0x1000003 * seed * (seed + 7)) & 0xFFFFFFFFFFFFFFFF | 5
        self.back = pow(self.base, -1, 1 << 64)
        self.power, self.inverse = self._powers(self.base, _SLICE), self._powers(self.back, _SLICE)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, base, _U)
        out[0] = 1
        return np.cumprod(out, dtype=_U)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), _U)
        first = 0
        while first < len(starts):
            lo = int(starts[first])
            last = max(first + 1, int(np.searchsorted(ends, lo + _SLICE, side="right")))
            hi = int(ends[last - 1])
            if hi - lo > len(self.power) - 1:  # one word longer than a slice
                power, inverse = self._powers(self.base, hi - lo), self._powers(self.back, hi - lo)
            else:
                power, inverse = self.power, self.inverse
            sums = np.zeros(hi - lo + 1, _U)
            np.cumsum(self.table[data[lo:hi]] * power[: hi - lo], out=sums[1:])
            a, b = starts[first:last] - lo, ends[first:last] - lo
            out[first:last] = (sums[b] - sums[a]) * inverse[a]
            first = last
        out = mix(out)
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word.lower() if self.lower else word, digest_size=8, salt=self.seed.to_bytes(8, "little")).digest(), "little")
        return out


_FAMILIES: dict[tuple[int, bool], _Family] = {}


def family(seed: int, lower: bool) -> _Family:
    if (seed, lower) not in _FAMILIES:
        _FAMILIES[seed, lower] = _Family(seed, lower)
    return _FAMILIES[seed, lower]


class Words:
    """The words of the rows of one text column.

    ``starts`` and ``ends`` are byte positions in ``data``; row ``i`` has the words
    ``rows[i]:rows[i + 1]``.
    """

    def __init__(self, column: pa.Array, lower: bool = False, between: np.ndarray = SPACE):
        self.data, bounds = text_buffer(column)
        self.lower = lower
        word = ~between[self.data]
        n = len(word)
        breaks = np.zeros(n + 1, bool)
        breaks[bounds] = True
        begins, stops = word.copy(), word.copy()
        if n:
            begins[1:] &= ~word[:-1] | breaks[1:n]
            stops[:-1] &= ~word[1:] | breaks[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.rows = np.searchsorted(self.starts, bounds)
        self.bounds = bounds

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return family(seed, self.lower).hashes(self.data, self.starts, self.ends)

    def affixes(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each word's first and last ``size`` bytes."""
        hashes = family(seed, self.lower).hashes
        return hashes(self.data, self.starts, np.minimum(self.ends, self.starts + size)), hashes(self.data, np.maximum(self.starts, self.ends - size), self.ends)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` words; run ``i`` starts at word ``i``. Row ends are not looked at."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.zeros(n, _U)
    base = (0xD6E8FEB86659FD93 + 4 * seed) & 0xFFFFFFFFFFFFFFFF
    for lo in range(0, n, _SLICE):
        hi = min(n, lo + _SLICE)
        part = np.zeros(hi - lo, _U)
        for k in range(size):
            part *= _U(base)
            part += hashes[lo + k : hi + k]
        out[lo:hi] = mix(part, 17 + seed)
    return out


def pack_marked(values: np.ndarray, marks: np.ndarray) -> bytes:
    """Sorted distinct values and a mark of each: gaps of one byte, larger ones as 255 with 8 bytes or, mostly, 2 aside."""
    gaps = values.copy()
    gaps[1:] -= values[:-1]
    wide = gaps[gaps >= _U(255)]
    wider = wide[wide >= _U(65535)]
    head = np.array([len(gaps), len(wide), len(wider)], "<u8")
    return b"".join(x.tobytes() for x in (head, np.minimum(gaps, _U(255)).astype("u1"), np.minimum(wide, _U(65535)).astype("<u2"), wider.astype("<u8"), np.packbits(marks)))


def unpack_marked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, n_wide, n_wider = np.frombuffer(blob, "<u8", 3).astype(np.int64).tolist()
    gaps = np.frombuffer(blob, "u1", n, 24).astype(_U)
    if n_wide:
        wide = np.frombuffer(blob, "<u2", n_wide, 24 + n).astype(_U)
        if n_wider:
            wide[wide == 65535] = np.frombuffer(blob, "<u8", n_wider, 24 + n + 2 * n_wide)
        gaps[gaps == 255] = wide
    marks = np.unpackbits(np.frombuffer(blob, "u1", offset=24 + n + 2 * n_wide + 8 * n_wider), count=n).astype(bool)
    return np.cumsum(gaps, dtype=_U), marks
