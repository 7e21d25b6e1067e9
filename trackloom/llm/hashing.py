"""Word and window hashes of whole Arrow columns of text, in numpy.

A word's hash is a polynomial over its bytes, each replaced by a random number, modulo 2**64; words
are found at all places at once through a prefix sum. A window's hash is a polynomial over its
words' hashes. Words are runs of bytes other than U+0009 to U+000D and U+0020 (or other ``breaks``), within one document.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text hashed at a time.
SLICE = 1 << 20
BASE = U(0x9E3779B97F4A7C13)  # odd, and 3 modulo 4
INVERSE = U(pow(int(BASE), -1, 1 << 64))
LENGTH = U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
BYTES = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
#: Breaks of terms rather than words: every ASCII character that is no letter or digit.
TERM_BREAKS = np.zeros(256, bool)
TERM_BREAKS[:128] = [not chr(c).isalnum() for c in range(128)]


_POWERS = [np.ones(0, U), np.ones(0, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; a worker keeps one table of each."""
    if n > len(_POWERS[0]):
        up, down = np.full(n, BASE, U), np.full(n, INVERSE, U)
        up[0] = down[0] = 1
        _POWERS[:] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _POWERS[0], _POWERS[1]


class Words:
    """hash and doc (row) of every word of an Arrow text column, and the number of words of each row (``counts``)."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, fold_case: bool = False, breaks: np.ndarray = SPACES) -> None:
        self.breaks = breaks
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string())
        n = len(texts)
        _, at, data = texts.buffers()
        self.offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        table = FOLDED if fold_case else BYTES
        parts = [self._piece(*p, table) for p in self._pieces()]
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        self.hash, self.doc = join(0, U), join(1, np.int32)
        self.counts = np.bincount(self.doc, minlength=n) if n else np.zeros(0, np.int64)

    def _boundary(self, a: int, b: int, last: bool) -> int:
        """The last, or first, place in (a, b] where no word goes on: behind a white space, or between documents; -1 if there is none."""
        gaps = np.flatnonzero(self.breaks[self.data[a:b]])
        cuts = self.offsets[np.searchsorted(self.offsets, a, "right") : np.searchsorted(self.offsets, b, "right")]
        found = [int(x[-1 if last else 0]) + more for x, more in ((gaps, a + 1), (cuts, 0)) if len(x)]
        return -1 if not found else max(found) if last else min(found)

    def _pieces(self):
        """Runs of bytes [a, b) that hold whole words, of at most ``SLICE`` bytes but for a single longer word."""
        a, end = int(self.offsets[0]), int(self.offsets[-1])
        while a < end:
            b = min(a + SLICE, end)
            if b < end:
                cut = self._boundary(a, b, True)
                while cut < 0:
                    low, b = b, min(b + SLICE, end)
                    cut = b if b == end and self._boundary(low, b, False) < 0 else self._boundary(low, b, False)
                b = cut
            yield a, b
            a = b

    def _piece(self, a: int, b: int, table: np.ndarray):
        raw = self.data[a:b]
        n = b - a
        if n > SLICE:  # one word, and perhaps the white space behind it
            n -= int(self.breaks[raw[-1]])
            up = _powers(SLICE)[0]
            h, scale = 0, 1
            for k in range(0, n, SLICE):
                part = table[raw[k : min(k + SLICE, n)]]
                h = (h + scale * int((part * up[: len(part)]).sum(dtype=U))) % (1 << 64)
                scale = scale * pow(int(BASE), SLICE, 1 << 64) % (1 << 64)
            h = mixed(np.array([h], U) + np.array([n], U) * LENGTH)
            return h, np.searchsorted(self.offsets, [a], "right").astype(np.int32) - 1
        lo = int(np.searchsorted(self.offsets, a, "right")) - 1
        inside = self.offsets[lo : int(np.searchsorted(self.offsets, b, "left")) + 1]
        space = self.breaks[raw]
        apart = np.ones(n + 1, bool)  # nothing of a word lies on both sides of this place
        apart[1:n] = space[:-1] | space[1:]
        apart[inside[(inside >= a) & (inside <= b)] - a] = True
        start = np.flatnonzero(~space & apart[:-1])
        end = np.flatnonzero(~space & apart[1:]) + 1
        up, down = _powers(SLICE)
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum(table[raw] * up[:n], out=sums[1:])
        h = (sums[end] - sums[start]) * down[start]
        h = mixed(h + (end - start).astype(U) * LENGTH)
        doc = np.searchsorted(inside, start + a, "right") - 1 + lo
        return h, doc.astype(np.int32)


def windows(words: Words, width: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that starts at each word, and whether it lies in one document. Both may be shorter than the words."""
    n = len(words.hash) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    out = np.full(n, U(lane + 1), U)
    step = U(0xC2B2AE3D27D4EB4F + 2 * lane)
    for k in range(width):
        out *= step
        out += words.hash[k : k + n]
    return mixed(out), words.doc[:n] == words.doc[width - 1 :]


def released() -> None:
    """Gives memory that this worker has freed back to the system: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def first_of_runs(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out
