"""Array kernels over the words of a batch of texts: spans, hashes, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are worked on in groups of about this many bytes; a longer text is a group by itself.
GROUP_BYTES = 1 << 20
_BASE, _STEP = U(0x9E3779B97F4A7C55), U(0xD6E8FEB86659FD93)
_STEP_INV = U(pow(int(_STEP), -1, 1 << 64))

SPACE_BYTES = np.ones(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, letters and everything beyond ASCII.
LETTER_BYTES = np.zeros(256, bool)
LETTER_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of SplitMix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    def __init__(self, base: np.uint64):
        self.base, self.table = base, np.ones(1, U)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            size = max(n, 2 * len(self.table), 1 << 10)
            t = np.full(size, self.base, U)
            t[0] = 1
            self.table = np.cumprod(t)
        return self.table[:n]


_BYTE_POWERS, _STEP_POWERS, _STEP_INV_POWERS = _Powers(_BASE), _Powers(_STEP), _Powers(_STEP_INV)


class Words:
    """The words of some texts laid end to end: byte spans, hashes, and where each text's words begin."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = SPACE_BYTES):
        self.buf, self.offsets = buf, offsets
        w = word_bytes[buf]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        filled = offsets[1:] > offsets[:-1]
        at, to = offsets[:-1][filled], offsets[1:][filled] - 1
        first[at], last[to] = w[at], w[to]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)
        lengths = self.ends - self.starts
        n = len(lengths)
        if n:
            before = np.concatenate([[0], np.cumsum(lengths)])
            place = np.arange(before[-1]) - np.repeat(before[:-1], lengths)
            terms = (buf[w].astype(U) + U(1)) * _BYTE_POWERS.upto(int(lengths.max()))[place]
            self.hashes = mix(np.add.reduceat(terms, before[:-1]) ^ (lengths.astype(U) << U(48)))
        else:
            self.hashes = np.zeros(0, U)

    def __len__(self) -> int:
        return len(self.hashes)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on (those that pass the end of the array are left out)."""
        g, m = self.hashes, len(self.hashes) - n + 1
        if m <= 0:
            return np.zeros(0, U)
        out, done, power, width = np.zeros(m, U), 0, g, 1
        step = _STEP
        while True:  # binary powers of the window's length
            if n & width:
                out = out * step + power[done : done + m]
                done += width
            if done == n:
                return mix(out)
            power = power[:-width] * step + power[width:]
            step, width = U(int(step) ** 2 % (1 << 64)), 2 * width

    def inside(self, n: int) -> np.ndarray:
        """For each word: do n words from it on lie in its text?"""
        ends = np.repeat(self.first[1:], self.counts())
        return np.arange(len(self)) + n <= ends

    def span_hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences [lo, hi)."""
        n = len(self)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(self.hashes * _STEP_POWERS.upto(n))]) if n else np.zeros(1, U)
        return mix((sums[hi] - sums[lo]) * _STEP_INV_POWERS.upto(n + 1)[lo]) ^ mix((hi - lo).astype(U))


def text_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets into them. Nulls count as empty."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n, at = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[at : at + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows [i, j) of about GROUP_BYTES: i, j, bytes, offsets."""
    buf, offsets = text_array(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` neighbours stands, the leftmost of equals.

    Values are compared by their upper 36 bits, which leaves 28 for the place.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(values) >= 1 << 28:
        raise ValueError("a text of 2^28 words or more")
    best = (values & ~U((1 << 28) - 1)) | np.arange(len(values), dtype=U)
    span = 1
    while 2 * span <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    best = np.minimum(best[:n], best[width - span : width - span + n])
    return (best & U((1 << 28) - 1)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
