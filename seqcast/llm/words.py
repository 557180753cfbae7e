"""Words of whole texts as 64-bit numbers, a column at a time.

Inside a task, all texts of a slice lie in one byte buffer. Words, their hashes and the hashes of word windows come from
a few passes of numpy over that buffer; no Python runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20_240_229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**62)) * 8 + 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Separators of words: space and the control characters 09 to 0D.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Separators of words: every ASCII character but letters and digits.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _powers(base: int, n: int) -> np.ndarray:
    """base ** (0 ... n-1) modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


class _Tables:
    """Powers of the base and of its inverse, grown to the longest slice so far."""

    up = _powers(_BASE, 1 << 16)
    down = _powers(pow(_BASE, -1, 1 << 64), 1 << 16)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix in which every bit depends on all bits of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column without nulls, and where each begins, with the end."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = texts if pa.types.is_large_string(texts.type) else texts.cast(pa.large_string())
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data else np.zeros(0, np.uint8)
    return raw, places - places[0]


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes."""
    n = len(raw)
    up, down = _Tables.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] ^ (end - begin).astype(np.uint64))


class Words:
    """The words of a slice of texts.

    ``begin`` and ``end`` are byte places in ``raw``, ``hash`` the 64-bit hashes, ``doc`` the row of each word, and
    ``first`` the number of the first word of each row, with the number of all words at its end.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = WHITE, lower: bool = False):
        self.raw, self.places = text_bytes(texts)
        n = len(self.raw)
        self.low = _LOWER[self.raw] if lower else self.raw
        inside = ~separators[self.raw]
        before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        before[1:], after[:-1] = inside, inside
        before[self.places], after[self.places] = False, False  # words end where texts end
        self.begin = np.flatnonzero(inside & ~before[:-1])
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.begin, self.places)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.hash = span_hashes(self.low, self.begin, self.end)

    def __len__(self) -> int:
        return len(self.begin)

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words that lie in one text, and the number of each one's first word."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return self.window_hash(at, size, seed), at

    def window_hash(self, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
        """Hashes of the windows of ``size`` words from the words numbered ``at``."""
        factor, total = np.uint64(0x9E3779B97F4A7C15 + 2 * seed), np.zeros(len(at), np.uint64)
        for k in range(size):
            total = total * factor + self.hash[at + k]
        return mixed(total + np.uint64(size))

    def covered(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Which words lie in one of the spans that begin at these words."""
        change = np.zeros(len(self) + 1, np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + size, -1)
        return np.cumsum(change[:-1]) > 0

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many words of each text are marked."""
        sums = np.zeros(len(self) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def text(self, word: int) -> bytes:
        return self.low[self.begin[word] : self.end[word]].tobytes()

    def joined(self, words: np.ndarray) -> list[bytes]:
        """For each text, those of its words that are marked, joined by one space."""
        out, raw = [], self.low.tobytes()
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            at = a + np.flatnonzero(words[a:b])
            out.append(b" ".join([raw[i:j] for i, j in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True)]))
        return out
