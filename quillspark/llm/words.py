"""Words of many texts at once as numpy arrays: where they start and end, and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The six characters [\x20\x09-\x0D] that part words; bytes.split() parts at the same ones.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Every byte that is neither a digit, a letter nor part of a non-ASCII character becomes a space; A-Z becomes a-z.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_AT_ONCE = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def factor(k: int) -> np.uint64:
    """An odd number for the k-th of a row of hashes."""
    return mix(np.array([k + 1], np.uint64) * _ODD)[0] | np.uint64(1)


class Words:
    """Words of a list of UTF-8 texts. doc[i] is the text of word i, start and end its bytes in .data, hash its hash."""

    def __init__(self, texts: list[bytes], normal: bytes | None = None):
        data = b" ".join(texts)
        self.data = data.translate(normal) if normal else data
        self.n_docs = len(texts)
        raw = np.frombuffer(self.data, np.uint8)
        self.raw = raw
        word = np.empty(len(raw) + 2, bool)
        word[0] = word[-1] = False
        np.logical_not(SPACE[raw], out=word[1:-1])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        first = np.searchsorted(self.start, self.text_start)
        self.first = np.append(first, len(self.start)).astype(np.int64)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self._hash = self._check = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self._sums(np.uint64(0))
        return self._hash

    @property
    def check(self) -> np.ndarray:
        """A second hash of each word, of other values."""
        if self._check is None:
            self._check = self._sums(np.uint64(1) << np.uint64(60))
        return self._check

    def _sums(self, salt: np.uint64) -> np.ndarray:
        """Each byte at each place of a word has a value of its own; a word's hash mixes their sum. So no arrangement of
        letters is special, as it is to powers of a base."""
        out = np.zeros(len(self.start), np.uint64)
        for a in range(0, len(self.start), _AT_ONCE):
            start, size = self.start[a : a + _AT_ONCE], self.end[a : a + _AT_ONCE] - self.start[a : a + _AT_ONCE]
            last = np.cumsum(size)
            place = np.arange(last[-1]) - np.repeat(last - size, size)
            byte = self.raw[np.repeat(start, size) + place]
            total = np.zeros(last[-1] + 1, np.uint64)
            np.cumsum(mix(((place.astype(np.uint64) << np.uint64(8)) | byte | salt) * _ODD), out=total[1:])
            out[a : a + _AT_ONCE] = mix(total[last] - total[last - size])
        return out

    def grams(self, k: int, check: bool = False) -> np.ndarray:
        """Hash (or check) of the k words from each word on; runs that leave a text are meaningless, see inside()."""
        h = self.check if check else self.hash
        out = np.zeros(len(h), np.uint64)
        if len(h) >= k:
            n = len(h) - k + 1
            for j in range(k):
                out[:n] += h[j : j + n] * factor(j)
            out[:n] = mix(out[:n])
        return out

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are of one text."""
        left = self.first[1:][self.doc] - np.arange(len(self.doc))
        return left >= k


def parts(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes each; a longer text is a range of its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
