"""Words of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

from .common import mix

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BLANKS = [9, 10, 11, 12, 13, 32]


def word_bytes(punctuation: bool) -> np.ndarray:
    """Which bytes words are made of: all but ASCII white space, or of ASCII only letters and digits."""
    ok = np.ones(256, bool)
    ok[BLANKS] = False
    if not punctuation:
        ok[:128] = [chr(c).isalnum() for c in range(128)]
    return ok


class Words:
    """Words of texts (UTF-8): places in the joined buffer, and the text each belongs to. No word spans two texts."""

    def __init__(self, texts: list[bytes], punctuation: bool = False):
        self.raw = b" ".join(texts) + b" "
        buf = np.frombuffer(self.raw, np.uint8)
        inside = word_bytes(punctuation)[buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.insert(edge, 0, 0)
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_end = np.cumsum(sizes)
        self.owner = np.searchsorted(self.text_end, self.start, "right")
        self.per_text = np.bincount(self.owner, minlength=len(texts))
        power = np.full(len(buf), BASE, np.uint64)
        power[:1] = 1
        power = np.cumprod(power, dtype=np.uint64)
        scrambled = mix(np.arange(1, 257, dtype=np.uint64))
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled[buf] * power, dtype=np.uint64)))
        power = np.full(len(buf), INVERSE, np.uint64)
        power[:1] = 1
        self._shift = np.cumprod(power, dtype=np.uint64)[self.start] if len(self.start) else np.zeros(0, np.uint64)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first bytes."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        return mix((self._sums[end] - self._sums[self.start]) * self._shift)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words inside one text, and their texts. A text with fewer words gives none."""
    h, n = words.hashes(), len(words.owner) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out + h[i : i + n]) * np.uint64(BASE)
        out ^= out >> np.uint64(32)
    same = words.owner[:n] == words.owner[size - 1 :]
    return mix(out[same]), words.owner[:n][same]


def batches(texts: list[bytes], size: int = 1 << 20, rows: int = 1 << 14):
    """(first, last + 1) of runs of texts of about `size` bytes and at most `rows` texts."""
    s = total = 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= size or i + 1 - s >= rows:
            yield s, i + 1
            s, total = i + 1, 0
    if s < len(texts):
        yield s, len(texts)
