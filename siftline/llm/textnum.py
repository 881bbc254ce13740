"""Words of many texts at once, as numbers.

A batch of texts is one buffer of UTF-8 bytes with a newline between texts. Words are maximal runs of
bytes other than ASCII white space; each gets a 64-bit hash from one running sum over the buffer, so
the cost is a few nanoseconds a byte and no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed in one go; longer texts go piece by piece, cut at white space.
PIECE = 1 << 18

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_TABLE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        fill = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
        _powers[:] = [fill(_BASE), fill(inverse)]
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of one buffer: start, end (exclusive), 64-bit hash; ``raw`` has the bytes as they were."""

    def __init__(self, raw: np.ndarray, lower: bool = True):
        self.raw = raw
        parts = list(self._pieces(raw, lower))
        self.start, self.end, self.hash = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, np.uint64)))

    def _pieces(self, raw: np.ndarray, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = 0
        while at < len(raw):
            to = min(at + PIECE, len(raw))
            while to < len(raw) and not _SPACE[raw[to]]:  # to the end of the word
                more = np.flatnonzero(_SPACE[raw[to : to + PIECE]])
                to = to + int(more[0]) if len(more) else min(to + PIECE, len(raw))
            yield self._hashed(raw[at:to], at, lower)
            at = to

    @staticmethod
    def _edges(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = np.zeros(len(piece) + 2, np.int8)
        word[1:-1] = ~_SPACE[piece]
        step = np.diff(word)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def _hashed(self, piece: np.ndarray, at: int, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, end = self._edges(piece)
        up, down = _power(max(PIECE + 64, len(piece) + 1))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_TABLE[_LOWER[piece] if lower else piece] * up[: len(piece)], out=total[1:])
        return start + at, end + at, mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def batches(texts: list[str | None], limit: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, buffer, offsets of its texts and of the end): runs of texts of about ``limit`` bytes."""
    at = 0
    while at < len(texts):
        parts, size, k = [], 0, at
        while k < len(texts) and (k == at or size < limit):
            parts.append((texts[k] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            k += 1
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
        yield at, np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), offsets
        at = k


def owner(words: Words, offsets: np.ndarray) -> np.ndarray:
    """For each text of a batch the number of its first word; one more entry for the end."""
    return np.searchsorted(words.start, offsets)
