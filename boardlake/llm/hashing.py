"""Hashes of words and of runs of words for whole batches of texts, in NumPy.

Words are runs of bytes other than the six ASCII spaces. The hash of a word does not depend on
where it stands, so long texts are worked through in pieces cut at spaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

PIECE_BYTES = 1 << 20
_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit mix of each value."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_BYTES = splitmix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < size:
        steps = np.full(max(size, PIECE_BYTES + 1), base, _U)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if size <= 4 * PIECE_BYTES:
            _powers[base] = held
    return held[:size]


def _pieces(data: bytes) -> Iterator[bytes]:
    """Stretches of about PIECE_BYTES that end with a space or with the data."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + PIECE_BYTES)
        while stop < len(data) and not _SPACE[data[stop - 1]]:
            stop += 1
        yield data[at:stop]
        at = stop


def _word_hashes(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a stretch."""
    raw = np.frombuffer(piece, np.uint8)
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTES[raw] * _power(_R, len(raw)), out=sums[1:])
    plain = (sums[ends] - sums[starts]) * _power(_R_INVERSE, len(raw) + 1)[starts]
    return starts, splitmix(plain + (ends - starts).astype(_U) * _U(0xA0761D6478BD642F))


def batches_of_words(texts: Iterable[str | None], lower: bool = True) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; null texts have none. A-Z are lower-cased first."""
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        data = b" ".join(held)
        bounds = np.cumsum([0] + [len(b) + 1 for b in held])
        found, offset = [], 0
        for piece in _pieces(data):
            starts, hashes = _word_hashes(piece)
            found.append((starts + offset, hashes))
            offset += len(piece)
        starts = np.concatenate([s for s, _ in found]) if found else np.zeros(0, np.int64)
        hashes = np.concatenate([h for _, h in found]) if found else np.zeros(0, _U)
        cuts = np.searchsorted(starts, bounds)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield hashes[a:b]

    for text in texts:
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        held.append(raw.lower() if lower else raw)  # bytes.lower() changes A-Z alone
        size += len(raw) + 1
        if size >= PIECE_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def shingle_set(words: np.ndarray, length: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the runs of ``length`` words; all words as one run if fewer."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    size = min(n, length)
    h = np.full(n - size + 1, size, _U)
    for k in range(size):
        h = h * _U(0x9FB21C651E98DF25) + words[k : n - size + 1 + k]
    return np.unique(splitmix(h) >> _U(1)).astype(np.int64)


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
