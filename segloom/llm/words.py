"""Words of whole texts as 64-bit hashes, a chunk of documents at a time.

A word is a run of bytes other than U+0020 and U+0009 to U+000D, after lower-casing A-Z.
Its hash is a polynomial over random byte codes modulo 2**64, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def chunks(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters, one text at least."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n + 1
    if lo < len(texts):
        yield lo, len(texts)


def spans(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts, each followed by a line feed; starts and ends of words; word offsets of the texts."""
    parts = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    gap = SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    at = np.zeros(len(parts) + 1, np.int64)
    at[1:] = np.cumsum([len(p) + 1 for p in parts])
    return raw, starts, ends, np.searchsorted(starts, at + 1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    fwd, back = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODE[raw] * fwd[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of each text's words among them."""
    raw, starts, ends, at = spans(texts)
    return span_hashes(raw, starts, ends), at


def shingle_sets(texts: Sequence[str | None], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted set of hashed shingles; a shorter text is one shingle, a text without words none."""
    h, at = word_hashes(texts)
    a = np.uint64(0xD6E8FEB86659FD93)
    rolled = None
    if len(h) >= width:
        rolled = h[: len(h) - width + 1].copy()
        for i in range(1, width):
            rolled = rolled * a + h[i : len(h) - width + 1 + i]
        rolled = mix(rolled)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        n = hi - lo
        if n >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif n:
            acc = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[lo:hi]:
                    acc = acc * a + x
            out.append(mix(np.array([acc], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
