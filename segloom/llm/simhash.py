"""SimHash: hashed terms vote with their weights on signed bits."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np

from segloom.llm.words import mix

_SIGNS = ((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2.0 - 1.0
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_SECOND = np.uint64(0xA0761D6478BD642F)


def word_terms(hashes: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and weight of each term of runs of words; run i has the words at[i] to at[i + 1].

    Terms are pairs of neighbouring words, of weight 1, and words of five bytes or more, weighing up to 1 by length:
    short words are everywhere and tell little.
    """
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, np.int64)
    long = np.flatnonzero(lengths >= 5)
    terms = np.concatenate([mix(hashes[pair] * _PAIR + hashes[pair + 1]), hashes[long]])
    return np.concatenate([owner[pair], owner[long]]), terms, np.concatenate([np.ones(len(pair)), np.minimum(lengths[long], 8) / 8])


def votes(owner: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The sum of signed weights for each of n owners and each bit, from one histogram for each byte of the hashes."""
    out = np.zeros((n, bits))
    base = owner.astype(np.int64) << 8
    for at in range(0, bits, 8):
        if at == 64:
            terms = mix(terms ^ _SECOND)
        byte = ((terms >> np.uint64(at % 64)) & np.uint64(255)).astype(np.int64)
        out[:, at : at + 8] = np.bincount(base + byte, weights=weights, minlength=n << 8).reshape(n, 256) @ _SIGNS
    return out


def signs(total: np.ndarray) -> np.ndarray:
    """Votes as 64-bit words; a tie is 0."""
    return np.packbits(total > 1e-9, axis=1, bitorder="little").view(np.uint64)


def block_keys(words: np.ndarray, blocks: int, width: int, intact: int) -> np.ndarray:
    """A key for each choice of intact blocks: fingerprints that differ in at most blocks - intact bits share one.

    words: n rows of 64-bit words, cut into blocks of width bits (a divisor of 64).
    """
    per = 64 // width
    cut = [(words[:, i // per] >> np.uint64(width * (i % per))) & np.uint64(2**width - 1) for i in range(blocks)]
    out = np.zeros((len(words), 0), np.uint64)
    keys: Sequence[np.ndarray] = []
    for number, chosen in enumerate(combinations(range(blocks), intact)):
        key = np.full(len(words), number + 1, np.uint64)
        for i in chosen:
            key = (key << np.uint64(width)) | cut[i]
        keys.append(key)
    return np.stack(keys, axis=1) if keys else out
