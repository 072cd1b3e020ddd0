"""Hashed word shingles and MinHash signatures of whole texts, vectorised per text."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

WORDS = 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(32)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at space and \\t to \\r; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of n words, in order; none where there are fewer words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    x = np.full(len(hashes) - n + 1, n, np.uint64)
    for j in range(n):
        x = (x ^ (x >> _S)) * _M1 + hashes[j : len(hashes) - n + 1 + j]
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles; with fewer than n words the whole sequence is one; without words, none."""
    h = word_hashes(words_of(text))
    return np.unique(windows(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def permutations(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each permutation of 32 bits over the set; the set must not be empty."""
    x = (shingles >> _S).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (a[:, None] * x[None, at : at + 1024] + b[:, None]).min(axis=1), out=out)
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
