"""Word-shingle sets of whole texts, in numpy inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: Fixed odd multipliers of the hash mixes.
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words: runs of characters other than space, tab, newline, VT, FF and CR."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; with fewer words one of all; without words none."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    m = min(k, len(w))
    n = len(w) - m + 1
    acc = np.full(n, m, np.uint64)
    for j in range(m):
        acc = (acc ^ h[j : j + n]) * P1
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set that don't depend on its order, as signed integers."""
    mixed = (s ^ (s >> np.uint64(31))) * P2
    mixed ^= mixed >> np.uint64(33)
    a = np.add.reduce(mixed, dtype=np.uint64)
    b = np.bitwise_xor.reduce(mixed * P3, dtype=np.uint64) if len(s) else np.uint64(0)
    return int(np.int64(a.view(np.int64))), int(np.int64(np.uint64(b).view(np.int64)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


class Seeds:
    """Seed keys of a set: under each of `bands` random orders of all shingles, the first shingles of the set
    under `rows` sub-orders, hashed together."""

    def __init__(self, bands: int, rows: int, seed: int = 20240229) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.c = (rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.tag = rng.integers(0, 1 << 62, bands, dtype=np.uint64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            v = x[None, i : i + 2048] * self.a
            v ^= v >> np.uint32(15)
            v *= self.c
            np.minimum(least, v.min(axis=1), out=least)
        key = self.tag.copy()
        for m in least.reshape(self.bands, self.rows).T.astype(np.uint64):
            key = (key ^ m) * P1
            key ^= key >> np.uint64(32)
        return key.view(np.int64)
