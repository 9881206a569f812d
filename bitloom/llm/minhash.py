"""Shingles, signatures and the sequential Bayesian comparison of signatures; NumPy only, no Spark."""

from __future__ import annotations

from math import comb

import numpy as np
import xxhash

N_HASHES, ROWS, BATCH = 128, 4, 16
BANDS = N_HASHES // ROWS
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.Generator(np.random.PCG64(20240229))
_MUL = _rng.integers(1, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, N_HASHES, dtype=np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str | None) -> list[bytes]:
    """The words of a text, A to Z in lower case (bytes.split splits at space and U+0009 to U+000D, and at nothing else)."""
    return text.encode().translate(_LOWER).split() if text else []


def shingles(text: str | None, k: int) -> set[bytes]:
    """The distinct runs of k words; with fewer words, all of them as one; none without words."""
    w = words(text)
    if not w:
        return set()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """64-bit hashes of shingles(text, k), sorted, without repeats."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - k + 1)
    out = np.full(n, len(w) if len(w) < k else 0, np.uint64)
    for i in range(min(k, len(w))):
        out = _mixed(out * _MIX[0] + h[i : i + n])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value under each of N_HASHES multiply-shift hashes, 32 bits each."""
    out = np.full(N_HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(hashes), 4096):
        x = hashes[i : i + 4096, None] * _MUL + _ADD
        out = np.minimum(out, (x >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature: (n, N_HASHES) to (n, BANDS)."""
    x = sigs.reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sigs), BANDS)).copy()
    for i in range(ROWS):
        out = _mixed(out * _MIX[0] + x[:, :, i])
    return out.view(np.int64)


def fewest_matches(threshold: float, miss: float) -> np.ndarray:
    """For 1, 2, ... batches of BATCH hashes: with fewer equal ones, the similarity reaches the threshold with a
    posterior probability below miss (uniform prior, so Beta(m + 1, n - m + 1) after m of n)."""
    out = []
    for n in range(BATCH, N_HASHES + 1, BATCH):
        tail, m = 0.0, -1  # P(similarity >= threshold | m of n) = P(Binomial(n + 1, threshold) <= m)
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, fewest: np.ndarray) -> np.ndarray:
    """Which pairs of signatures (n, N_HASHES) pass every batch; a pruned pair is not compared any further."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(fewest):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def near(a: str | None, b: str | None, k: int, percent: int) -> bool:
    """Whether the full sets of shingles have 100 * common >= percent * union; an empty set is near nothing."""
    x, y = shingles(a, k), shingles(b, k)
    common = len(x & y)
    return bool(common) and 100 * common >= percent * (len(x) + len(y) - common)
