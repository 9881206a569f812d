"""Suffix arrays over token ids by prefix doubling, and the parts of a text that recur in other pages; NumPy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def suffix_array(tokens: np.ndarray, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in the order of their first 2**k >= length tokens, and the ranks of their first 1, 2, 4, ... tokens."""
    n, step = len(tokens), 1
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, order = [rank], np.argsort(rank)
    while step < length:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        ranks.append(rank)
        step *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Of each suffix and the next one in order: how many first tokens are equal, up to twice the last step."""
    n = len(order)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        # equal ranks near the end stand for equal, shorter suffixes; no two suffixes are equal
        out += same << k
        a, b = a + (same << k), b + (same << k)
    return out


def _digests(words: list) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(str(w).encode("utf-8", "surrogatepass")) for w in words), np.uint64).reshape(-1, 2)


def _mixed(words) -> list[bytes]:
    """Digests of runs from those of their first words, of their second words, and so on."""
    out = np.uint64(0)
    for each in words:
        out = out * _MIX[0] + each
        out = (out ^ (out >> np.uint64(30))) * _MIX[1]
        out = (out ^ (out >> np.uint64(27))) * _MIX[2]
        out = out ^ (out >> np.uint64(31))
    raw = out.tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def run_keys(pages: list[list[str]], least: int) -> list[list[bytes]]:
    """The digests of each page's runs in order, those of Windows.keys."""
    ids: dict[str, int] = {}
    flat = [ids.setdefault(w, len(ids)) for p in pages for w in p]
    n, keys, out, at = len(flat) - least + 1, [], [], 0
    if n > 0:
        each = _digests([*ids])[flat]
        keys = _mixed(each[k : k + n] for k in range(least))
    for p in pages:  # without the runs that cross an end
        out.append(keys[at : at + max(0, len(p) - least + 1)])
        at += len(p)
    return out


@dataclass
class Windows:
    """All runs of ``least`` tokens within pages, by the suffix array of the pages' stream.

    starts: where each stands in the stream, in the order of the array; run: the number of its class of equal runs;
    pages: of each class, on how many pages it stands; at: one place of each class.
    """

    sizes: list[int]
    least: int
    words: list
    tokens: np.ndarray
    starts: np.ndarray
    run: np.ndarray
    pages: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, pages: list[list], least: int) -> Windows:
        sizes = [len(p) for p in pages]
        ids: dict = {}
        stream = []
        for i, tokens in enumerate(pages):  # a token of its own ends each page
            stream += [ids.setdefault(t, len(ids)) for t in tokens]
            stream.append(-1 - i)
        tokens, page = np.array(stream, np.int64), np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64) + 1)
        whole = np.repeat(np.cumsum(np.array(sizes, np.int64) + 1), np.array(sizes, np.int64) + 1) - np.arange(len(tokens)) > least
        if not whole.any():
            none = np.empty(0, np.int64)
            return cls(sizes, least, list(ids), tokens, none, none, none, none)
        order, ranks = suffix_array(tokens, least)
        new = np.concatenate([[True], common_prefixes(order, ranks) < least])
        keep = whole[order]  # a run that crosses an end is a class of its own
        starts, run = order[keep], np.unique(np.cumsum(new)[keep], return_inverse=True)[1]
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        on = np.bincount(np.unique(run * len(sizes) + page[starts]) // len(sizes), minlength=len(first))
        return cls(sizes, least, list(ids), tokens, starts, run, on, starts[first])

    @property
    def many(self) -> np.ndarray:
        """Of each class, whether it stands on two pages."""
        return self.pages > 1

    def keys(self, of: np.ndarray | None = None) -> list[bytes]:
        """A digest of 128 bits of each class's tokens (of: of these classes), the same in every stream."""
        at = self.at if of is None else self.at[of]
        if not len(at):
            return []
        each = _digests(self.words)
        return _mixed(each[self.tokens[at + k]] for k in range(self.least))

    def covered(self, also: np.ndarray | None = None) -> list[np.ndarray]:
        """Of each page's tokens, which lie in a run that stands on two pages, or (also, by class) on a page elsewhere."""
        gone = self.many if also is None else self.many | also
        starts = self.starts[gone[self.run]] if len(self.run) else self.starts
        mark = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + self.least, -1)
        inside, at, out = np.cumsum(mark)[:-1] > 0, 0, []
        for s in self.sizes:
            out.append(inside[at : at + s])
            at += s + 1
        return out


def repeated(pages: list[list], least: int) -> list[np.ndarray]:
    """For each page's tokens, which lie in a run of at least ``least`` tokens that another page has too."""
    return Windows.of(pages, least).covered()
