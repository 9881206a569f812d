"""Ids of the byte-level vocabulary, by the fastest of the installed libraries that gives the same ids."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

BYTE_BPE = "byte_bpe_50k"


class Encoder:
    """Encodes with tiktoken; where it fails (a run that its pattern can't take), and for the special token's own
    string, with tokenizers, whose ids are the ones meant. The tests hold both libraries' ids against each other."""

    def __init__(self, name: str = BYTE_BPE, folder: str | None = None):
        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        path = lambda f: f"{folder}/{f}" if folder else str(public.path(f))
        with open(path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = max(ranks.values()) + 1  # the id of <|endoftext|>
        self.lengths = np.zeros(self.special + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self._load = lambda: Tokenizer.from_file(path(f"{name}.json"))
        self._slow = None

    @property
    def slow(self):
        if self._slow is None:
            self._slow = self._load()
        return self._slow

    def ids(self, text: str | None) -> np.ndarray:
        text = text or ""
        if "<|endoftext|>" not in text:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except MemoryError:
                raise
            except Exception:  # a run that its pattern can't take
                pass
            except BaseException as failure:
                if type(failure).__name__ != "PanicException":  # the library's panic, which is no Exception
                    raise
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def encoder(name: str = BYTE_BPE, folder: str | None = None) -> Encoder:
    return Encoder(name, folder)
