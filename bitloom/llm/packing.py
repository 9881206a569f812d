"""Lexical retrieval packing: windows filled with a seed document and its nearest unused neighbours under BM25.

Each task reads its documents once, in shards of about SHARD_TOKENS tokens. A shard has an inverted index of its own; a
window's seed, the document it begins with, asks it by all of its terms for unused neighbours, which fill the window in
the order of their scores until none are left; then the next row is placed and asks. A cut document seeds the next window. The open window is carried from shard to shard; at a
task's end it is dealt out over sequences whose lengths are powers of two. So nothing is padded, and nothing shuffled.

Defined results: a null text is empty, and an empty text has one token, the final id 0. Ties go to the earlier row;
repeated rows are packed each; a text of any length is cut into windows; an empty table gives no rows. Sequence ids are
(partition, number) in one long. Further columns don't pass; an id column named like a result gets an underscore.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bitloom.llm.common import free_name, ship, table
from bitloom.llm.tokenizer import encoder

WINDOW, SHARD_TOKENS, END = 1024, 1_000_000, 0
K1, B = 1.2, 0.75


class Index:
    """BM25 over the documents of one shard; rows of an id's postings stand together."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        terms, counts = zip(*(np.unique(d[:-1], return_counts=True) for d in docs)) if n else ((), ())
        sizes = np.fromiter(map(len, terms), np.int64, n)
        term, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        length = np.fromiter(map(len, docs), np.float32, n)
        order = np.argsort(term, kind="stable")
        self.doc, tf = doc[order], tf[order]
        self.vocabulary, self.first, df = np.unique(term[order], return_index=True, return_counts=True)
        self.end = self.first + df
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / max(1.0, float(length.mean()))))
        self.n, self.unused = n, np.ones(n, bool)
        # terms in more than an eighth of the documents have a row each: 32 bytes a posting at most
        often = np.flatnonzero(df > n / 8)
        self.row = np.full(len(df), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n), np.float32)
        for row, i in enumerate(often):
            self.dense[row, self.doc[self.first[i] : self.end[i]]] = self.weight[self.first[i] : self.end[i]]

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Of every document under all the terms; 0 for the used ones."""
        at = np.searchsorted(self.vocabulary, terms)
        at[at == len(self.vocabulary)] = 0
        at = at[self.vocabulary[at] == terms] if len(self.vocabulary) else at[:0]
        rows = self.row[at]
        score = self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float64)
        at = at[rows < 0]
        if len(at):
            first, size = self.first[at], self.end[at] - self.first[at]
            spans = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            score += np.bincount(self.doc[spans], self.weight[spans], self.n)
        return score * self.unused

    def ranked(self, terms: np.ndarray):
        """The unused documents that share a term, the best first; only as many are sorted as are asked for."""
        score, some = self.scores(terms), 16
        left = np.flatnonzero(score > 0)
        while len(left):
            of = score[left]
            least = np.partition(of, len(left) - some)[len(left) - some] if len(left) > some else 0.0
            best, left = left[of >= least], left[of < least]
            yield from best[np.lexsort((best, -score[best]))].tolist()
            some *= 4

    def neighbours(self, terms: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """All that ranked() has. A term counts once, however often (counts) the asking document has it."""
        return np.array(list(self.ranked(terms)), np.int64)


class Packer:
    """Windows of one task. place() is told documents in their final order."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.fill, self.rows = window, first_sequence, 0, []
        self.open: list[tuple] = []  # pieces of the open window

    def place(self, handle, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            n = min(len(ids) - start, self.window - self.fill)
            self.open.append((handle, start, ids[start : start + n], len(ids)))
            start, self.fill = start + n, self.fill + n
            if self.fill == self.window:
                self._close(self.open)
                self.open, self.fill = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for handle, start, ids, total in pieces:
            self.rows.append((handle, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """The open window, dealt out over sequences of 512, 256, ... tokens as its length in binary says."""
        rest, size = self.open, self.window // 2
        left = self.fill
        while left:
            if left < size:
                size //= 2
                continue
            part, room = [], size
            while room:
                handle, start, ids, total = rest[0]
                n = min(room, len(ids))
                part.append((handle, start, ids[:n], total))
                rest = ([(handle, start + n, ids[n:], total)] if n < len(ids) else []) + rest[1:]
                room -= n
            self._close(part)
            left -= size
        self.open, self.fill = [], 0


def pack_shard(docs: list[np.ndarray], handles: list, packer: Packer, seed: np.ndarray | None = None) -> np.ndarray | None:
    """Places all documents of a shard; seed: the document that the open window asks. That of the window left open."""
    index, next_row = Index(docs), 0
    queue = None
    while True:
        k = None
        if packer.fill and seed is not None:
            queue = queue or index.ranked(np.unique(seed[:-1]))
            k = next(queue, None)
        if k is None:  # a new window, or the seed has no neighbours left
            while next_row < len(docs) and not index.unused[next_row]:
                next_row += 1
            if next_row == len(docs):
                return seed
            k = next_row
            seed, queue = docs[k], None
        index.unused[k] = False
        before = packer.sequence
        packer.place(handles[k], docs[k])
        if packer.sequence != before:
            seed, queue = docs[k], None  # what is left of it seeds the next window


def _packing(at_id: int, at_text: int, window: int, names: list[str], folder: str | None):
    def run(batches):
        encode = encoder(folder=folder).ids
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        docs, handles, size, seed, id_type = [], [], 0, None, pa.int64()

        def out():
            cols = list(zip(*packer.rows)) or [()] * len(names)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for batch in batches:
            id_type = batch.schema.field(at_id).type
            for handle, text in zip(batch.column(at_id), batch.column(at_text)):
                docs.append(np.append(encode(text.as_py()), np.uint32(END)))
                handles.append(handle.as_py())
                size += len(docs[-1])
                if size >= SHARD_TOKENS:
                    seed = pack_shard(docs, handles, packer, seed)
                    docs, handles, size = [], [], 0
                    yield out()
        if docs:
            pack_shard(docs, handles, packer, seed)
        packer.finish()
        yield out()

    return run


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, folder: str | None = None) -> DataFrame:
    """Pieces of documents in sequences: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    ship(docs.sparkSession)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names = [free_name(id, names), *names]
    schema = T.StructType([T.StructField(names[0], docs.schema[id].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])])
    return docs.select(id, text).mapInArrow(_packing(0, 1, window, names, folder), schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
