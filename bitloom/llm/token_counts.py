"""Tokens of a document's sections, by offsets: each document is encoded once, whole, and its tokens' character spans are
joined with the sections' intervals.

A token that crosses a boundary is allocated by a rule: ``most`` gives it to the section that holds most of its
characters, ``first`` to one that holds its first character; ties go to the section that begins first, then to the one
that ends first. A token that no section gets counts under the section null. So the counts of a document always add up
to those of its whole text.

Defined results: a null text is empty; a document without sections or tokens gives no rows; sections are half-open, in
code points, and may leave gaps and overlap. Null sections are none; a section that is null, has a null bound or ends where
it begins or before holds nothing and has its row, with 0 tokens. Sections are numbered in the order of their bounds, null
ones last. Texts of any length are encoded whole; rows that repeat an id are counted each; an empty table gives no rows.
Further columns don't pass; an id column named like a result gets an underscore.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bitloom.llm.common import free_name, ship, table
from bitloom.llm.tokenizer import Encoder, encoder

_LINE = re.compile(r"[^\n]*\n|[^\n]+")


def line_sections(text: str) -> list[tuple[int, int]]:
    """The lines of a text, each with the line break that ends it."""
    return [m.span() for m in _LINE.finditer(text)]


def spans(text: str, encode: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in code points, of each token: all characters of which it holds a byte."""
    ids = encode.ids(text)
    raw = np.frombuffer(text.encode(), np.uint8)
    if encode.special in ids:  # the special token's own string stands for itself
        sizes = encode.lengths[ids].copy()
        sizes[ids == encode.special] = len("<|endoftext|>")
    else:
        sizes = encode.lengths[ids]
    ends = np.cumsum(sizes)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    return char[ends - sizes], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str = "most") -> tuple[np.ndarray, int]:
    """Tokens of each section, and those of none; sections in the order of their bounds."""
    if rule not in ("most", "first"):
        raise ValueError(f"no such rule: {rule}")
    if any(e <= s for s, e in sections) or any(b[0] < a[1] for a, b in zip(sections, sections[1:])):
        return _allocate_any(starts, ends, sections, rule)
    n = len(sections)
    low, high = (np.array(x, np.int64) for x in zip(*sections)) if n else (np.empty(0, np.int64),) * 2
    first, last = np.searchsorted(high, starts, "right"), np.searchsorted(low, ends, "left") - 1
    owner = np.where(first <= last, first, n)
    if rule == "most":
        for i in np.flatnonzero(first < last):  # the few that cross
            held = np.minimum(high[first[i] : last[i] + 1], ends[i]) - np.maximum(low[first[i] : last[i] + 1], starts[i])
            owner[i] = first[i] + int(held.argmax())
    else:
        inside = owner < n
        owner[inside] = np.where(low[owner[inside]] <= starts[inside], owner[inside], n)
    counts = np.bincount(owner, minlength=n + 1)
    return counts[:n], int(counts[n])


def _allocate_any(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str) -> tuple[np.ndarray, int]:
    """The same for sections that overlap or are empty: each claims the tokens that it touches, where it holds more."""
    n = len(sections)
    owner, held = np.full(len(starts), n), np.zeros(len(starts), np.int64)
    for i, (low, high) in enumerate(sections):
        if high <= low:
            continue
        part = slice(int(np.searchsorted(ends, low, "right")), int(np.searchsorted(starts, high, "left")))
        if rule == "most":
            mine = np.minimum(high, ends[part]) - np.maximum(low, starts[part])
        else:
            mine = ((low <= starts[part]) & (starts[part] < high)).astype(np.int64)
        better = mine > held[part]
        owner[part][better] = i
        held[part][better] = mine[better]
    counts = np.bincount(owner, minlength=n + 1)
    return counts[:n], int(counts[n])


def _bounds(sections: list | None) -> list[tuple]:
    """(start, end) of given sections in order; null ones last."""
    given = [(None, None) if s is None else (s["start"], s["end"]) for s in sections or []]
    return sorted(given, key=lambda b: (None in b, b[0] is None, b[0] or 0, b[1] is None, b[1] or 0))


def _counter(sectioned: bool, rule: str, folder: str | None, names: list[str]):
    def run(batches):
        encode = encoder(folder=folder)
        for batch in batches:
            out = [[] for _ in range(5)]
            given = batch.column(2).to_pylist() if sectioned else [None] * batch.num_rows
            for id, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), given):
                text = text or ""
                own = _bounds(own) if sectioned else line_sections(text)
                real = [(0, 0) if None in b else b for b in own] if sectioned else own
                counts, none = allocate(*spans(text, encode), real, rule) if text else (np.zeros(len(own), int), 0)
                rows = [(id, k, s, e, int(c)) for k, ((s, e), c) in enumerate(zip(own, counts))] + [(id, None, None, None, none)] * (none > 0)
                for column, values in zip(out, zip(*rows)):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in out[1:])], names)

    return run


def count_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "most", folder: str | None = None) -> DataFrame:
    """(id, section, start, end, n_tokens). sections: a column of arrays of (start, end); without it, the text's lines."""
    ship(docs.sparkSession)
    names = ["section", "start", "end", "n_tokens"]
    names = [free_name(id, names), *names]
    schema = T.StructType([T.StructField(names[0], docs.schema[id].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])])
    return docs.select(id, text, *([sections] if sections else [])).mapInArrow(_counter(bool(sections), rule, folder, names), schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
