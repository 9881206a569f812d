"""Elements: sketches as values, with operators. An element is a logical plan of rows (bit) until something is asked.

Unions, intersections and differences only extend the plan; a cardinality, a key or the bytes run it. Keys are computed
when asked for, so the parts of an expression are never serialized.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.consts import TOTAL_BITS
from bitloom.functions.hashing import murmur3, positions
from bitloom.functions.records import from_bytes_of, to_bytes_of
from bitloom.functions.text import DEFAULT, Tokenizer
from bitloom.operators.sketch import atoms, cardinality_of, tz_counts_of


def number_text(x: float) -> str:
    """A number in full, without an exponent, by the fewest digits that give it back: 1234567, 0.1, inf."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    return f"{x:.0f}" if x == int(x) and abs(x) < 2**53 else _plain(repr(float(x)))


def _plain(text: str) -> str:
    """repr()'s digits, the exponent written out."""
    from decimal import Decimal

    text = format(Decimal(text), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


class Element:
    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def from_tokens(cls, spark: SparkSession, tokens) -> Element:
        data = [t if isinstance(t, bytes) else str(t).encode() for t in tokens]
        bits = np.unique(positions(murmur3(data))).tolist() if data else []
        return cls(spark.createDataFrame([(int(b),) for b in bits], "bit int"))

    @classmethod
    def from_column(cls, df: DataFrame, tokens) -> Element:
        """Of all tokens of a column of arrays; nothing is collected."""
        return cls(atoms(df, tokens))

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes) -> Element | None:
        bits = from_bytes_of(data)
        return None if bits is None else cls(spark.createDataFrame([(int(b),) for b in bits if b < TOTAL_BITS], "bit int"))

    @classmethod
    def empty(cls, spark: SparkSession) -> Element:
        return cls(spark.createDataFrame([], "bit int"))

    # what is asked: at most 32,768 numbers reach the driver
    @cached_property
    def bits(self) -> np.ndarray:
        return np.array(sorted(r.bit for r in self.rows.distinct().collect()), np.int32)

    @cached_property
    def _counts(self) -> np.ndarray:
        flags = np.zeros(TOTAL_BITS, np.uint8)
        flags[self.bits] = 1
        return tz_counts_of(np.packbits(flags, bitorder="little")[None])[0]

    @property
    def card(self) -> float:
        return float(cardinality_of(self._counts))

    @property
    def popcount(self) -> int:
        return len(self.bits)

    @property
    def is_empty(self) -> bool:
        return not len(self.bits)

    def to_bytes(self) -> bytes:
        return to_bytes_of(self.bits)

    @cached_property
    def content_hash(self) -> str:
        import hashlib

        return hashlib.sha1(self.to_bytes()).hexdigest()

    @property
    def key(self) -> str:
        return f"h:{self.content_hash}"

    # plans
    def union(self, other: Element) -> Element:
        return Element(self.rows.unionByName(other.rows).distinct())

    def intersection(self, other: Element) -> Element:
        return Element(self.rows.join(other.rows, "bit", "left_semi"))

    def difference(self, other: Element) -> Element:
        return Element(self.rows.join(other.rows, "bit", "left_anti"))

    def symmetric_difference(self, other: Element) -> Element:
        return self.difference(other).union(other.difference(self))

    # measures
    def jaccard(self, other: Element) -> float:
        whole = self.union(other).card
        return self.intersection(other).card / whole if whole else 1.0

    def bss_inclusion(self, other: Element) -> float:
        return min(self.intersection(other).card / other.card, 1.0) if other.card else 1.0

    def bss_exclusion(self, other: Element) -> float:
        return min(self.difference(other).card / other.card, 1.0) if other.card else 0.0

    def morph_to(self, other: Element, tau_min: float, rho_max: float) -> dict:
        tau, rho = self.bss_inclusion(other), self.bss_exclusion(other)
        return {"inclusion": tau, "exclusion": rho, "holds": tau >= tau_min and rho <= rho_max}

    def approx_eq(self, other: Element, tau: float) -> bool:
        return self.morph_to(other, tau, 0.0)["holds"] and other.morph_to(self, tau, 0.0)["holds"]

    def is_subset_of(self, other: Element) -> bool:
        return not len(np.setdiff1d(self.bits, other.bits))

    def is_superset_of(self, other: Element) -> bool:
        return other.is_subset_of(self)

    def __len__(self) -> int:
        return int(self.card)

    def __add__(self, other: Element) -> Element:
        return self.union(other)

    def __mul__(self, other: Element) -> Element:
        return self.intersection(other)

    def __sub__(self, other: Element) -> Element:
        return self.difference(other)

    def __eq__(self, other) -> bool:
        return isinstance(other, Element) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)

    def __bool__(self) -> bool:
        return True

    def __str__(self) -> str:
        return f"Element({self.key}, card={number_text(self.card)})"


class Session:
    """What the script surfaces call: elements, and a store for them."""

    def __init__(self, spark: SparkSession, storage=None):
        from bitloom.sources.store import MemoryStore

        self.spark, self.storage, self.named = spark, storage or MemoryStore(), {}

    def inscribe(self, values) -> Element:
        """Of strings and numbers; anything else is skipped."""
        show = lambda v: number_text(v) if isinstance(v, float) else str(v)
        return Element.from_tokens(self.spark, [v if isinstance(v, (str, bytes)) else show(v) for v in values if isinstance(v, (str, bytes, int, float)) and not isinstance(v, bool)])

    def empty(self) -> Element:
        return Element.empty(self.spark)

    def tokenize(self, text: str, tokenizer: Tokenizer = DEFAULT) -> Element:
        return Element.from_tokens(self.spark, tokenizer.apply(text))

    def store(self, e: Element) -> str:
        self.storage.put(e.key, e.to_bytes())
        return e.key

    def load(self, key: str) -> Element | None:
        data = self.storage.get(key)
        if data is None:
            return None
        e = Element.from_bytes(self.spark, data)
        if e is None:
            raise ValueError(f"{key}: not the bytes of a sketch")
        return e


    def eval(self, source: str):
        """What a postfix program leaves on top of the stack; None of nothing."""
        stack = self.exec(source)
        return stack[-1] if stack else None

    def exec(self, source: str) -> list:
        """The whole stack after a postfix program."""
        from bitloom.plans.forth import Interpreter

        return Interpreter(self).run(source)

    def eval_element(self, source: str) -> Element:
        """The element on top of the stack; an error where there is none."""
        top = self.eval(source)
        if not isinstance(top, Element):
            raise ValueError("the program leaves no element")
        return top


class Worker:
    """A store's sketches by key. Its errors count as absence."""

    def __init__(self, session: Session):
        self.session = session

    def load(self, key: str) -> Element | None:
        try:
            return self.session.load(key)
        except Exception:  # noqa: BLE001
            return None

    def inscribe(self, tokens) -> str:
        return self.session.store(self.session.inscribe(tokens))

    def has_resource(self, key: str) -> bool:
        return self.session.storage.has(key)

    def bss_inclusion(self, a: str, b: str) -> float | None:
        x, y = self.load(a), self.load(b)
        return None if x is None or y is None else x.bss_inclusion(y)
