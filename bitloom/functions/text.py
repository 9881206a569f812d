"""Patterns, normalizers and the tokenizer.

A Pattern matches bytes, greedily and without ever giving back. It compiles to a Java regular expression of possessive
and atomic parts; where its sets are ASCII and it takes no complement of them, the tokenizer stays in built-in
functions, else it runs the matcher itself over Arrow batches (a complement takes single bytes of a character).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.consts import EOS, LOWER, UPPER, WORD_PATTERN

_SPACE = " \t\n\x0c\r"


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    captures: tuple[tuple[int, int], ...] = ()


@dataclass(frozen=True)
class Pattern:
    """kind: literal, any, notany, span, break, arb, cat, alt or capture."""

    kind: str
    data: bytes = b""
    parts: tuple[Pattern, ...] = ()

    @staticmethod
    def literal(s: bytes) -> Pattern:
        return Pattern("literal", s)

    @staticmethod
    def any(s: bytes) -> Pattern:
        return Pattern("any", s)

    @staticmethod
    def notany(s: bytes) -> Pattern:
        return Pattern("notany", s)

    @staticmethod
    def span(s: bytes) -> Pattern:
        return Pattern("span", s)

    @staticmethod
    def break_(s: bytes) -> Pattern:
        return Pattern("break", s)

    @staticmethod
    def arb() -> Pattern:
        return Pattern("arb")

    def cat(self, other: Pattern) -> Pattern:
        return Pattern("cat", parts=(self, other))

    def alt(self, other: Pattern) -> Pattern:
        return Pattern("alt", parts=(self, other))

    def capture(self) -> Pattern:
        return Pattern("capture", parts=(self,))

    def _end(self, s: bytes, at: int, captures: list) -> int | None:
        """Where the match that begins at ``at`` ends. Captures are added inner ones first."""
        if self.kind == "literal":
            return at + len(self.data) if s.startswith(self.data, at) else None
        if self.kind in ("any", "notany"):
            return at + 1 if at < len(s) and (s[at] in self.data) == (self.kind == "any") else None
        if self.kind in ("span", "break"):
            end = at
            while end < len(s) and (s[end] in self.data) == (self.kind == "span"):
                end += 1
            return None if self.kind == "span" and end == at else end
        if self.kind == "arb":
            return len(s)
        if self.kind == "cat":
            middle = self.parts[0]._end(s, at, captures)
            return None if middle is None else self.parts[1]._end(s, middle, captures)
        if self.kind == "alt":
            for part in self.parts:
                kept = len(captures)
                if (end := part._end(s, at, captures)) is not None:
                    return end
                del captures[kept:]
            return None
        end = self.parts[0]._end(s, at, captures)
        if end is not None:
            captures.append((at, end))
        return end

    def match_at(self, s: bytes, at: int = 0) -> Match | None:
        captures: list = []
        end = self._end(s, at, captures)
        return None if end is None else Match(at, end, tuple(captures))

    def find(self, s: bytes, at: int = 0) -> Match | None:
        """The first match at or after ``at``."""
        return next((m for i in range(at, len(s) + 1) if (m := self.match_at(s, i))), None)

    def find_all(self, s: bytes, at: int = 0) -> list[Match]:
        """Matches that do not overlap; after an empty one the search goes on a byte further."""
        out = []
        while at <= len(s) and (m := self.find(s, at)):
            out.append(m)
            at = m.end if m.end > m.start else m.end + 1
        return out

    @property
    def plain(self) -> bool:
        """Whether the regular expression takes the same text as the matcher, whatever the text."""
        return self.kind in ("literal", "any", "span", "cat", "alt", "capture") and all(b < 128 for b in self.data) and all(p.plain for p in self.parts)

    def regex(self) -> str:
        chars = "".join(f"\\x{b:02x}" for b in sorted(set(self.data)))
        kinds = {
            "any": f"[{chars}]" if chars else "(?!)", "notany": f"[^{chars}]" if chars else "(?s:.)", "span": f"[{chars}]++" if chars else "(?!)",
            "break": f"[^{chars}]*+" if chars else "(?s:.*+)", "arb": "(?s:.*+)",
        }
        if self.kind == "literal":
            return "".join(f"\\x{b:02x}" for b in self.data)
        if self.kind in kinds:
            return kinds[self.kind]
        inner = [p.regex() for p in self.parts]
        return {"cat": "".join(inner), "alt": f"(?>{'|'.join(inner)})", "capture": f"({inner[0]})"}[self.kind]


def ascii_lower(text: Column) -> Column:
    """A to Z only: the full lower() would turn a Kelvin sign into an ASCII letter."""
    return F.translate(text, UPPER, LOWER)


@dataclass(frozen=True)
class Normalizer:
    """kind: lowercase, trim or keep_only (data: the characters kept). A token that becomes empty is dropped by the last two."""

    kind: str
    data: str = ""

    def apply(self, token: bytes) -> bytes | None:
        if self.kind == "lowercase":
            return token.lower()
        out = token.strip(_SPACE.encode()) if self.kind == "trim" else bytes(b for b in token if b in self.data.encode())
        return out or None

    def column(self, token: Column) -> Column:
        if self.kind == "lowercase":
            return ascii_lower(token)
        if self.kind == "trim":
            return F.nullif(F.regexp_replace(token, f"^[{_SPACE}]+|[{_SPACE}]+$", ""), F.lit(""))
        kept = "".join(f"\\x{ord(c):02x}" for c in self.data)
        return F.nullif(F.regexp_replace(token, f"[^{kept}]", ""), F.lit(""))


@dataclass(frozen=True)
class Tokenizer:
    """Extract, normalize, pad and make n-grams, in this order. Every method returns a new tokenizer."""

    matcher: Pattern | None = None
    normalizers: tuple[Normalizer, ...] = ()
    least: int = 1
    most: int = 1
    start: str | None = None
    end: str | None = None
    _words: str = field(default=WORD_PATTERN, repr=False)

    def pattern(self, p: Pattern) -> Tokenizer:
        return replace(self, matcher=p)

    def word_pattern(self) -> Tokenizer:
        return replace(self, matcher=None)

    def normalizer(self, n: Normalizer) -> Tokenizer:
        return replace(self, normalizers=(*self.normalizers, n))

    def lowercase(self) -> Tokenizer:
        return self.normalizer(Normalizer("lowercase"))

    def trim(self) -> Tokenizer:
        return self.normalizer(Normalizer("trim"))

    def keep_only(self, allowed: str) -> Tokenizer:
        return self.normalizer(Normalizer("keep_only", allowed))

    def ngrams(self, least: int, most: int) -> Tokenizer:
        if not 1 <= least <= most:
            raise ValueError("1 <= least <= most")
        return replace(self, least=least, most=most)

    def pad(self, start: str, end: str) -> Tokenizer:
        return replace(self, start=start, end=end)

    def extract(self, text: Column) -> Column:
        """The tokens as they stand in the text."""
        if self.matcher is None or self.matcher.plain:
            pattern = self._words if self.matcher is None else self.matcher.regex()
            return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        matcher = self.matcher

        def run(values: pd.Series) -> pd.Series:
            cut = lambda b: [b[m.start : m.end].decode("utf-8", "replace") for m in matcher.find_all(b)]
            return values.map(lambda v: None if v is None else cut(v.encode()))

        run.__annotations__ = {"values": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, "array<string>")(text)

    def tokens(self, text: Column | str) -> Column:
        """The array of tokens of a text; empty where nothing is left, padding included."""
        out = self.extract(F.col(text) if isinstance(text, str) else text)
        for n in self.normalizers:
            out = F.transform(out, n.column)
            if n.kind != "lowercase":
                out = F.filter(out, lambda t: t.isNotNull())
        if self.start is not None or self.end is not None:
            pads = [F.array(F.lit(p)) if p is not None else F.array().cast("array<string>") for p in (self.start, self.end)]
            out = F.transform(F.array(out), lambda t: F.when(F.size(t) > 0, F.concat(pads[0], t, pads[1])).otherwise(t))[0]
        if (self.least, self.most) == (1, 1):
            return out
        grams = [ngrams_of(out, n) for n in range(self.least, self.most + 1)]
        return F.concat(*grams) if len(grams) > 1 else grams[0]

    def apply(self, text: str) -> list[str]:
        """The tokens of one text, on the driver."""
        data = text.encode()
        if self.matcher is None:
            found = [m[0].encode() for m in re.finditer(self._words, text)]
        else:
            found = [data[m.start : m.end] for m in self.matcher.find_all(data)]
        for n in self.normalizers:
            found = [t for t in map(n.apply, found) if t is not None]
        out = [t.decode("utf-8", "replace") for t in found]
        if not out:
            return []
        out = [*([self.start] if self.start is not None else []), *out, *([self.end] if self.end is not None else [])]
        return [EOS.join(out[i : i + n]) for n in range(self.least, self.most + 1) for i in range(len(out) - n + 1)]


def ngrams_of(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by NUL; none where there are fewer than n."""
    if n == 1:
        return tokens
    grams = lambda t: F.transform(
        F.when(t.isNull(), F.lit(None)).when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(t, i, F.lit(n)), EOS),
    )
    return F.transform(F.array(tokens), grams)[0]


#: The default of every query: words of ASCII letters and digits, in lower case.
DEFAULT = Tokenizer().lowercase()
