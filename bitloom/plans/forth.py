"""A postfix language over elements: words are parsed, then run on a stack of lazy elements, strings and numbers."""

from __future__ import annotations

from dataclasses import dataclass

from bitloom.plans.element import Element, Session, number_text


class ParseError(ValueError):
    """An unterminated string or comment."""


@dataclass(frozen=True)
class Word:
    """kind: str, num, ident or def (value: the name; body: its words)."""

    kind: str
    value: object
    body: tuple[Word, ...] = ()

    def __str__(self) -> str:
        if self.kind == "str":
            return '"' + str(self.value).replace("\\", "\\\\").replace('"', '\\"') + '"'
        if self.kind == "num":
            return number_text(self.value)
        return str(self.value) if self.kind == "ident" else f": {self.value} {' '.join(map(str, self.body))} ;"


def _number(word: str) -> float | None:
    try:
        return None if "_" in word else float(word)
    except ValueError:
        return None


def parse(source: str) -> list[Word]:
    """Words between white space; \\ comments to the line's end; ( ) comments, which nest; strings with \\ before any character."""
    words, held, i, n = [], "", 0, len(source)

    def flush():
        nonlocal held
        if held:
            x = _number(held)
            words.append(Word("ident", held) if x is None else Word("num", x))
            held = ""

    while i < n:
        c = source[i]
        if c.isspace():
            flush()
        elif c == "\\":
            flush()
            end = source.find("\n", i)
            i = n if end < 0 else end
            continue
        elif c == "(":
            flush()
            depth = 1
            while depth:
                i += 1
                if i >= n:
                    raise ParseError("unterminated comment")
                depth += (source[i] == "(") - (source[i] == ")")
        elif c == '"':
            flush()
            text = ""
            while True:
                i += 1
                if i < n and source[i] == '"':
                    break
                i += i < n and source[i] == "\\"
                if i >= n:
                    raise ParseError("unterminated string")
                text += source[i]
            words.append(Word("str", text))
        else:
            held += c
        i += 1
    flush()
    return _definitions(words)


def _definitions(words: list[Word]) -> list[Word]:
    out, i = [], 0
    colon, semicolon = Word("ident", ":"), Word("ident", ";")
    while i < len(words):
        if words[i] == colon and i + 2 < len(words) and words[i + 1].kind == "ident" and semicolon in words[i + 2 :]:
            end = words.index(semicolon, i + 2)
            out.append(Word("def", words[i + 1].value, tuple(words[i + 2 : end])))
            i = end + 1
        else:
            out.append(words[i])
            i += 1
    return out


class _Literal(float):
    """A number that stands in the source: only such a one counts the tokens of INSCRIBE."""


class Interpreter:
    """Runs words. Taking from an empty stack gives nothing and is no error; an unknown word pushes its own name."""

    def __init__(self, session: Session):
        self.session, self.stack = session, []

    def run(self, source: str) -> list:
        """The whole stack after the program."""
        self.words(parse(source))
        return [float(x) if isinstance(x, _Literal) else x for x in self.stack]

    def words(self, words) -> None:
        for w in words:
            if w.kind == "def":
                self.words(w.body)  # a definition runs once, where it stands; its name is an unknown word afterwards
            elif w.kind == "ident":
                self._word(str(w.value))
            else:
                self.stack.append(_Literal(w.value) if w.kind == "num" else w.value)

    def _pop(self):
        return self.stack.pop() if self.stack else None

    def _two(self):
        b = self._pop()
        return self._pop(), b

    def _word(self, name: str) -> None:
        push, s, known = self.stack.append, self.session, name.upper()
        pairs = {"UNION": "union", "INTERSECT": "intersection", "DIFF": "difference", "BSS": "bss_inclusion", "JACCARD": "jaccard"}
        if known == "DUP":
            if self.stack:
                push(self.stack[-1])
        elif known == "SWAP":
            if len(self.stack) > 1:
                self.stack[-2:] = self.stack[:-3:-1]
        elif known == "DROP":
            self._pop()
        elif known == "OVER":
            if len(self.stack) > 1:
                push(self.stack[-2])
        elif known == "ROT":
            if len(self.stack) > 2:
                push(self.stack.pop(-3))
        elif known == "INSCRIBE":
            n = self._pop()
            n = int(n) if isinstance(n, _Literal) else 1
            push(s.inscribe([self._pop() for _ in range(n)][::-1]))
        elif known == "TOKENIZE":
            push(s.tokenize(str(self._pop() or "")))
        elif known == "EMPTY":
            push(s.empty())
        elif known in pairs:
            a, b = self._two()
            push(getattr(a, pairs[known])(b))
        elif known == "CARD":
            push(self._pop().card)
        elif known == "POPCOUNT":
            push(self._pop().popcount)
        elif known == "KEY":
            push(self._pop().key)
        elif known == "STORE":
            push(s.store(self._pop()))
        elif known == "LOAD":
            push(s.load(self._pop()))
        elif known == "LIST":
            push(s.storage.list(self._pop() or ""))
        elif known == "PIN":
            s.storage.pin(self._pop())
        elif known == "UNPIN":
            s.storage.unpin(self._pop())
        elif known == "GC":
            gone = s.storage.gc()
            push(gone if isinstance(gone, list) else [r.key for r in gone.toLocalIterator()])
        else:
            push(name)


def shown(value) -> object:
    """A value as JSON has it: whole numbers without a fraction, elements by their text."""
    if isinstance(value, Element):
        return str(value)
    if isinstance(value, float):
        return int(value) if value.is_integer() else (value if value == value and abs(value) != float("inf") else None)
    return [shown(v) for v in value] if isinstance(value, (list, tuple)) else value
