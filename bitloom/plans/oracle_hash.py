"""The hash in DuckDB SQL, independent of the Python form: wrapping 64-bit arithmetic in UHUGEINT, blocks by recursion."""

from __future__ import annotations

_T64 = f"{2**64}::UHUGEINT"
_C1, _C2, _F1, _F2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _nest(source: str, steps: list[tuple[str, str]]) -> str:
    """Each step sees the columns of those before; nested selects keep long expressions from being repeated."""
    for name, expr in steps:
        source = f"(SELECT *, {expr} AS {name} FROM {source})"
    return source


def _mul(a: str, c: int) -> str:
    return f"(({a}) * {c}::UHUGEINT) % {_T64}"


def _rotl(x: str, r: int) -> str:
    return f"(({x} * {2**r}::UHUGEINT) % {_T64}) + ({x} // {2 ** (64 - r)}::UHUGEINT)"


def _word(at: str) -> str:
    pairs = " || ".join(f"substr(hx, {at} + {k}, 2)" for k in range(14, -1, -2))
    return f"('0x' || {pairs})::UBIGINT::UHUGEINT"


def _mix(prefix: str) -> list[tuple[str, str]]:
    """ka and kb: the two words of block i, mixed."""
    return [
        (f"{prefix}a1", _mul(_word("i * 32 + 1"), _C1)), (f"{prefix}a2", _rotl(f"{prefix}a1", 31)), (f"{prefix}a", _mul(f"{prefix}a2", _C2)),
        (f"{prefix}b1", _mul(_word("i * 32 + 17"), _C2)), (f"{prefix}b2", _rotl(f"{prefix}b1", 33)), (f"{prefix}b", _mul(f"{prefix}b2", _C1)),
    ]


def _fmix(x: str, out: str) -> list[tuple[str, str]]:
    s = f"{2**33}::UHUGEINT"
    return [(f"{out}1", _mul(f"xor({x}, {x} // {s})", _F1)), (f"{out}2", _mul(f"xor({out}1, {out}1 // {s})", _F2)), (out, f"xor({out}2, {out}2 // {s})")]


def hashed(tokens: str, seed: int, name: str) -> str:
    """CTEs that end with name(token, h): h is the hash, unsigned, of each row of the CTE tokens(token)."""
    body = _nest(
        f"(SELECT * FROM {name}_r WHERE i < nb)",
        [*_mix("k"), ("x1", "xor(h1, ka)"), ("x2", _rotl("x1", 27)), ("n1", f"((((x2 + h2) % {_T64}) * 5) + {0x52DCE729}) % {_T64}"),
         ("y1", "xor(h2, kb)"), ("y2", _rotl("y1", 31)), ("n2", f"((((y2 + n1) % {_T64}) * 5) + {0x38495AB5}) % {_T64}")],
    )
    tail = _nest(
        f"(SELECT * FROM {name}_r WHERE i = nb)",
        [*_mix("k"), ("z1", "xor(xor(h1, ka), len::UHUGEINT)"), ("z2", "xor(xor(h2, kb), len::UHUGEINT)"), ("s1", f"(z1 + z2) % {_T64}"), ("s2", f"(s1 + z2) % {_T64}"),
         *_fmix("s1", "f1"), *_fmix("s2", "f2"), ("h", f"(f1 + f2) % {_T64}")],
    )
    return f"""{name}_b AS (SELECT token, strlen(token) AS len, strlen(token) // 16 AS nb,
        rpad(hex(encode(token)), ((strlen(token) // 16 + 1) * 32)::INTEGER, '0') AS hx FROM {tokens}),
    {name}_r AS (SELECT token, len, nb, hx, 0::BIGINT AS i, {seed}::UHUGEINT AS h1, {seed}::UHUGEINT AS h2 FROM {name}_b
        UNION ALL SELECT token, len, nb, hx, i + 1, n1, n2 FROM {body}),
    {name} AS (SELECT token, h FROM {tail})"""


def bit(h: str = "h") -> str:
    """The bit of an unsigned hash."""
    rest = f"(({h}) // 1024::UHUGEINT)"
    tz = f"(CASE WHEN {rest} % {2**31}::UHUGEINT = 0 THEN 31 ELSE bit_count(xor({rest} % {2**31}::UHUGEINT, {rest} % {2**31}::UHUGEINT - 1)::BIGINT) - 1 END)"
    return f"((({h}) % 1024)::BIGINT * 32 + {tz})"


def tokens(table: str = "documents", keys: str = "", text: str = "text") -> str:
    """SELECT of keys and every lower-cased word, one row for each occurrence."""
    return f"SELECT {keys}{', ' if keys else ''}lower(unnest(regexp_extract_all({text}, '[A-Za-z0-9]+'))) AS token FROM {table}"
