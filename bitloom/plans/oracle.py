"""Builders of DuckDB SQL: the same results from another engine, by other means (rows and joins, no packed sketches)."""

from __future__ import annotations

from bitloom.plans.oracle_hash import bit, hashed, tokens


def occ(table: str = "documents", keys: str = "lang", text: str = "text") -> str:
    return f"occ AS ({tokens(table, keys, text)})"


def bits(source: str = "occ", seeds: tuple[int, ...] = (0,)) -> str:
    """CTEs that end with hb(token, seed, bit) of the distinct tokens of a CTE."""
    each = ",\n".join(hashed("dt", s, f"h{s}") for s in seeds)
    rows = " UNION ALL ".join(f"SELECT token, {s} AS seed, {bit()} AS bit FROM h{s}" for s in seeds)
    return f"dt AS (SELECT DISTINCT token FROM {source}),\n{each},\nhb AS ({rows})"


def atoms(keys: str = "lang", table: str = "documents", text: str = "text") -> str:
    """CTEs occ, hb and at(keys, b): the distinct bits of each group."""
    return f"{occ(table, keys, text)}, {bits()}, at_ AS (SELECT DISTINCT {keys}, bit FROM occ JOIN hb USING (token))"


def counts(source: str, keys: str) -> str:
    return f"SELECT {keys}, bit % 32 AS tz, count(*) AS c FROM {source} GROUP BY ALL"


def card(source: str, keys: str) -> str:
    """keys and card of the sets in source(keys, tz, c); sets without bits have no row."""
    over = f"OVER (PARTITION BY {keys})"
    return f"""SELECT {keys}, greatest(round(sum(CASE WHEN c < 1024 THEN -1024.0 * ln(1.0 - c / 1024.0)
        WHEN lv > tz THEN -1024.0 * ln(1.0 - cl / 1024.0) * pow(2.0, lv - tz) ELSE 1024.0 * ln(1024.0) END)), 0.0) AS card
      FROM (SELECT *, min(tz) FILTER (c < 1024) {over} AS lv, arg_min(c, tz) FILTER (c < 1024) {over} AS cl FROM ({source}) WHERE c > 0) GROUP BY ALL"""


def pairs(pair_list: str, source: str = "at_", key: str = "lang") -> str:
    """CTEs that end with m(a, b, card_a, card_b, card_and, card_or, card_diff, card_rest, jaccard, tau, rho, subset, superset).

    pair_list: SELECT of a, b. source(key, bit)."""
    return f"""pl AS ({pair_list}),
    s1 AS (SELECT {key} AS k, bit FROM {source}),
    na AS (SELECT a, b, bit % 32 AS tz, count(*) AS c FROM pl JOIN s1 ON k = a GROUP BY ALL),
    nb_ AS (SELECT a, b, bit % 32 AS tz, count(*) AS c FROM pl JOIN s1 ON k = b GROUP BY ALL),
    ni AS (SELECT a, b, x.bit % 32 AS tz, count(*) AS c FROM pl JOIN s1 x ON x.k = a JOIN s1 y ON y.k = b AND x.bit = y.bit GROUP BY ALL),
    sp AS (SELECT a, b, tz FROM pl, range(32) r(tz)),
    al AS (SELECT a, b, tz, coalesce(na.c, 0) AS ca, coalesce(nb_.c, 0) AS cb, coalesce(ni.c, 0) AS ci FROM sp
        LEFT JOIN na USING (a, b, tz) LEFT JOIN nb_ USING (a, b, tz) LEFT JOIN ni USING (a, b, tz)),
    lo AS (SELECT a, b, tz, 'a' AS what, ca AS c FROM al UNION ALL SELECT a, b, tz, 'b', cb FROM al UNION ALL SELECT a, b, tz, 'i', ci FROM al
        UNION ALL SELECT a, b, tz, 'u', ca + cb - ci FROM al UNION ALL SELECT a, b, tz, 'd', ca - ci FROM al UNION ALL SELECT a, b, tz, 'r', cb - ci FROM al),
    cc AS ({card("SELECT * FROM lo", "a, b, what")}),
    pv AS (SELECT a, b, coalesce(max(card) FILTER (what = 'a'), 0.0) AS card_a, coalesce(max(card) FILTER (what = 'b'), 0.0) AS card_b,
        coalesce(max(card) FILTER (what = 'i'), 0.0) AS card_and, coalesce(max(card) FILTER (what = 'u'), 0.0) AS card_or,
        coalesce(max(card) FILTER (what = 'd'), 0.0) AS card_diff, coalesce(max(card) FILTER (what = 'r'), 0.0) AS card_rest
        FROM pl LEFT JOIN cc USING (a, b) GROUP BY ALL),
    sb AS (SELECT a, b, sum(ca) = sum(ci) AS subset, sum(cb) = sum(ci) AS superset FROM al GROUP BY ALL),
    m AS (SELECT *, CASE WHEN card_or = 0 THEN 1.0 ELSE card_and / card_or END AS jaccard,
        CASE WHEN card_b = 0 THEN 1.0 ELSE least(card_and / card_b, 1.0) END AS tau,
        CASE WHEN card_b = 0 THEN 0.0 ELSE least(card_diff / card_b, 1.0) END AS rho FROM pv JOIN sb USING (a, b))"""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
