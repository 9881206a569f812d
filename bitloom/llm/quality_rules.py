"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

``measures`` has the ratios, ``verdict`` compiles the table.  No user function, pandas or Arrow code takes part, and
no row leaves its partition: there is no shuffle.

Defined results: a null, empty or blank text has no words and fails; a text of any length is measured whole; columns of
any name pass, those named like a result with an underscore added; every row is judged by itself, so repeated rows get
equal answers, and an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import WHITE, free_name, let, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent function words of the corpus's four languages.
STOP_WORDS = {
    "en": "the of and to in is that for it as with was on be by are this from at or an not have which but".split(),
    "fr": "le la de et les des un une du en est que qui dans pour sur au par avec pas ne se plus ce".split(),
    "de": "der die das und in den von zu mit ist im nicht ein eine auf für dem des sich auch als an es".split(),
    "es": "el la de que y en los del se las por un para con no una su al lo como más es o".split(),
}


@dataclass(frozen=True)
class Rule:
    """The document fails where the measure is below low or above high, if it has from_words words or more."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The base rules (too short; more than 20 % of the words in repeated windows), then the method's own.
BASE = (Rule("short", "n_words", low=10), Rule("repeats", "repeat_percent", high=20))
RULES = (
    Rule("symbols", "symbols_per_word", high=0.25),
    Rule("word_length", "mean_word", low=2, high=18),
    Rule("stop_words", "stop_ratio", low=0.01, from_words=50),
    Rule("same_lines", "dup_line_ratio", high=0.5),
    Rule("shouting", "upper_ratio", high=0.5),
    Rule("letters", "letter_ratio", low=0.4),
    Rule("stutter", "stutter_ratio", high=0.3),
)


def _covered(keys: Column) -> Column:
    """How many words lie in windows that occur twice or more; keys: each window's key, by position.

    Equal keys become neighbours by sorting; the windows' starts then cover min(5, distance to the next) words each.
    """

    def twice(pairs: Column) -> Column:
        same = lambda x, k, by: x["k"] == F.get(pairs, k + by)["k"]
        return F.filter(pairs, lambda x, k: F.coalesce(same(x, k, -1), F.lit(False)) | F.coalesce(same(x, k, 1), F.lit(False)))

    def cover(starts: Column) -> Column:
        each = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    starts = let(ordered, lambda pairs: F.sort_array(F.transform(twice(pairs), lambda x: x["i"])))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(starts, cover))


def repeated_words(found: Column) -> Column:
    """Words in 5-word windows that are found twice or more in the array of words, first occurrences included.

    A window's key is the 64-bit hash of its words' 64-bit hashes.
    """
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    window = lambda h: F.slice(
        F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))), F.lit(1), F.size(h) - (WINDOW - 1)
    )
    return F.when(F.size(found) <= WINDOW, F.lit(0)).otherwise(let(let(hashes, window), _covered)).cast("long")


def measures(text: Column) -> Column:
    """A struct of counts and ratios of a text. Every part is bound to a lambda's variable and so computed once, wherever
    the optimizer moves the whole; a projected column would be written out again for each use in a filter."""
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def parts(t: Column) -> Column:
        return F.struct(
            words(t).alias("words"),
            F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0).alias("lines"),
            F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("upper"),
            F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).alias("letters"),
        )

    def ratios(raw: Column) -> Column:
        found, lines, chars, symbols = raw["words"], raw["lines"], raw["word_chars"], raw["n_symbols"]
        n, n_lines = F.size(found), F.size(lines)
        dup = n_lines - F.size(F.array_distinct(lines))
        stutter = F.size(F.filter(found, lambda x, i: F.coalesce(x == F.get(found, i + 1), F.lit(False))))
        counts = {
            "n_words": n.cast("long"),
            "word_chars": chars,
            "n_symbols": symbols,
            "n_dup_lines": dup.cast("long"),
            "n_repeat_words": repeated_words(found),
            "symbols_per_word": per(symbols, n),
            "mean_word": per(chars, n),
            "stop_ratio": per(F.size(F.filter(found, lambda w: F.lower(w).isin(stops))), n),
            "dup_line_ratio": per(dup, n_lines),
            "stutter_ratio": per(stutter, n),
            "upper_ratio": per(raw["upper"], raw["letters"]),
            "letter_ratio": per(raw["letters"], chars),
        }
        return F.struct(*(v.alias(k) for k, v in counts.items()))

    return let(let(F.coalesce(text, F.lit("")), parts), ratios)


def _fails(rule: Rule, m: Column) -> Column:
    if rule.measure == "repeat_percent":  # in whole numbers, so that the bound itself passes
        return 100 * m["n_repeat_words"] > int(rule.high) * m["n_words"]
    x, out = m[rule.measure], F.lit(False)
    if rule.low is not None:
        out = out | (x < rule.low)
    if rule.high is not None:
        out = out | (x > rule.high)
    return out & (m["n_words"] >= rule.from_words) if rule.from_words else out


def compile_rules(rules: tuple[Rule, ...], m: Column) -> Column:
    """True where any rule of the table fails; m: measures()."""
    out = F.lit(False)
    for rule in rules:
        out = out | _fails(rule, m)
    return out


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the counts, base_failed, failed_rule (the first one, null if none fails) and kept."""

    def judged(m: Column) -> Column:
        first = F.coalesce(*(F.when(_fails(r, m), F.lit(r.name)) for r in (*BASE, *rules)))
        base = compile_rules(BASE, m)
        own = {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        own |= {"base_failed": base, "failed_rule": first, "kept": ~(base | compile_rules(rules, m))}
        return F.struct(*(v.alias(k) for k, v in own.items()))

    return let(measures(text), judged)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept")


def score(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs' columns, then the counts, base_failed, failed_rule and kept. Columns of docs that have such a name are renamed."""
    names: list[str] = []
    for c in docs.columns:
        names.append(free_name(c, [*RESULTS, *names, *(d for d in docs.columns if d != c)] if c.lower() in RESULTS else []))
    judged = free_name("verdict", names)
    own = [docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names)]
    return docs.select(*own, F.explode(F.array(verdict(docs[f"`{text}`"], rules))).alias(judged)).select(*(F.col(f"`{n}`") for n in names), f"{judged}.*")


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that every rule accepts, with docs' own columns."""
    return docs.filter(verdict(docs[text], rules)["kept"])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).drop("text")


def _sql(rules: tuple[Rule, ...]) -> str:
    """The query in DuckDB SQL, the rules' table compiled once more."""

    def fails(rule: Rule) -> str:
        if rule.measure == "repeat_percent":
            return f"100 * n_repeat_words > {int(rule.high)} * n_words"
        parts = [f"{rule.measure} < {rule.low}"] * (rule.low is not None) + [f"{rule.measure} > {rule.high}"] * (rule.high is not None)
        return f"(({' OR '.join(parts)}) AND n_words >= {rule.from_words})"

    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    white = r"[\x20\x09-\x0D]"
    named = "CASE " + " ".join(f"WHEN {fails(r)} THEN '{r.name}'" for r in (*BASE, *rules)) + " END"
    base = " OR ".join(fails(r) for r in BASE)
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '{white}+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    g AS (SELECT r, unnest(list_transform(range(1, len(w) - 3), lambda i: {{'i': i, 'g': array_to_string(w[i:i + 4], ' ')}}), recursive := true) FROM w WHERE len(w) > 5),
    s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
    c AS (SELECT r, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM s) GROUP BY r),
    m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{white}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(ls) AS nl,
        len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter,
        length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS up, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS le FROM w LEFT JOIN c USING (r)),
    q AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word,
        CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio, CASE WHEN nl > 0 THEN n_dup_lines / nl ELSE 0 END AS dup_line_ratio,
        CASE WHEN n_words > 0 THEN n_stutter / n_words ELSE 0 END AS stutter_ratio, CASE WHEN le > 0 THEN up / le ELSE 0 END AS upper_ratio,
        CASE WHEN word_chars > 0 THEN le / word_chars ELSE 0 END AS letter_ratio FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words,
        {base} AS base_failed, {named} AS failed_rule, ({named}) IS NULL AS kept FROM q"""


ORACLE_SQL = _sql(RULES)
