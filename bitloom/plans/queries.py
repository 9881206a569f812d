"""The engine's own queries: each takes (spark, sf_dir) and returns a DataFrame; SQL has its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions import keys as K
from bitloom.functions import records as Z
from bitloom.functions.hashing import bit_of_hash, hash64, token_bits
from bitloom.functions.text import DEFAULT
from bitloom.operators import algebra, bridge, context, grams, lut, search, sketch
from bitloom.plans import oracle as O
from bitloom.plans.oracle_hash import bit as sql_bit
from bitloom.plans.oracle_hash import hashed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words():
    """The words of column text (a column needs a session, so none is made at import)."""
    return DEFAULT.tokens("text")


def docs(spark, d) -> DataFrame:
    return read(spark, d, "documents")


def sets(spark, d, *keys: str) -> DataFrame:
    """(keys, bm) of the documents' words."""
    return sketch.build(docs(spark, d), words(), *keys)


def own_sets(spark, d, *keys: str) -> DataFrame:
    """(keys, bm) of each document: what stands in one row needs no aggregation."""
    return docs(spark, d).select(*keys, sketch.of_tokens(words()).alias("bm"))


def bit_sets(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, bits) of the words of each row."""
    return df.select(*keys, token_bits(words()).alias("bits"))


def rows(spark, d, *keys: str) -> DataFrame:
    return sketch.atoms(docs(spark, d), words(), *keys)


def index(spark, d, *keys: str, seeds=(0,)) -> DataFrame:
    return lut.build(lut.occurrences(docs(spark, d), words(), *keys), *keys, seeds=seeds)


# --- texts and hashes ----------------------------------------------------------------------------------------------


@query(O.with_(O.occ()) + "SELECT lang, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM occ GROUP BY lang")
def tokens_by_lang(spark, d):
    return lut.occurrences(docs(spark, d), words(), "lang").groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_distinct("token").alias("n_distinct"))


def _grams_sql(table: str, key: str, words: str, sizes: range) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {key}, {n} AS n, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], chr(0)))) AS gram FROM t WHERE len(w) >= {n}" for n in sizes
    )
    return f"WITH t AS (SELECT {key}, {words} AS w FROM {table}), g AS ({parts}) SELECT {key}, n, count(*) AS total, count(DISTINCT gram) AS n_distinct FROM g GROUP BY ALL"


_LIST = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))"


@query(_grams_sql("documents", "lang", _LIST, range(1, 4)))
def ngram_counts(spark, d):
    return grams.counts(docs(spark, d), words(), "lang", range(1, 4))


@query(_grams_sql("conversations", "role", f"CASE WHEN len({_LIST}) > 0 THEN list_concat(['<s>'], list_concat({_LIST}, ['</s>'])) ELSE [] END", range(2, 3)))
def padded_bigrams(spark, d):
    return grams.counts(read(spark, d, "conversations"), DEFAULT.pad("<s>", "</s>").tokens("text"), "role", range(2, 3))


@query(O.with_(O.occ(keys=""), "t AS (SELECT DISTINCT token FROM occ)", hashed("t", 0, "hs")) + "SELECT token, CASE WHEN h >= 9223372036854775808::UHUGEINT THEN (h - 9223372036854775808::UHUGEINT)::BIGINT - 9223372036854775807 - 1 ELSE h::BIGINT END AS hash FROM hs")
def token_hashes(spark, d):
    distinct = lut.occurrences(docs(spark, d), words()).distinct()
    return distinct.select("token", hash64("token").alias("hash"))


def _token_bits(seed: int):
    def run(spark, d):
        return lut.occurrences(docs(spark, d), words()).distinct().select("token", bit_of_hash(hash64("token", seed)).cast("long").alias("bit"))

    return run


for _seed in (0, 1, 2):
    query(O.with_(O.occ(keys=""), "t AS (SELECT DISTINCT token FROM occ)", hashed("t", _seed, "hs")) + f"SELECT token, {sql_bit()} AS bit FROM hs", f"token_bits_seed{_seed}")(_token_bits(_seed))


# --- sketches ------------------------------------------------------------------------------------------------------


@query(O.with_(O.atoms()) + "SELECT lang, count(*) AS popcount FROM at_ GROUP BY lang")
def sketch_popcount_by_lang(spark, d):
    return sets(spark, d, "lang").select("lang", sketch.popcount("bm").alias("popcount"))


@query(O.with_(O.atoms("source")) + O.card(O.counts("at_", "source"), "source"))
def sketch_card_by_source(spark, d):
    return sets(spark, d, "source").select("source", sketch.card("bm").alias("card"))


@query(O.with_(O.atoms("1 AS one").replace("SELECT DISTINCT 1 AS one, bit", "SELECT DISTINCT one, bit")) + f"SELECT card FROM ({O.card(O.counts('at_', 'one'), 'one')})")
def card_saturated_all(spark, d):
    return sets(spark, d).select(sketch.card("bm").alias("card"))


@query(O.with_(O.atoms()) + "SELECT lang, tz, coalesce(c, 0) AS n FROM (SELECT lang, tz FROM (SELECT DISTINCT lang FROM at_), range(32) r(tz)) LEFT JOIN (" + O.counts("at_", "lang") + ") USING (lang, tz)")
def bit_counts(spark, d):
    return sketch.bit_counts(rows(spark, d, "lang"), "lang").select("lang", F.col("tz").cast("long").alias("tz"), "n")


@query(O.with_(O.atoms()) + "SELECT lang, bit // 32 AS reg, max(bit % 32) AS max_tz FROM at_ GROUP BY ALL")
def register_max_tz(spark, d):
    out = sketch.register_max(rows(spark, d, "lang"), "lang")
    return out.select("lang", F.col("reg").cast("long").alias("reg"), F.col("max_tz").cast("long").alias("max_tz"))


@query(O.with_(O.atoms()) + "SELECT lang, bit // 32 AS reg, sum(1::BIGINT << (bit % 32)::INTEGER)::BIGINT AS mask FROM at_ GROUP BY ALL")
def dense_registers(spark, d):
    return sketch.dense_registers(rows(spark, d, "lang"), "lang").select("lang", F.col("reg").cast("long").alias("reg"), "mask")


@query(O.with_(O.atoms()) + "SELECT lang, count(DISTINCT bit // 32) AS n, count(*) FILTER (bit % 32 = 3) AS n_tz3, (bool_or(bit = 0)) AS has_00 FROM at_ GROUP BY lang")
def nonzero_registers(spark, d):
    n, tz3 = sketch.nonzero_registers("bm").cast("long"), F.size(sketch.registers_with("bm", 3)).cast("long")
    return sets(spark, d, "lang").select("lang", n.alias("n"), tz3.alias("n_tz3"), sketch.has_bit(F.col("bm"), 0, 0).alias("has_00"))


@query(O.with_(O.atoms("doc_id")) + "SELECT doc_id, CASE WHEN n <= 4096 THEN 16 + 2 * n ELSE 8208 END AS bytes FROM (SELECT doc_id, count(*) AS n FROM at_ GROUP BY ALL)")
def memory_usage(spark, d):
    one = docs(spark, d).select("doc_id", F.size(token_bits(words())).alias("n")).filter("n > 0")
    return one.select("doc_id", sketch.memory_usage(F.col("n")).alias("bytes"))


@query(O.with_(O.atoms("lang, source")) + "SELECT lang, source, count(DISTINCT bit) AS popcount FROM at_ GROUP BY CUBE (lang, source)")
def cube_lang_source(spark, d):
    cube = sets(spark, d, "lang", "source").cube("lang", "source").agg(F.bitmap_or_agg("bm").alias("bm"))
    return cube.select("lang", "source", sketch.popcount("bm").alias("popcount"))


# --- algebra -------------------------------------------------------------------------------------------------------


def _two(spark, d):
    both = rows(spark, d, "lang")
    return both.filter("lang = 'en'").select("bit"), both.filter("lang = 'fr'").select("bit")


for _name, _op, _sql in (("union", algebra.union_rows, "UNION"), ("intersection", algebra.intersection_rows, "INTERSECT"), ("difference", algebra.difference_rows, "EXCEPT")):
    query(O.with_(O.atoms()) + f"SELECT bit FROM at_ WHERE lang = 'en' {_sql} SELECT bit FROM at_ WHERE lang = 'fr'", f"lang_{_name}")(
        lambda spark, d, op=_op: op(*_two(spark, d), *([] if op is algebra.union_rows else [["bit"]])).select(F.col("bit").cast("long").alias("bit"))
    )


@query(O.with_(O.atoms()) + "SELECT bit FROM at_ WHERE lang IN ('en', 'fr') GROUP BY bit HAVING count(*) = 1")
def lang_symmetric_difference(spark, d):
    return algebra.symmetric_difference_rows(*_two(spark, d), ["bit"]).select(F.col("bit").cast("long").alias("bit"))


@query(O.with_(O.atoms("source")) + "SELECT source, count(*) AS popcount FROM at_ GROUP BY source")
def union_all_by_source(spark, d):
    per_doc = own_sets(spark, d, "source")
    return algebra.union_all(per_doc, "source").select("source", sketch.popcount("bm").alias("popcount"))


@query(O.with_(O.atoms("source")) + "SELECT count(*) AS popcount FROM (SELECT bit FROM at_ GROUP BY bit HAVING count(*) = (SELECT count(DISTINCT source) FROM at_))")
def intersection_all_sources(spark, d):
    return algebra.intersection_all(sets(spark, d, "source")).select(sketch.popcount("bm").alias("popcount"))


def _pairs(s: DataFrame, key: str, condition: str = "a <> b") -> DataFrame:
    """The pairs of a table of a few named groups."""
    a, b = s.select(F.col(key).alias("a"), F.col("bm").alias("bm_a")), s.select(F.col(key).alias("b"), F.col("bm").alias("bm_b"))
    return a.join(b, F.expr(condition))


_LANGS = O.pairs("SELECT x.lang AS a, y.lang AS b FROM (SELECT DISTINCT lang FROM documents) x, (SELECT DISTINCT lang FROM documents) y WHERE x.lang <> y.lang")
_SOURCES = O.pairs("SELECT x.source AS a, y.source AS b FROM (SELECT DISTINCT source FROM documents) x, (SELECT DISTINCT source FROM documents) y WHERE x.source < y.source", key="source")


@query(O.with_(O.atoms("source"), _SOURCES) + "SELECT a, b, card_and, card_or, jaccard FROM m")
def jaccard_pairs(spark, d):
    return algebra.measured(_pairs(sets(spark, d, "source"), "source", "a < b")).select("a", "b", "card_and", "card_or", "jaccard")


@query(O.with_(O.atoms(), _LANGS) + "SELECT a, b, card_a, card_b, tau, rho, tau >= 0.1 AND rho <= 0.9 AS holds FROM m")
def bss_pairs(spark, d):
    m = algebra.measured(_pairs(sets(spark, d, "lang"), "lang"))
    return m.select("a", "b", "card_a", "card_b", "tau", "rho", algebra.morphism(0.1, 0.9).alias("holds"))


@query(O.with_(O.atoms("source"), _SOURCES) + """SELECT a, b, tau >= 0.2 AND rho <= 0 AND CASE WHEN card_a = 0 THEN true ELSE least(card_and / card_a, 1.0) >= 0.2 AND card_rest / card_a <= 0 END AS approx_equal FROM m""")
def approx_eq_pairs(spark, d):
    return algebra.measured(_pairs(sets(spark, d, "source"), "source", "a < b")).select("a", "b", algebra.approx_equal(0.2).alias("approx_equal"))


_CONTAIN = f"""WITH RECURSIVE {O.occ(keys="doc_id")}, o2 AS ({O.tokens("benchmark", "item_id")}),
    un AS (SELECT token FROM occ UNION SELECT token FROM o2), {O.bits("un")},
    da AS (SELECT DISTINCT doc_id, bit FROM occ JOIN hb USING (token)), ia AS (SELECT DISTINCT item_id, bit FROM o2 JOIN hb USING (token)),
    ni AS (SELECT item_id, doc_id, count(*) AS n FROM ia JOIN da USING (bit) GROUP BY ALL), ns AS (SELECT item_id, count(*) AS size FROM ia GROUP BY ALL)"""


@query(_CONTAIN + " SELECT item_id, doc_id FROM ni JOIN ns USING (item_id) WHERE n = size")
def subset_pairs(spark, d):
    """Documents whose sketch holds all bits of a benchmark item's: those that share so many, measured as packed pairs."""
    items, own = bit_sets(read(spark, d, "benchmark"), "item_id"), bit_sets(docs(spark, d), "doc_id")
    size = items.select("item_id", F.size("bits").alias("size"))
    near = search.inclusion(items, own, "item_id", "doc_id", 0.5).join(size, "item_id").filter("shared = size").select("item_id", "doc_id")
    packed = lambda df, key, name: df.select(key, sketch.of_tokens(words()).alias(name))
    pairs = near.join(packed(read(spark, d, "benchmark"), "item_id", "bm_a"), "item_id").join(packed(docs(spark, d), "doc_id", "bm_b"), "doc_id")
    return algebra.measured(pairs).filter("subset").select("item_id", "doc_id")


# --- keys and records ----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, 'h:' || sha1(array_to_string(list_sort(list_distinct({_LIST})), chr(0))) AS h, 'o:' || sha1(array_to_string(list_sort(list_distinct({_LIST})), chr(0))) AS o FROM documents")
def token_keys(spark, d):
    return docs(spark, d).select("doc_id", K.content_key(words()).alias("h"), K.original_key(words()).alias("o"))


_LE2 = "substr(printf('%04X', {0}), 3, 2) || substr(printf('%04X', {0}), 1, 2)"


@query(O.with_(O.atoms("doc_id"), "sz AS (SELECT doc_id, count(*) AS n FROM at_ GROUP BY doc_id)",
    f"ar AS (SELECT doc_id, n, string_agg({_LE2.format('bit')}, '' ORDER BY bit) AS body FROM at_ JOIN sz USING (doc_id) WHERE n <= 4096 GROUP BY ALL)",
    "by_ AS (SELECT doc_id, bit // 8 AS k, sum(1 << (bit % 8)::INTEGER)::BIGINT AS v FROM at_ JOIN sz USING (doc_id) WHERE n > 4096 GROUP BY ALL)",
    "bi AS (SELECT doc_id, n, string_agg(printf('%02X', coalesce(v, 0)), '' ORDER BY k) AS body FROM (SELECT doc_id, n, k FROM sz, range(8192) r(k) WHERE n > 4096) LEFT JOIN by_ USING (doc_id, k) GROUP BY ALL)")
    + f"""SELECT doc_id, 'h:' || sha1(unhex(CASE WHEN body IS NULL THEN '3A30000000000000' ELSE '3A300000010000000000' || {_LE2.format('n - 1')} || '10000000' || body END)) AS key
    FROM documents LEFT JOIN (SELECT * FROM ar UNION ALL SELECT * FROM bi) USING (doc_id)""")  # fmt: skip
def bitmap_keys(spark, d):
    """Of every document, in whichever of the three forms its sketch has: none, an array, or bits; a null text is empty."""
    return Z.bitmap_keys(docs(spark, d), words(), "doc_id")


_COMMIT = """SELECT n_nationkey AS ts, '{"ts":' || n_nationkey || ',"s":"' || n_name || '","h":"h:' || n_regionkey || '","d":"d","r":"r","n":"n"}' AS body FROM nation"""


@query(f"WITH c AS ({_COMMIT}) SELECT ts::BIGINT AS ts, body, 't:' || sha1(body) AS key, lag('t:' || sha1(body)) OVER (ORDER BY ts) AS before FROM c")
def commit_chain(spark, d):
    from pyspark.sql import Window as W

    n = read(spark, d, "nation")
    body = Z.commit_json(F.col("n_nationkey"), F.col("n_name"), F.concat(F.lit("h:"), F.col("n_regionkey").cast("string")), F.lit("d"), F.lit("r"), F.lit("n"))
    c = n.select(F.col("n_nationkey").cast("long").alias("ts"), body.alias("body")).withColumn("key", Z.commit_key(F.col("body")))
    return c.withColumn("before", F.lag("key").over(W.orderBy("ts")))


_LEAF = "sha1(unhex('00' || " + _LE2.format("bit") + " || '0000'))"


@query(O.with_(O.atoms()) + f"SELECT lang, bit, {_LEAF} AS leaf FROM at_")
def merkle_leaves(spark, d):
    return rows(spark, d, "lang").select("lang", F.col("bit").cast("long").alias("bit"), lut.merkle_leaf(F.col("bit")).alias("leaf"))


@query(O.with_(O.atoms("item_id", "benchmark"), f"""lv AS (SELECT item_id, list({_LEAF} ORDER BY bit) AS l FROM at_ GROUP BY item_id
    UNION ALL SELECT item_id, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha1(chr(1) || l[2 * i + 1] || coalesce(l[2 * i + 2], l[2 * i + 1]))) FROM lv WHERE len(l) > 1)""")
    + "SELECT item_id, l[1] AS root FROM lv WHERE len(l) = 1")
def merkle_root(spark, d):
    return lut.atom_tree(sketch.atoms(read(spark, d, "benchmark"), words(), "item_id"), "item_id").select("item_id", "root")


# --- reverse index, restoration, ranks -----------------------------------------------------------------------------


@query(O.with_(O.occ(keys="")) + "SELECT token, count(*) AS n FROM occ GROUP BY token")
def ingest_tf(spark, d):
    return lut.tf_table(lut.occurrences(docs(spark, d), words()))


@query(O.with_(O.occ(keys=""), O.bits(seeds=(0, 1, 2))) + "SELECT seed::INTEGER AS seed, bit, count(*) AS n_tokens, max(token) AS last FROM hb GROUP BY ALL")
def lut_fibers(spark, d):
    out = index(spark, d, seeds=(0, 1, 2)).groupBy("seed", "bit").agg(F.count("*").alias("n_tokens"), F.max("token").alias("last"))
    return out.withColumn("bit", F.col("bit").cast("long"))


@query(O.with_(O.occ(), O.bits()) + "SELECT DISTINCT token FROM hb WHERE bit IN (SELECT bit FROM occ JOIN hb USING (token) WHERE lang = 'fr') AND token IN (SELECT token FROM occ WHERE lang = 'en')")
def slice_restore(spark, d):
    """The French documents' sketch, read through the English documents' index."""
    i = index(spark, d, "lang")
    return lut.restore(i.filter("lang = 'fr'").select("bit").distinct(), i.filter("lang = 'en'"))


@query(O.with_(O.occ(), O.bits()) + "SELECT token, bit IN (SELECT bit FROM occ JOIN hb USING (token) WHERE lang = 'fr') AS passes, token IN (SELECT token FROM occ WHERE lang = 'fr') AS known FROM hb")
def gate_restore(spark, d):
    """For every token whether the French sketch lets it through, and whether it truly is French."""
    i = index(spark, d, "lang")
    fr, every = i.filter("lang = 'fr'"), i.select("token", "bit").distinct()
    out = every.join(fr.select("bit", F.lit(True).alias("passes")).distinct(), "bit", "left").join(fr.select("token", F.lit(True).alias("known")).distinct(), "token", "left")
    return out.select("token", F.coalesce("passes", F.lit(False)).alias("passes"), F.coalesce("known", F.lit(False)).alias("known"))


_ALL_SEEDS = (O.occ(), O.bits(seeds=(0, 1, 2)), "tf AS (SELECT token, count(*) AS n FROM occ GROUP BY token)")


@query(O.with_(*_ALL_SEEDS, "cand AS (SELECT DISTINCT h.bit, g.token FROM (SELECT DISTINCT seed, bit FROM occ JOIN hb USING (token) WHERE lang = 'fr') h JOIN hb g USING (seed, bit))")
    + "SELECT DISTINCT token FROM (SELECT bit, arg_max(token, (n, token)) AS token FROM cand JOIN tf USING (token) GROUP BY bit)")
def materialize_tf(spark, d):
    i = index(spark, d, "lang", seeds=(0, 1, 2))
    tf = lut.tf_table(lut.occurrences(docs(spark, d), words()))
    return lut.materialize(i.filter("lang = 'fr'").select("seed", "bit").distinct(), i.select("seed", "bit", "token").distinct(), tf)


@query(O.with_(*_ALL_SEEDS, "se AS (SELECT DISTINCT seed, bit FROM occ JOIN hb USING (token) WHERE lang = 'fr')") + "SELECT token, count(*) AS n_seeds FROM hb JOIN se USING (seed, bit) GROUP BY token HAVING count(*) >= 2")
def seed_consensus(spark, d):
    i = index(spark, d, "lang", seeds=(0, 1, 2))
    return lut.consensus(i.filter("lang = 'fr'").select("seed", "bit"), i.select("seed", "bit", "token").distinct())


_RANKED = (O.occ(), O.bits(), "tf AS (SELECT token, count(*) AS n FROM occ GROUP BY token)", "at_ AS (SELECT DISTINCT lang, bit FROM occ JOIN hb USING (token))")


def _ranks(how: str):
    def bit_rank(spark, d):
        i = index(spark, d)
        return lut.bit_rank(i, lut.tf_table(lut.occurrences(docs(spark, d), words())), how)

    wide = lambda df: df.withColumn("bit", F.col("bit").cast("long"))
    query(O.with_(*_RANKED) + f"SELECT bit, {how}(n)::BIGINT AS rank FROM hb JOIN tf USING (token) GROUP BY bit", f"bit_rank_{how}")(lambda s, d: wide(bit_rank(s, d)))
    g = f"g AS (SELECT bit, {how}(n)::BIGINT AS rank FROM hb JOIN tf USING (token) GROUP BY bit)"
    low = "CASE WHEN count(*) < 32 THEN 0 ELSE min(rank) END" if how == "min" else f"{how}(rank)"
    query(O.with_(*_RANKED, g) + f"SELECT bit // 32 AS reg, ({low})::BIGINT AS rank FROM g GROUP BY 1", f"register_rank_{how}")(
        lambda s, d: lut.register_rank(bit_rank(s, d), how).withColumn("reg", F.col("reg").cast("long"))
    )
    query(O.with_(*_RANKED, g) + f"SELECT lang, {how}(rank)::BIGINT AS rank FROM at_ JOIN g USING (bit) GROUP BY lang", f"set_rank_{how}")(lambda s, d: lut.set_rank(rows(s, d, "lang"), bit_rank(s, d), how, "lang"))
    query(O.with_(*_RANKED, g) + f"SELECT {how}(rank)::BIGINT AS rank FROM (SELECT lang, {how}(rank) AS rank FROM at_ JOIN g USING (bit) GROUP BY lang)", f"compound_rank_{how}")(
        lambda s, d: lut.compound_rank(lut.set_rank(rows(s, d, "lang"), bit_rank(s, d), how, "lang"), how)
    )


for _how in ("sum", "max", "min"):
    _ranks(_how)


@query(O.with_(O.occ()) + "SELECT token, max(n) AS n FROM (SELECT lang, token, count(*) AS n FROM occ GROUP BY ALL) GROUP BY token")
def tf_merge_max(spark, d):
    per = lut.tf_table(lut.occurrences(docs(spark, d), words(), "lang"), "lang")
    return lut.tf_merge(per.select("token", "n"))


@query(O.with_(O.atoms("doc_id")) + "SELECT bit, count(*)::DOUBLE AS tf FROM at_ GROUP BY bit")
def tf_bits(spark, d):
    return lut.tf_bits(docs(spark, d).select(F.explode(token_bits(words())).alias("bit"))).withColumn("bit", F.col("bit").cast("long"))


# --- contexts ------------------------------------------------------------------------------------------------------

_DAYS = """dy AS (SELECT DISTINCT date_diff('day', DATE '1970-01-01', ts::DATE) AS step, user_id FROM events), wi AS (SELECT min(step) AS a, max(step) AS b FROM dy)"""


def _daily(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    step = F.datediff(F.col("ts"), F.lit("1970-01-01")).cast("long")
    return e.select(step.alias("step"), F.explode(token_bits(F.array(F.col("user_id").cast("string")))).alias("bit"))


_DAILY = ("occ AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS step, user_id::VARCHAR AS token FROM events)", O.bits(), "at_ AS (SELECT DISTINCT step, bit FROM occ JOIN hb USING (token))")


@query(O.with_(*_DAILY) + """SELECT coalesce(c.step, p.step + 1) AS step, count(*) FILTER (c.bit IS NULL) AS departed, count(*) FILTER (c.bit IS NOT NULL AND p.bit IS NOT NULL) AS retained,
    count(*) FILTER (p.bit IS NULL) AS novel FROM at_ c FULL OUTER JOIN at_ p ON p.bit = c.bit AND p.step = c.step - 1 GROUP BY 1""")
def drn_daily(spark, d):
    return context.evolve_steps(_daily(spark, d), "step")


@query(O.with_(O.atoms()) + "SELECT coalesce(a.bit, b.bit) AS bit, CASE WHEN a.bit IS NULL THEN 'N' WHEN b.bit IS NULL THEN 'D' ELSE 'R' END AS part FROM (FROM at_ WHERE lang = 'en') a FULL OUTER JOIN (FROM at_ WHERE lang = 'fr') b ON a.bit = b.bit")
def drn_parts(spark, d):
    return context.evolve(*_two(spark, d)).select(F.col("bit").cast("long").alias("bit"), "part")


@query(O.with_(O.atoms("source, lang"), "xa AS (SELECT DISTINCT source, bit FROM at_ WHERE lang = 'en')", "xb AS (SELECT DISTINCT source, bit FROM at_ WHERE lang <> 'en')",
    "pr AS (SELECT coalesce(a.source, b.source) AS source, a.bit AS was, b.bit AS now FROM xa a FULL OUTER JOIN xb b ON a.source = b.source AND a.bit = b.bit)",
    "na AS (SELECT source, count(*) AS n FROM xa GROUP BY 1), nb AS (SELECT source, count(*) AS n FROM xb GROUP BY 1)")
    + "SELECT source, count(was) = coalesce(any_value(na.n), 0) AND count(now) = coalesce(any_value(nb.n), 0) AND count(*) FILTER (now IS NULL) + count(*) FILTER (was IS NOT NULL AND now IS NOT NULL) + count(*) FILTER (was IS NULL) = count(*) AS holds FROM pr LEFT JOIN na USING (source) LEFT JOIN nb USING (source) GROUP BY source")
def drn_invariants(spark, d):
    r = rows(spark, d, "source", "lang")
    a, b = r.filter("lang = 'en'").select("source", "bit"), r.filter("lang <> 'en'").select("source", "bit").distinct()
    return context.invariants(context.evolve(a, b, "source"), a, b, "source")


_FOLLOW = "fo AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, event_id FROM events)"


@query(f"WITH {_FOLLOW} SELECT src, dst, count(*) AS w FROM fo WHERE dst IS NOT NULL GROUP BY ALL")
def follow_events(spark, d):
    return context.transitions(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


def _halves(spark, d):
    e = read(spark, d, "events")
    return [context.transitions(e.filter(f"user_id % 2 = {k}"), "user_id", ["ts", "event_id"], "event_type") for k in (0, 1)]


_HALF = "SELECT src, dst, max(w) AS w FROM (SELECT src, dst, user_id % 2 AS k, count(*) AS w FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, user_id FROM events) WHERE dst IS NOT NULL GROUP BY ALL) GROUP BY ALL"


@query(_HALF)
def follow_merge(spark, d):
    return context.follow_merge(*_halves(spark, d))


@query(f"WITH k AS (SELECT DISTINCT event_type AS t FROM events ORDER BY 1 LIMIT 2) SELECT * FROM ({_HALF}) WHERE src IN (SELECT t FROM k) AND dst IN (SELECT t FROM k)")
def follow_restrict(spark, d):
    kept = read(spark, d, "events").select(F.col("event_type").alias("token")).distinct().orderBy("token").limit(2)
    return context.follow_restrict(context.follow_merge(*_halves(spark, d)), kept)


# --- bridges and routing -------------------------------------------------------------------------------------------

_BITS = "array_sort(collect_set(bit))"


def _bit_sets(spark, d, key: str = "lang") -> DataFrame:
    return sets(spark, d, key).select(key, sketch.bits("bm").alias("bits"))


def _represented(source: str, key: str, out: str) -> str:
    """CTEs that end with out(key, bit): source(key, bit), each set written as tokens and hashed again."""
    return f"{out}_o AS (SELECT {key}, 'reg:' || (bit // 32) || ':tz:' || (bit % 32) AS token FROM {source}), {out}_t AS (SELECT DISTINCT token FROM {out}_o), {hashed(out + '_t', 0, out + '_h')}, {out} AS (SELECT DISTINCT {key}, {sql_bit()} AS bit FROM {out}_o JOIN {out}_h USING (token))"


def _trigrams(source: str, key: str, out: str) -> str:
    """CTEs that end with out(key, bit): the 3-grams of source's bits in order."""
    return f"""{out}_w AS (SELECT {key}, list((bit // 32) || ':' || (bit % 32) ORDER BY bit) AS l FROM {source} GROUP BY {key}),
    {out}_p AS (SELECT {key}, list_concat(['_START_'], list_concat(l, ['_END_'])) AS l FROM {out}_w),
    {out}_o AS (SELECT {key}, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || chr(0) || l[i + 1] || chr(0) || l[i + 2])) AS token FROM {out}_p),
    {out}_t AS (SELECT DISTINCT token FROM {out}_o), {hashed(out + '_t', 0, out + '_h')}, {out} AS (SELECT DISTINCT {key}, {sql_bit()} AS bit FROM {out}_o JOIN {out}_h USING (token))"""


@query(O.with_(O.atoms(), _represented("at_", "lang", "rr")) + "SELECT lang, bit FROM rr")
def re_represent(spark, d):
    return _bit_sets(spark, d).select("lang", F.explode(bridge.re_represent(F.col("bits"))).alias("bit")).select("lang", F.col("bit").cast("long").alias("bit"))


@query(O.with_(O.atoms(), _represented("at_", "lang", "rr"), _trigrams("rr", "lang", "tg")) + "SELECT lang, bit // 32 AS reg, count(*) AS n FROM tg GROUP BY ALL")
def fingerprint_3gram(spark, d):
    v = bridge.fingerprints(_bit_sets(spark, d), "lang")
    return v.select("lang", F.posexplode("vector").alias("reg", "n")).filter("n > 0").select("lang", F.col("reg").cast("long").alias("reg"), F.col("n").cast("long").alias("n"))


@query(O.with_(O.atoms()) + "SELECT lang, r AS reg, count(bit) AS n FROM (SELECT lang, r FROM (SELECT DISTINCT lang FROM at_), range(1024) q(r)) LEFT JOIN (SELECT lang, bit, bit // 32 AS r FROM at_) USING (lang, r) GROUP BY ALL")
def register_vector(spark, d):
    return sketch.register_popcounts(rows(spark, d, "lang"), "lang").select("lang", F.col("reg").cast("long").alias("reg"), "n")


def _rho(vectors: str, where: str) -> str:
    """SELECT a, b, rho from vectors(k, r, n)."""
    return f"""rk AS (SELECT k, r, rank() OVER (PARTITION BY k ORDER BY n DESC) + (count(*) OVER (PARTITION BY k, n) - 1) / 2.0 AS x FROM {vectors}),
    rh AS (SELECT p.k AS a, q.k AS b, round(coalesce(corr(p.x, q.x), 0), 9) AS rho FROM rk p JOIN rk q ON p.r = q.r AND {where} GROUP BY ALL)"""


_VEC = "ve AS (SELECT k, r, count(bit) AS n FROM (SELECT k, r FROM (SELECT DISTINCT lang AS k FROM at_), range(1024) q(r)) LEFT JOIN (SELECT lang AS k, bit, bit // 32 AS r FROM {0}) USING (k, r) GROUP BY ALL)"


@query(O.with_(O.atoms(), _VEC.format("at_"), _rho("ve", "p.k < q.k")) + "SELECT a, b, rho FROM rh")
def spearman_pairs(spark, d):
    v = _bit_sets(spark, d).select("lang", bridge.register_vector("bits").alias("v"))
    a, b = v.select(F.col("lang").alias("a"), F.col("v").alias("va")), v.select(F.col("lang").alias("b"), F.col("v").alias("vb"))
    return a.join(b, F.expr("a < b")).select("a", "b", F.round(bridge.spearman("va", "vb"), 9).alias("rho"))


@query(O.with_(O.atoms(), "en AS (SELECT '+' AS lang, bit FROM at_ WHERE lang = 'en')", _represented("en", "lang", "r1"), "al AS (SELECT * FROM r1 UNION ALL SELECT * FROM at_ WHERE lang <> 'en')", _represented("al", "lang", "r2"), _trigrams("r2", "lang", "tg"),
    "ve AS (SELECT k, r, count(bit) AS n FROM (SELECT k, r FROM (SELECT DISTINCT lang AS k FROM al), range(1024) q(r)) LEFT JOIN (SELECT lang AS k, bit, bit // 32 AS r FROM tg) USING (k, r) GROUP BY ALL)", _rho("ve", "p.k = '+' AND q.k <> '+'")) + "SELECT b AS lang, rho FROM rh ORDER BY rho DESC, lang LIMIT 2")
def bridge_topk(spark, d):
    """The two languages whose lattice fits the English sketch best."""
    s = _bit_sets(spark, d)
    out = bridge.bridge(s.filter("lang = 'en'"), s.filter("lang <> 'en'"), 2, "lang")
    return out.select("lang", F.round("rho", 9).alias("rho"))


@query(O.with_(O.atoms("source, doc_id")) + "SELECT source, count(DISTINCT bit) AS popcount, count(DISTINCT doc_id) AS set_count FROM at_ GROUP BY source")
def node_fingerprints(spark, d):
    n = bridge.node_fingerprints(own_sets(spark, d, "source").filter(sketch.popcount("bm") > 0), "source")
    return n.select("source", sketch.popcount("bm").alias("popcount"), "set_count")


_REQUEST = "SELECT DISTINCT source AS a, '+' AS b FROM documents"
_ASKED = f"""WITH RECURSIVE {O.occ(keys="source")}, o2 AS (SELECT '+' AS source, token FROM ({O.tokens("benchmark")})), oa AS (SELECT * FROM occ UNION ALL SELECT * FROM o2), {O.bits("oa")},
    at_ AS (SELECT DISTINCT source, bit FROM oa JOIN hb USING (token)), {O.pairs(_REQUEST, key="source")}"""


def _request(spark, d) -> DataFrame:
    return sketch.build(read(spark, d, "benchmark"), words())


@query(_ASKED + " SELECT a AS source, tau FROM m WHERE tau > 0 ORDER BY tau DESC, source LIMIT 5")
def route_topk(spark, d):
    return bridge.route(sets(spark, d, "source"), _request(spark, d), 5, "source")


@query(_ASKED + f""", pa AS (SELECT 1 AS one, x.bit FROM at_ x JOIN at_ y ON y.source = '+' AND x.bit = y.bit WHERE x.source <> '+' GROUP BY ALL), rq AS (SELECT 1 AS one, bit FROM at_ WHERE source = '+')
    SELECT (SELECT count(DISTINCT source) FROM documents) AS responses, (SELECT card FROM ({O.card(O.counts("pa", "one"), "one")})) / (SELECT card FROM ({O.card(O.counts("rq", "one"), "one")})) AS coverage""")
def coverage(spark, d):
    asked = _request(spark, d)
    parts = sets(spark, d, "source").join(F.broadcast(asked.select(F.col("bm").alias("asked")))).select("source", sketch.combined("bm", "asked", "intersection").alias("bm"))
    return bridge.coverage(parts, asked)


# --- keys of documents (the store's queries are in queries_calls.py) -------------------------------------------------

_KEYS = f"ks AS (SELECT doc_id, 'h:' || sha1(array_to_string(list_sort(list_distinct({_LIST})), chr(0))) AS key FROM documents)"


@query(f"WITH {_KEYS}, p AS (SELECT DISTINCT key FROM ks WHERE doc_id % 3 <> 0), c AS (SELECT DISTINCT key FROM ks WHERE doc_id % 3 <> 1) SELECT key, CASE WHEN key NOT IN (SELECT key FROM p) THEN 'N' WHEN key NOT IN (SELECT key FROM c) THEN 'D' ELSE 'R' END AS part FROM (SELECT key FROM p UNION SELECT key FROM c)")
def key_drn(spark, d):
    keyed = docs(spark, d).select("doc_id", K.content_key(words()).alias("bit"))
    p, c = keyed.filter("doc_id % 3 <> 0").select("bit").distinct(), keyed.filter("doc_id % 3 <> 1").select("bit").distinct()
    return context.evolve(p, c).withColumnRenamed("bit", "key")
