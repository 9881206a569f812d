"""Queries over time, search and windows; see queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions.hashing import token_bits
from bitloom.operators import algebra, lut, search, sketch, temporal
from bitloom.plans import oracle as O
from bitloom.plans.oracle_hash import bit as sql_bit
from bitloom.plans.oracle_hash import hashed
from bitloom.plans.queries import _CONTAIN, _DAILY, _LIST, _daily, _pairs, bit_sets, docs, query, read, rows, sets, words
from bitloom.streaming import windows

_SIZES = (1, 3, 9, 27)


def _commits(spark, d):
    """One commit for each day of events, numbered from 1."""
    from pyspark.sql import Window as W

    packed = sketch.pack(_daily(spark, d), "step")
    return packed.withColumn("commit", F.row_number().over(W.orderBy("step")))  # one row a day


_LAYERS = (
    *_DAILY,
    "nu AS (SELECT step, row_number() OVER (ORDER BY step) AS c FROM (SELECT DISTINCT step FROM at_)), mx AS (SELECT max(c) AS n FROM nu)",
    f"ly AS (SELECT {' + '.join(f'(c <= (n // {s}) * {s})::BIGINT' for s in _SIZES[1:])} AS layer, step FROM nu, mx)",
    "la AS (SELECT DISTINCT layer, bit FROM ly JOIN at_ USING (step))",
)


def _layers(spark, d):
    c = _commits(spark, d)
    now = c.agg(F.max("commit").alias("now"))
    return temporal.pyramid(c.join(F.broadcast(now)), F.col("now"), sizes=_SIZES)


@query(O.with_(*_LAYERS) + "SELECT layer, count(*) AS popcount FROM la GROUP BY layer")
def pyramid_layers(spark, d):
    return _layers(spark, d).select("layer", sketch.popcount("bm").alias("popcount"))


@query(O.with_(*_LAYERS) + "SELECT (SELECT count(DISTINCT bit) FROM at_) AS popcount, (SELECT count(*) FROM (SELECT bit FROM la EXCEPT SELECT bit FROM at_)) + (SELECT count(*) FROM (SELECT bit FROM at_ EXCEPT SELECT bit FROM la)) = 0 AS holds")
def pyramid_union_invariant(spark, d):
    """The union of all layers is that of all commits."""
    layers = _layers(spark, d).agg(F.bitmap_or_agg("bm").alias("bm"))
    commits = _commits(spark, d).agg(F.bitmap_or_agg("bm").alias("all"))
    return layers.join(F.broadcast(commits)).select(sketch.popcount("bm").alias("popcount"), (F.col("bm") == F.col("all")).alias("holds"))


@query(O.with_(*_LAYERS, O.pairs("SELECT x.layer AS a, y.layer AS b FROM (SELECT DISTINCT layer FROM la) x, (SELECT DISTINCT layer FROM la) y WHERE x.layer <> y.layer", "la", "layer")) + "SELECT a, b, tau FROM m")
def cross_layer_bss(spark, d):
    return algebra.measured(_pairs(_layers(spark, d), "layer")).select("a", "b", "tau")


@query(O.with_(O.atoms("source")) + "SELECT x.source AS a, y.source AS b, count(*) AS weight FROM at_ x JOIN at_ y ON x.bit = y.bit AND x.source < y.source GROUP BY ALL HAVING count(*) > 1000")
def rlink_weights(spark, d):
    return temporal.rlinks(_pairs(sets(spark, d, "source"), "source", "a < b"), 1000)


@query(_CONTAIN + " SELECT item_id, doc_id, n AS shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM ni) WHERE rank <= 3")
def precedents(spark, d):
    items, own = bit_sets(read(spark, d, "benchmark"), "item_id"), bit_sets(docs(spark, d), "doc_id")
    return search.precedents(items, own, "item_id", "doc_id", 3).withColumn("rank", F.col("rank").cast("long"))


_TAU = f""", nc AS ({O.card("SELECT item_id, doc_id, bit % 32 AS tz, count(*) AS c FROM ia JOIN da USING (bit) GROUP BY ALL", "item_id, doc_id")}),
    qc AS ({O.card(O.counts("ia", "item_id"), "item_id")}),
    ta AS (SELECT item_id, doc_id, n AS shared, least(nc.card / qc.card, 1.0) AS tau FROM ni JOIN nc USING (item_id, doc_id) JOIN qc USING (item_id))"""


@query(_CONTAIN + _TAU + " SELECT item_id, doc_id, shared, tau, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS rank FROM ta WHERE tau > 0.5) WHERE rank <= 3")
def two_phase_search(spark, d):
    items, own = bit_sets(read(spark, d, "benchmark"), "item_id"), bit_sets(docs(spark, d), "doc_id")
    return search.two_phase(items, own, "item_id", "doc_id").withColumn("rank", F.col("rank").cast("long"))


@query(_CONTAIN + _TAU + " SELECT item_id, doc_id, shared, tau FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY tau DESC, doc_id) AS rank FROM ta) WHERE rank = 1")
def contamination(spark, d):
    """For each benchmark item the document that holds most of it."""
    items, own = bit_sets(read(spark, d, "benchmark"), "item_id"), bit_sets(docs(spark, d), "doc_id")
    best = search.top(search.inclusion(items, own, "item_id", "doc_id"), "item_id", "doc_id", "tau", 1)
    return best.select("item_id", "doc_id", "shared", "tau")


_TF = "tb AS (SELECT bit, count(*)::DOUBLE AS tf FROM (SELECT DISTINCT doc_id, bit FROM occ JOIN hb USING (token)) GROUP BY bit)"


@query(O.with_(O.occ(keys="doc_id, lang"), O.bits(), "at_ AS (SELECT DISTINCT lang, bit FROM occ JOIN hb USING (token))", _TF) + "SELECT lang, sum(tf) AS rank, sum(tf) / count(*) AS mean_rank FROM at_ JOIN tb USING (bit) GROUP BY lang")
def rank_vector(spark, d):
    tf = lut.tf_bits(docs(spark, d).select(F.explode(token_bits(words())).alias("bit")))
    return temporal.rank_vector(rows(spark, d, "lang"), tf, "lang")


@query(O.with_(O.occ(keys="doc_id"), O.bits(), _TF) + "SELECT bit FROM tb WHERE tf > 100")
def observable_mask(spark, d):
    tf = lut.tf_bits(docs(spark, d).select(F.explode(token_bits(words())).alias("bit")))
    return temporal.observable(tf.withColumnRenamed("tf", "rank"), 100).select(F.col("bit").cast("long").alias("bit"))


_FLUX = "SELECT event_type, date_diff('day', DATE '1970-01-01', ts::DATE) AS step, count(*) AS rank FROM events GROUP BY ALL"


@query(f"SELECT event_type, step, rank, delta, delta - lag(delta) OVER w AS accel FROM (SELECT *, rank - lag(rank) OVER (PARTITION BY event_type ORDER BY step) AS delta FROM ({_FLUX})) WINDOW w AS (PARTITION BY event_type ORDER BY step)")
def rank_flux(spark, d):
    e = read(spark, d, "events")
    ranks = e.groupBy("event_type", F.datediff(F.col("ts"), F.lit("1970-01-01")).cast("long").alias("step")).agg(F.count("*").alias("rank"))
    return temporal.rank_flux(ranks, "step", "event_type")


_PARTS = """pt AS (SELECT coalesce(c.step, p.step + 1) AS step, coalesce(c.bit, p.bit) AS bit, CASE WHEN p.bit IS NULL THEN 'N' WHEN c.bit IS NULL THEN 'D' ELSE 'R' END AS part
    FROM at_ c FULL OUTER JOIN at_ p ON p.bit = c.bit AND p.step = c.step - 1)"""


@query(O.with_(*_DAILY, _PARTS, f"cd AS ({O.card(O.counts('''(SELECT * FROM pt WHERE part <> 'R')''', 'step, part'), 'step, part')})", "wd AS (SELECT step, coalesce(max(card) FILTER (part = 'N'), 0.0) AS gained, coalesce(max(card) FILTER (part = 'D'), 0.0) AS lost FROM cd GROUP BY step)")
    + "SELECT *, gained - lost AS v, (gained - lost) - lag(gained - lost) OVER (ORDER BY step) AS a FROM wd")
def steering(spark, d):
    return temporal.steering(temporal.step_parts(_daily(spark, d), "step"), "step")


def _level_sql(n: int) -> str:
    grams = f"SELECT lang, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i+{n - 1}], chr(0)))) AS token FROM wl WHERE len(w) >= {n}"
    return f"o{n} AS ({grams}), t{n} AS (SELECT DISTINCT token FROM o{n}), {hashed(f't{n}', n - 1, f'h{n}')}, l{n} AS (SELECT lang, {n} AS level, count(DISTINCT {sql_bit()}) AS popcount FROM o{n} JOIN h{n} USING (token) GROUP BY lang)"


@query(O.with_(f"wl AS (SELECT role AS lang, {_LIST} AS w FROM conversations)", *map(_level_sql, (1, 2, 3))) + "SELECT lang AS role, level, popcount FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)")
def globals_by_level(spark, d):
    out = search.levels(read(spark, d, "conversations"), words(), 3, "role")
    return out.select("role", "level", sketch.popcount("bm").alias("popcount"))


@query(f"WITH k AS (SELECT DISTINCT unnest({_LIST}) AS token FROM documents WHERE lang = 'en'), i AS (SELECT DISTINCT item_id, unnest({_LIST}) AS token FROM benchmark) SELECT item_id, count(*) AS tokens, count(*) FILTER (token NOT IN (SELECT token FROM k)) AS unknown FROM i GROUP BY item_id")
def exact_gate(spark, d):
    known = lut.occurrences(docs(spark, d).filter("lang = 'en'"), words())
    return search.hallucination(lut.occurrences(read(spark, d, "benchmark"), words(), "item_id"), known, "item_id")


@query("""WITH s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM (FROM embeddings WHERE vec_id % 20 = 0) q, embeddings v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS k FROM s) SELECT query, array_to_string(list_sort(list('tid' || id)), ',') AS tokens FROM r WHERE k <= 10 GROUP BY query""")
def embed_sketch(spark, d):
    """Every vector whose id is divisible by 20, against all vectors."""
    v = read(spark, d, "embeddings")
    out = search.embed_tokens(v, v.filter("vec_id % 20 = 0"), 10)
    return out.select("query", F.concat_ws(",", "tokens").alias("tokens"))


@query(O.with_(O.atoms()) + "SELECT lang, 32768 - count(*) AS popcount FROM at_ GROUP BY lang")
def complement(spark, d):
    return sets(spark, d, "lang").select("lang", sketch.popcount(sketch.complement("bm")).alias("popcount"))


_TYPES = ("occ AS (SELECT *, user_id::VARCHAR AS token FROM events)", O.bits())


def _user():
    return F.col("user_id").cast("string")


@query(O.with_(*_TYPES) + "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(DISTINCT bit) AS popcount, count(*) AS n_events FROM occ JOIN hb USING (token) GROUP BY ALL")
def tumbling_sketch(spark, d):
    out = windows.tumbling(read(spark, d, "events"), _user(), "1 day", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", sketch.popcount("bm").alias("popcount"), "n_events")


@query(O.with_(*_TYPES) + "SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * k AS start, count(DISTINCT bit) AS popcount, count(*) AS n_events FROM occ JOIN hb USING (token), range(2) r(k) GROUP BY ALL")
def sliding_sketch(spark, d):
    out = windows.sliding(read(spark, d, "events"), _user(), "2 days", "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), sketch.popcount("bm").alias("popcount"), "n_events")


_SESSION = """se AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR) IS NOT TRUE AS f,
    CASE WHEN f THEN 1 ELSE 0 END AS fresh FROM events))"""


@query(O.with_(_SESSION, "occ AS (SELECT *, event_type AS token FROM se)", O.bits()) + "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end_, count(DISTINCT bit) AS popcount, count(*) AS n_events FROM occ JOIN hb USING (token) GROUP BY user_id, k")
def session_sketch(spark, d):
    out = windows.sessions(read(spark, d, "events"), F.col("event_type"), "6 hours", "user_id")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end_"), sketch.popcount("bm").alias("popcount"), "n_events")
