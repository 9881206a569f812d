"""Queries over the store, elements, programs, nodes and laws, each through its operator; see queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.consts import PREFIXES
from bitloom.functions import hashing as H
from bitloom.functions import keys as K
from bitloom.functions.hashing import token_bits
from bitloom.functions.text import Pattern, Tokenizer
from bitloom.operators import bridge, context, joins, lut, search, sketch, temporal
from bitloom.plans import oracle as O
from bitloom.plans.oracle_hash import bit as sql_bit
from bitloom.plans.queries import _ASKED, _KEYS, _LIST, _bit_sets, _request, _trigrams, docs, own_sets, query, read, rows, sets, words
from bitloom.plans.queries_time import _level_sql
from bitloom.sources import files
from bitloom.sources.shared import new_path

# --- store ---------------------------------------------------------------------------------------------------------


def _store(spark, d, pinned: bool = False):
    """A store of the documents' distinct words by content key, those of the even ids pinned where asked for."""
    from bitloom.sources.store import Store

    store = Store(spark, new_path(spark, "store"))
    own = docs(spark, d).select("doc_id", K.content_key(words()).alias("key"), F.array_join(F.array_sort(F.array_distinct(words())), "\0").cast("binary").alias("bytes"))
    store.put_all(own)
    if pinned:
        store.pin_all(own.filter("doc_id % 2 = 0").select("key").distinct())
    return store


@query(f"WITH {_KEYS} SELECT DISTINCT key FROM ks WHERE starts_with(key, 'h:a') ORDER BY key")
def store_list_prefix(spark, d):
    return _store(spark, d).keys("h:a")


@query(f"WITH {_KEYS} SELECT DISTINCT key, substr(key, 3) AS sha1 FROM ks")
def store_contents(spark, d):
    """What a store gives back after one key was deleted, put again, and all was compacted: by its sha1 the bytes put in."""
    store = _store(spark, d)
    key = store.keys().first()
    if key is not None:
        data = store.get(key.key)
        store.delete(key.key)
        store.put(key.key, data)
    store.compact()
    return store.contents().select("key", F.sha1("bytes").alias("sha1"))


@query(f"WITH {_KEYS} SELECT DISTINCT key, key NOT IN (SELECT key FROM ks WHERE doc_id % 2 = 0) AS removed FROM ks")
def gc_survivors(spark, d):
    store = _store(spark, d, pinned=True)
    gone = store.gc().withColumn("removed", F.lit(True))
    return gone.unionByName(store.keys().withColumn("removed", F.lit(False)))


@query("SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY event_type")
def named_values(spark, d):
    """The last version of each named value."""
    from bitloom.sources.store import Store

    store = Store(spark, new_path(spark, "store"))
    store.put_tmp_all(read(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("ver"), F.col("props").cast("binary").alias("bytes")))
    return store.named().select("key", F.col("bytes").cast("string").alias("value"))


@query(O.with_(O.atoms("doc_id"), f"cd AS ({O.card(O.counts('at_', 'doc_id'), 'doc_id')})", "pc AS (SELECT doc_id, count(*) AS popcount FROM at_ GROUP BY 1)")
    + "SELECT doc_id, popcount, card, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS token_count FROM documents JOIN cd USING (doc_id) JOIN pc USING (doc_id)")
def ingest_records(spark, d):
    """What an ingest run records of each text that has words."""
    out = files.records(docs(spark, d), "doc_id")
    return out.select("doc_id", F.col("popcount").cast("long").alias("popcount"), "card", F.col("token_count").cast("long").alias("token_count"))


# --- elements and programs -----------------------------------------------------------------------------------------

_OTHER = "europe of the middle east"
_PAIRED = O.with_(
    f"occ AS (SELECT k, unnest(string_split(lower(t), ' ')) AS token FROM (SELECT 'a' || r_regionkey AS k, r_name AS t FROM region UNION ALL SELECT 'b' || r_regionkey, '{_OTHER}' FROM region))",
    O.bits(), "at_ AS (SELECT DISTINCT k, bit FROM occ JOIN hb USING (token))", O.pairs("SELECT 'a' || r_regionkey AS a, 'b' || r_regionkey AS b FROM region", "at_", "k"),
)
_POP = "(SELECT count(*) FROM (SELECT bit FROM at_ WHERE k = a {0} SELECT bit FROM at_ WHERE k = b))"


@query(_PAIRED + f"SELECT a AS region, (SELECT count(*) FROM at_ WHERE k = a) AS popcount, card_a AS card, {_POP.format('UNION')} AS either, {_POP.format('INTERSECT')} AS both, {_POP.format('EXCEPT')} AS only, jaccard, tau, rho, tau >= 0.3 AND rho <= 0.5 AS holds, subset FROM m")
def element_measures(spark, d):
    """Elements of region names against one other, by the operators of elements; one row a region, few by nature."""
    from bitloom.plans.element import Session

    s, out = Session(spark), []
    other = s.tokenize(_OTHER)
    for r in read(spark, d, "region").collect():
        e = s.load(s.store(s.inscribe(r.r_name.lower().split(" "))))
        m = e.morph_to(other, 0.3, 0.5)
        sizes = (e.popcount, e.card, (e + other).popcount, (e * other).popcount, (e - other).popcount)
        out.append((f"a{r.r_regionkey}", *sizes, e.jaccard(other), m["inclusion"], m["exclusion"], m["holds"], e.is_subset_of(other)))
    return spark.createDataFrame(out, "region string, popcount long, card double, either long, both long, only long, jaccard double, tau double, rho double, holds boolean, subset boolean")


@query(_PAIRED + f"SELECT a AS region, (SELECT count(*) FROM at_ WHERE k = a) AS popcount, card_or, {_POP.format('EXCEPT')} AS only, jaccard, tau FROM m")
def program_results(spark, d):
    """The same by programs of the postfix language: strings, stack words, set words and a definition."""
    from bitloom.plans.element import Session

    s, out = Session(spark), []
    for r in read(spark, d, "region").collect():
        source = f'"{r.r_name}" TOKENIZE DUP POPCOUNT SWAP "{_OTHER}" TOKENIZE ( region, other ) OVER OVER UNION CARD ROT ROT OVER OVER DIFF POPCOUNT ROT ROT OVER OVER JACCARD ROT ROT : last BSS ;'
        out.append((f"a{r.r_regionkey}", *s.exec(source)))
    return spark.createDataFrame([(k, int(n), c, int(o), j, t) for k, n, c, o, j, t in out], "region string, popcount long, card_or double, only long, jaccard double, tau double")


# --- encodings, registers, index ------------------------------------------------------------------------------------


@query(f"SELECT n_nationkey, lower(substr(n_name, 1, 1)) IN ({', '.join(repr(c) for c in PREFIXES)}) AS valid FROM nation")
def cid_prefixes(spark, d):
    return read(spark, d, "nation").select("n_nationkey", K.is_valid_prefix(F.lower(F.substring("n_name", 1, 1))).alias("valid"))


@query(O.with_(O.atoms()) + "SELECT lang, bit, bit // 32 AS reg, bit % 32 AS tz FROM at_")
def bit_addresses(spark, d):
    """Bits back from their dense registers, and their addresses to bits again."""
    back = sketch.from_dense(sketch.dense_registers(rows(spark, d, "lang"), "lang"), "lang")
    split = back.select("lang", H.reg_of(F.col("bit")).alias("reg"), H.tz_of(F.col("bit")).alias("tz"))
    return split.select("lang", H.address(F.col("reg"), F.col("tz")).cast("long").alias("bit"), F.col("reg").cast("long").alias("reg"), F.col("tz").cast("long").alias("tz"))


@query("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda x: lower(x)), '|') AS tokens FROM part")
def word_tokens(spark, d):
    t = Tokenizer().pattern(Pattern.any(b"x")).word_pattern().lowercase()
    return read(spark, d, "part").select("p_partkey", F.array_join(t.tokens("p_name"), "|").alias("tokens"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '#', ' ')) AS token FROM customer")
def trimmed_tokens(spark, d):
    """Tokens with white space around them: runs up to a digit, trimmed."""
    t = Tokenizer().pattern(Pattern.break_(b"~")).trim().lowercase()
    named = read(spark, d, "customer").select("c_custkey", F.concat(F.lit(" \t"), F.translate("c_name", "#", " "), F.lit("  ~")).alias("t"))
    return named.select("c_custkey", F.explode(t.tokens("t")).alias("token")).filter("token <> ''")


_DOC_BITS = "SELECT DISTINCT doc_id, lang, bit FROM occ JOIN hb USING (token)"


@query(O.with_(O.occ(keys="doc_id, lang"), O.bits()) + f"SELECT bit, max(n) AS tf FROM (SELECT lang, bit, count(*)::DOUBLE AS n FROM ({_DOC_BITS}) WHERE lang IN ('en', 'fr') GROUP BY ALL) GROUP BY bit")
def tf_bits_merged(spark, d):
    """The greater of two languages' frequencies of each bit."""
    own = lambda lang: lut.tf_bits(docs(spark, d).filter(F.col("lang") == lang).select(F.explode(token_bits(words())).alias("bit")))
    return lut.tf_bits_merge(own("en"), own("fr")).withColumn("bit", F.col("bit").cast("long"))


@query(O.with_(O.occ(keys="doc_id, lang"), O.bits(), "at_ AS (SELECT DISTINCT lang, bit FROM occ JOIN hb USING (token))") + f"SELECT bit, tf FROM at_ JOIN (SELECT bit, count(*)::DOUBLE AS tf FROM ({_DOC_BITS}) WHERE lang = 'en' GROUP BY bit) USING (bit) WHERE lang = 'fr'")
def time_lens(spark, d):
    """The French sketch through the frequencies of the English documents."""
    tf = lut.tf_bits(docs(spark, d).filter("lang = 'en'").select(F.explode(token_bits(words())).alias("bit")))
    return temporal.time_lens(rows(spark, d, "lang").filter("lang = 'fr'").select("bit"), tf).select(F.col("bit").cast("long").alias("bit"), "tf")


@query(O.with_(O.occ()) + "SELECT 'en∪fr' AS label, count(DISTINCT token) AS tokens FROM occ WHERE lang IN ('en', 'fr')")
def node_union(spark, d):
    occ = lut.occurrences(docs(spark, d), words(), "lang")
    label, tokens = lut.node_union(occ.filter("lang = 'en'"), occ.filter("lang = 'fr'"), "en", "fr")
    return tokens.agg(F.count("*").alias("tokens")).select(F.lit(label).alias("label"), "tokens")


@query(O.with_(O.atoms(), _trigrams("at_", "lang", "tg")) + "SELECT lang, count(*) AS n, sum(bit)::BIGINT AS total FROM tg GROUP BY lang")
def sketch_trigrams(spark, d):
    """The 3-grams of each sketch's bits in order, as bits: how many, and their sum."""
    grams = _bit_sets(spark, d).select("lang", bridge.trigram_bits(F.col("bits")).alias("bits"))
    total = F.aggregate("bits", F.lit(0).cast("long"), lambda a, x: a + x)
    return grams.select("lang", F.size("bits").cast("long").alias("n"), total.alias("total"))


# --- nodes and contexts --------------------------------------------------------------------------------------------


@query(_ASKED + " SELECT a AS source, rho FROM m")
def node_novelty(spark, d):
    return bridge.novelty(sets(spark, d, "source"), _request(spark, d), "source")


@query(O.with_(O.atoms("source, doc_id")) + """SELECT source AS node, count(DISTINCT bit) + CASE WHEN source = 'src2' THEN (SELECT count(*) FROM (SELECT bit FROM at_ WHERE source = 'src3' EXCEPT SELECT bit FROM at_ WHERE source = 'src2')) ELSE 0 END AS popcount,
    count(DISTINCT doc_id) + CASE source WHEN 'src1' THEN -1 WHEN 'src2' THEN 1 ELSE 0 END AS set_count FROM at_ WHERE source <> 'src0' GROUP BY source""")
def router_changes(spark, d):
    """A registry of nodes after one was removed, one lost a set, and one got another's sketch."""
    nodes = bridge.node_fingerprints(own_sets(spark, d, "source").filter(sketch.popcount("bm") > 0), "source").withColumnRenamed("source", "node")
    router = bridge.Router(nodes).remove_node("src0").remove_set("src1").add_set("src2", nodes.filter("node = 'src3'"))
    return router.nodes.select("node", sketch.popcount("bm").alias("popcount"), F.col("set_count").cast("long").alias("set_count"))


@query(O.with_(O.atoms("source")) + "SELECT (SELECT count(DISTINCT bit) FROM at_) AS whole, count(DISTINCT bit) AS popcount FROM at_ WHERE source <> 'src0'")
def context_without(spark, d):
    """The state of all sources, and of all but one; putting it back gives the first again."""
    every = sets(spark, d, "source")
    one = every.filter("source = 'src0'")
    less = context.without_generator(every, one)
    whole = context.state(context.with_generator(less, one)).select(sketch.popcount("bm").alias("whole"))
    return whole.join(context.state(less).select(sketch.popcount("bm").alias("popcount")))


@query("""WITH RECURSIVE f AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
    n AS (SELECT src, dst, count(*) AS n FROM f WHERE dst IS NOT NULL GROUP BY src, dst), e AS (SELECT src, dst, n::DOUBLE / sum(n) OVER (PARTITION BY dst) AS weight FROM n),
    w0 AS (SELECT 'view' AS node, 0 AS wave),
    w1 AS (SELECT dst AS node, 1 AS wave FROM e JOIN w0 ON src = node WHERE dst NOT IN (SELECT node FROM w0) GROUP BY dst HAVING sum(weight) >= 0.2),
    w2 AS (SELECT dst AS node, 2 AS wave FROM e JOIN w1 ON src = node WHERE dst NOT IN (SELECT node FROM w0 UNION ALL SELECT node FROM w1) GROUP BY dst HAVING sum(weight) >= 0.2)
    SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2""")
def agent_waves(spark, d):
    """Event types as agents: what fires after views, by the shares of what follows what."""
    from pyspark.sql import Window as W

    f = context.transitions(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    edges = f.withColumn("weight", F.col("w") / F.sum("w").over(W.partitionBy("dst"))).select("src", "dst", "weight")
    return search.waves(edges, spark.createDataFrame([("view",)], "node string"), 2, 0.2)


@query(O.with_("occ AS (SELECT event_type, user_id::VARCHAR AS token FROM events)", O.bits(), "at_ AS (SELECT DISTINCT event_type, bit FROM occ JOIN hb USING (token))",
    "f AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)")
    + "SELECT dst AS node, count(DISTINCT bit) AS popcount FROM (SELECT DISTINCT src, dst FROM f WHERE dst IS NOT NULL AND src <> dst) JOIN at_ ON event_type = src GROUP BY dst")
def agent_inboxes(spark, d):
    """The users of all event types that each type follows on, as one sketch."""
    e = read(spark, d, "events")
    edges = context.transitions(e, "user_id", ["ts", "event_id"], "event_type").filter("src <> dst")
    own = sketch.build(e.select(F.col("event_type").alias("node"), F.array(F.col("user_id").cast("string")).alias("t")), F.col("t"), "node")
    return search.inboxes(edges, own).select("node", sketch.popcount("bm").alias("popcount"))


# --- time ----------------------------------------------------------------------------------------------------------

_SIZES = (1, 3, 9, 27)
_BY_TYPE = (
    "occ AS (SELECT event_type, date_diff('day', DATE '1970-01-01', ts::DATE) AS step, user_id::VARCHAR AS token FROM events)", O.bits(),
    "at_ AS (SELECT DISTINCT event_type, step, bit FROM occ JOIN hb USING (token))",
    "nu AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY step) AS c, count(*) OVER (PARTITION BY event_type) AS n FROM (SELECT DISTINCT event_type, step FROM at_))",
    f"la AS (SELECT DISTINCT event_type, {' + '.join(f'(c <= (n // {s}) * {s})::BIGINT' for s in _SIZES[1:])} AS layer, bit FROM nu JOIN at_ USING (event_type, step))",
)


def _shared(k: int) -> str:
    """CTE t{k}(event_type, tau): how much of layer k layer 0 has."""
    both = f"(SELECT x.event_type, x.bit FROM la x JOIN la y ON x.event_type = y.event_type AND x.bit = y.bit WHERE x.layer = 0 AND y.layer = {k})"
    return f"""i{k} AS ({O.card(O.counts(both, 'event_type'), 'event_type')}), w{k} AS ({O.card(O.counts(f'(SELECT event_type, bit FROM la WHERE layer = {k})', 'event_type'), 'event_type')}),
    t{k} AS (SELECT event_type, CASE WHEN coalesce(w{k}.card, 0) = 0 THEN 1.0 ELSE least(coalesce(i{k}.card, 0) / w{k}.card, 1.0) END AS tau FROM (SELECT DISTINCT event_type FROM la) LEFT JOIN i{k} USING (event_type) LEFT JOIN w{k} USING (event_type))"""


@query(O.with_(*_BY_TYPE, _shared(1), _shared(3)) + "SELECT event_type, t1.tau AS tau_01, t3.tau AS tau_03, CASE WHEN t1.tau < 0.5 THEN 'override' WHEN t3.tau < 0.3 THEN 're-route' ELSE 'stable' END AS action FROM t1 JOIN t3 USING (event_type)")
def controller_actions(spark, d):
    """For each event type, what the layers of its pyramid of days call for."""
    from pyspark.sql import Window as W

    e = read(spark, d, "events")
    bits = e.select("event_type", F.datediff(F.col("ts"), F.lit("1970-01-01")).alias("step"), F.explode(token_bits(F.array(F.col("user_id").cast("string")))).alias("bit"))
    packed, by = sketch.pack(bits, "event_type", "step"), W.partitionBy("event_type")  # a row for each type and day
    commits = packed.withColumn("commit", F.row_number().over(by.orderBy("step"))).withColumn("now", F.count("*").over(by))
    return temporal.control(temporal.pyramid(commits, F.col("now"), "event_type", sizes=_SIZES), "event_type")


_RANKS = ("occ AS (SELECT date_diff('day', DATE '1970-01-01', ts::DATE) AS step, user_id::VARCHAR AS token FROM events)", O.bits(), "ra AS (SELECT step, bit, count(*) AS rank FROM occ JOIN hb USING (token) GROUP BY ALL)")


@query(O.with_(*_RANKS, """pa AS (SELECT coalesce(c.step, p.step + 1) AS step, coalesce(sum(c.rank - p.rank), 0) AS drift, coalesce(sum(c.rank) FILTER (p.bit IS NULL), 0) AS influx, coalesce(sum(p.rank) FILTER (c.bit IS NULL), 0) AS outflux, coalesce(sum(c.rank), 0) AS mass
    FROM ra c FULL OUTER JOIN ra p ON c.bit = p.bit AND p.step = c.step - 1 GROUP BY 1)""", "va AS (SELECT *, influx - outflux AS v FROM pa)", "aa AS (SELECT *, v - lag(v) OVER (ORDER BY step) AS a FROM va)")
    + "SELECT step, drift::BIGINT AS drift, influx::BIGINT AS influx, outflux::BIGINT AS outflux, v::BIGINT AS v, a::BIGINT AS a, mass::BIGINT AS mass, (mass * a)::BIGINT AS force FROM aa")
def rank_forces(spark, d):
    """Ranks of users by day: what drifts, comes and goes, and the force that its change stands for."""
    e = read(spark, d, "events")
    ranks = e.select(F.datediff(F.col("ts"), F.lit("1970-01-01")).cast("long").alias("step"), F.explode(token_bits(F.array(F.col("user_id").cast("string")))).alias("bit"))
    return temporal.flux(ranks.groupBy("step", "bit").agg(F.count("*").alias("rank")), "step")


@query(O.with_(_RANKS[0], O.bits(), "at_ AS (SELECT DISTINCT step, bit FROM occ JOIN hb USING (token))", "nu AS (SELECT step, row_number() OVER (ORDER BY step) AS c FROM (SELECT DISTINCT step FROM at_))")
    + "SELECT x.step, count(DISTINCT bit) AS popcount FROM nu x JOIN nu y ON y.c BETWEEN x.c - 2 AND x.c JOIN at_ ON at_.step = y.step GROUP BY x.step")
def running_sketch(spark, d):
    """The users of each day and the two days with events before it."""
    from bitloom.plans.queries import _daily

    packed = sketch.pack(_daily(spark, d), "step")
    return temporal.running(packed, "step", 3).select("step", sketch.popcount("bm").alias("popcount"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS seen FROM events WHERE event_type = 'view' AND value IS NOT NULL GROUP BY ALL)
    SELECT event_id, seen FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_views(spark, d):
    """Each purchase with the value of its user's last view before it."""
    e = read(spark, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"))
    return joins.asof(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "ts", "user_id", value="seen").select("event_id", "seen")


@query("""WITH s AS (SELECT event_id AS signup, ts AS a, ts + INTERVAL 2 HOUR AS b FROM events WHERE event_type = 'signup') SELECT signup, count(*) AS errors FROM s JOIN events e ON e.ts >= a AND e.ts < b WHERE e.event_type = 'error' GROUP BY signup""")
def errors_within(spark, d):
    """Errors of any user in the two hours after each signup: an interval join on cells of time."""
    e = read(spark, d, "events")
    spans = e.filter("event_type = 'signup'").select(F.col("event_id").alias("signup"), F.col("ts").alias("a"), F.expr("ts + interval 2 hours").alias("b"))
    points = e.filter("event_type = 'error'").select("ts")
    seconds = lambda df, *cs: df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in cs})
    return joins.within(seconds(points, "ts"), seconds(spans, "a", "b"), "ts", "a", "b", 3.6e9).groupBy("signup").agg(F.count("*").alias("errors"))


@query(O.with_(f"wl AS (SELECT role AS lang, {_LIST} AS w FROM conversations)", *(_level_sql(n).split(f", l{n} AS")[0] for n in (1, 2, 3)),
    "lv AS (" + " UNION ALL ".join(f"SELECT DISTINCT lang, {n} AS level, {sql_bit()} AS bit FROM o{n} JOIN h{n} USING (token)" for n in (1, 2, 3)) + ")",
    "hs AS (SELECT DISTINCT lang, bit FROM lv), gs AS (SELECT DISTINCT level, bit FROM lv)") + "SELECT lang AS role, level, count(*) AS popcount FROM hs JOIN gs USING (bit) GROUP BY ALL")
def globals_within(spark, d):
    """What each role's whole sketch shares with the global one of each n-gram length."""
    own = search.levels(read(spark, d, "conversations"), words(), 3, "role")
    whole = own.groupBy("role").agg(F.bitmap_or_agg("bm").alias("h"))
    every = own.groupBy("level").agg(F.bitmap_or_agg("bm").alias("g"))
    both = whole.join(F.broadcast(every))  # three rows
    return both.select("role", "level", sketch.popcount(sketch.combined("h", "g", "intersection")).alias("popcount"))


# --- covers and order ----------------------------------------------------------------------------------------------

_COVER = f"""WITH RECURSIVE {O.occ(keys="source")}, o2 AS ({O.tokens("benchmark", "1 AS source")}), un AS (SELECT token FROM occ UNION SELECT token FROM o2), {O.bits("un")},
    tg AS (SELECT DISTINCT bit FROM o2 JOIN hb USING (token)), ow AS (SELECT DISTINCT source, bit FROM occ JOIN hb USING (token) WHERE bit IN (SELECT bit FROM tg)),
    tf AS (SELECT bit, {{0}} AS tf FROM (SELECT * FROM occ JOIN hb USING (token)) GROUP BY bit),
    g AS (SELECT -1::BIGINT AS round, NULL::VARCHAR AS source, []::BIGINT[] AS done
    UNION ALL SELECT g.round + 1, b.source, list_concat(g.done, b.bits) FROM g, LATERAL (SELECT ow.source, sum(tf) AS n, list(ow.bit) AS bits FROM ow JOIN tf USING (bit) WHERE NOT list_contains(g.done, ow.bit) GROUP BY ow.source ORDER BY n DESC, ow.source LIMIT 1) b)
    SELECT round, source FROM g WHERE round >= 0"""
for _name in ("hb", "tg", "ow", "tf"):  # else every round computes them again
    _COVER = _COVER.replace(f"{_name} AS (", f"{_name} AS MATERIALIZED (", 1)


def _cover(spark, d, **how):
    target = sketch.atoms(read(spark, d, "benchmark"), words())
    own = sets(spark, d, "source").select("source", F.explode(sketch.bits("bm")).alias("bit"))
    chosen = search.minimal_cover(own, target, "source", **how)
    return spark.createDataFrame(list(enumerate(chosen)), "round long, source string")


@query(_COVER.format("1"))
def minimal_cover(spark, d):
    """Sources chosen greedily until no source adds one of the benchmark's bits (a loop on the driver, a source a round)."""
    return _cover(spark, d)


@query(_COVER.format("count(*)"))
def ranked_cover(spark, d):
    """The same by rank: each round the source whose new bits occur most in the documents."""
    occ = lut.occurrences(docs(spark, d), words())
    index = lut.build(occ, seeds=(0,)).join(lut.tf_table(occ), "token").groupBy("bit").agg(F.sum("n").alias("tf"))
    return _cover(spark, d, ranks=index)


@query(f"WITH t AS (SELECT item_id, {_LIST} AS w FROM benchmark), p AS (SELECT item_id, unnest(list_zip(w[:-2], w[2:])) AS x FROM t WHERE len(w) > 1) SELECT item_id, x[1] AS src, x[2] AS dst, count(*) AS n FROM p GROUP BY ALL")
def restored_bigrams(spark, d):
    """The bigrams of each benchmark item's restored order: those it was restored from, none more and none less."""
    from bitloom.plans.queries_more import restored_order

    out = restored_order(spark, d).select("item_id", F.explode(F.arrays_zip(F.col("tokens").alias("src"), F.slice("tokens", F.lit(2), F.greatest(F.size("tokens"), F.lit(1))).alias("dst"))).alias("p"))
    return out.select("item_id", "p.src", "p.dst").filter("dst is not null").groupBy("item_id", "src", "dst").agg(F.count("*").alias("n"))
