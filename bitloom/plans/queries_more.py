"""Queries over encodings, keys, patterns, records, snapshots and compositions; see queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.functions import hashing as H
from bitloom.functions import keys as K
from bitloom.functions import records as Z
from bitloom.functions.text import Pattern, Tokenizer
from bitloom.operators import algebra, search, sketch, temporal
from bitloom.plans import oracle as O
from bitloom.plans.queries import _LANGS, _LIST, _pairs, docs, own_sets, query, read, rows, sets, words
from bitloom.sources import files

_SWAP = "substr({0}, 7, 2) || substr({0}, 5, 2) || substr({0}, 3, 2) || substr({0}, 1, 2)"


@query(f"WITH c AS (SELECT c_custkey * 1000003 % 4294967296 AS n, printf('%08X', c_custkey * 1000003 % 4294967296) AS h FROM customer) SELECT n, 'tid' || n AS text, {_SWAP.format('h')} AS le, n AS text_back, n AS le_back FROM c")
def token_encodings(spark, d):
    n = read(spark, d, "customer").select((F.col("c_custkey") * 1000003 % 2**32).alias("n"))
    both = n.select("n", H.token_text(F.col("n")).alias("text"), H.token_le(F.col("n")).alias("b"))
    return both.select("n", "text", F.hex("b").alias("le"), H.parse_token_text(F.col("text")).alias("text_back"), H.parse_token_le(F.col("b")).alias("le_back"))


@query("SELECT n_name, 'h:' || sha1(n_name) AS cid, NULL::VARCHAR AS bad, 'h' AS prefix, sha1(n_name) AS sha1, 't:' || sha1(n_name) AS commit_key, 'system:' || n_name AS system_key, 'u:' || md5(n_name) AS user_key FROM nation")
def cid_checks(spark, d):
    n, name = read(spark, d, "nation"), F.col("n_name")
    md5 = F.regexp_replace(F.md5(name), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    cid = K.make_cid(F.lit("h"), K.sha1_hex(name))
    cols = {"cid": cid, "bad": K.make_cid(F.lit("x"), K.sha1_hex(name)), "prefix": K.parse_cid(cid)["prefix"], "sha1": K.parse_cid(K.cid(name))["sha1"]}
    cols |= {"commit_key": K.commit_key(name), "system_key": K.system_key(name), "user_key": K.user_key(md5)}
    return n.select("n_name", *(v.alias(k) for k, v in cols.items()))


_LE8 = " || ".join(f"substr(printf('%016X', n_nationkey), {k}, 2)" for k in range(15, 0, -2))


@query(f"SELECT n_nationkey, sha1(encode(sha1(n_name)) || unhex({_LE8})) AS key FROM nation")
def ontological_keys(spark, d):
    return read(spark, d, "nation").select("n_nationkey", K.ontological_key(K.sha1_hex(F.col("n_name")), F.col("n_nationkey")).alias("key"))


_NAMES = "sha1(array_to_string(list_sort(list(DISTINCT n_name)), chr(0)))"


@query("SELECT n_regionkey, " + ", ".join(f"'{p}:' || {_NAMES} AS {n}" for n, p in (("catalog", "c"), ("retained", "r"), ("departed", "d"), ("novel", "n"), ("view", "v"), ("context", "l"))) + " FROM nation GROUP BY n_regionkey")
def region_keys(spark, d):
    names = read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    made = {"catalog": K.catalog_key, "retained": K.retained_key, "departed": K.departed_key, "novel": K.new_key, "view": K.view_key, "context": K.context_key}
    return names.select("n_regionkey", *(f(F.col("names")).alias(k) for k, f in made.items()))


@query("SELECT * FROM (VALUES ('Slice', 1, 1), ('Renorm', 1, 1), ('Gate', 1, 1), ('Ground', 1, 2), ('Experts', 2, 1), ('Merge', 2, 1)) t(kind, inputs, outputs)")
def module_ports(spark, d):
    return Z.module_ports(spark)


@query("SELECT n_nationkey, (n_nationkey % 2 = 0 AND n_regionkey % 2 = 0) AS fire, (n_nationkey % 2 = 0 AND n_regionkey % 2 <> 0) AS stalled FROM nation")
def handshakes(spark, d):
    beat = Z.handshake(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey") % 2 == 0)
    return read(spark, d, "nation").select("n_nationkey", beat.alias("x")).select("n_nationkey", "x.fire", "x.stalled")


def _joined(name: str, tokenizer):
    def run(spark, d):
        return read(spark, d, "part").select("p_partkey", F.array_join(tokenizer().tokens("p_name"), "|").alias("tokens"))

    return run


_PART = "SELECT p_partkey, array_to_string({0}, '|') AS tokens FROM part"
_VOWELS = b"aeiou"
query(_PART.format("regexp_extract_all(p_name, '[aeiou]+')"), "pattern_span")(_joined("span", lambda: Tokenizer().pattern(Pattern.span(_VOWELS))))
query(_PART.format("regexp_extract_all(p_name, '[aeiou]')"), "pattern_any")(_joined("any", lambda: Tokenizer().pattern(Pattern.any(_VOWELS))))
query(_PART.format("regexp_extract_all(p_name, '[^aeiou]')"), "pattern_notany")(_joined("notany", lambda: Tokenizer().pattern(Pattern.notany(_VOWELS))))
query(_PART.format("regexp_extract_all(p_name, 'a[^ ]*')"), "pattern_break")(_joined("break", lambda: Tokenizer().pattern(Pattern.literal(b"a").cat(Pattern.break_(b" ")))))
query(_PART.format("regexp_extract_all(p_name, '(?s)a.*')"), "pattern_arb")(_joined("arb", lambda: Tokenizer().pattern(Pattern.literal(b"a").cat(Pattern.arb()))))
query(_PART.format("regexp_extract_all(p_name, 'an|[aeiou]')"), "pattern_alt")(_joined("alt", lambda: Tokenizer().pattern(Pattern.literal(b"an").alt(Pattern.any(_VOWELS)))))
query(_PART.format("list_filter(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda x: regexp_replace(lower(x), '[^bcdfg]', '', 'g')), lambda x: x <> '')"), "normalizers")(
    _joined("normalizers", lambda: Tokenizer().trim().lowercase().keep_only("bcdfg"))
)


_SNAP = "p AS (SELECT doc_id, sha1(text) AS c FROM documents WHERE doc_id % 5 <> 0), q AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE sha1(text) END AS c FROM documents WHERE doc_id % 7 <> 0), ch AS (SELECT coalesce(p.doc_id, q.doc_id) AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'A' WHEN q.doc_id IS NULL THEN 'D' WHEN p.c <> q.c THEN 'M' END AS status FROM p FULL OUTER JOIN q ON p.doc_id = q.doc_id)"


def _changes(spark, d):
    c = docs(spark, d).select("doc_id", F.sha1(F.col("text").cast("binary")).alias("content"))
    now = c.filter("doc_id % 7 <> 0").withColumn("content", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("content")))
    return files.changes(c.filter("doc_id % 5 <> 0"), now, "doc_id")


@query(f"WITH {_SNAP} SELECT doc_id, status FROM ch WHERE status IS NOT NULL")
def snapshot_changes(spark, d):
    return _changes(spark, d)


@query(f"WITH {_SNAP}, n AS (SELECT source, count(*) FILTER (status = 'A') AS added, count(*) FILTER (status = 'D') AS deleted FROM ch JOIN documents USING (doc_id) WHERE status IS NOT NULL GROUP BY source) SELECT *, abs(added - deleted) AS difference, abs(added - deleted) > 3 AS diverges FROM n")
def divergence(spark, d):
    return files.divergence(_changes(spark, d).join(docs(spark, d).select("doc_id", "source"), "doc_id"), "source")


@query(O.with_(O.atoms(), _LANGS) + "SELECT x.a, x.b, y.b AS c, least(x.tau, y.tau) AS tau, greatest(x.rho, y.rho) AS rho FROM m x JOIN m y ON x.b = y.a AND x.a <> y.b")
def composed_morphisms(spark, d):
    m = algebra.measured(_pairs(sets(spark, d, "lang"), "lang")).select("a", "b", "tau", "rho")
    n = m.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("tau").alias("t2"), F.col("rho").alias("r2"))
    both = m.join(n, "b").filter("a <> c")
    out = algebra.composed(F.col("tau"), F.col("rho"), F.col("t2"), F.col("r2"))
    return both.select("a", "b", "c", out.alias("x")).select("a", "b", "c", "x.tau", "x.rho")


@query(f"WITH k AS (SELECT doc_id, list_sort(list_distinct({_LIST})) AS w FROM documents), g AS (SELECT w, min(doc_id) AS first, count(*) AS n FROM k GROUP BY w) SELECT first, n FROM g WHERE n > 1")
def equal_token_sets(spark, d):
    """Documents of equal words, by their key: one row for each group of two or more."""
    keyed = docs(spark, d).select("doc_id", K.content_key(words()).alias("key"))
    return keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("first", "n")


@query(O.with_(O.atoms("doc_id"), "e AS (SELECT doc_id, list(bit ORDER BY bit) AS b FROM at_ GROUP BY doc_id)") + "SELECT min(doc_id) AS first, count(*) AS n FROM e GROUP BY b HAVING count(*) > 1")
def equal_sketches(spark, d):
    """Documents of equal sketches: packed ones are compared by their SHA-256, so that 4 KiB a document are neither shuffled nor
    held."""
    s = own_sets(spark, d, "doc_id").select("doc_id", F.sha2("bm", 256).alias("same"), sketch.popcount("bm").alias("size"))
    groups = s.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max("size").alias("size"))
    return groups.filter("n > 1 and size > 0").select("first", "n")  # filtered here, each sketch is made once


@query(O.with_(O.atoms("lang, source"), "tp AS (SELECT bit FROM at_ GROUP BY bit ORDER BY count(*) DESC, bit LIMIT 20)", "ow AS (SELECT DISTINCT source AS layer, bit FROM at_ WHERE bit IN (SELECT bit FROM tp))") + "SELECT x.bit AS a, y.bit AS b, count(*) AS n FROM ow x JOIN ow y ON x.layer = y.layer AND x.bit < y.bit GROUP BY ALL")
def cooccurrence(spark, d):
    """How often the twenty most common bits stand together in a source."""
    r = rows(spark, d, "lang", "source")
    top = r.groupBy("bit").count().orderBy(F.desc("count"), "bit").limit(20).select("bit")
    out = temporal.cooccurrence(r.select(F.col("source").alias("layer"), "bit"), top)
    return out.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n")


@query(f"WITH b AS (SELECT DISTINCT unnest({_LIST}) AS token FROM benchmark), t AS (SELECT unnest({_LIST}) AS token FROM documents WHERE lang = 'en') SELECT DISTINCT token FROM b WHERE token NOT IN (SELECT token FROM t)")
def unearned_tokens(spark, d):
    """Tokens of an index over the benchmark that the English documents give no frequency."""
    from bitloom.operators import lut

    index = lut.occurrences(read(spark, d, "benchmark"), words())
    tf = lut.tf_table(lut.occurrences(docs(spark, d).filter("lang = 'en'"), words()))
    return search.unearned(index, tf)


@query()
def restored_order(spark, d):
    """The order of each benchmark item's words, from its bigrams alone."""
    pairs = read(spark, d, "benchmark").select("item_id", F.explode(F.zip_with(words(), F.slice(words(), F.lit(2), F.greatest(F.size(words()), F.lit(1))), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))).alias("p"))
    return search.restore_order(pairs.select("item_id", "p.src", "p.dst").filter("dst is not null"), "item_id")
