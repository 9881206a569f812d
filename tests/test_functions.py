"""Known answers and laws of hashes, keys, texts and records."""

import hashlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitloom.consts import MODULE_PORTS
from bitloom.functions import hashing as H
from bitloom.functions import keys as K
from bitloom.functions import records as Z
from bitloom.functions.text import DEFAULT, Match, Normalizer, Pattern, Tokenizer


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hash_known_answers():
    assert H.murmur3([b"tid0", b"hello"]).tolist() == [2892634914804110692, 14688674573012802306]
    assert H.murmur3([b"x"], 1)[0] == 4758147062373591632
    assert H.positions(H.murmur3([(262).to_bytes(4, "little"), (48300).to_bytes(4, "little")])).tolist() == [759 * 32] * 2
    assert H.positions(np.array([0, 1023 | 1024], np.uint64)).tolist() == [31, 1023 * 32]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=70), min_size=1, max_size=8), st.integers(0, 3))
def test_hash_does_not_depend_on_the_batch(tokens, seed):
    assert H.murmur3(tokens, seed).tolist() == [int(H.murmur3([t], seed)[0]) for t in tokens]


def test_bits_of_columns_equal_numpy(spark):
    words = ["", "a", "fifteen bytes..", "sixteen bytes...", "é" * 20, "x" * 33]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.b for r in df.select("w", H.bit_of("w").alias("b")).collect()}
    assert got == dict(zip(words, H.positions(H.murmur3([w.encode() for w in words])).tolist()))
    row = spark.createDataFrame([(words + [None],), (None,), ([],)], "w array<string>").select(H.token_bits("w").alias("b")).collect()
    assert row[0].b == sorted(set(got.values())) and row[1].b is None and row[2].b == []


def test_addresses(spark):
    assert one(spark, H.address(F.lit(3), F.lit(5)).alias("x")).x == 101
    assert one(spark, H.reg_of(F.lit(101)).alias("r"), H.tz_of(F.lit(101)).alias("t")) == (3, 5)
    with pytest.raises(Exception, match="no such bit"):
        one(spark, H.address(F.lit(1024), F.lit(0)))
    with pytest.raises(Exception, match="no such bit"):
        one(spark, H.checked_bit(F.lit(32768)))


def test_token_encodings(spark):
    df = spark.createDataFrame([(0,), (262,), (2**32 - 1,)], "n long")
    for r in df.select("n", H.token_text(F.col("n")).alias("t"), H.token_le(F.col("n")).alias("b")).collect():
        assert r.t == f"tid{r.n}" and bytes(r.b) == r.n.to_bytes(4, "little")
    back = df.select("n", H.parse_token_text(H.token_text(F.col("n"))).alias("t"), H.parse_token_le(H.token_le(F.col("n"))).alias("b"))
    assert all(r.t == r.n == r.b for r in back.collect())
    bad = spark.createDataFrame([("tid",), ("tidx",), ("tid4294967296",), ("xtid1",)], "s string")
    assert all(r.x is None for r in bad.select(H.parse_token_text(F.col("s")).alias("x")).collect())
    assert one(spark, H.parse_token_le(F.lit(b"abc")).alias("x")).x is None


def test_keys(spark):
    tokens = F.array(*(F.lit(t) for t in ("b", "a", "b")))
    sha = hashlib.sha1(b"a\0b").hexdigest()
    row = one(spark, *(f(tokens).alias(n) for n, f in (("h", K.content_key), ("o", K.original_key), ("r", K.retained_key), ("d", K.departed_key), ("n", K.new_key), ("v", K.view_key), ("l", K.context_key), ("c", K.catalog_key))))
    assert row.asDict() == {p: f"{p}:{sha}" for p in "hordnvlc"}
    parent = "ab" * 20
    expected = hashlib.sha1(parent.encode() + (7).to_bytes(8, "little")).hexdigest()
    assert one(spark, K.ontological_key(F.lit(parent), F.lit(7)).alias("k")).k == expected
    assert one(spark, K.user_key(F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8")).alias("k")).k == "u:6ba7b8119dad11d180b400c04fd430c8"
    assert one(spark, K.user_key(F.lit("nope")).alias("k")).k is None
    assert one(spark, K.make_cid(F.lit("h"), F.lit(sha)).alias("k")).k == f"h:{sha}"
    assert one(spark, K.make_cid(F.lit("x"), F.lit(sha)).alias("k")).k is None
    assert one(spark, K.parse_cid(F.lit(f"h:{sha.upper()}")).alias("k")).k.asDict() == {"prefix": "h", "sha1": sha.upper()}
    assert one(spark, K.parse_cid(F.lit("h:1")).alias("k")).k is None
    assert one(spark, K.cid(F.lit("x")).alias("a"), K.commit_key(F.lit("x")).alias("b"), K.system_key(F.lit("tf")).alias("c")) == (
        f"h:{hashlib.sha1(b'x').hexdigest()}", f"t:{hashlib.sha1(b'x').hexdigest()}", "system:tf",
    )


def test_patterns():
    word = Pattern.span(b"abc")
    assert word.match_at(b"xabcd", 1) == Match(1, 4) and word.match_at(b"xabcd") is None
    assert Pattern.break_(b"c").match_at(b"abc") == Match(0, 2) and Pattern.break_(b"a").match_at(b"abc") == Match(0, 0)
    assert Pattern.arb().match_at(b"abc", 1) == Match(1, 3)
    assert word.cat(Pattern.literal(b"c")).match_at(b"abc") is None  # never gives back
    assert Pattern.literal(b"a").alt(Pattern.literal(b"ab")).cat(Pattern.literal(b"c")).match_at(b"abc") is None
    nested = Pattern.literal(b"a").capture().cat(Pattern.any(b"b")).capture()
    assert nested.match_at(b"ab").captures == ((0, 1), (0, 2))
    assert [m.start for m in Pattern.break_(b"x").find_all(b"xx")] == [0, 1, 2]
    assert Pattern.notany(b"a").find(b"aab") == Match(2, 3)


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcAB1 é\t", max_size=20))
def test_tokenizer_of_one_text_lowers_after_extraction(text):
    import re

    assert DEFAULT.apply(text) == [w.lower() for w in re.findall("[A-Za-z0-9]+", text)]


def test_tokenizer_columns_equal_apply(spark):
    texts = ["", "  ", "Hello World", "a", "x-y z", "K K", "one two three four", "été Été", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    taken = [
        DEFAULT, DEFAULT.ngrams(1, 3), DEFAULT.ngrams(2, 2).pad("<s>", "</s>"), Tokenizer().keep_only("aeiouAEIOU"), Tokenizer().trim().lowercase(),
        Tokenizer().pattern(Pattern.span(b"abcdefghijklmnopqrstuvwxyz")), Tokenizer().pattern(Pattern.notany(b" ").cat(Pattern.break_(b" "))),
    ]
    for tok in taken:
        for r in df.select("t", tok.tokens("t").alias("x")).collect():
            assert r.x == (None if r.t is None else tok.apply(r.t)), (tok, r.t)
    with pytest.raises(ValueError):
        DEFAULT.ngrams(2, 1)
    assert Normalizer("trim").apply(b" \t") is None and Normalizer("lowercase").apply("É".encode()) == "É".encode()


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 32767), max_size=300))
def test_portable_bytes_round_trip(bits):
    data = Z.to_bytes_of(np.array(sorted(bits), np.int32))
    assert Z.from_bytes_of(data).tolist() == sorted(bits)


def test_portable_bytes_layout(spark):
    assert Z.to_bytes_of(np.empty(0, int)) == struct.pack("<II", 12346, 0)
    assert Z.to_bytes_of(np.array([1, 258])) == struct.pack("<IIHHIHH", 12346, 1, 0, 1, 16, 1, 258)
    many = np.arange(5000)
    assert len(Z.to_bytes_of(many)) == 16 + 8192 and Z.from_bytes_of(Z.to_bytes_of(many)).tolist() == many.tolist()
    assert Z.from_bytes_of(b"abc") is None and Z.from_bytes_of(struct.pack("<II", 12346, 1)) is None
    row = one(spark, Z.to_bytes_native(F.array(F.lit(1), F.lit(258))).alias("x")).x
    assert bytes(row) == Z.to_bytes_of(np.array([1, 258]))


def test_frequency_bytes(spark):
    rows = spark.createDataFrame([(3, 1.5), (32767, 2.0)], "bit int, tf double").withColumn("k", F.lit("a"))
    data = bytes(Z.tf_bytes(rows, "k").first().bytes)
    assert len(data) == 262148
    values = Z.tf_from_bytes(data + b"more")
    assert values[3] == 1.5 and values[32767] == 2.0 and values.sum() == 3.5
    assert Z.tf_from_bytes(data[:-1]) is None and Z.tf_from_bytes(b"\0" * len(data)) is None


def test_commits_modules_handshakes(spark):
    body = one(spark, Z.commit_json(F.lit(5), *(F.lit(x) for x in "shdrn")).alias("x")).x
    assert body == '{"ts":5,"s":"s","h":"h","d":"d","r":"r","n":"n"}'
    assert Z.commit_from_json(body)["ts"] == 5 and Z.commit_from_json("{") is None and Z.commit_from_json("{}") is None
    assert {r.kind: (r.inputs, r.outputs) for r in Z.module_ports(spark).collect()} == MODULE_PORTS
    assert Z.port_in_range("Ground", 1, True) and not Z.port_in_range("Ground", 1)
    assert one(spark, Z.handshake(F.lit(True), F.lit(False)).alias("x")).x.asDict() == {"fire": False, "stalled": True}
    block = bytes(one(spark, Z.dense_block(F.unhex(F.repeat(F.lit("00"), 4096)), b"NAME").alias("x")).x)
    assert len(block) == 4116 and block[:20] == b"NAME\0\0\0\0" + struct.pack("<III", 1, 1024, 32)
