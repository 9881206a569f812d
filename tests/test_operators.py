"""Laws and small examples of sketches, algebra, reverse index, contexts, bridges, time and search."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.functions import records as Z
from bitloom.functions.hashing import murmur3, positions
from bitloom.functions.text import DEFAULT
from bitloom.operators import algebra, bridge, context, lut, search, sketch, temporal
from bitloom.streaming import windows


def bits_of(words):
    return set(positions(murmur3([w.encode() for w in words])).tolist()) if words else set()


def texts(spark, **named):
    return spark.createDataFrame([(k, v) for k, v in named.items()], "k string, text string")


def built(spark, **named):
    return sketch.build(texts(spark, **named), DEFAULT.tokens("text"), "k")


def test_sketch_is_the_or_of_token_bits(spark):
    s = built(spark, a="one two three", b="", c="one one")
    got = {r.k: (set(r.x), r.n) for r in s.select("k", sketch.bits("bm").alias("x"), sketch.popcount("bm").alias("n")).collect()}
    assert got == {"a": (bits_of(["one", "two", "three"]), 3), "b": (set(), 0), "c": (bits_of(["one"]), 1)}
    own = texts(spark, a="one two three", b="", c="one one").select("k", sketch.of_tokens(DEFAULT.tokens("text")).alias("bm"))
    assert {r.k: bytes(r.bm) for r in own.collect()} == {r.k: bytes(r.bm) for r in s.collect()}
    reg, tz = divmod(next(iter(bits_of(["one"]))), 32)
    assert {r.k: r.h for r in s.select("k", sketch.has_bit(F.col("bm"), reg, tz).alias("h")).collect()} == {"a": True, "b": False, "c": True}


def test_cardinality_column_equals_scalar(spark):
    rng = np.random.default_rng(1)
    counts = [[0] * 32, [1024] * 32, [1024, 1024, 700, 300] + [0] * 28, [1024] + [0] * 31] + [np.minimum(1024, rng.poisson(2000 / 2 ** np.arange(1, 33))).tolist() for _ in range(5)]
    df = spark.createDataFrame([(c,) for c in counts], "c array<int>")
    assert [r.x for r in df.select(sketch.cardinality(F.col("c")).alias("x")).collect()] == [float(sketch.cardinality_of(np.array(c))) for c in counts]


def test_cardinality_is_near_and_monotone(spark):
    sizes = [0, 10, 100, 1000, 50000]
    df = spark.createDataFrame([(n,) for n in sizes], "n int")
    words = F.transform(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("w"), i.cast("string")))
    got = [r.c for r in sketch.build(df, words, "n").orderBy("n").select(sketch.card("bm").alias("c")).collect()]
    assert got == sorted(got) and got[0] == 0 and all(abs(g - n) <= 0.15 * n for g, n in zip(got, sizes))


def test_dense_round_trip(spark):
    rows = sketch.atoms(texts(spark, a="one two three four five"), DEFAULT.tokens("text"), "k")
    back = sketch.from_dense(sketch.dense_registers(rows, "k"), "k")
    assert sorted(r.bit for r in back.collect()) == sorted(r.bit for r in rows.collect())
    counts = {r.tz: r.n for r in sketch.bit_counts(rows, "k").collect()}
    assert len(counts) == 32 and sum(counts.values()) == rows.count()
    assert sketch.register_popcounts(rows, "k").count() == 1024


def test_set_operations(spark):
    s = {r.k: r.bm for r in built(spark, a="x y z", b="y z w").collect()}
    df = spark.createDataFrame([(s["a"], s["b"])], "a binary, b binary")
    a, b = bits_of("xyz"), bits_of("yzw")
    for how, want in (("union", a | b), ("intersection", a & b), ("difference", a - b), ("symmetric_difference", a ^ b)):
        assert set(df.select(sketch.combined("a", "b", how).alias("c")).select(sketch.bits("c").alias("x")).first().x) == want
    assert df.select(sketch.popcount(sketch.complement("a")).alias("n")).first().n == 32768 - len(a)


def test_nothing_intersected_is_empty(spark):
    none = built(spark, a="x").filter("false")
    assert algebra.intersection_all(none).select(sketch.popcount("bm").alias("n")).first().n == 0
    assert algebra.union_all(none).select(sketch.popcount("bm").alias("n")).first().n == 0


def test_measures_of_empty_and_equal_sets(spark):
    s = {r.k: r.bm for r in built(spark, a="x y z", e="").collect()}
    pairs = spark.createDataFrame([("ee", s["e"], s["e"]), ("ae", s["a"], s["e"]), ("ea", s["e"], s["a"]), ("aa", s["a"], s["a"])], "p string, bm_a binary, bm_b binary")
    got = {r.p: r for r in algebra.measured(pairs).withColumn("eq", algebra.approx_equal(1.0)).collect()}
    assert (got["ee"].jaccard, got["ee"].tau, got["ee"].rho) == (1.0, 1.0, 0.0)
    assert (got["ae"].tau, got["ae"].rho, got["ae"].subset, got["ae"].superset) == (1.0, 0.0, False, True)
    assert (got["ea"].tau, got["ea"].rho, got["ea"].subset) == (0.0, 0.0, True)
    assert got["aa"].eq and not got["ea"].eq and got["aa"].jaccard == 1.0


def test_bitmap_key_follows_the_bits(spark):
    s = built(spark, a="x y", b="y x x", c="x")
    keys = {r.k: r.key for r in s.select("k", Z.bitmap_key("bm").alias("key")).collect()}
    assert keys["a"] == keys["b"] != keys["c"]
    back = s.select("k", "bm", Z.from_bytes(Z.to_bytes("bm")).alias("again")).collect()
    assert all(bytes(r.bm) == bytes(r.again) for r in back)


def test_materialize_prefers_frequent_then_largest(spark):
    index = spark.createDataFrame([(0, 5, "a"), (1, 5, "b"), (0, 5, "c"), (0, 7, "d")], "seed int, bit int, token string")
    tf = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "token string, n long")
    bits = spark.createDataFrame([(0, 5), (1, 5), (0, 7)], "seed int, bit int")
    assert {r.token for r in lut.materialize(bits, index, tf).collect()} == {"b", "d"}  # seeds meet on the bit
    assert {r.token for r in lut.restore(bits, index).collect()} == {"a", "b", "c", "d"}
    assert {r.token for r in lut.fiber(index, 5).collect()} == {"a", "c"}
    assert {r.token for r in lut.consensus(bits, index, 1).collect()} == {"a", "b", "c", "d"}


def test_restoring_distributes_over_unions(spark):
    words = "alpha beta gamma delta epsilon".split()
    index = lut.build(spark.createDataFrame([(w,) for w in words], "token string"), seeds=(0,))
    one = lambda ws: spark.createDataFrame([(b,) for b in bits_of(ws)], "bit int")
    get = lambda df: {r.token for r in lut.restore(df, index).collect()}
    assert get(algebra.union_rows(one(words[:2]), one(words[2:]))) == get(one(words[:2])) | get(one(words[2:])) == set(words)


def test_ranks(spark):
    index = spark.createDataFrame([(0, 0, "a"), (0, 0, "b"), (0, 33, "c")], "seed int, bit int, token string")
    tf = spark.createDataFrame([("a", 3), ("b", 5), ("c", 2)], "token string, n long")
    for how, bits, regs in (("sum", {0: 8, 33: 2}, {0: 8, 1: 2}), ("max", {0: 5, 33: 2}, {0: 5, 1: 2}), ("min", {0: 3, 33: 2}, {0: 0, 1: 0})):
        r = lut.bit_rank(index, tf, how)
        assert {x.bit: x.rank for x in r.collect()} == bits
        assert {x.reg: x.rank for x in lut.register_rank(r, how).collect()} == regs
    rows = spark.createDataFrame([("s", 0), ("s", 33), ("s", 99)], "k string, bit int")
    assert lut.set_rank(rows, lut.bit_rank(index, tf, "min"), "min", "k").first()["rank"] == 0
    assert lut.set_rank(rows, lut.bit_rank(index, tf, "sum"), "sum", "k").first()["rank"] == 10


def test_frequencies_merge_by_maximum(spark):
    a, b = (spark.createDataFrame(r, "token string, n long") for r in ([("x", 1), ("y", 5)], [("x", 3)]))
    assert {r.token: r.n for r in lut.tf_merge(a, b).collect()} == {"x": 3, "y": 5}


def test_merkle_roots(spark):
    import hashlib

    leaf = lambda b: hashlib.sha1(b"\0" + b.to_bytes(4, "little")).hexdigest()
    node = lambda x, y: hashlib.sha1(b"\1" + (x + y).encode()).hexdigest()
    assert lut.merkle_root_of([]) == hashlib.sha1(b"empty-atom-tree").hexdigest()
    assert lut.merkle_root_of([7]) == leaf(7)
    assert lut.merkle_root_of([1, 2, 3]) == node(node(leaf(1), leaf(2)), node(leaf(3), leaf(3)))
    assert spark.range(1).select(lut.merkle_leaf(F.lit(258)).alias("x")).first().x == leaf(258)
    assert lut.node_union(*(spark.createDataFrame([(t,)], "token string") for t in "ab"), "p", "q")[0] == "p∪q"


def test_evolution_and_invariants(spark):
    one = lambda bits: spark.createDataFrame([(b,) for b in bits], "bit int")
    a, b = one([1, 2, 3, 4, 5]), one([3, 4, 5, 6, 7])
    parts = context.evolve(a, b)
    assert {p: sum(r.part == p for r in parts.collect()) for p in "DRN"} == {"D": 2, "R": 3, "N": 2}
    assert context.invariants(parts, a, b).first().holds
    steps = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (4, 6)], "step long, bit int")
    got = {r.step: (r.departed, r.retained, r.novel) for r in context.evolve_steps(steps, "step").collect()}
    assert got == {1: (0, 0, 2), 2: (1, 1, 0), 3: (1, 0, 0), 4: (0, 0, 1), 5: (1, 0, 0)}


def test_generators(spark):
    g = built(spark, a="x y", b="y z", c="y x")
    gone = context.without_generator(g.select("bm"), g.filter("k = 'a'").select("bm"))
    assert gone.count() == 1  # a and c are equal
    assert context.state(context.with_generator(gone, g.filter("k = 'a'").select("bm"))).select(sketch.popcount("bm").alias("n")).first().n == 3


def test_follow(spark):
    t = spark.createDataFrame([("a", "b", 1), ("a", "b", 4), ("b", "c", 2)], "src string, dst string, w long")
    f = context.follow(t)
    assert {(r.src, r.dst): r.w for r in f.collect()} == {("a", "b"): 4, ("b", "c"): 2}
    assert context.follow_get(f, "a", "b").first().w == 4 and context.follow_get(f, "x", "b").first().w == 0
    kept = spark.createDataFrame([("a",), ("b",)], "token string")
    assert context.follow_restrict(context.follow_merge(f, t), kept).count() == 1


def test_spearman():
    assert bridge.spearman_of([1, 2, 3], [10, 20, 30]) == pytest.approx(1)
    assert bridge.spearman_of([1, 2, 3], [3, 2, 1]) == pytest.approx(-1)
    assert bridge.spearman_of([1, 1, 1], [1, 2, 3]) == 0 and bridge.spearman_of([5], [5]) == 1 and bridge.spearman_of([5], [4]) == 0
    assert bridge.average_ranks(np.array([5.0, 7, 5])).tolist() == [2.5, 1, 2.5]


def test_re_representation_keeps_order(spark):
    s = built(spark, a="x y", b="x y z").select("k", sketch.bits("bm").alias("bits"))
    r = {x.k: set(x.b) for x in s.select("k", bridge.re_represent(F.col("bits")).alias("b")).collect()}
    assert r["a"] <= r["b"]
    assert np.array_equal(bridge.represented_of(np.array(sorted(bits_of(["x", "y"])))), sorted(r["a"]))
    assert bridge.trigrams_of([b"a"]) == [b"_START_\0a\0_END_"] and bridge.trigrams_of([]) == []


def test_routing_and_coverage(spark):
    nodes = bridge.node_fingerprints(built(spark, p="a b c", q="x y z", r="a x").withColumnRenamed("k", "node"))
    asked = built(spark, ask="a b").select("bm")
    assert [r.node for r in bridge.route(nodes, asked, 5).collect()] == ["p", "r"]
    router = bridge.Router(nodes).remove_node("q").add_set("r", built(spark, z="b").select("bm")).remove_set("p")
    assert {r.node: r.set_count for r in router.nodes.collect()} == {"p": 0, "r": 2} and len(router) == 2 and not router.is_empty()
    assert [(r.node, r.tau) for r in router.rank(asked, 5).collect()] == [("p", 1.0), ("r", 1.0)]
    assert bridge.coverage(nodes.select("bm").limit(0), asked).first().coverage == 0
    assert bridge.coverage(built(spark, x="a", y="b").select("bm"), asked).first().coverage == 1
    assert bridge.coverage(asked, built(spark, x="").select("bm")).first().coverage == 1


def test_pyramid(spark):
    sizes = (1, 3, 9)

    def replay(n):  # layer of each commit by carrying the state on
        layers = [[], [], []]
        for c in range(1, n + 1):
            layers[0].append(c)
            for i in (0, 1):
                if c % sizes[i + 1] == 0:
                    layers[i + 1] += layers[i]
                    layers[i] = []
        return {c: i for i, cs in enumerate(layers) for c in cs}

    for n in (1, 3, 8, 9, 13, 20):
        got = spark.range(1, n + 1).select("id", temporal.layer_of(F.col("id"), F.lit(n), sizes).alias("l")).collect()
        assert {r.id: r.l for r in got} == replay(n), n


def test_time(spark):
    assert spark.range(1).select(temporal.controller(F.lit(0.4), F.lit(1.0)).alias("x"), temporal.controller(F.lit(0.6), F.lit(0.2)).alias("y"), temporal.controller(F.lit(0.6), F.lit(0.9)).alias("z")).first() == ("override", "re-route", "stable")
    channels = spark.createDataFrame([("x", 3.0, 1.0, 0.0), ("x", 1.0, 0.0, 1.0)], "k string, card_b double, tau double, rho double")
    assert temporal.channel_inclusion(channels, "k").first().asDict() == {"k": "x", "tau": 0.75, "rho": 0.25}
    layers = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)], "layer int, bit int")
    pairs = temporal.cooccurrence(layers, spark.createDataFrame([(1,), (2,)], "bit int")).collect()
    assert [(r.a, r.b, r.n) for r in pairs] == [(1, 2, 2)]
    ranks = spark.createDataFrame([("x", 1, 5), ("x", 2, 9), ("x", 3, 9)], "k string, step int, rank long")
    assert [(r.delta, r.accel) for r in temporal.rank_flux(ranks, "step", "k").orderBy("step").collect()] == [(None, None), (4, None), (0, -4)]


def test_search(spark):
    sets = spark.createDataFrame([("p", 1), ("p", 2), ("q", 3), ("r", 1), ("r", 2), ("r", 3)], "k string, bit int")
    target = spark.createDataFrame([(1,), (2,), (3,), (9,)], "bit int")
    assert search.minimal_cover(sets, target, "k", 5) == ["r"]
    assert search.complement(target).count() == 32764
    walk = spark.createDataFrame([("w", "a", "b"), ("w", "b", "c"), ("w", "c", "a"), ("w", "a", "d"), ("v", "a", "b"), ("v", "c", "d")], "k string, src string, dst string")
    got = {r.k: r.tokens for r in search.restore_order(walk, "k").collect()}
    assert got["w"] in (["a", "b", "c", "a", "d"],) and got["v"] is None
    edges = spark.createDataFrame([("a", "c", 0.5), ("b", "c", 0.5), ("c", "d", 1.0), ("d", "a", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a",), ("b",)], "node string")
    assert {r.node: r.wave for r in search.waves(edges, seeds, 5, 1.0).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}
    assert search.agent_scores(spark.createDataFrame([(1.0, 2.0, 4.0)], "tf1 double, tf2 double, tf3 double")).first().score == 3.0


def test_a_batch_is_sketched_in_slices(monkeypatch):
    """Whatever a batch holds, a few MB are in memory; and no slice changes a sketch."""
    import tracemalloc

    import pyarrow as pa

    words = pa.array([f"word{i}" for i in range(600_000)])
    lists = pa.ListArray.from_arrays(pa.array(range(0, 600_001, 300), pa.int32()), words)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"] * 1000), lists], ["k", "tokens_"])
    tracemalloc.start()
    made = [r for out in sketch._combiner(1)([batch]) for r in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(made) == 2 and peak < 60, peak

    monkeypatch.setattr("bitloom.functions.arrow.TOKENS", 1000)
    own = dict(a=set(), b=set())
    for r in batch.slice(1900).to_pylist():
        own[r["k"]] |= bits_of(r["tokens_"])
    for r in (r for out in sketch._combiner(1)([batch.slice(1900)]) for r in out.to_pylist()):
        assert set(np.flatnonzero(np.unpackbits(np.frombuffer(r["bm"], np.uint8), bitorder="little")).tolist()) == own[r["k"]]


def test_tokens_of_any_length_in_slices_of_a_column(spark, monkeypatch):
    import pyarrow as pa

    from bitloom.functions import arrow
    from bitloom.functions import hashing as H

    lists = pa.array([["x" * n for n in (0, 15, 16, 17, 33, 1000)], None, [], ["a", None, "b", "a"], ["é" * 9]], pa.list_(pa.string()))
    monkeypatch.setattr(arrow, "TOKENS", 3)
    for first in range(3):
        part = lists.slice(first)
        assert [i for at, n in arrow.slices(part) for i in range(at, at + n)] == list(range(len(part)))
        got = [set() for _ in part]
        for at, n in arrow.slices(part):
            for row, bit in zip(*H.found(part.slice(at, n))):
                got[at + row].add(int(bit))
        assert got == [bits_of([t for t in v if t is not None]) if v else set() for v in part.to_pylist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists.to_pylist())], "i int, w array<string>").coalesce(1)
    for r in df.select("i", "w", H.token_bits("w").alias("b"), sketch.of_tokens("w").alias("bm"), H.hash64(F.get("w", F.lit(1))).alias("h")).collect():
        want = None if r.w is None else sorted(bits_of([t for t in r.w if t is not None]))
        assert r.b == want and (r.bm is None) == (want is None)
        assert r.bm is None or np.flatnonzero(np.unpackbits(np.frombuffer(r.bm, np.uint8), bitorder="little")).tolist() == want
        assert r.h == (None if r.w is None or len(r.w) < 2 or r.w[1] is None else int(murmur3([r.w[1].encode()]).view(np.int64)[0]))


def test_ngrams_are_counted_by_parts_of_their_digests(spark, monkeypatch):
    """Totals and distinct n-grams of each key against plain Python, however often a task lets go of what it holds."""
    import pyarrow as pa

    from bitloom.operators import grams

    texts_ = [("a", "x y x y x y z"), ("b", "x y z"), (None, "x"), ("a", ""), ("a", None), ("b", " ".join(f"w{i % 7} v{i}" for i in range(50))), ("c", "...")]
    want: dict = {}
    for k, t in texts_:
        w = (t or "").replace(".", "").split()
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                want.setdefault((k, n), []).append(tuple(w[i : i + n]))
    want = {k: (len(v), len(set(v))) for k, v in want.items()}
    df = spark.createDataFrame(texts_, "k string, text string")
    got = grams.counts(df, DEFAULT.tokens("text"), "k", range(1, 4)).collect()
    assert {(r.k, r.n): (r.total, r.n_distinct) for r in got} == want and len(got) == len(want)
    two = grams.counts(df, DEFAULT.tokens("text"), "k", range(2, 3)).collect()
    assert {(r.k, r.n): (r.total, r.n_distinct) for r in two} == {k: v for k, v in want.items() if k[1] == 2}

    monkeypatch.setattr(grams, "HELD", 20)
    monkeypatch.setattr("bitloom.functions.arrow.TOKENS", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts_], pa.string()), pa.array([None if t is None else t.replace(".", "").split() for _, t in texts_], pa.list_(pa.string()))], ["key", "tokens"])
    rows = pa.Table.from_batches(list(grams._digests(range(1, 4))([batch, batch])))
    sums: dict = {}
    for out in grams._counted(rows.sort_by([("key", "ascending"), ("n", "ascending"), ("part", "ascending")]).combine_chunks().to_batches(max_chunksize=3)):
        for r in out.to_pylist():
            size, n = sums.get((r["key"], r["n"]), (0, 0))
            sums[r["key"], r["n"]] = (size + r["size"], n + r["n_distinct"])
    assert len(rows) > 100 and sums == {k: (2 * size, n) for k, (size, n) in want.items()}
    alike = np.array([(5, 1), (5, 2), (5, 1), (5, 2), (4, 1)] * 3, grams._DIGEST)
    assert len(grams._distinct(np.array([0, 0, 0, 1, 1] * 3), alike)) == 4


def test_a_word_that_follows_itself_keeps_its_order(spark):
    words = {"w": "the the end of the the the way".split(), "v": "so so".split()}
    walk = spark.createDataFrame([(k, a, b) for k, w in words.items() for a, b in zip(w, w[1:])], "k string, src string, dst string")
    for r in search.restore_order(walk, "k").collect():
        assert sorted(zip(r.tokens, r.tokens[1:])) == sorted(zip(words[r.k], words[r.k][1:])), r.k


def test_sessions_end_with_their_gap(spark, tmp_path):
    """An event that comes just when the gap is over begins a session, in a batch and in a stream; one without a token makes none
    and counts nowhere, but a batch goes on with it."""
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [(1, at(0), "a"), (1, at(6), "b"), (1, "2024-01-01 11:59:59.999999", "a"), (2, at(0), "a"), (2, at(5), None), (2, at(10), "b"), (3, at(1), None), (None, at(2), "c")]
    events = spark.createDataFrame(rows, "who int, t string, token string").select("who", F.col("t").cast("timestamp").alias("ts"), "token")
    seen = lambda df: sorted(((r.who or 0, str(r.start), str(r.end), r.n, r.n_events) for r in df.withColumn("n", sketch.popcount("bm")).collect()))
    d = "2024-01-01 "
    one = [(1, d + "00:00:00", d + "06:00:00", 1, 1), (1, d + "06:00:00", d + "17:59:59.999999", 2, 2)]
    none = [(0, d + "02:00:00", d + "08:00:00", 1, 1)]
    got = windows.sessions(events, F.col("token"), "6 hours", "who")
    assert seen(got) == none + one + [(2, d + "00:00:00", d + "16:00:00", 2, 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bm" not in plan[plan.rindex("Exchange") :] and "session_window" not in plan

    folder = str(tmp_path / "in")
    events.write.parquet(folder)
    stream = windows.sessions(spark.readStream.schema(events.schema).parquet(folder), F.col("token"), "6 hours", "who", late="1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r for r in seen(spark.table("sessions")) if r[0] < 2] == none + one


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    token = F.col("user_id").cast("string")
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(folder), token, "1 day", "event_type", late="10 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = windows.tumbling(events, token, "1 day", "event_type")
    get = lambda df: sorted((r.start, r.event_type, bytes(r.bm), r.n_events) for r in df.collect())
    assert get(spark.table("tumbling")) == get(batch)


def test_stream_of_commits(spark, sf, tmp_path):
    from bitloom.functions.hashing import token_bits

    events = spark.read.parquet(f"{sf}/events.parquet")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    bits = stream.select(F.explode(token_bits(F.array(F.col("user_id").cast("string")))).alias("bit"))
    bits.writeStream.foreachBatch(windows.pyramid_sink(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    commits = spark.read.parquet(out)
    layers = temporal.pyramid(commits, 4, sizes=(1, 3, 9))
    assert {r.layer for r in layers.collect()} == {0, 1}
    whole = sketch.pack(events.select(F.explode(token_bits(F.array(F.col("user_id").cast("string")))).alias("bit")))
    assert bytes(algebra.union_all(layers).first().bm) == bytes(whole.first().bm)


def test_embed_tokens_of_every_twentieth_id(spark, sf, monkeypatch):
    from bitloom.plans import queries_time  # noqa: F401
    from bitloom.plans.queries import QUERIES

    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "VECTOR_BLOCK", 90)
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = {}
    for q in (i for i in v if i % 20 == 0):
        best = sorted(v, key=lambda i: (-sum(x * y for x, y in zip(v[q].tolist(), v[i].tolist())), i))[:10]
        want[q] = ",".join(sorted(f"tid{i}" for i in best))
    got = {r.query: r.tokens for r in QUERIES["embed_sketch"](spark, sf).collect()}
    assert len(want) > 5 and got == want


def test_bitmap_keys_of_empty_and_dense_documents(spark, tmp_path):
    import hashlib
    import struct

    from bitloom.plans.queries import QUERIES

    many = [f"w{i}" for i in range(30_000)]
    rows = [(1, " ".join(many)), (2, "日本語 — ..."), (3, ""), (4, None), (5, "one two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.key for r in QUERIES["bitmap_keys"](spark, str(tmp_path)).collect()}
    key = lambda data: "h:" + hashlib.sha1(data).hexdigest()
    dense, few = bits_of(many), sorted(bits_of(["one", "two"]))
    assert len(dense) > 4096
    body = bytearray(8192)
    for b in dense:
        body[b // 8] |= 1 << b % 8
    head = lambda n: struct.pack("<IIHHI", 12346, 1, 0, n - 1, 16)
    empty = key(struct.pack("<II", 12346, 0))
    assert got == {1: key(head(len(dense)) + bytes(body)), 2: empty, 3: empty, 4: empty, 5: key(head(2) + struct.pack("<2H", *few))}


def test_minimal_cover_goes_on_until_nothing_is_left(spark, sf):
    from bitloom.plans import queries_calls  # noqa: F401
    from bitloom.plans.queries import QUERIES

    sets = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("source", DEFAULT.tokens("text").alias("w")).collect():
        sets[r.source] |= bits_of(r.w)
    left = set().union(*(bits_of(r.w) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select(DEFAULT.tokens("text").alias("w")).collect()))
    want = []
    while sets and (best := min(sets, key=lambda k: (-len(sets[k] & left), k))) and sets[best] & left:
        want.append(best)
        left -= sets[best]
    assert len(want) > 10
    assert [r.source for r in QUERIES["minimal_cover"](spark, sf).orderBy("round").collect()] == want
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 2), ("a", 3)], "k string, bit int")
    assert search.minimal_cover(nulls, spark.createDataFrame([(1,), (2,), (3,)], "bit int"), "k") == [None, "a"]


def test_waves_with_delays(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, 1), ("b", "c", 1.0, 2), ("c", "a", 1.0, 1), ("a", "d", 0.5, 3), ("c", "d", 0.5, 1), ("b", "d", 0.5, 3)], "src string, dst string, weight double, delay int")
    got = search.waves(edges, spark.createDataFrame([("a",)], "node string"), 6, 1.0)
    assert {r.node: r.wave for r in got.collect()} == {"a": 0, "b": 1, "c": 3, "d": 4}


def test_joins_in_time(spark):
    from bitloom.operators import joins

    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3), (None, 2)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("b", 4, "w"), (None, 1, "n"), ("b", 1, None)], "k string, t long, v string")
    assert {(r.k, r.t): r.v for r in joins.asof(left, right, "t", "k", value="v").collect()} == {("a", 5): "z", ("a", 1): None, ("b", 3): None, (None, 2): "n"}
    points = spark.createDataFrame([(x / 2,) for x in range(-10, 30)], "at double")
    spans = spark.createDataFrame([(1, 0.0, 3.0), (2, -4.5, 11.0), (3, 2.0, 2.0), (4, 5.0, 1.0), (5, 100.0, 200.0)], "i long, a double, b double")
    got = sorted((r.i, r["at"]) for r in joins.within(points, spans, "at", "a", "b", 2.0).collect())
    assert got == sorted((i, x / 2) for i, a, b in ((1, 0.0, 3.0), (2, -4.5, 11.0)) for x in range(-10, 30) if a <= x / 2 < b)


def test_inclusion_in_blocks(spark, monkeypatch):
    """The same whatever the blocks of queries and of pairs; against sets of Python."""
    import random

    r = random.Random(4)
    queries = [(i, sorted(r.sample(range(60), r.randint(0, 20)))) for i in range(9)]
    sets = [(i, sorted(r.sample(range(60), r.randint(0, 30)))) for i in range(40)] + [(90, None), (91, [])]
    q, s = spark.createDataFrame(queries, "q long, bits array<int>"), spark.createDataFrame(sets, "k long, bits array<int>")
    card = lambda bits: float(sketch.cardinality_of(np.bincount(np.array(sorted(bits), int) % 32, minlength=32)))
    want = {}
    for i, a in queries:
        for k, b in sets:
            both = set(a) & set(b or [])
            if both:
                want[(i, k)] = (len(both), min(card(both) / card(a), 1.0))
    for blocks, cells in ((1024, 1 << 22), (2, 64), (1, 1)):
        monkeypatch.setattr(search, "QUERIES", blocks)
        monkeypatch.setattr(search, "PAIR_CELLS", cells)
        assert {(x.q, x.k): (x.shared, x.tau) for x in search.inclusion(q, s, "q", "k").collect()} == want
