"""Near duplicates, mixing, packing, archives, neighbours and the pipeline, against plain Python and on odd tables."""

import collections
import hashlib
import heapq
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import ann, graph, minhash, mixing, near_dedup, packing, pii, registry, warc
from bitloom.llm.common import new_path, shared_folder, written
from bitloom.llm.tokenizer import encoder
from plain import plain_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, size string, words string"


def table(spark, rows):
    """rows: (doc_id, text, source)"""
    return spark.createDataFrame([(i, t, None, s, None, "c", "s", "w") for i, t, s in rows], DOCS)


def words(r, n):
    return [f"w{r.randint(0, 3000)}" for _ in range(n)]


def family(r, n, changes):
    base = words(r, 120)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**9)}"
        out.append(" ".join(w))
    return out


def plain_components(rows, k, percent=80):
    ids = [i for i, _ in rows]
    sets = [minhash.shingles(t, k) for _, t in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[a], sets[b]
            common = len(x & y)
            if common and 100 * common >= percent * (len(x) + len(y) - common):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_signatures_estimate_similarity():
    r = random.Random(5)
    a = words(r, 400)
    b = a[:300] + words(r, 100)
    x, y = (minhash.shingle_hashes(" ".join(t), 4) for t in (a, b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((minhash.signature(x) == minhash.signature(y)).mean() - true) < 0.15
    assert len(minhash.shingle_hashes("one two", 4)) == 1 and len(minhash.shingle_hashes(" ", 4)) == 0
    assert len(minhash.shingle_hashes("A b c d E", 4)) == len(minhash.shingles("a B c d e", 4)) == 2


def test_pruning_loses_no_more_than_it_may():
    rng, fewest = np.random.default_rng(2), minhash.fewest_matches(0.8, 1e-4)
    a = rng.integers(0, 2**32, (20000, minhash.N_HASHES), dtype=np.uint32)
    for similarity, low, high in ((0.8, 0.998, 1), (0.3, 0, 0.001)):
        b = np.where(rng.random(a.shape) < similarity, a, a + 1)
        assert low <= minhash.survivors(a, b, fewest).mean() <= high


def test_components_by_stars(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7)]
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        p, q = find(u), find(v)
        root[max(p, q)] = min(p, q)
    assert all(got.get(x, x) == find(x) for x in root)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("small", [32, 2])
def test_near_classes(spark, monkeypatch, small):
    """With small = 2 every larger bucket goes by its least id and then by blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(near_dedup, "HUB", 3)
    r = random.Random(7)
    texts = family(r, 12, 4) + family(r, 25, 8) + [" ".join(words(r, 60)) for _ in range(10)] + family(r, 6, 1) + ["same text here"] * 3 + ["short"] * 2 + ["", " \n"]
    r.shuffle(texts)
    rows = list(enumerate(texts, 10))
    df = table(spark, [(i, t, "s") for i, t in rows] + [(500, None, None), (None, "null id " * 9, "s"), (None, texts[0], "s")])
    for k in (4, 5):
        got = near_dedup.near_classes(df, k=k).collect()
        assert {x.id: x.component_id for x in got if x.id not in (None, 500)} == plain_components(rows, k)
        assert len(got) == df.count() and all(x.kept == (x.id is None or x.id == x.component_id) for x in got)
        assert {x.id: x.n_shingles for x in got if x.id is not None} == {i: len(minhash.shingles(t, k)) for i, t in rows} | {500: 0}
    named = near_dedup.near_classes(df.withColumn("doc_id", F.concat(F.lit("é "), F.lpad(F.col("doc_id").cast("string"), 5, "0"))), k=5)  # ids of another type
    assert {(x.id, x.component_id) for x in named.collect() if x.id} == {tuple(f"é {i:05}" for i in p) for p in [*plain_components(rows, 5).items(), (500, 500)]}
    kept = near_dedup.keep_one(df, k=5)
    assert kept.schema == df.schema
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted({*plain_components(rows, 5).values(), 500})
    assert near_dedup.near_classes(df.filter("false")).count() == 0


def test_repeated_ids_are_one_document(spark):
    a, b = family(random.Random(1), 2, 0)[0], " ".join(words(random.Random(2), 80))
    df = table(spark, [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, b, "s"), (3, b, "s")])
    got = near_dedup.near_classes(df).collect()
    assert len(got) == 5 and {x.component_id for x in got} == {1}
    kept = near_dedup.keep_one(df.withColumn("size", F.monotonically_increasing_id().cast("string")))
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == [(1, a), (2, b)]  # no text is lost with its id


# --- mixing --------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        each = (budget - sum(out.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * each > 2 * sizes[s] or not sizes[s]}
        if not over:
            return out | {s: w[s] * each for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def plain_mix(rows, packet):
    """The queues of all sources, served one packet after the other: [(source, key, words)] in the order of the mix."""
    size = lambda t: len((t or "").split())
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    goals, heap, queues, queued = plain_targets(dict(sizes)), [], {}, collections.Counter()
    for s in sizes:
        key = lambda x: (hashlib.sha1(":".join(str(v) for v in (x[0], x[1], 17) if v is not None).encode()).hexdigest()[:15], x[0] or -1, size(x[1]))
        own = sorted((x for x in rows if x[2] == s and size(x[1])), key=key)
        queues[s] = collections.deque(((i, t, k), n) for k in range(2) for i, t, _ in own for n in [packet] * (size(t) // packet) + [size(t) % packet] * (size(t) % packet > 0))

    def push(s):
        if queues[s]:
            queued[s] += queues[s][0][1]
            heapq.heappush(heap, (queued[s] / goals[s], s is None, s or "", queues[s].popleft()))

    for s in sizes:
        push(s)
    left, out = int(1.5 * sum(sizes.values())), []
    while heap and left:
        _, none, s, (key, n) = heapq.heappop(heap)
        out.append((None if none else s, key, min(n, left)))
        left -= out[-1][2]
        push(out[-1][0])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix_is_that_of_the_queues(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    r = random.Random(seed)
    rows = [(i, " ".join(words(r, r.randint(0, 30))), r.choice(["a", "b", "c", "é", None, "hot", "hot", "hot"])) for i in range(120)]
    rows += [(500, None, "empty"), (501, "", "empty"), (502, "one", "tiny"), (None, "null id", "a"), (None, "another", "a"), (7, "again " * 5, "a"), (7, "again " * 5, "a"), (7, "other " * 5, "a"), (8, "big " * 2000, "giant")]
    df = table(spark, rows)
    q = mixing.queue(df)
    size = lambda t: len((t or "").split())
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    goals, got = plain_targets(dict(sizes)), {x.source: x for x in q.collect()}
    assert all(got[s].target == pytest.approx(t) and got[s].source_size == sizes[s] for s, t in goals.items())
    for packet in (4, 128):
        want = plain_mix(rows, packet)
        m = sorted(mixing.mix(q, packet=packet).collect(), key=lambda x: x.start)
        last, each = {}, collections.Counter()  # an entry stands where its last packet does
        for k, (s, key, n) in enumerate(want):
            last[(s, key)], each[(s, key)] = k, each[(s, key)] + n
        ends = sorted(last, key=last.get)
        same = collections.Counter(rows)  # repeated rows have two entries of one name here
        plain = [e for e in ends if same[(*e[1][:2], e[0])] == 1]
        named = {(x.source, x.first): (x.id, x.content) for x in q.collect() if x["size"]}
        texts = {c.h: c.text for c in df.select(F.xxhash64("text").alias("h"), "text").distinct().collect()}
        mine = [(x.source, (i, texts[c], x["pass"]), x.words) for x in m for i, c in [named[(x.source, x.first)]]]
        assert [e[:2] for e in mine if same[(*e[1][:2], e[0])] == 1] == plain
        assert all(each[e[:2]] == e[2] for e in mine if same[(*e[1][:2], e[0])] == 1)
        taken = collections.Counter()
        for s, _, n in mine:
            taken[s] += n
        assert sum(taken.values()) == sum(n for *_, n in want) == int(1.5 * sum(sizes.values()))
        assert all(abs(goals[s] - taken[s]) <= packet for s in goals)
    again = mixing.mix(mixing.queue(df)).collect()
    assert sorted((x.start, x.words, x.source or "") for x in m) == sorted((x.start, x.words, x.source or "") for x in again)
    out = mixing.mixed(df)
    assert out.schema == df.schema
    counts, order = collections.Counter(), []
    for x in out.collect():
        counts[x.source] += size(x.text)
        order.append((x.source, x.doc_id, size(x.text)))
    assert counts == +taken
    assert order == [(s, i, n) for s, (i, _, _), n in mine]  # the mix's own order
    assert mixing.mix(mixing.queue(df.filter("false"))).count() == 0 and mixing.mixed(df.filter("false")).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------


def test_pack_round_trip(spark):
    r = random.Random(3)
    texts = [None, "", "a", " ".join(words(r, 9000)), "é😀 \n" * 50] + [" ".join(words(r, r.randint(1, 300))) for _ in range(80)]
    df = table(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "null id", "s")])
    pieces = packing.pack(df.repartition(3)).collect()
    ids = {i: np.append(encoder().slow.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4") for i, t in [*enumerate(texts), (None, "null id")]}
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(docs) == set(ids)
    for i, ps in docs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[i]), zlib.crc32(ids[i][at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids[i])
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024
    assert packing.pack(df.filter("false")).count() == 0


def test_neighbours_are_those_of_bm25():
    docs = [np.array(d + [0], np.uint32) for d in ([1, 2, 3, 9, 9], [4, 5, 6], [1, 2, 3, 7], [8, 5], [7, 9])]
    index = packing.Index(docs)
    index.unused[0] = False
    got = index.neighbours(*np.unique(docs[0][:-1], return_counts=True)).tolist()

    def score(d):
        n, mean, total = len(docs), np.mean([len(x) for x in docs]), 0.0
        for t in (1, 2, 3, 9):
            df, tf = sum(t in x[:-1] for x in docs), list(docs[d][:-1]).count(t)
            total += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        return total

    assert got == sorted((d for d in range(1, 5) if score(d) > 0), key=lambda d: (-score(d), d))


def test_neighbours_by_all_terms_and_to_the_last():
    r = random.Random(5)
    docs = [np.array([*range(1, 21), 0], np.uint32)] + [np.array([r.randint(1, 60) for _ in range(r.randint(1, 30))] + [0], np.uint32) for _ in range(300)]
    docs[7] = np.array([20, 99, 0], np.uint32)
    index = packing.Index(docs)
    index.unused[0] = False
    mean, sets = np.mean([len(d) for d in docs]), [set(d[:-1].tolist()) for d in docs]
    df = {t: sum(t in s for s in sets) for t in range(1, 21)}

    def score(d):
        own = docs[d][:-1].tolist()
        return sum(np.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * own.count(t) * 2.2 / (own.count(t) + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) for t in df if t in sets[d])

    got = index.neighbours(*np.unique(docs[0][:-1], return_counts=True)).tolist()
    assert set(got) == {d for d in range(1, 301) if score(d) > 0} and 7 in got and len(got) > 100
    assert all(score(a) > score(b) - 1e-5 for a, b in zip(got, got[1:]))


def test_a_seed_is_asked_until_the_window_is_full():
    far = [np.array([1000 + i, 0], np.uint32) for i in range(30)]
    near = [np.array([5, 100 + i, 0], np.uint32) for i in range(40)]  # these share 5 with the seed only
    docs = [np.array([*range(1, 31), 0], np.uint32), *far, *near]
    packer = packing.Packer(1024, 0)
    packing.pack_shard(docs, list(range(len(docs))), packer)
    assert [p[0] for p in packer.open] == [0, *range(31, 71), *range(1, 31)]


def test_similar_documents_share_windows(spark):
    r = random.Random(1)
    topics = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)] for _ in range(8)]
    rows = [(i, " ".join(r.choice(topics[i % 8]) for _ in range(60)), "s") for i in range(160)]
    topic = lambda i: i % 8
    pieces = packing.pack(table(spark, rows).coalesce(1)).orderBy("sequence_id", "offset").collect()
    same = sum(topic(a.doc_id) == topic(b.doc_id) for a, b in zip(pieces, pieces[1:]))
    assert same > 0.8 * len(pieces)


# --- archives ------------------------------------------------------------------------------------------------------


def test_archive_bytes_round_trip():
    r = random.Random(2)
    records = [warc.record(i, f"http://a/{i}", " ".join(words(r, r.randint(0, 400))).encode(), None, "A" * 32) for i in range(300)] + [warc.record(None, None, b"\r\n\r\n" * 90_000, None, "B" * 32)]
    data = warc.archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.records(data)) == records
    assert [warc.parse(x)[1] for x in warc.records(data)][-1] == b"\r\n\r\n" * 90_000
    assert list(warc.records(warc.archive(records[:2]))) == records[:2] and list(warc.records(warc.archive([]))) == []
    assert len(data) < 0.8 * len(warc.archive([b"".join(records)])) or len(data) < sum(map(len, records))


def test_archives(spark, monkeypatch):
    import base64
    import hashlib

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    pages = [(i, f"http://a/{i}", f"<p>{'x' * (i % 5) * 200}</p>") for i in range(40)] + [(100, None, None), (101, "u", ""), (102, "é ü", "unique"), (None, "n", "null id"), (7, "http://a/7", f"<p>{'x' * 400}</p>")]
    df = spark.createDataFrame([(*p, "r", "s") for p in pages], "page_id long, url string, html string, refers_to string, sha1 string")
    manifest = warc.write(df, new_path(spark, "warc"))
    got = warc.read(manifest).collect()
    assert manifest.count() > 1 and len(got) == len(pages) == manifest.agg(F.sum("records")).first()[0]
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = collections.Counter()
    for i, _, h in pages:
        h = h or ""
        main = last[h] < 0 or i == last[h]
        want[(i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if main else "revisit", None if main else last[h], h.encode() if main else None)] += 1
    number = lambda x: x if x is None else int(x)
    assert want == collections.Counter((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to), None if r.record_type == "revisit" else bytes(r.payload)) for r in got)
    assert warc.read(warc.write(df.filter("false"), new_path(spark, "warc"))).count() == 0


# --- neighbours ----------------------------------------------------------------------------------------------------


def plain_nearest(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[ids == ids[q]] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])]


def test_recall_and_scores(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    got = collections.defaultdict(list)
    for r in ann.op10_ann(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        want = plain_nearest(x, ids, q, 10)
        mine = got[int(ids[q])]
        assert len(mine) == len(want) and mine == sorted(mine, key=lambda h: (h[1], h[0]))
        assert all(s == pytest.approx(float(np.linalg.norm(x[ids == v][0] - x[q])), abs=1e-12) for v, s in mine)
        hits, total = hits + len({v for v, _ in mine} & {v for v, _ in want}), total + len(want)
    assert hits >= 0.95 * total


def test_a_shard_verifies_few(sf):
    """Against brute force on Gaussian vectors, the hardest case: 4 % of a shard of 8,192 are verified."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((8192, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    shard, asked = ann.Shard(np.arange(8192), x), np.arange(0, 8192, 100)
    hits = sum(len({v for v, _ in plain_nearest(x, shard.ids, q, 10)} & {v for v, _ in got}) for q, got in zip(asked, shard.search(asked, x[asked], 10)))
    assert hits >= 0.95 * 10 * len(asked)
    assert shard.asked == len(asked) and shard.verified < 0.15 * len(asked) * 8192


def test_far_queries_and_equal_rows_end():
    x = np.concatenate([np.ones((50, 3)), np.random.default_rng(1).standard_normal((50, 3)) * 1e-6])
    shard = ann.Shard(np.arange(100), x)
    for q in (np.array([1e9, 0, 0]), np.array([1.0, 1, 1]), np.array([1e-9, 1e-9, 1.0])):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        assert [s for _, s in shard.search(np.array([-1]), q[None, :], 100)[0]] == sorted(d.tolist())
        assert len(shard.search(np.array([5]), q[None, :], 200)[0]) == 99


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_NUMBERS", 24)
    monkeypatch.setattr(ann, "QUERY_NUMBERS", 12)
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), 1.0, 0.5 * (i // 3)]) for i in range(20)]
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (105, [1.0, 2.0]), (200, []), (300, [9.0, 9.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    x, ids = np.array([v for _, v in good]), np.array([i for i, _ in good])
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df, k=30).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(20):
        want = plain_nearest(x, ids, q, 30)
        assert [v for v, _ in got[q]] == [v for v, _ in want] and [s for _, s in got[q]] == pytest.approx([s for _, s in want])
    assert [v for v, _ in got[105]] == [300] and [v for v, _ in got[300]] == [105] and not set(got) & {100, 101, 102, 103, 104, 200, None}
    assert ann.nearest(df.filter("false"), df).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(i, [float(i), 1.0, 1.0]) for i in range(60, 90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.filter("vec_id in (0, 40)")).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in got if r.query_id == 40] == [(i, 0.0) for i in range(10)]
    assert [r.vec_id for r in got if r.query_id == 0] == list(range(1, 11))


def test_archives_of_other_ids_and_long_records(spark):
    long = "<p>" + "line %d " * 10 + "</p>"
    rows = [("a b\r\né", "u", "one"), ("b", "u", "one"), ("c", "u", (long % tuple(range(10))) * 60_000), (None, "u", "two")]
    got = warc.read(warc.write(spark.createDataFrame(rows, "page_id string, url string, html string"), new_path(spark, "warc"))).collect()
    assert sorted(((r.page_id or "", r.refers_to, r.payload and bytes(r.payload).decode()) for r in got), key=str) == sorted([("a b\r\né", "b", None), ("b", None, "one"), ("c", None, rows[2][2]), ("", None, "two")], key=str)


# --- all of it -----------------------------------------------------------------------------------------------------


def test_registry():
    names = set(registry.queries())
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11)) and set(registry.oracle_sql()) <= names


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "private", "mixture", "packed"]
    kept = stages["quality"](spark, docs, sf)
    one = stages["near_duplicates"](spark, kept, sf)
    clean = stages["private"](spark, one, sf)
    mixed = stages["mixture"](spark, clean, sf)
    assert kept.schema == one.schema == clean.schema == mixed.schema == docs.schema
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id for r in one.collect()} == set(plain_components(rows, 5).values())
    clean = written(clean, "clean")
    texts, plain = {r.doc_id: r.text for r in one.collect()}, [r for r in clean.collect()]
    assert len(plain) == len(texts) and sum(r.text != texts[r.doc_id] for r in plain) > 3
    for r in plain:
        base = [{"kind": k, "start": s, "end": e} for s, e, k in plain_spans(texts[r.doc_id])]
        if not re.search(r"\[(%s)\]" % "|".join(k.upper() for k in pii.GENERATORS), r.text):  # only base kinds
            assert r.text == pii.redacted(texts[r.doc_id], base)
        assert not plain_spans(r.text)
    mixed = written(stages["mixture"](spark, clean, sf), "mixed")
    rows, want = {r.doc_id: r for r in plain}, collections.Counter()
    for _, (i, _, k), n in plain_mix([(r.doc_id, r.text, r.source) for r in plain], mixing.PACKET):
        want[(i, k)] += n
    cut = collections.Counter((i, " ".join(rows[i].text.split()[:n]) if n < len(rows[i].text.split()) else rows[i].text) for (i, _), n in want.items())
    assert collections.Counter((r.doc_id, r.text) for r in mixed.collect()) == cut
    out = written(stages["packed"](spark, mixed, sf), "out")
    encode = encoder().slow.encode
    tokens = collections.Counter()
    for (i, t), n in cut.items():
        tokens[(i, len(encode(t, add_special_tokens=False).ids) + 1)] += n
    assert collections.Counter((p.doc_id, p.doc_tokens) for p in out.collect() if p.start == 0) == tokens
    assert out.agg(F.sum(F.when(F.col("start") == 0, F.col("doc_tokens")))).first()[0] == out.agg(F.sum("length")).first()[0]
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] == out.agg(F.sum("length")).first()[0]
    assert len(set(os.listdir(folder)) - before) == 1  # of all tables only the result is left
