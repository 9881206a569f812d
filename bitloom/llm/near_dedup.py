"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact confirmation, components.

1. One pass makes a signature and a digest of the set of shingles for each document; documents with the same digest
   are one class, and only its least id goes on. A class of any size costs one aggregation.
2. Classes that share a band of the signature are candidates. A bucket of at most SMALL classes gives its pairs; a
   larger one links each class to its least id only.
3. Candidates are pruned batch by batch: a pair goes when, given the equal hashes so far, it reaches the threshold with
   a probability below ``miss``. Full sets of shingles then decide on every survivor.
4. Large buckets that still hold more than one component are compared in blocks, each against each but for those of the
   bucket's largest component among themselves; a block pair is pruned and confirmed within its task. So no link
   between two components is lost, whatever the bucket's size, and no task or row holds a whole bucket.

Classes are numbered for the links between them, so ids may be of any type that has an order. The centre of a large
bucket's star is copied once for every HUB links, so that no task has all of them.

Defined results: null, empty and blank texts have no shingles and no links. Rows with a null id take no part: their
component is null, and they are kept. In near_classes(), rows that repeat an id are one document: what one of them is
linked with, all are, and repeated rows all get their answer. keep_one() goes by texts: of rows that repeat an id, those
with other texts are other documents, those with the same text are one. Ties go to the smaller id. A text of any length
is compared whole; an empty table gives no rows. near_classes() has columns of its own, keep_one() docs', whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm import minhash as mh
from bitloom.llm.common import remove, ship, table, written
from bitloom.llm.graph import components

SMALL, HUB = 32, 256
BLOCK_ROWS, BLOCK_BYTES = 256, 2_000_000
#: Chance of losing a pair at the threshold, for each batch of hashes.
MISS = 1e-6
_SIGNED = [("content", T.LongType()), ("n_shingles", T.LongType()), ("hi", T.LongType()), ("lo", T.LongType()), ("sig", T.BinaryType())]


def _signer(k: int):
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("n", "hi", "lo", "sig")}
            for text in batch.column(1):
                h = mh.shingle_hashes(text.as_py(), k)
                out["n"].append(len(h))
                digest = xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None
                out["hi"].append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                out["lo"].append(int.from_bytes(digest[8:], "little", signed=True) if digest else None)
                out["sig"].append(mh.signature(h).tobytes() if digest else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out["n"], pa.int64()), pa.array(out["hi"], pa.int64()), pa.array(out["lo"], pa.int64()), pa.array(out["sig"], pa.binary())],
                ["id", *(name for name, _ in _SIGNED)],
            )

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, mh.N_HASHES)


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            keys = mh.band_keys(_matrix(batch.column(1)))
            ids = np.repeat(np.asarray(batch.column(0)), mh.BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "id"])


def _pruner(fewest: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ok = mh.survivors(_matrix(batch.column(2)), _matrix(batch.column(3)), fewest)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1, 4)], ["u", "v", "salt"])

    return run


def _confirmer(k: int, percent: int):
    def run(batches):
        for batch in batches:
            ok = [mh.near(a.as_py(), b.as_py(), k, percent) for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["u", "v"])

    return run


def _block_comparer(k: int, percent: int, fewest: np.ndarray):
    """Links between two blocks of a bucket, only as many as it takes to connect what they connect."""

    def compare(key: int, a: list, b: list, same: bool):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        sides = []
        for rows in (a, b):
            sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(-1, mh.N_HASHES)
            sides.append((sig, mh.band_keys(sig)))
        cache: dict[int, set] = {}
        get = lambda r: cache[r["id"]] if r["id"] in cache else cache.setdefault(r["id"], mh.shingles(r["text"], k))
        (sa, ka), (sb, kb) = sides
        labels = np.array([r["label"] for r in b])
        for i, x in enumerate(a):
            js = np.flatnonzero(labels != x["label"])
            js = js[js > i] if same else js
            js = js[mh.survivors(np.broadcast_to(sa[i], (len(js), mh.N_HASHES)), sb[js], fewest)]
            if len(js):  # a pair that shares several buckets belongs to that of its first common band
                equal = kb[js] == ka[i]
                js = js[kb[js, equal.argmax(axis=1)] == key]
            for j in js:
                y = b[j]
                if (p := find(x["label"])) == (q := find(y["label"])):
                    continue
                s, t = get(x), get(y)
                common = len(s & t)
                if common and 100 * common >= percent * (len(s) + len(t) - common):
                    root[p] = q
                    yield x["id"], y["id"]

    def run(batches):
        for batch in batches:
            found = []
            for i in range(batch.num_rows):  # one pair of blocks in memory at a time
                r = batch.slice(i, 1).to_pylist()[0]
                found += compare(r["key"], r["a"], r["b"], r["same"])
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

    return run


def _sides(pairs: DataFrame, hubs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """pairs (u, v, salt) with a column of rows for either side. hubs: (id, copies) of the v that have more salts than 0."""
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)).cast("long") - 1)
    u, v = rows.select(F.col("id").alias("u"), F.col(name).alias(f"{name}_u")), rows.join(hubs, "id", "left")
    v = v.select(F.col("id").alias("v"), F.explode(copies).alias("salt"), F.col(name).alias(f"{name}_v"))
    return pairs.join(u, "u").join(v, ["v", "salt"]).select("u", "v", f"{name}_u", f"{name}_v", "salt")


def _left_over(large: DataFrame, labels: DataFrame, reps: DataFrame, k: int, percent: int, fewest: np.ndarray) -> DataFrame:
    """Links between different components within large buckets (key, id)."""
    large = large.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    parts = large.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    main = written(main.select("key", F.col("m.label").alias("main")), "main")
    mixed = written(
        large.join(main, "key")
        .join(reps.select("id", "sig", "text"), "id")
        .select("key", "id", "label", (F.col("label") == F.col("main")).cast("int").alias("side"), "sig", "text"),
        "mixed",
    )
    size = written(mixed.groupBy("key", "side").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.length("text") + 600) / BLOCK_BYTES)).alias("blocks")), "blocks")
    blocks = written(
        mixed.join(size, ["key", "side"])
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .repartition("key", "side", "block")  # else a bucket's blocks would stay together
        .groupBy("key", "side", "block")
        .agg(F.sort_array(F.collect_list(F.struct("id", "label", "sig", "text"))).alias("rows")),
        "blocks",
    )
    few = size.groupBy("key").agg(F.sum(F.when(F.col("side") == 0, F.col("blocks"))).alias("others"), F.sum(F.when(F.col("side") == 1, F.col("blocks"))).alias("mains"))
    first = few.select("key", "others", "mains", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("x"))
    rest = F.concat(
        F.transform(F.sequence(F.col("x"), F.col("others") - 1), lambda i: F.struct(F.lit(0).alias("s"), i.cast("long").alias("y"))),
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.struct(F.lit(1).alias("s"), i.cast("long").alias("y"))),
    )
    pairs = first.select("key", "x", F.explode(rest).alias("o")).select("key", "x", "o.s", "o.y")
    side = lambda c, rows: blocks.select("key", F.col("side").alias(f"s{c}"), F.col("block").alias(c), F.col("rows").alias(rows))
    both = pairs.withColumn("sx", F.lit(0)).join(side("x", "a"), ["key", "sx", "x"]).join(side("y", "b").withColumnRenamed("sy", "s"), ["key", "s", "y"])
    both = both.select("key", "a", "b", ((F.col("s") == 0) & (F.col("x") == F.col("y"))).alias("same"))
    links = written(both.mapInArrow(_block_comparer(k, percent, fewest), "u long, v long"), "confirmed")
    for done in (main, mixed, size, blocks):
        remove(done)
    return links


def _linked(docs: DataFrame, id: str, text: str, k: int, percent: int, miss: float, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """All rows as (id, content, n_shingles, hi, lo), and of each class (hi, lo, first): first is the (id, content) of the
    least row of its component. by_id: classes that share an id are linked."""
    ship(docs.sparkSession)
    fewest = mh.fewest_matches(percent / 100, miss)
    plain = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("content"))
    schema = T.StructType([plain.schema["id"], *(T.StructField(n, t) for n, t in _SIGNED)])
    signed = written(plain.mapInArrow(_signer(k), schema), "signed")
    real = signed.filter("id is not null and hi is not null")
    grouped = real.groupBy("hi", "lo").agg(F.min(F.struct("id", "content")).alias("rep"))
    classes = written(grouped.select("hi", "lo", "rep", F.monotonically_increasing_id().alias("node")), "classes")
    reps = classes.select("hi", "lo", F.col("rep.id").alias("id"), F.col("rep.content").alias("content"), "node")
    repeated = not real.groupBy("id", "content").count().filter("count > 1").isEmpty()
    one = lambda df: df.dropDuplicates(["id"]) if repeated else df  # noqa: E731  (a row for each class)
    # what joins all rows joins by shuffles at every size, so that a small table's plan is that of a large one
    sigs = written(one(real.join(reps.hint("merge"), ["hi", "lo", "id", "content"]).select(F.col("node").alias("id"), "sig")), "sigs")
    keyed = sigs.mapInArrow(_bands, "key long, id long")
    # written, so that the join has plain exchanges on both sides and Spark can split a hot band
    counts = written(keyed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1"), "counts")
    shared = written(keyed.join(counts, "key"), "shared")
    part = lambda n: F.ceil(F.col(n) / HUB)
    stars = shared.filter("id <> least").groupBy(F.col("id").alias("u"), F.col("least").alias("v")).agg(F.max("n").alias("n"))
    stars = stars.select("u", "v", F.pmod(F.xxhash64("u"), part("n")).alias("salt"))
    hubs = written(counts.filter(f"n > {HUB}").groupBy(F.col("least").alias("id")).agg(F.max(part("n")).alias("copies")), "hubs")
    small = shared.filter(f"n <= {SMALL}").select("key", "id", "least")
    pairs = small.join(small.select("key", F.col("id").alias("v")), "key").filter("id > v and v <> least").select(F.col("id").alias("u"), "v").distinct()
    pairs = stars.unionByName(pairs.withColumn("salt", F.lit(0).cast("long")))
    left = written(_sides(pairs, hubs, sigs, "sig").mapInArrow(_pruner(fewest), "u long, v long, salt long"), "pruned")
    large = written(shared.filter(f"n > {SMALL}").select("key", "id"), "large")
    remove(shared)
    # only texts that are compared are moved
    needed = left.select(F.col("u").alias("node")).unionByName(left.select(F.col("v").alias("node"))).unionByName(large.select(F.col("id").alias("node"))).distinct()
    named = written(reps.join(needed, "node").select("id", "content", "node"), "needed")
    texts = written(one(plain.join(named.hint("merge"), ["id", "content"]).select(F.col("node").alias("id"), "text")), "texts")
    links = written(_sides(left, hubs, texts, "text").mapInArrow(_confirmer(k, percent), "u long, v long"), "confirmed")
    if not large.isEmpty():
        known = components(links).withColumnRenamed("component", "label")
        links = links.unionByName(_left_over(large, known, texts.join(sigs, "id"), k, percent, fewest))
    for done in (left, named, texts, sigs, counts, hubs, large):
        remove(done)
    if by_id:
        own = real.join(classes, ["hi", "lo"]).select("id", "node")
        links = links.unionByName(own.join(own.groupBy("id").agg(F.min("node").alias("v")), "id").filter("node <> v").select(F.col("node").alias("u"), "v"))
    found = components(links).withColumnRenamed("id", "node")
    named = written(classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    first = written(named.groupBy("component").agg(F.min("rep").alias("first")), "first")
    return signed.drop("sig"), written(named.join(first, "component").select("hi", "lo", "first"), "components")


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs."""
    repeated = not docs.filter(F.col(id).isNotNull()).groupBy(id).count().filter("count > 1").isEmpty()
    rows, classes = _linked(docs, id, text, k, percent, miss, repeated)
    out = rows.join(classes, ["hi", "lo"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("first.id", "id"))
    return out.select("id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row of each group of near duplicates, with docs' own columns: that of the least id."""
    rows, classes = _linked(docs, id, text, k, percent, miss, False)
    alone = rows.filter("id is not null and hi is null").select("id", "content")
    kept = written(classes.select("first.id", "first.content").unionByName(alone).distinct(), "kept")
    names = {c: f"mine_{i}" for i, c in enumerate(docs.columns)}
    mine = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(id).alias("id"), F.xxhash64(text).alias("content"))
    one = mine.join(kept, ["id", "content"], "left_semi")
    if not one.groupBy("id", "content").count().filter("count > 1").isEmpty():  # of repeated rows the one of the least digest
        one = one.withColumn("digest", F.xxhash64(*names.values()))
        one = one.join(one.groupBy("id", "content").agg(F.min("digest").alias("digest")), ["id", "content", "digest"]).dropDuplicates(["id", "content"])
    return one.unionByName(mine.filter("id is null"), allowMissingColumns=True).select(*(F.col(n).alias(c) for c, n in names.items()))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract of this query: shingles of four words."""
    return near_classes(table(spark, sf_dir, "documents"), k=4).withColumnRenamed("id", "doc_id")


#: For small tables: all pairs that share a shingle, and what is reachable by links.
ORACLE_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
        GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
    r AS (SELECT a AS id, b AS x FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.x),
    c AS (SELECT id, min(least(id, x)) AS c FROM r GROUP BY id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON id = doc_id"""
