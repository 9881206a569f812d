"""Search over sketches: inclusion of a stated set of queries in all sets, precedents, gates, covers, order, embeddings, agents."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bitloom.consts import REG_BITS, TOTAL_BITS
from bitloom.functions.hashing import token_bits
from bitloom.operators import sketch

#: Queries of inclusion() that a task holds at once (32 MiB of flags), and numbers of a block of pairs.
QUERIES, PAIR_CELLS = 1024, 1 << 22
#: Rows of a pair of blocks whose dot products a task makes at once.
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096


def _overlaps(queries: np.ndarray, ids: list, kind: pa.DataType, least: float):
    """Rows of all pairs of a query and a set that share a bit, for Arrow batches of sets (key, bits). queries: (n, 32768)."""
    width = len(queries)
    columns = np.ascontiguousarray(queries.T)
    own = sketch.cardinality_of(queries.reshape(width, -1, REG_BITS).sum(axis=1))
    names = pa.array(ids, kind)

    def levels(at: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """(n, queries, 32): how many bits of each level each set shares with each query."""
        out = np.zeros((n, REG_BITS, width), np.int32)
        if len(at):
            place = owner * REG_BITS + (at & (REG_BITS - 1))
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) > 0]))
            out.reshape(-1, width)[place[order][first]] = np.add.reduceat(columns[at[order]], first, axis=0, dtype=np.int32)
        return out.transpose(0, 2, 1)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            starts = np.concatenate([[0], np.cumsum(np.nan_to_num(np.asarray(pc.list_value_length(lists), np.float64)).astype(np.int64))])
            bits = np.asarray(lists.flatten(), np.int64)
            low = 0
            while low < batch.num_rows:  # some sets at a time: about 16 MB of counts and of shared bits
                high = int(np.searchsorted(starts, starts[low] + PAIR_CELLS // width, "right"))
                high = max(low + 1, min(high - 1, low + max(1, PAIR_CELLS // (width * REG_BITS)), batch.num_rows))
                owner = np.repeat(np.arange(high - low), np.diff(starts[low : high + 1]))
                n = levels(bits[starts[low] : starts[high]], owner, high - low)
                shared = n.sum(axis=2)
                i, j = np.nonzero(shared)
                both = sketch.cardinality_of(n[i, j])
                tau = np.where(own[j] == 0, 1.0, np.minimum(both / np.where(own[j] == 0, 1.0, own[j]), 1.0))
                keep = tau > least
                i, j, tau = i[keep], j[keep], tau[keep]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), batch.column(0).take(pa.array(low + i)), pa.array(shared[i, j].astype(np.int64)), pa.array(tau)], ["query", "key", "shared", "tau"])
                low = high

    return run


def inclusion(queries: DataFrame, sets: DataFrame, query: str, key: str, least: float = -1.0) -> DataFrame:
    """(query, key, shared, tau) of every query (query, bits) and set (key, bits) that share a bit, of a tau above least: how
    much of the query the set holds, by the estimates.

    A stated set of queries against all sets: the queries' bits go to the tasks in blocks of QUERIES, 32 KiB each, and a set
    is compared where its row is. Nothing is shuffled; each block is one more pass over the sets."""
    spark, kind = sets.sparkSession, queries.schema[query].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField("key", sets.schema[key].dataType), T.StructField("shared", T.LongType()), T.StructField("tau", T.DoubleType())])
    own, out = queries.select(F.col(query).alias("query"), "bits").persist(), spark.createDataFrame([], schema)
    blocks = -(-own.count() // QUERIES)
    for i in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == i).collect()  # about QUERIES rows
        if rows:
            flags = np.zeros((len(rows), TOTAL_BITS), np.uint8)
            for flag, r in zip(flags, rows):
                flag[r.bits or []] = 1
            run = _overlaps(flags, [r["query"] for r in rows], to_arrow_type(kind), least)
            out = out.unionByName(sets.select(key, "bits").mapInArrow(run, schema))
    own.unpersist()
    return out.select(F.col("query").alias(query), F.col("key").alias(key), "shared", "tau")


def top(scored: DataFrame, query: str, key: str, score: str, k: int) -> DataFrame:
    """The k best rows of each query, ties by key."""
    order = W.partitionBy(query).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def two_phase(queries: DataFrame, sets: DataFrame, query: str, key: str, least: float = 0.5, k: int = 3) -> DataFrame:
    """Sets that hold more than ``least`` of a query, then the k that share most bits with it."""
    return top(inclusion(queries, sets, query, key, least), query, key, "shared", k)


def precedents(queries: DataFrame, sets: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """The k sets of each query that share most bits with it."""
    return top(inclusion(queries, sets, query, key), query, key, "shared", k).drop("tau")


def exact_gate(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """The tokens that the reverse index does not know. A sketch's gate lets nearly all of them through; this one none."""
    return tokens.join(known.select("token").distinct(), "token", "left_anti")


def hallucination(answer: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """(keys, tokens, unknown) of an answer's distinct tokens (keys, token)."""
    own = answer.select(*keys, "token").distinct().join(known.select("token", F.lit(1).alias("there")).distinct(), "token", "left")
    return own.groupBy(*keys).agg(F.count("*").alias("tokens"), F.count_if(F.col("there").isNull()).alias("unknown"))


def levels(df: DataFrame, tokens: Column, most: int, *keys: str) -> DataFrame:
    """(keys, level, bm): a sketch for each n-gram length, hashed under the seed length - 1."""
    from bitloom.functions.text import ngrams_of

    sized = [F.struct(F.lit(n).alias("level"), token_bits(F.col(f"g{n}"), n - 1).alias("bits")) for n in range(1, most + 1)]
    grams = df.select(*keys, *(ngrams_of(tokens, n).alias(f"g{n}") for n in range(1, most + 1)))
    flat = grams.select(*keys, F.explode(F.array(*sized)).alias("x")).select(*keys, "x.level", F.explode("x.bits").alias("bit"))
    return sketch.pack(flat, *keys, "level")


def _matrix(vectors: pd.Series) -> np.ndarray:
    """One row for each vector; of NaN for a null one or a null value."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    return np.array([np.full(width, np.nan) if v is None else v for v in vectors], np.float64).reshape(len(vectors), width)


def _best(k: int):
    """The k best pairs of each query in one pair of blocks, ties by id; null scores last."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        q, v = _matrix(queries["q"]), _matrix(vectors["v"]).T
        score, ids, parts = np.zeros((len(q), v.shape[1])), vectors["id"].to_numpy(), []
        for d in range(q.shape[1] if v.size else 0):  # summed in one order, so equal vectors have equal scores
            score += q[:, d, None] * v[d]
        for query, s in zip(queries["query"], score):
            low = np.nan_to_num(-s, nan=np.inf)
            at = np.flatnonzero(low <= np.partition(low, k - 1)[k - 1]) if len(low) > k else np.arange(len(low))
            at = at[np.lexsort((ids[at], low[at]))[:k]]
            parts.append(pd.DataFrame({"query": query, "id": ids[at], "score": s[at]}))
        return pd.concat(parts) if parts else pd.DataFrame({"query": [], "id": [], "score": []})

    return run


def embed_tokens(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, tokens): tid{n} of the k vectors of greatest dot product with each of a stated set of queries.

    Both are dealt out in blocks; a task has one pair of blocks at a time, and k pairs of each query leave it."""
    kind = vectors.schema[id].dataType.simpleString()
    n_q, n_v = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-vectors.count() // VECTOR_BLOCK))
    block = lambda n: F.pmod(F.xxhash64(id), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = queries.select(F.col(id).alias("query"), F.col(vector).cast("array<double>").alias("q"), block(n_q).alias("i"), every(n_v).alias("j"))
    b = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), block(n_v).alias("j"), every(n_q).alias("i"))
    scored = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(_best(k), f"query {kind}, id {kind}, score double")
    best = top(scored, "query", "id", "score", k)
    return best.groupBy("query").agg(F.sort_array(F.collect_list(F.concat(F.lit("tid"), F.col("id").cast("string")))).alias("tokens"))


def top_bits(spark: SparkSession) -> DataFrame:
    """All bits: the top of the lattice."""
    return spark.range(TOTAL_BITS).select(F.col("id").cast("int").alias("bit"))


def complement(bits: DataFrame) -> DataFrame:
    return top_bits(bits.sparkSession).join(bits.select("bit"), "bit", "left_anti")


def minimal_cover(sets: DataFrame, target: DataFrame, key: str, rounds: int | None = None, ranks: DataFrame | None = None) -> list[str]:
    """Keys chosen greedily, each for the most target bits that are still uncovered (or, with ranks (bit, tf), for the most
    rank of such bits), ties by key, until no key adds a bit (each round takes one key) or for a stated number of rounds.
    Every round has the same plan, however many went before."""
    target = target.select("bit").distinct().persist()
    worth = F.count("*") if ranks is None else F.sum(F.coalesce("tf", F.lit(0)))
    sets, chosen = sets.select(key, "bit").join(target, "bit", "left_semi").distinct(), []
    sets = (sets if ranks is None else sets.join(ranks.select("bit", "tf"), "bit", "left")).persist()
    while rounds is None or len(chosen) < rounds:
        taken = F.when(F.col(key).isNull(), F.lit(None in chosen)).otherwise(F.col(key).isin([c for c in chosen if c is not None]))
        covered = sets.filter(taken).select("bit").distinct()
        best = sets.join(covered, "bit", "left_anti").groupBy(key).agg(worth.alias("n")).orderBy(F.desc("n"), key).first()
        if best is None:
            break
        chosen.append(best[key])
    sets.unpersist()
    target.unpersist()
    return chosen


def restore_order(bigrams: DataFrame, key: str) -> DataFrame:
    """(key, tokens): a walk that uses every bigram (key, src, dst) once, where there is one; else null. One task a key."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        degree: dict[str, int] = {}
        for a, b in sorted(zip(pdf["src"], pdf["dst"]), reverse=True):
            out.setdefault(a, []).append(b)
            degree[a] = degree.get(a, 0) + 1
            degree[b] = degree.get(b, 0) - 1  # read after: a word may follow itself
        starts = [v for v, n in degree.items() if n > 0]
        stack, path = [min(starts) if starts else min(degree)], []
        while stack:
            if out.get(stack[-1]):
                stack.append(out[stack[-1]].pop())
            else:
                path.append(stack.pop())
        whole = len(path) == len(pdf) + 1 and sum(n for n in degree.values() if n > 0) <= 1
        return pd.DataFrame({key: [pdf[key].iloc[0]], "tokens": [path[::-1] if whole else None]})

    kind = bigrams.schema[key].dataType.simpleString()
    return bigrams.select(key, "src", "dst").groupBy(key).applyInPandas(walk, f"{key} {kind}, tokens array<string>")


def agent_scores(scores: DataFrame) -> DataFrame:
    """(.., score) of term frequencies by level (tf1, tf2, tf3)."""
    return scores.withColumn("score", F.col("tf1") + 0.5 * F.col("tf2") + 0.25 * F.col("tf3"))


def inboxes(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, bm): of each agent the OR of the sketches (node, bm) of those with an edge (src, dst) to it."""
    return edges.select(F.col("src").alias("node"), "dst").join(sets, "node").groupBy(F.col("dst").alias("node")).agg(F.bitmap_or_agg("bm").alias("bm"))


def waves(edges: DataFrame, seeds: DataFrame, rounds: int, threshold: float) -> DataFrame:
    """(node, wave): agents that fire. One fires in the first wave if it is a seed (node), later if the weights that reach it
    in a wave add up to the threshold; each fires once. An edge (src, dst, weight) takes one wave, or as many as its column
    delay says: so cycles end up in later waves."""
    edges = edges if "delay" in edges.columns else edges.withColumn("delay", F.lit(1))
    fired = seeds.select("node", F.lit(0).alias("wave"))
    for k in range(1, rounds + 1):
        sent = edges.join(fired.withColumnRenamed("node", "src"), "src").filter(F.col("wave") + F.col("delay") == k)
        reached = sent.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("in")).filter(F.col("in") >= threshold)
        fired = fired.unionByName(reached.join(fired.select("node"), "node", "left_anti").select("node", F.lit(k).alias("wave")))
    return fired


def unearned(index: DataFrame, tf: DataFrame) -> DataFrame:
    """Tokens of a reverse index without a frequency: an index must hold none."""
    return index.select("token").distinct().join(tf.filter("n > 0").select("token"), "token", "left_anti")
