"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in a shuffled order, the whole queue twice over at most. A document is served in packets
of at most PACKET words, and a packet's virtual finish time is the words its source has queued up to the packet's end,
divided by the source's target; a document's is that of its last packet. All packets are range-sorted by that time, and
the mix is cut where the running total over them reaches the total budget. What a document gives is what its packets
before the cut hold, so a source comes within about a packet of its target: of sources side by side in the order, none
is ahead of another by more.

Running totals never pass through one task: a source's queue is split into slices by its shuffling key, and the order
into ranges; slices and ranges are summed first, and totals run over the sums and then within each. The targets come from
one row for each source.

Defined results: null texts have no words; a null source is a source of its own, the last; sources without words have
the target 0; an empty table gives no rows. A text of any length is queued whole. Equal shuffling keys are told apart by
id and size; rows that repeat an id are told apart by their texts, and rows that repeat both share what they take alike
(of them, mixed() gives one, as often as all are taken). Further columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitloom.llm.common import n_words, remove, table, words, written

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Words of a packet, at most.
PACKET = 128
#: Rows of a source in one slice, about.
SLICE_ROWS = 4_000
SEED = 17


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, slices, target) from (source, source_size, rows): one row for each source.

    The budget is shared by weight; a source stops at repeats times its size, the excess is shared again by weight until
    none is above. In closed form: in the order of repeats * size / weight, the first sources stop at their cap, and the
    water level of the rest is the least that fits.
    """
    by_name, everything = W.orderBy(F.col("source").isNull(), "source"), W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    df = sources.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size").cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    order = W.orderBy("level", F.col("source").isNull(), "source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    budget = share * F.sum("source_size").over(everything)
    df = df.withColumn("water", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source whose level is above the water that is left for it and those after: it and they share that water
    df = df.withColumn("water", F.min(F.when(F.col("level") > F.col("water"), F.struct("level", "water"))).over(everything)["water"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water")))
    return df.select("source", "source_size", F.ceil(F.col("rows") / SLICE_ROWS).alias("slices"), target.alias("target"))


def queue(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **how) -> DataFrame:
    """One row for each document: (id, source, content, size, source_size, target, first), as a written table.

    content: hash of the text; first: the words of its source that are queued before it. (source, first) names a row
    that has words.
    """
    # shuffled by 60 bits of a digest, which any engine has; the text is in it, so that rows of one id are spread
    digest = F.sha1(F.concat_ws(":", F.col(id).cast("string"), F.col(text), F.lit(str(seed))).cast("binary"))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    plain = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.xxhash64(text).alias("content"), n_words(F.col(text)).alias("size"), order.alias("order"))
    plain = written(plain, "sizes")
    goals = targets(plain.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), **how)
    joined = plain.join(goals, plain["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    # a slice holds the rows whose key, as a fraction of all keys, falls into it
    rows = joined.withColumn("slice", F.floor(F.col("order") / float(2**60) * F.col("slices")))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    starts = sums.withColumn("base", F.sum("n").over(W.partitionBy("source").orderBy("slice")) - F.col("n")).drop("n")
    inner = W.partitionBy("source", "slice").orderBy("order", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("first", F.sum("size").over(inner) - F.col("size"))
    same = local["source"].eqNullSafe(starts["source"]) & (local["slice"] == starts["slice"])
    out = local.join(starts, same).drop(starts["source"], starts["slice"])
    queued = written(out.select("id", "source", "content", "size", "source_size", "target", (F.col("first") + F.col("base")).alias("first")), "queue")
    remove(plain)
    return queued


def mix(queued: DataFrame, share: float = SHARE, repeats: int = REPEATS, packet: int = PACKET) -> DataFrame:
    """(source, first, pass, words, size, finish, start) of each entry of a queue() that the mix takes.

    words: how many it takes of the entry's; finish: the virtual time of the last packet taken; start: the words of the
    mix before that packet. In the order of start, the entries are the mix.
    """
    total = queued.agg(F.sum("size")).first()[0] or 0
    budget = int(min(share, repeats) * total + 1e-6)
    last = F.ceil(F.col("size") / packet) - 1
    passes = queued.filter("size > 0 and target > 0").withColumn("pass", F.explode(F.array(*(F.lit(i) for i in range(repeats)))))
    packets = passes.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    end = F.least("size", (F.col("packet") + 1) * packet)
    packets = packets.withColumn("n", end - F.col("packet") * packet)
    packets = packets.withColumn("finish", (F.col("first") + F.col("pass") * F.col("source_size") + end) / F.col("target"))
    order = (F.col("finish"), F.col("source").asc_nulls_last())  # total: a source's packets end at different times
    ranged = written(packets.select("source", "first", "pass", "size", "n", "finish").repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("range").agg(F.sum("n").alias("total"))
    bases = sums.select("range", (F.sum("total").over(W.orderBy("range")) - F.col("total")).alias("base"))
    inner = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = ranged.join(bases.filter(F.col("base") < budget), "range")  # ranges beyond the budget are not sorted
    placed = placed.withColumn("start", F.sum("n").over(inner) - F.col("n") + F.col("base")).filter(F.col("start") < budget)
    taken = F.sum(F.least("n", budget - F.col("start")))
    entries = placed.groupBy("source", "first", "pass").agg(taken.alias("words"), F.max("size").alias("size"), F.max("finish").alias("finish"), F.max("start").alias("start"))
    mix = written(entries, "mix")
    remove(ranged)
    return mix


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs' rows as often as the mix takes them, with docs' own columns, sorted by range in the order of the mix. A text
    that the budget cuts keeps its first words, with one space between them."""
    queued = queue(docs, id, text, source, **how)
    repeated = not queued.groupBy("id", "source", "content").count().filter("count > 1").isEmpty()
    own = queued.filter("size > 0").select("id", F.col("source").alias("of"), "content", F.col("first").alias("at"))
    entries = mix(queued, **{k: v for k, v in how.items() if k in ("share", "repeats")})
    taken = entries.join(own, entries["source"].eqNullSafe(own["of"]) & (entries["first"] == own["at"]))
    taken = taken.select("id", "source", "content", "size", "words", "start")
    names = {c: f"mine_{i}" for i, c in enumerate(docs.columns)}
    mine = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.xxhash64(text).alias("mine"))
    keys = {"id": names[id], "source": names[source], "content": "mine"}
    same = [taken[a].eqNullSafe(mine[b]) for a, b in keys.items()]
    mine = mine.dropDuplicates(list(keys.values())) if repeated else mine  # each of their entries then finds one
    both = mine.join(taken, same[0] & same[1] & same[2])
    cut = F.concat_ws(" ", F.slice(words(F.col(names[text])), 1, F.col("words").cast("int")))
    now = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col(names[text]))
    out = both.select("start", *((now if c == text else F.col(n)).alias(n) for c, n in names.items()))
    return out.repartitionByRange("start").sortWithinPartitions("start").select(*(F.col(n).alias(c) for c, n in names.items()))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """For each document, the words of all of its entries in the mix."""
    queued = queue(table(spark, sf_dir, "documents"))
    taken = mix(queued).groupBy("source", "first").agg(F.sum("words").alias("taken"))
    same = queued["source"].eqNullSafe(taken["source"]) & (queued["first"] == taken["first"]) & (queued["size"] > 0)
    return queued.join(taken, same, "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce(taken["taken"], F.lit(0)).cast("long").alias("taken")
    )


#: The packets of all documents in one order, cut at the budget.
ORACLE_SQL = r"""
    WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
    v AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS lv FROM s),
    x AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY lv, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY lv, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM v),
    y AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(water, (lv, water)) FROM x WHERE lv > water)), cap) AS target FROM x),
    q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY substr(sha1(concat_ws(':', doc_id, text, '17')), 1, 15), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS first
        FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source),
    e AS (SELECT *, unnest(range(0, (size + 127) // 128)) AS packet FROM (SELECT *, unnest([0, 1]) AS pass FROM q WHERE size > 0 AND target > 0)),
    p AS (SELECT *, least(128, size - packet * 128) AS n, (first + pass * source_size + least(size, (packet + 1) * 128)) / target AS finish FROM e),
    o AS (SELECT *, sum(n) OVER (ORDER BY finish, source NULLS LAST ROWS UNBOUNDED PRECEDING) - n AS start FROM p),
    t AS (SELECT doc_id, sum(least(n, b - start)) AS taken FROM o, (SELECT floor(1.5 * sum(size) + 1e-6)::BIGINT AS b FROM d) WHERE start < b GROUP BY doc_id)
    SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN t USING (doc_id)"""
