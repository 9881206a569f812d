"""Main text of web pages: structure, then host suffix arrays over the blocks that may be main text.

A page's blocks are inside an article (article, main, or a container that says so), outside the text (menus, footers,
sidebars, notices, adverts, forms, comments and the like, by tag, role, class or id), or open. The pages of a host are
concatenated into token streams, the articles' blocks and, of pages that have none, the open ones apart; suffix arrays
find the runs of LEAST or more tokens that recur in distinct pages. What recurring says differs by what structure says:

- Open blocks: recurring runs are boilerplate and go, the unique runs stay.
- Articles' blocks: a host has articles twice or with changes, and passages that many articles share, which are main text.
  A run is boilerplate where it stands in more than half of the host's distinct articles, and the host has FEW of them at
  least (of fewer, half says nothing). A block that such runs cover wholly goes; one with words of its own stays whole,
  as does an article that would lose more than half of its words, which is a copy of others rather than framed like them.

Equal pages of a host are one page and don't erase each other. A host of any size is spread over streams of about
STREAM_BYTES (ARTICLE_BYTES), on which the results don't depend. Open blocks: where a host has more streams than one, each
sends digests of its runs, those that another stream has too come back to it, and both drop them. Articles: what is in more
than half of all is in more than half of some stream's, so each sends digests and counts of those; where the counts don't
decide, the other articles of the host are asked. Copies of a page are judged once.

Defined results: null html is empty and gives an empty text; pages without text give an empty text; unclosed and stray
tags are read as browsers do; a null or broken url is a host of its own; repeated rows get their row each; an empty table
gives no rows; a page of any length is read whole, in linear time. Further columns don't pass, so their names are free.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitloom.llm.common import ship, table, written
from bitloom.llm.html_blocks import chosen
from bitloom.llm.suffix_array import Windows, run_keys

LEAST, FEW = 10, 10
STREAM_BYTES = 4_000_000
#: Of streams of articles; those of fewer articles would ask for runs that few have.
ARTICLE_BYTES, PER_STREAM = 250_000, 8
#: Words whose runs are digested at once.
TOGETHER = 20_000


def host(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _parser(batches):
    seen: set[tuple] = set()
    for batch in batches:
        out = [[] for _ in range(5)]
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            _, found, article = chosen(page)
            # a page is its blocks: equal ones are one page
            key = (host(url), _digest("\n".join(found)), article) if found else None
            for column, value in zip(out, (key and key[0], key and key[1], article, key and key not in seen, found)):
                column.append(value)
            if key:
                seen.add(key)
        kinds = pa.string(), pa.binary(), pa.bool_(), pa.bool_(), pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), *(pa.array(c, t) for c, t in zip(out, kinds))],
            ["page_id", "url", "host", "page", "article", "first", "open"],
        )


class Stream:
    """Distinct pages of a host, each as its open blocks."""

    def __init__(self, pages: list[list[str]], least: int = LEAST):
        self.pages, self.least = pages, least
        self.runs = Windows.of([[w for b in bs for w in b.split()] for bs in pages], least)
        short = [{b for b in bs if b.count(" ") < least - 1} for bs in pages]
        self.short: dict[str, int] = {}  # blocks too short for a run: on how many pages they stand whole
        for s in short:
            for b in s:
                self.short[b] = self.short.get(b, 0) + 1

    def recurring(self) -> list[tuple[bytes, bool]]:
        """A digest of every run and short block, and whether two of the pages have it."""
        return [*zip(self.runs.keys(), self.runs.many.tolist()), *((_digest("block " + b), n > 1) for b, n in self.short.items())]

    def texts(self, elsewhere: frozenset = frozenset()) -> list[str]:
        """Each page's text without the runs that another page has too, and without short blocks that stand whole on another;
        elsewhere: the digests of those that pages of other streams have."""
        also = None
        if elsewhere:
            also = np.fromiter((k in elsewhere for k in self.runs.keys()), bool)
        gone, out = self.runs.covered(also), []
        for bs, mask in zip(self.pages, gone):
            kept, at = [], 0
            for b in bs:
                words = b.split()
                if b not in self.short or self.short[b] < 2 and not (elsewhere and _digest("block " + b) in elsewhere):
                    kept += [w for w, g in zip(words, mask[at : at + len(words)]) if not g]
                at += len(words)
            out.append(" ".join(kept))
        return out


def _runs(least: int):
    def run(group: pa.Table) -> pa.Table:
        found = Stream(group.column("open").to_pylist(), least).recurring()
        first = lambda name: pa.array([group.column(name)[0].as_py()] * len(found), group.schema.field(name).type)
        return pa.table({"host": first("host"), "stream": first("stream"), "run": pa.array([k for k, _ in found], pa.binary()), "many": pa.array([m for _, m in found], pa.bool_())})

    return run


def _texts(least: int):
    def run(pages: pa.Table, elsewhere: pa.Table) -> pa.Table:
        texts = Stream(pages.column("open").to_pylist(), least).texts(frozenset(elsewhere.column("run").to_pylist())) if len(pages) else []
        return pa.table({"host": pages.column("host"), "page": pages.column("page"), "text": pa.array(texts, pa.string())})

    return run


def unique_texts(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(host, page, text) of pages (host, page, open), distinct in host and page."""
    size = F.sum(F.aggregate("open", F.lit(0).cast("long"), lambda n, b: n + F.length(b)))
    streams = pages.groupBy("host").agg(F.ceil((size + 1) / STREAM_BYTES).alias("n"))
    dealt = written(pages.join(streams, "host").withColumn("stream", F.pmod(F.xxhash64("page"), "n")), "streams")
    runs = written(dealt.filter("n > 1").groupBy("host", "stream").applyInArrow(_runs(least), "host string, stream long, run binary, many boolean"), "runs")
    # a run that one stream has on one page only, but other streams have too: it is told so
    shared = runs.groupBy("host", "run").agg(F.count("*").alias("streams")).filter("streams > 1").drop("streams")
    told = runs.filter("not many").join(shared, ["host", "run"]).select("host", "stream", "run")
    return dealt.groupBy("host", "stream").cogroup(told.groupBy("host", "stream")).applyInArrow(_texts(least), "host string, page binary, text string")


def _packed(batches):
    """Blocks as compressed bytes, which is what shuffles."""
    for batch in batches:
        packed = [zlib.compress("\n".join(bs).encode(), 1) for bs in batch.column("open").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "stream", "page")), pa.array(packed, pa.binary())], ["host", "stream", "page", "blocks"])


def _frequent(least: int):
    """Digests of the runs that stand in more than half of a stream's distinct articles, and in how many."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[bytes, bytes] = {}
        for batch in batches:  # copies from several tasks are not held
            for page, blocks in zip(batch.column("page").to_pylist(), batch.column("blocks").to_pylist()):
                packed.setdefault(page, blocks)
        runs = Windows.of([zlib.decompress(b).decode().split() for b in packed.values()], least)
        most = np.flatnonzero(2 * runs.pages > len(packed))
        columns = pa.array([key[0].as_py()] * len(most), pa.string()), pa.array(runs.keys(most), pa.binary()), pa.array(runs.pages[most], pa.int64())
        yield pa.RecordBatch.from_arrays([*columns], ["host", "run", "pages"])

    return run


def _keyed(batch: pa.RecordBatch, known: dict, least: int):
    """Each row: its number, its blocks, the runs that its host is told and, if there are any, its own."""
    rows, words, n = [], [], 0
    for i, (name, blocks) in enumerate(zip(batch.column("host").to_pylist(), batch.column("open").to_pylist())):
        if name not in known:
            known[name] = frozenset(batch.column("runs")[i].as_py() or ())
        rows.append((i, blocks or [], known[name]))
        words.append(" ".join(blocks).split() if known[name] else [])
        n += len(words[-1])
        if n > TOGETHER or i == batch.num_rows - 1:
            yield from ((*row, keys) for row, keys in zip(rows, run_keys(words, least)))
            rows, words, n = [], [], 0


def _standing(least: int):
    """Which of the runs that a host is told stand in an article."""

    def run(batches):
        known: dict = {}
        for batch in batches:
            found = [(i, k) for i, _, told, keys in _keyed(batch, known, least) for k in told.intersection(keys)]
            rows = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("host").take(rows), batch.column("page").take(rows), pa.array([k for _, k in found], pa.binary())], ["host", "page", "run"])

    return run


def without(blocks: list[str], told: frozenset, keys: list[bytes], least: int) -> list[str]:
    """An article's blocks but for those that the told ones of its runs cover wholly; all, if these are more than half of its
    words."""
    sizes = [len(b.split()) for b in blocks]
    inside = bytearray(sum(sizes))  # of each word, whether it is in such a run
    for at, key in enumerate(keys):
        if key in told:
            inside[at : at + least] = b"\1" * least
    kept, at, gone = [], 0, 0
    for b, n in zip(blocks, sizes):
        if 0 in inside[at : at + n]:
            kept.append(b)
        else:
            gone += n
        at += n
    return kept if 2 * gone <= at else blocks


def _cut(least: int):
    def run(batches):
        known: dict = {}
        for batch in batches:
            texts = [" ".join(without(blocks, told, keys, least) if told else blocks) for _, blocks, told, keys in _keyed(batch, known, least)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def frames(articles: DataFrame, least: int = LEAST) -> DataFrame | None:
    """(host, runs): digests of the runs that more than half of a host's distinct articles (host, page, first, open) have;
    None where there are none."""
    size = F.aggregate("open", F.lit(0).cast("long"), lambda n, b: n + F.length(b))
    firsts = articles.filter("first").select("host", "page", "open")
    distinct = firsts.select("host", "page", size.alias("size")).groupBy("host", "page").agg(F.max("size").alias("size"))
    hosts = distinct.groupBy("host").agg(F.count("*").alias("articles"), F.ceil((F.sum("size") + 1) / ARTICLE_BYTES).alias("n"))
    hosts = hosts.withColumn("n", F.least("n", F.ceil(F.col("articles") / PER_STREAM)))
    hosts = written(hosts.filter(F.col("articles") >= FEW), "hosts")
    dealt = firsts.join(hosts, "host").select("host", F.pmod(F.xxhash64("page"), "n").alias("stream"), "page", "open")
    packed = dealt.mapInArrow(_packed, "host string, stream long, page binary, blocks binary")
    asked = packed.groupBy("host", "stream").applyInArrow(_frequent(least), "host string, run binary, pages long")
    asked = written(asked.groupBy("host", "run").agg(F.sum("pages").alias("pages")).join(hosts, "host"), "asked")
    if asked.isEmpty():
        return None
    found = asked.filter("2 * pages > articles").select("host", "run")
    # where the streams that sent a run don't have half of the articles, the others are asked for it (told is written: of a
    # known size, so articles needn't shuffle)
    told = written(asked.filter("2 * pages <= articles").groupBy("host").agg(F.collect_list("run").alias("runs")), "told")
    if not told.isEmpty():
        standing = firsts.join(told, "host").mapInArrow(_standing(least), "host string, page binary, run binary").distinct()
        counts = standing.groupBy("host", "run").agg(F.count("*").alias("pages")).join(hosts, "host")
        found = found.unionByName(counts.filter("2 * pages > articles").select("host", "run"))
    found = written(found.groupBy("host").agg(F.collect_list("run").alias("runs")), "frames")
    return None if found.isEmpty() else found


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, text) of every page."""
    ship(pages.sparkSession)
    plain = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    more = [("host", T.StringType()), ("page", T.BinaryType()), ("article", T.BooleanType()), ("first", T.BooleanType()), ("open", T.ArrayType(T.StringType()))]
    kinds = T.StructType([plain.schema["page_id"], plain.schema["url"], *(T.StructField(*m) for m in more)])
    parsed = written(plain.mapInArrow(_parser, kinds), "parsed", "zstd")
    ready, framed = parsed.filter("article or open is null"), frames(parsed.filter("article"), least)
    if framed is None:
        texts = ready.select("page_id", "url", F.concat_ws(" ", "open").alias("text"))  # "" of a page without blocks
    else:
        texts = ready.join(framed, "host", "left").select("page_id", "url", "host", "open", "runs").mapInArrow(_cut(least), T.StructType(kinds[:2].fields + [T.StructField("text", T.StringType())]))
    left = parsed.filter("not article and open is not null")
    found = unique_texts(left.select("host", "page", "open").dropDuplicates(["host", "page"]), least).withColumnRenamed("text", "unique")
    mine = left.select("page_id", "url", "host", "page").join(found, ["host", "page"]).select("page_id", "url", F.col("unique").alias("text"))
    return texts.unionByName(mine)


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
