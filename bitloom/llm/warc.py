"""WARC archives with a Zstandard dictionary: written in parallel, records compressed one by one, and read back.

Each task writes archives of at most ARCHIVE_BYTES of records. An archive begins with a skippable frame (0x184D2A5D)
that holds the dictionary, built from records of the archive itself, spread evenly over it, SAMPLE_BYTES of them; each
record is a frame of its own, so that any one can be read alone.

Of records with equal payloads that with the largest id is a response, the others are revisits that name it. The
payloads' digests alone are grouped, before the shuffle; the join back lets Spark split a hot digest.

A response holds its page as the body of an HTTP response with a head of two lines, as readers of archives expect; the
payload, its length and its digest are those of the page. Archives are written and read by pyarrow's file systems (local
folders, hdfs, viewfs, gs, s3; s3a and s3n are read as s3): Spark has no sink of plain files.

Defined results: a null payload is empty; rows that repeat an id are written each; a null id is no response's name, and
such rows with a payload of their own are responses. Ids may be of any type that has an order; they come back as text.
Records of any length are written whole; an empty table writes nothing. Further columns don't pass, so their names are
free.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import new_path, ship, table, written

ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL, MOST_TASKS = 16_000_000, 65_536, 2_000_000, 3, 10_000
MAGIC = 0x184D2A5D
DATE, _HTTP = "2020-01-01T00:00:00Z", "application/http; msgtype=response"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record(id, url: str | None, payload: bytes, refers, digest: str) -> bytes:
    """One WARC/1.1 record. A revisit (refers is another record's id) has no block; its length and digest are the payload's."""
    kind = "text/html; charset=utf-8"
    name = lambda i: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{i}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}",
    ]
    if id is not None:
        head.append(f"Page-ID: {quote(str(id))}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}", f"Refers-To-Page-ID: {quote(str(refers))}"]
        block = b""
    else:
        head.append(f"Content-Type: {_HTTP}")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record; ids are decoded."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    fields |= {k: unquote(fields[k]) for k in ("page-id", "refers-to-page-id") if k in fields}
    block = rest[:n]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("content-type") == _HTTP else block


def dictionary(records: list[bytes]) -> bytes:
    """Built from SAMPLE_BYTES of records at most, whole ones, every so many; b"" where they are too few to build one."""
    total = sum(map(len, records))
    step, sample, left = max(1, -(-total // SAMPLE_BYTES)), [], SAMPLE_BYTES
    for r in records[::step]:
        if len(r) <= left:
            sample.append(r)
            left -= len(r)
    if len(sample) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little that repeats
        return b""


def archive(records: list[bytes]) -> bytes:
    words = dictionary(records)
    made = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    frames = [MAGIC.to_bytes(4, "little") + len(words).to_bytes(4, "little") + words] if words else []
    return b"".join(frames + [made.compress(r) for r in records])


def records(data: bytes):
    """The records of an archive, one after the other."""
    words = b""
    if data[:4] == MAGIC.to_bytes(4, "little"):
        n = int.from_bytes(data[4:8], "little")
        words, data = data[8 : 8 + n], memoryview(data)[8 + n :]
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    at = 0
    while at < len(data):
        one = opened.decompressobj()
        block = one.decompress(data[at : at + 65_536])
        step = 65_536
        while not one.eof:
            block += one.decompress(data[at + step : at + step + 1_048_576])
            step += 1_048_576
        at = min(at + step, len(data)) - len(one.unused_data)
        yield block


def _filesystem(path: str):
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    if urlsplit(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(path).path
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else path)


def _writer(folder: str):
    def run(batches):
        system, top = _filesystem(folder)
        held: list[bytes] = []

        def put():
            name, data = f"{uuid.uuid4().hex}.warc.zst", archive(held)
            with system.open_output_stream(f"{top}/{name}", compression=None) as f:
                f.write(data)
            n = len(held)
            held.clear()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [len(data)]})

        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row["id"], row["url"], (row["html"] or "").encode(), row["refers"], base32(row["sha1"])))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put()
                    size = 0
        if held:
            yield put()

    return run


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def plan(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, html, sha1, refers): refers is the response's id for a revisit, null for a response."""
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    # only digests that recur, written: usually few, so that the pages themselves need no shuffle; if many, a hot one can be split
    last = written(rows.groupBy("sha1").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n"), "recurring")
    refers = F.when(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.join(last, "sha1", "left").select("id", "url", "html", "sha1", refers.alias("refers"))


def write(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Writes the archives below folder, which all executors see. The written manifest (path, records, bytes) names those
    that count: an attempt that is lost may leave a file, but no row."""
    spark = pages.sparkSession
    ship(spark)
    home = spark._jvm.org.apache.hadoop.fs.Path(folder)
    home.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(home)
    return written(plan(pages, **columns).mapInArrow(_writer(folder), "path string, records long, bytes long"), "manifest")


_READ = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def _reader(payloads: bool):
    def run(batches):
        schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _filesystem(path)
                with system.open_input_file(at) as f:
                    data = f.read()
                rows = []
                for one in records(data):
                    head, block = parse(one)
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"{path}: a payload of another digest than its record says")
                    rows.append((head.get("page-id"), head["warc-target-uri"], int(head["payload-length"]), digest, kind, head.get("refers-to-page-id"), block if payloads and kind == "response" else None))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives in column path; payload is null for revisits and where it is not asked for."""
    ship(manifest.sparkSession)
    paths = manifest.select("path")
    return paths.repartition(max(1, min(paths.count(), MOST_TASKS)), "path").mapInArrow(_reader(payloads), _READ)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    found = read(write(table(spark, sf_dir, "pages"), new_path(spark, "warc")), payloads=False).drop("payload")
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def _base32_sql(hexadecimal: str) -> str:
    digits = " || ".join(f"to_base(('0x' || substr({hexadecimal}, {1 + 10 * k}, 10))::BIGINT, 32, 8)" for k in range(4))
    return f"translate({digits}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


ORACLE_SQL = f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
    SELECT page_id, regexp_replace(coalesce(url, ''), '\\s+', '', 'g') AS url, strlen(html) AS payload_bytes, {_base32_sql("sha1(html)")} AS payload_digest,
        CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM p"""
