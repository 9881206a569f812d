"""A content-addressed store in Parquet: contents by prefix, pins, and named values by version.

Every write is an append: a put adds a version of its key, a delete or gc a version without bytes, and the last version
counts. So no write touches what is there, and one that dies half-way leaves what was there before. Reads push the key and
the prefix's folder down to the files. ``compact`` writes the last versions as a new generation beside the old one; a
generation counts from the moment its marker file exists. Like any plain Parquet folder the store takes one writer at a
time; cas_tmp compares and then appends.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTENT, _PINS, _NAMED = "key string, ver long, bytes binary, prefix string", "key string, ver long, pinned boolean", "key string, ver long, bytes binary"


class StoreError(Exception):
    """Any failure of a store."""


class NotFound(StoreError):
    pass


class CasMismatch(StoreError):
    pass


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._ver = spark, path.rstrip("/"), 0
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _next(self) -> int:
        """A version above all that this writer, or one before it, has given."""
        self._ver = max(time.time_ns(), self._ver + 1)
        return self._ver

    def _generation(self) -> str:
        """The folder of contents: that of the last generation with a marker."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []
        return f"content-{max((int(n.removeprefix('ready-')) for n in names if n.startswith('ready-')), default=0)}"

    def _table(self, name: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(f"{self.path}/{name}") if self._fs.exists(self._path(name)) else self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("prefix").parquet(f"{self.path}/{self._generation()}")

    def _versions(self) -> DataFrame:
        return self._table(self._generation(), _CONTENT)

    def _keys(self) -> DataFrame:
        """(key, prefix) of what is there; bytes are not read."""
        last = self._versions().groupBy("key", "prefix").agg(F.max(F.struct("ver", F.col("bytes").isNotNull().alias("there"))).alias("last"))
        return last.filter("last.there").select("key", "prefix")

    def contents(self) -> DataFrame:
        """(key, bytes, prefix): the last versions."""
        v = self._versions()
        last = v.groupBy("key", "prefix").agg(F.max("ver").alias("ver"))
        return v.join(last, ["key", "prefix", "ver"]).filter("bytes is not null").select("key", "bytes", "prefix")

    def pins(self) -> DataFrame:
        return self._table("pins", _PINS).groupBy("key").agg(F.max_by("pinned", "ver").alias("pinned")).filter("pinned").select("key")

    def put_all(self, rows: DataFrame) -> None:
        """Adds rows (key, bytes); keys that are there keep what they have (a content key names its bytes). Null bytes are
        empty ones."""
        bytes_ = F.coalesce("bytes", F.lit(b"")).alias("bytes")
        new = rows.select("key", F.lit(self._next()).alias("ver"), bytes_, F.substring_index("key", ":", 1).alias("prefix")).dropDuplicates(["key"])
        self._append(new.join(self._keys().select("key"), "key", "left_anti"))

    def _put(self, key: str, data: bytes | None) -> None:
        row = (key, self._next(), None if data is None else bytearray(data), key.partition(":")[0])
        self._append(self.spark.createDataFrame([row], _CONTENT))

    def put(self, key: str, data: bytes) -> None:
        """Overwrites."""
        self._put(key, data)

    def _one(self, key: str):
        rows = self._versions().filter((F.col("prefix") == key.partition(":")[0]) & (F.col("key") == key))
        return rows.orderBy(F.desc("ver")).select("bytes").first()

    def get(self, key: str) -> bytes | None:
        row = self._one(key)
        return None if row is None or row.bytes is None else bytes(row.bytes)

    def has(self, key: str) -> bool:
        return self.get(key) is not None

    def delete(self, key: str) -> bool:
        """Whether it was there. A pin on it stays."""
        there = self.has(key)
        if there:
            self._put(key, None)
        return there

    def keys(self, prefix: str = "") -> DataFrame:
        """The keys that begin with any prefix, sorted."""
        rows = self._keys()
        if ":" in prefix:
            rows = rows.filter(F.col("prefix") == prefix.partition(":")[0])
        return rows.filter(F.col("key").startswith(prefix)).select("key").orderBy("key")

    def list(self, prefix: str = "") -> list[str]:
        """keys(), one after the other on the driver: for few keys."""
        return [r.key for r in self.keys(prefix).toLocalIterator()]

    def _pin(self, key: str, pinned: bool) -> None:
        self.spark.createDataFrame([(key, self._next(), pinned)], _PINS).write.mode("append").parquet(f"{self.path}/pins")

    def pin(self, key: str) -> None:
        """Pinning again, or pinning what is not there, is no error."""
        self._pin(key, True)

    def pin_all(self, keys: DataFrame) -> None:
        """Pins all of a table of keys (key)."""
        keys.select("key", F.lit(self._next()).alias("ver"), F.lit(True).alias("pinned")).write.mode("append").parquet(f"{self.path}/pins")

    def unpin(self, key: str) -> None:
        self._pin(key, False)

    def unpinned(self) -> DataFrame:
        """The keys that gc would remove, sorted."""
        return self._keys().join(self.pins(), "key", "left_anti").select("key").orderBy("key")

    def gc(self) -> DataFrame:
        """Removes all content that is not pinned; a table (key) of what went, sorted. Named values stay."""
        ver, now = self._next(), self._generation()
        gone = self._keys().join(self.pins(), "key", "left_anti")
        self._append(gone.select("key", F.lit(ver).alias("ver"), F.lit(None).cast("binary").alias("bytes"), "prefix"))
        return self._table(now, _CONTENT).filter(F.col("ver") == ver).select("key").orderBy("key")

    def compact(self) -> None:
        """Writes the last versions as a new generation, which counts once it is whole, and deletes the old one."""
        old = self._generation()
        new = int(old.removeprefix("content-")) + 1
        rows = self.contents().select("key", F.lit(self._next()).alias("ver"), "bytes", "prefix")
        rows.write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/content-{new}")
        self._fs.create(self._path(f"ready-{new}")).close()
        for name in (old, old.replace("content", "ready")):
            self._fs.delete(self._path(name), True)

    def named(self) -> DataFrame:
        """(key, bytes): the last version of each named value."""
        return self._table("named", _NAMED).groupBy("key").agg(F.max_by("bytes", "ver").alias("bytes"))

    def put_tmp_all(self, rows: DataFrame) -> None:
        """Adds versions (key, ver, bytes) of named values."""
        rows.select("key", "ver", "bytes").write.mode("append").parquet(f"{self.path}/named")

    def put_tmp(self, key: str, data: bytes) -> None:
        ver = self._table("named", _NAMED).filter(F.col("key") == key).agg(F.coalesce(F.max("ver"), F.lit(0))).first()[0] + 1
        self.put_tmp_all(self.spark.createDataFrame([(key, ver, bytearray(data))], _NAMED))

    def get_tmp(self, key: str) -> bytes | None:
        row = self.named().filter(F.col("key") == key).first()
        return bytes(row.bytes) if row else None

    def cas_tmp(self, key: str, old: bytes, new: bytes) -> bool:
        """Sets a named value that is old; an error where it is another or none."""
        now = self.get_tmp(key)
        if now is None:
            raise NotFound(key)
        if now != old:
            raise CasMismatch(key)
        self.put_tmp(key, new)
        return True

    store, load, exists = put, get, has


class MemoryStore:
    """The same interface over dictionaries on the driver, for sessions and tests."""

    def __init__(self):
        self.content, self.pinned, self.temporal = {}, set(), {}

    def put(self, key: str, data: bytes) -> None:
        self.content[key] = bytes(data)

    def get(self, key: str) -> bytes | None:
        return self.content.get(key)

    def has(self, key: str) -> bool:
        return key in self.content

    def delete(self, key: str) -> bool:
        return self.content.pop(key, None) is not None

    def list(self, prefix: str = "") -> list[str]:
        return sorted(k for k in self.content if k.startswith(prefix))

    def pin(self, key: str) -> None:
        self.pinned.add(key)

    def unpin(self, key: str) -> None:
        self.pinned.discard(key)

    def gc(self) -> list[str]:
        gone = sorted(set(self.content) - self.pinned)
        for k in gone:
            del self.content[k]
        return gone

    def put_tmp(self, key: str, data: bytes) -> None:
        self.temporal[key] = bytes(data)

    def get_tmp(self, key: str) -> bytes | None:
        return self.temporal.get(key)

    def cas_tmp(self, key: str, old: bytes, new: bytes) -> bool:
        if key not in self.temporal:
            raise NotFound(key)
        if self.temporal[key] != old:
            raise CasMismatch(key)
        self.temporal[key] = bytes(new)
        return True

    store, load, exists = put, get, has


class CacheStore:
    """Keeps the values read last, up to a number and an age. Pins, gc and named values of the inner store are not
    passed on: they do nothing here."""

    def __init__(self, inner, most: int, age: float):
        import time
        from collections import OrderedDict

        self.inner, self.most, self.age, self._clock, self._kept = inner, most, age, time.monotonic, OrderedDict()

    def _keep(self, key: str, data: bytes) -> None:
        self._kept[key] = (self._clock(), data)
        self._kept.move_to_end(key)
        while len(self._kept) > self.most:
            self._kept.popitem(last=False)

    def cache_size(self) -> int:
        return len(self._kept)

    def put(self, key: str, data: bytes) -> None:
        self.inner.put(key, data)
        self._keep(key, bytes(data))

    def get(self, key: str) -> bytes | None:
        if key in self._kept:
            at, data = self._kept[key]
            if self._clock() - at <= self.age:
                self._kept.move_to_end(key)
                return data
            del self._kept[key]
        data = self.inner.get(key)
        if data is not None:
            self._keep(key, data)
        return data

    def has(self, key: str) -> bool:
        return key in self._kept or self.inner.has(key)

    def delete(self, key: str) -> bool:
        self._kept.pop(key, None)
        return self.inner.delete(key)

    def list(self, prefix: str = "") -> list[str]:
        return self.inner.list(prefix)

    def pin(self, key: str) -> None:
        return None

    unpin = pin

    def gc(self) -> list[str]:
        return []

    def put_tmp(self, key: str, data: bytes) -> None:
        return None

    def get_tmp(self, key: str) -> bytes | None:
        return None

    def cas_tmp(self, key: str, old: bytes, new: bytes) -> bool:
        raise CasMismatch(key)

    store, load, exists = put, get, has
