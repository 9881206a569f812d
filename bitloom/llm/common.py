"""What the operators of this folder share: the shared folder, written tables and the words of a text."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.plans.ship import ship  # noqa: F401
from bitloom.sources.shared import new_path, shared_folder  # noqa: F401

#: A word is a run of anything but these six characters: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


class _Scopes(threading.local):
    """For each settled() that this thread is in, the paths that were written there."""

    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder: losing an executor loses nothing of it."""
    path = new_path(df.sparkSession, name)
    for scope in _scopes.open[-1:]:
        scope.append(path)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remove(df: DataFrame) -> None:
    """Deletes the files of a written() table that nothing needs any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def settled(make, name: str) -> DataFrame:
    """make()'s table, written; the tables that were written on the way to it are deleted. For operators whose results
    are read lazily from such tables."""
    _scopes.open.append([])
    try:
        out = written(make(), name)
    finally:
        paths = _scopes.open.pop()
    for scope in _scopes.open[-1:]:
        scope.append(paths[-1])
    for path in paths[:-1]:
        _delete(out.sparkSession, path)
    return out


def free_name(name: str, taken) -> str:
    """name, with as many underscores as it takes to be none of the taken ones (Spark's names know no case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is never inlined, a projected column may be."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, as an array; [] for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words, without making them: 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
