"""Ingestion of files and snapshots: records of texts, what is new, and what changed between two states."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.functions.records import bitmap_key
from bitloom.functions.text import DEFAULT, Tokenizer
from bitloom.operators import sketch

#: The file names that are read as text, by ending.
EXTENSIONS = (
    ".rs", ".py", ".md", ".toml", ".lock", ".json", ".lua", ".forth",
    ".ipynb", ".sh", ".yml", ".yaml", ".txt", ".cfg", ".dockerfile",
    ".containerfile", ".gitignore", ".editorconfig", ".xml",
)
#: Added and deleted files may differ by this many before a state is said to diverge.
DIVERGENCE = 3


def read_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of all text files below a folder, whole, but for those under excluded folder names."""
    raw = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    ends = F.lit(False)
    for e in extensions:
        ends = ends | F.lower("path").endswith(e)
    for name in exclude:
        ends = ends & ~F.col("path").contains(f"/{name}/")
    return raw.filter(ends)


def records(texts: DataFrame, key: str = "path", tokenizer: Tokenizer = DEFAULT) -> DataFrame:
    """(key, sketch_key, popcount, card, token_count) of texts; those without words are left out."""
    built = sketch.build(texts, tokenizer.tokens("text"), key)
    counts = texts.select(key, F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+")).alias("token_count"))
    out = built.join(counts, key).withColumn("popcount", sketch.popcount("bm")).filter("popcount > 0")
    return out.select(key, bitmap_key("bm").alias("sketch_key"), "popcount", sketch.card("bm").alias("card"), "token_count")


def not_indexed(texts: DataFrame, index: DataFrame, key: str = "path") -> DataFrame:
    return texts.join(index.select(key), key, "left_anti")


def changes(previous: DataFrame, current: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, status) between two snapshots (key, content): A added, M modified, D deleted. A renamed file is a deleted one
    and an added one."""
    a, b = previous.select(key, F.col(content).alias("was"), F.lit(1).alias("p")), current.select(key, F.col(content).alias("is"), F.lit(1).alias("c"))
    status = F.when(F.col("p").isNull(), "A").when(F.col("c").isNull(), "D").when(~F.col("was").eqNullSafe(F.col("is")), "M")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).filter("status is not null")


def divergence(changed: DataFrame, *keys: str, most: int = DIVERGENCE) -> DataFrame:
    """(keys, added, deleted, difference, diverges) of changes (keys, status)."""
    n = changed.groupBy(*keys).agg(F.count_if(F.col("status") == "A").alias("added"), F.count_if(F.col("status") == "D").alias("deleted"))
    return n.withColumn("difference", F.abs(F.col("added") - F.col("deleted"))).withColumn("diverges", F.col("difference") > most)


def write_metadata(path: str, data: dict) -> None:
    """A JSON file on the driver, replaced as a whole."""
    with open(f"{path}.tmp", "w") as f:
        json.dump(data, f, indent=2, sort_keys=True)
    os.replace(f"{path}.tmp", path)
