"""The folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines see; where it is unset and Spark runs on one machine, a
    temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="bitloom-"))
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path there that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
