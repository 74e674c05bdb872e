"""Tables that operators write on the way: they cut the lineage, and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset; it must name a folder that the driver and all executors share")
    return "file://" + _own()


_made: list[str] = []


def _own() -> str:
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="formloom-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return _made[0]


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/formloom/{spark.sparkContext.applicationId}"


_scopes: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a Parquet table in the shared folder."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for s in _scopes[-1:]:
        s.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that `written` makes within it, on failure too; for jobs whose results have been stored by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for p in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
