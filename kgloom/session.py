"""Session defaults, settings from the environment, and written tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "kgloom", **conf: str) -> SparkSession:
    """A session with the library's defaults; what conf or the cluster sets wins."""
    builder = SparkSession.builder.appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def safe_env(name: str, default: str = "") -> str:
    """An environment variable without white space around it."""
    return os.environ.get(name, default).strip()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session, whose tasks run in the driver's process, may leave it unset; then a temporary folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kgloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which a finished query's shuffle files go at once instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scope: ContextVar[list[tuple[DataFrame, bool]] | None] = ContextVar("tables", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """The tables that are written within are deleted when it ends. Those to be kept outlive it, for a result reads them, and go with the scope around it, if there is one."""
    tables: list[tuple[DataFrame, bool]] = []
    outer = _scope.get()
    token = _scope.set(tables)
    try:
        yield
    finally:
        _scope.reset(token)
        discard(*(table for table, keep in tables if not keep))
        if outer is not None:
            outer += [(table, False) for table, keep in tables if keep]


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends here, and lost executors lose nothing.

    The shuffle files of the job are dropped when it is done, for nothing reads them again. keep: a result reads the table, so it stays when the
    operator's scratch ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if (own := _scope.get()) is not None:
        own.append((out, keep))
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again: all that was made from them must have been written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, written and read again, to be kept: what follows uses it several times without computing it again. A scratch around the caller deletes it."""
    return written(df, "cut", keep=True)
