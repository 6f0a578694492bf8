"""Tables that several queries of a session share, written once below the shared folder named in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple, tuple[str, object]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session without one may use the machine's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/tables"
    return root.rstrip("/")


def kept(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, read from where it was first written in this application."""
    key = (spark.sparkContext.applicationId, name, source, stamp(spark, f"{source}/events.parquet"))
    if key not in _written:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df = make()
        df.write.parquet(path)
        atexit.register(_remove, spark, path)
        _written[key] = (path, df.schema)
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


def stamp(spark: SparkSession, path: str) -> tuple:
    """Length and latest change of a path's files: a source that is written anew is another one."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(at)
    return sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
