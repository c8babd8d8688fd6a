"""Cutting lineage in a folder that all executors share, and joins with a side of checked size."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side below this many bytes (rows times the width its caller states) is broadcast.
BROADCAST_BYTES = 16 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder for this application below spark.checkpoint.dir; only where that is unset (tests), a temporary one.

    It is removed when the driver ends.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="wikiloom-")
            atexit.register(shutil.rmtree, base, True)
        folder = f"{base.rstrip('/')}/wikiloom-{uuid.uuid4().hex}"
        _folders[sc.applicationId] = folder
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        atexit.register(_remove, sc, path)
    return _folders[sc.applicationId]


def _remove(sc, path) -> None:
    try:
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:
        pass


def durable(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    # Shuffle files are deleted once the frame is written, not when the driver happens to collect its garbage.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # Terms stay encoded by their dictionary, which takes more than the usual megabyte for a part of a corpus.
        df.write.option("compression", codec).option("parquet.dictionary.page.size", str(4 << 20)).parquet(at)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


def release(df: DataFrame) -> None:
    """Delete the files of a frame that durable() wrote and nothing will read again."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for at in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/wikiloom-" in at and folder.rpartition("/wikiloom-")[2] in at:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if its counted rows fit the limit, else as it is, for a shuffled join.

    df must be cheap to read again (a durable() frame).
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
