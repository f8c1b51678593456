"""Folders that all executors share, for results that are written between steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_written: list[tuple[SparkSession, str]] = []
_registered = False


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an own one only where none is set, on one machine."""
    global _own_folder
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="scourline-")
    return f"file://{_own_folder}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet; deleted when the driver ends."""
    global _registered
    path = f"{shared_folder(spark)}/scourline/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if not _registered:  # now that a session is there, so that this runs before the JVM is ended
        atexit.register(remove_written)
        _registered = True
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``, into the shared folder if the session has no checkpoint folder yet."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and return a frame that reads it back.

    Both readers of an intermediate result then see the same rows, and a lost executor costs no
    recomputation of it.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system Hadoop knows."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_written() -> None:
    """Delete all folders of new_folder(); results that still read them become invalid."""
    global _own_folder
    while _written:
        spark, path = _written.pop()
        try:
            if path.startswith("file:"):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
            else:
                delete(spark, path)
        except Exception:  # the session may be gone at exit
            pass
    if _own_folder is not None:
        shutil.rmtree(_own_folder, ignore_errors=True)
        _own_folder = None
