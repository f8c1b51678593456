"""Session helpers: a local session for tests and shipping this package to Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, with the settings the operators are tested with.

    Its folder for checkpoints and intermediate tables is one of this machine, deleted at the end. Small shuffles keep their
    partitions, as their rows take longer than their bytes suggest.
    """
    folder = tempfile.mkdtemp(prefix="scourline-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scourline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.checkpoint.dir", f"file://{folder}")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor; once a context."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="scourline-ship-")  # on the driver, from where executors fetch it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "scourline.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def map_in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` whose workers can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
