"""The stateless operators over streams, and counts in event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files below a path, or of one file, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a folder or a pattern
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(df: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """(start, key, n) for each window of event time; rows later than ``late`` behind the newest are left out.

    Grouping by (window, key) combines before the shuffle; state is dropped once a window is closed.
    """
    event_time = F.col(time).cast("timestamp")
    stamped = df.where(F.col(time).isNotNull()).select(event_time.alias("_time"), F.col(key)).withWatermark("_time", late)
    counts = stamped.groupBy(F.window("_time", window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")


def run_available(stream: DataFrame, steps: Callable[[DataFrame], DataFrame], folder: str, mode: str = "append") -> DataFrame:
    """Run ``steps`` over what the stream holds now, in as many micro-batches as it needs; the rows written.

    ``folder`` gets the output and the stream's checkpoint, so that a restarted run goes on where
    it was and each row is written once: a batch overwrites its own part. In 'complete' mode the last
    batch replaces the result.
    """
    out = steps(stream)
    target = f"{folder}/rows"

    def write(batch: DataFrame, number: int) -> None:
        part = 0 if mode == "complete" else number
        batch.write.mode("overwrite").parquet(f"{target}/batch={part}")

    query = (
        out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(out.schema).parquet(target).select(*out.columns)
