"""CSV, JSON, Parquet and URL sources, sinks, checkpoint folders and column dictionaries."""

from __future__ import annotations

import shutil
import tempfile
import urllib.request
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..storage import delete, new_folder

_CHUNK = 8192
_FOLDER = "checkPointFolder"


def _flag(value: str | bool, name: str) -> bool:
    if isinstance(value, bool):
        return value
    if value not in ("true", "false"):
        raise ValueError(f"{name} must be 'true' or 'false'")
    return value == "true"


def create_data_frame(spark: SparkSession, data: list[tuple], names: list[str]) -> DataFrame:
    """A DataFrame of tuples, types inferred."""
    if not isinstance(data, list) or not data or not isinstance(data[0], tuple):
        raise TypeError("data must be a list of tuples")
    if not isinstance(names, list) or not names or not isinstance(names[0], str):
        raise TypeError("names must be a list of strings")
    return spark.createDataFrame(data, names)


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: str | bool = "true", infer_schema: str | bool = "true", schema: Any = None, **options: Any) -> DataFrame:
    """A CSV file or folder. A schema saves the pass that infers one."""
    reader = spark.read.options(header=_flag(header, "header"), sep=sep, **options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", _flag(infer_schema, "infer_schema"))
    return reader.csv(path)


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, types inferred, malformed lines dropped.

    Lines are parsed whole, so that the same ones are dropped whichever columns are read.
    """
    return spark.read.options(header=True, inferSchema=True, mode="DROPMALFORMED", columnPruning=False).csv(path)


def read_json(spark: SparkSession, path: str, schema: Any = None) -> DataFrame:
    """A JSON document: an array of objects, or one object over several lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet under a file:/// or hdfs:/// path."""
    if not path.startswith(("file:///", "hdfs:///")):
        raise ValueError("path must start with file:/// or hdfs:///")
    return spark.read.parquet(path)


def download(url: str, folder: str) -> str:
    """A copy on the driver, in a folder, of what a URL names; its path. The name is what follows the last slash."""
    if not url.startswith(("http://", "https://", "file://")):
        raise ValueError("url must start with http://, https:// or file://")
    target = Path(folder) / (url.rstrip("/").rpartition("/")[2] or "download")
    with urllib.request.urlopen(urllib.request.Request(url)) as source, target.open("wb") as out:
        shutil.copyfileobj(source, out, _CHUNK)
    return str(target)


def download_shared(spark: SparkSession, url: str) -> str:
    """A copy of what a URL names in the folder that all executors share; its path."""
    folder = tempfile.mkdtemp(prefix="scourline-get-")  # on the driver only, until the copy is in the shared folder
    local = download(url, folder)
    target = f"{new_folder(spark, 'download')}/{Path(local).name}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place.getParent())
    system.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{local}"), place)
    shutil.rmtree(folder)
    return target


def read_url(spark: SparkSession, url: str, ty: str = "csv") -> DataFrame:
    """A CSV or JSON file behind a URL, read from a copy in the shared folder."""
    if ty not in ("csv", "json"):
        raise ValueError("ty must be csv or json")
    path = download_shared(spark, url)
    return read_json(spark, path) if ty == "json" else load_csv(spark, path)


def load_spark_data_frame_from_url(spark: SparkSession, url: str) -> DataFrame:
    """A CSV file behind a URL, as read_url reads it."""
    return read_url(spark, url)


def json_load_spark_data_frame_from_url(spark: SparkSession, url: str) -> DataFrame:
    """A JSON file behind a URL, as read_url reads it."""
    return read_url(spark, url, "json")


def csv_to_parquet(spark: SparkSession, input_path: str, output_path: str, sep: str = ",", header: str | bool = "true", num_partitions: int | None = None, mode: str = "error") -> None:
    """A CSV table written as Parquet, in at most ``num_partitions`` files."""
    df = read_csv(spark, input_path, sep, header)
    if num_partitions is not None:
        df = df.coalesce(num_partitions)
    df.write.mode(mode).parquet(output_path)


def write_csv(df: DataFrame, path: str, header: str | bool = "true", mode: str = "overwrite", sep: str = ",", **options: Any) -> None:
    """A folder of CSV files."""
    df.write.options(header=_flag(header, "header"), sep=sep, **options).mode(mode).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of files with one JSON object a line."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One local file with a JSON array of the rows, for results that fit one disk; rows come one partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for k, row in enumerate(df.toJSON().toLocalIterator()):
            out.write((",\n" if k else "") + row)
        out.write("]\n")


def _folder(path: str, file_system: str) -> str:
    if file_system not in ("local", "hadoop"):
        raise ValueError("file_system must be 'local' or 'hadoop'")
    base = path.rstrip("/") + "/" + _FOLDER
    return base if file_system == "hadoop" or "://" in base else f"file://{Path(base).resolve()}"


def set_check_point_folder(spark: SparkSession, path: str, file_system: str = "local") -> str:
    """An empty folder for checkpoints below ``path``; an old one is deleted."""
    folder = _folder(path, file_system)
    delete(spark, folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete_check_point_folder(spark: SparkSession, path: str, file_system: str = "local") -> None:
    delete(spark, _folder(path, file_system))


class ColumnDictionary:
    """A small table that gives each column its old name, new name and type.

    Its columns are 'Feature Name', 'Code Name' and 'DataType'.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, df: DataFrame | None = None) -> None:
        if (path is None) == (df is None):
            raise ValueError("give a path or a DataFrame")
        if path is not None and path.startswith(("http://", "https://")):
            path = download_shared(spark, path)
        self._df = df if path is None else read_csv(spark, path, infer_schema=False)

    def set_df(self, df: DataFrame) -> None:
        self._df = df

    def get_df(self) -> DataFrame:
        return self._df

    @staticmethod
    def column_values(df: DataFrame, column: str) -> list:
        """The values of a column of a small table."""
        return [row[0] for row in df.select(f"`{column}`").collect()]

    def _pairs(self, a: str, b: str) -> list[tuple]:
        return [(row[0], row[1]) for row in self._df.select(f"`{a}`", f"`{b}`").collect()]

    def read_col_names(self) -> list[tuple[str, str]]:
        """(old name, new name) of each column, as rename_columns takes them."""
        return self._pairs("Feature Name", "Code Name")

    def read_new_col_names(self) -> list[str]:
        return self.column_values(self._df, "Code Name")

    def read_old_col_names(self) -> list[str]:
        return self.column_values(self._df, "Feature Name")

    def read_col_types(self, names: str = "newNames") -> list[tuple[str, str]]:
        """(name, type) of each column, as cast_columns takes them; 'newNames' or 'oldNames'."""
        if names not in ("newNames", "oldNames"):
            raise ValueError("names must be 'newNames' or 'oldNames'")
        return self._pairs("Code Name" if names == "newNames" else "Feature Name", "DataType")


def load_demo(spark: SparkSession) -> DataFrame:
    """Seven places with the usual dirt."""
    # The demonstration table.
    rows = [
        ("Bogota", "Colombia", 37800000), ("New York", "America", 9795791), ("   São Paulo", "Brazil", 12341418),
        ("~Madrid", "Spain", 6489162), ("New York", "America", 19795791), ("New York  ", "Amarica", 19795791),
        ("Bogotá", "Colombia", 37800000),
    ]
    return spark.createDataFrame(rows, "city string, country string, population int")
