import json

import pytest
from pyspark.sql import functions as F

from scourline import Cleaner
from scourline.sources import io
from scourline.streaming import cleaning as R


def test_csv_json_parquet(spark, tmp_path):
    df = io.load_demo(spark)
    Cleaner(df).to_csv(str(tmp_path / "c"), sep=";")
    back = io.read_csv(spark, str(tmp_path / "c"), sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    assert back.count() == 7 and back.dtypes == df.dtypes
    io.csv_to_parquet(spark, str(tmp_path / "c"), str(tmp_path / "p"), ";", num_partitions=1)
    assert io.read_parquet(spark, f"file://{tmp_path}/p").count() == 7
    with pytest.raises(ValueError):
        io.read_parquet(spark, str(tmp_path / "p"))
    Cleaner(df).write_df_as_json(str(tmp_path / "a.json"))
    assert len(json.loads((tmp_path / "a.json").read_text())) == 7
    assert io.read_json(spark, str(tmp_path / "a.json")).count() == 7
    with pytest.raises(ValueError):
        io.read_csv(spark, str(tmp_path / "c"), header="yes")


def test_malformed_lines_are_dropped(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3,4,5\n6,7\n")
    assert io.load_csv(spark, str(tmp_path / "x.csv")).collect() == [(1, 2), (6, 7)]
    assert io.read_url(spark, f"file://{tmp_path}/x.csv").count() == 2
    assert io.load_spark_data_frame_from_url(spark, f"file://{tmp_path}/x.csv").collect() == [(1, 2), (6, 7)]
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert io.json_load_spark_data_frame_from_url(spark, f"file://{tmp_path}/x.json").count() == 2
    with pytest.raises(ValueError):
        io.read_url(spark, "ftp://x/y.csv")


def test_checkpoint_folder(spark, tmp_path):
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = io.set_check_point_folder(spark, str(tmp_path))
    assert spark.range(3).checkpoint().count() == 3
    io.delete_check_point_folder(spark, str(tmp_path))
    assert not (tmp_path / "checkPointFolder").exists() and folder.endswith("checkPointFolder")
    if before.isDefined():
        spark.sparkContext.setCheckpointDir(before.get())
    else:
        spark.sparkContext.setCheckpointDir(str(tmp_path))


def test_column_dictionary(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Feature Name,Code Name,DataType\nold,new,string\n")
    d = io.ColumnDictionary(spark, str(tmp_path / "d.csv"))
    assert d.read_col_names() == [("old", "new")] and d.read_old_col_names() == ["old"] and d.read_new_col_names() == ["new"]
    assert d.read_col_types() == [("new", "string")] and d.read_col_types("oldNames") == [("old", "string")]


def test_streams_clean_like_tables(spark, tmp_path):
    df = io.load_demo(spark)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    steps = lambda x: Cleaner(x).trim_col("*").clear_accents("*").lower_case("*").df
    got = R.run_available(R.read_stream(spark, str(tmp_path / "in"), 1), steps, str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps(df).collect()))
    # a second run has nothing new to write
    again = R.run_available(R.read_stream(spark, str(tmp_path / "in"), 1), steps, str(tmp_path / "out"))
    assert again.count() == 7


def test_windowed_counts(spark, tmp_path):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).cast("string").alias("k"))
    df.write.parquet(str(tmp_path / "in"))
    got = R.run_available(R.read_stream(spark, str(tmp_path / "in")), lambda x: R.windowed_counts(x, "ts", "k", "1 hour", "1 minute"), str(tmp_path / "out"), "complete")
    assert sorted(r.n for r in got.collect()) == [20, 20, 30, 30]
