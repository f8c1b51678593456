import os

import pytest

from scourline import storage


def test_staged_tables_are_read_back_and_removed(spark):
    df = storage.stage(spark.range(10).selectExpr("id", "struct(id as x) as s"), "test")
    assert df.count() == 10 and df.dtypes == [("id", "bigint"), ("s", "struct<x:bigint>")]
    own = storage.shared_folder(spark).removeprefix("file://")
    assert os.path.isdir(own)
    storage.remove_written()
    assert spark.conf.get("spark.checkpoint.dir", None) is not None or not os.path.exists(own)
    assert storage.stage(spark.range(3), "again").count() == 3  # a new folder is made


class Session:
    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_the_configured_folder_is_used():
    assert storage.shared_folder(Session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    with pytest.raises(ValueError):
        storage.shared_folder(Session(None, "spark://host:7077"))
