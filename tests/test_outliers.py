import pytest
from pyspark.sql import functions as F

from scourline import OutlierDetector
from scourline.operators import outliers as O

# Populations whose fences are known.
POPULATION = [37800000, 19795791, 12341418, 6489162, 15000000, 999999, 100000000]


@pytest.fixture
def demo(spark):
    return spark.createDataFrame(list(enumerate(POPULATION)), "id long, population int")


def test_fences_golden(demo):
    found = OutlierDetector(demo, "population")
    assert found.bounds() == (-40477095.0, 84766257.0)
    assert [r.population for r in found.outlier().collect()] == [100000000]
    assert found.fraction() == pytest.approx(1 / 7)
    kept = found.delete_outlier_one().get_dataframe()
    assert kept.columns == demo.columns and kept.count() == 6


def test_constant_null_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert [r.v for r in O.normalize(df, "v").collect()] == [0.0, 0.0, None]
    assert O.delete_outliers(df, "v").count() == 3
    empty = df.limit(0)
    assert O.bounds(empty, "v") == (None, None) and O.delete_outliers(empty, "v").count() == 0
    assert O.distance_ratio(empty, "v").count() == 0 and OutlierDetector(empty, "v").fraction() == 0.0
    with pytest.raises(ValueError):
        OutlierDetector(spark.createDataFrame([("a",)], "v string"), "v")


def test_kmeans(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 100, F.col("id") % 5).otherwise(1000 + F.col("id") % 5).cast("double").alias("x"))
    df = df.unionByName(spark.createDataFrame([(500, 40.0), (501, None)], "id long, x double"))
    rated = O.distance_ratio(df, "x", k=2, seed=1)
    got = {r.id: r.distance_ratio for r in rated.collect()}
    assert len(got) == 202 and got[501] is None and max(v for v in got.values() if v is not None) == 1.0
    kept = O.delete_outliers_kmeans(df, "x", 0.9, k=2, seed=1)
    assert 501 in {r.id for r in kept.collect()} and kept.columns == ["id", "x"]


def test_kmeans_ratios_against_the_centres(spark):
    import math
    import random

    rng = random.Random(3)
    rows = [(k, rng.gauss(rng.choice([0, 50, 90]), 4), None if k % 40 == 0 else rng.gauss(rng.choice([5, 70]), 6)) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    centres, scales = O.kmeans_centres(df, ["x", "y"], 3, True, 7)
    known = [r for r in rows if r[2] is not None]
    assert scales[0] == (min(r[1] for r in rows), max(r[1] for r in rows) - min(r[1] for r in rows)) and len(centres) == 3
    near, largest = {}, {}
    for i, *v in known:
        at = [(a - lo) / size for a, (lo, size) in zip(v, scales, strict=True)]
        far = [math.dist(at, c) for c in centres]
        near[i] = (far.index(min(far)), min(far))
        largest[near[i][0]] = max(largest.get(near[i][0], 0), min(far))
    got = {r.id: r.distance_ratio for r in O.distance_ratio(df, ["x", "y"], 3, True, 7).collect()}
    assert {i for i, v in got.items() if v is None} == {r[0] for r in rows if r[2] is None}
    assert all(got[i] == pytest.approx(d / largest[c]) for i, (c, d) in near.items())
    found = O.OutlierDetector(df, ["x", "y"], id_column="id")
    far = {i for i, v in got.items() if v is not None and v > 0.8}
    assert {r.id for r in found.kmeans_ids(0.8, 3, True, 7).collect()} == far
    assert {r.id for r in found.delete_outlier_kmeans(0.8, 3, True, 7).get_dataframe().collect()} == set(got) - far


def test_show_with_and_without_ids(demo, capsys):
    found = OutlierDetector(demo.select("population"), "population")
    found.show(2)
    assert "_row_id" not in capsys.readouterr().out
    found.show(2, True, True)
    assert "_row_id" in capsys.readouterr().out
    assert found.outlier_ids().columns == ["_row_id"] and found.outlier_ids().count() == 1
