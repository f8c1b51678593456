"""Outliers by Tukey's fences and by distance from k-means centres. Bounds and models run jobs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted, resolve_columns

#: Accuracy of quantiles: their rank error is the rows divided by it.
ACCURACY = 10_000


def _known(column: str) -> Column:
    c = F.col(quoted(column)).cast("double")
    return F.when(~F.isnan(c), c)


def normalize(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """Columns scaled to 0..1 by minimum and maximum, in place, as doubles; a constant column becomes 0."""
    names = resolve_columns(df, columns, "numeric")
    found = df.agg(*[f(_known(c)).alias(f"{f.__name__}{k}") for k, c in enumerate(names) for f in (F.min, F.max)]).first()
    scaled = {}
    for k, c in enumerate(names):
        low, high = found[f"min{k}"], found[f"max{k}"]
        x = F.col(quoted(c)).cast("double")
        scaled[c] = F.when(x.isNotNull(), F.lit(0.0)) if low is None or low == high else (x - low) / (high - low)
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(quoted(c)) for c in df.columns])


def bounds_frame(df: DataFrame, column: str, tolerance: float = 1.5, accuracy: int = ACCURACY) -> DataFrame:
    """(q1, q3, lower, upper): quartiles that are values of the column, and the fences they give; one row."""
    resolve_columns(df, column, "numeric")
    quartiles = df.agg(F.percentile_approx(_known(column), [0.25, 0.75], accuracy).alias("q")).select(F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    reach = tolerance * (F.col("q3") - F.col("q1"))
    return quartiles.select("q1", "q3", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def bounds(df: DataFrame, column: str, tolerance: float = 1.5, accuracy: int = ACCURACY) -> tuple[float | None, float | None]:
    """The fences q1 - tolerance * (q3 - q1) and q3 + tolerance * (q3 - q1); None without values."""
    row = bounds_frame(df, column, tolerance, accuracy).first()
    return row["lower"], row["upper"]


def flag_outliers(df: DataFrame, column: str, tolerance: float = 1.5, accuracy: int = ACCURACY, name: str = "is_outlier") -> DataFrame:
    """A column that says whether the value lies outside the fences; nulls and NaN don't."""
    low, high = bounds(df, column, tolerance, accuracy)
    c = _known(column)
    outside = F.lit(False) if low is None else F.coalesce((c < low) | (c > high), F.lit(False))
    return df.withColumn(name, outside)


def delete_outliers(df: DataFrame, column: str, tolerance: float = 1.5, accuracy: int = ACCURACY) -> DataFrame:
    """The rows within the fences, values as they were."""
    return flag_outliers(df, column, tolerance, accuracy, "_outlier").where(~F.col("_outlier")).drop("_outlier")


def kmeans_centres(df: DataFrame, columns: str | list[str], k: int = 3, normalized: bool = True, seed: int = 42) -> tuple[list[list[float]], list[tuple[float, float]]]:
    """(centres, (offset, scale) of each column): where k-means puts them in the scaled columns. Runs jobs.

    Centres come from 10 iterations after a random start; rows with a null or NaN are left out. No centres without rows.
    """
    names = resolve_columns(df, columns, "numeric")
    rows = df.select(*[_known(c).alias(f"_x{n}") for n, c in enumerate(names)]).dropna()
    scales = [(0.0, 1.0)] * len(names)
    if normalized:
        found = df.agg(*[f(_known(c)).alias(f"{f.__name__}{n}") for n, c in enumerate(names) for f in (F.min, F.max)]).first()
        lows, highs = ([found[f"{f}{n}"] for n in range(len(names))] for f in ("min", "max"))
        scales = [(lo or 0.0, (hi - lo) or 1.0 if lo is not None else 1.0) for lo, hi in zip(lows, highs, strict=True)]
        rows = rows.select(*[((F.col(f"_x{n}") - lo) / size).alias(f"_x{n}") for n, (lo, size) in enumerate(scales)])
    # made once for all iterations, in the memory or on the disks of the executors; lost parts are made again
    assembled = VectorAssembler(inputCols=rows.columns, outputCol="_v").transform(rows).select("_v").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if assembled.isEmpty():
            return [], scales
        model = KMeans(k=k, maxIter=10, initMode="random", seed=seed, featuresCol="_v", predictionCol="_c").fit(assembled)
    finally:
        assembled.unpersist()
    return [[float(x) for x in c] for c in model.clusterCenters()], scales


def centre_distances(df: DataFrame, columns: list[str], centres: list[list[float]], scales: list[tuple[float, float]]) -> DataFrame:
    """The table with _c, the number of the nearest centre (the first of several), and _d, the distance; null without one."""
    scaled = [(_known(c) - lo) / size for c, (lo, size) in zip(columns, scales, strict=True)]
    far = []
    for number, centre in enumerate(centres):
        square = F.lit(0.0)
        for x, at in zip(scaled, centre, strict=True):
            square = square + (x - at) * (x - at)
        far.append(F.struct(square.alias("d"), F.lit(number).alias("c")))
    whole = F.lit(True)
    for x in scaled:
        whole = whole & x.isNotNull()
    nearest = F.when(whole, F.array_min(F.array(*far)))
    return df.withColumn("_near", nearest).select("*", F.col("_near.c").alias("_c"), F.sqrt("_near.d").alias("_d")).drop("_near")


def centre_ratio(df: DataFrame, columns: list[str], centres: list[list[float]], scales: list[tuple[float, float]], name: str) -> DataFrame:
    """A column with the distance of each row from its nearest centre as a share of the largest among the rows of that centre.

    A centre whose rows all lie on it gives 0; a row with a null or NaN has no centre and gives null.
    """
    out = centre_distances(df, columns, centres, scales)
    largest = out.groupBy("_c").agg(F.max("_d").alias("_m"))  # a row for each centre and one for rows without
    joined = out.join(F.broadcast(largest), "_c", "left")
    ratio = F.when(F.col("_m") > 0, F.col("_d") / F.col("_m")).otherwise(F.when(F.col("_d").isNotNull(), 0.0))
    return joined.select(*[F.col(quoted(c)) for c in df.columns], ratio.alias(name))


def distance_ratio(
    df: DataFrame, columns: str | list[str], k: int = 3, normalized: bool = True, seed: int = 42, name: str = "distance_ratio"
) -> DataFrame:
    """The distance of each row from its k-means centre as a share of the largest in its cluster; see kmeans_centres and centre_ratio."""
    names = resolve_columns(df, columns, "numeric")
    centres, scales = kmeans_centres(df, names, k, normalized, seed)
    if not centres:
        return df.withColumn(name, F.lit(None).cast("double"))
    return centre_ratio(df, names, centres, scales, name)


def delete_outliers_kmeans(
    df: DataFrame, columns: str | list[str], threshold: float, k: int = 3, normalized: bool = True, seed: int = 42
) -> DataFrame:
    """The rows whose distance ratio is at most the threshold; rows without a cluster stay."""
    rated = distance_ratio(df, columns, k, normalized, seed, "_ratio")
    return rated.where(F.col("_ratio").isNull() | (F.col("_ratio") <= threshold)).drop("_ratio")


class OutlierDetector:
    """A table and the columns whose outliers are looked for.

    Without an ``id_column`` an id is generated; it depends on the partitions of the table.
    """

    def __init__(self, df: DataFrame, column: str | list[str], tolerance: float = 1.5, accuracy: int = ACCURACY, id_column: str | None = None) -> None:
        self._tolerance, self._accuracy = tolerance, accuracy
        self._columns = resolve_columns(df, column, "numeric")
        self._own = id_column is None
        self._id = id_column or "_row_id"
        self._df = df.withColumn(self._id, F.monotonically_increasing_id()) if self._own else df

    def _with(self, df: DataFrame) -> OutlierDetector:
        out = OutlierDetector(df, self._columns, self._tolerance, self._accuracy, self._id)
        out._own = self._own
        return out

    def _plain(self, df: DataFrame) -> DataFrame:
        return df.drop(self._id) if self._own else df

    def _one(self) -> str:
        if len(self._columns) != 1:
            raise ValueError("fences are for one column")
        return self._columns[0]

    def _flagged(self, tolerance: float | None = None) -> DataFrame:
        return flag_outliers(self._df, self._one(), tolerance or self._tolerance, self._accuracy, "_outlier")

    def _rated(self, k: int, normalize: bool, seed: int) -> DataFrame:
        return distance_ratio(self._df, self._columns, k, normalize, seed, "_ratio")

    def bounds(self) -> tuple[float | None, float | None]:
        return bounds(self._df, self._one(), self._tolerance, self._accuracy)

    def outlier(self, tolerance: float | None = None) -> DataFrame:
        """The rows outside the fences."""
        return self._plain(self._flagged(tolerance).where("_outlier").drop("_outlier"))

    def outlier_ids(self, tolerance: float | None = None) -> DataFrame:
        """The ids of the rows outside the fences."""
        return self._flagged(tolerance).where("_outlier").select(self._id)

    def fraction(self) -> float:
        """Share of the rows that are outliers; 0 for an empty table."""
        return self._flagged().agg(F.avg(F.col("_outlier").cast("int"))).first()[0] or 0.0

    def delete_outlier_one(self, tolerance: float | None = None) -> OutlierDetector:
        return self._with(delete_outliers(self._df, self._one(), tolerance or self._tolerance, self._accuracy))

    def kmeans_check(self, threshold: float, k: int = 3, normalize: bool = True, seed: int = 42) -> DataFrame:
        """The rows whose distance ratio exceeds the threshold."""
        return self._plain(self._rated(k, normalize, seed).where(F.col("_ratio") > threshold).drop("_ratio"))

    def kmeans_ids(self, threshold: float, k: int = 3, normalize: bool = True, seed: int = 42) -> DataFrame:
        """The ids of the rows whose distance ratio exceeds the threshold."""
        return self._rated(k, normalize, seed).where(F.col("_ratio") > threshold).select(self._id)

    def delete_outlier_kmeans(self, threshold: float, k: int = 3, normalize: bool = True, seed: int = 42) -> OutlierDetector:
        return self._with(delete_outliers_kmeans(self._df, self._columns, threshold, k, normalize, seed))

    def show(self, n: int = 10, truncate: bool = True, with_id: bool = False) -> None:
        (self._df if with_id else self.get_dataframe()).show(n, truncate)

    def get_dataframe(self) -> DataFrame:
        return self._plain(self._df)
