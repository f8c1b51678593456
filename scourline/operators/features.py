"""Feature columns through Spark ML. Fitting runs a job over the inputs."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    IndexToString,
    MinMaxScaler,
    Normalizer,
    OneHotEncoder,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import DataFrame

from ..functions.columns import resolve_columns


def _names(df: DataFrame, columns: str | list[str]) -> list[str]:
    return list(dict.fromkeys(resolve_columns(df, columns)))


def vector_assembler(df: DataFrame, input_cols: str | list[str], output: str = "features", invalid: str = "error") -> DataFrame:
    """Columns as one vector column; ``invalid`` says what to do with nulls: error, skip (the row), or keep (NaN)."""
    return VectorAssembler(inputCols=_names(df, input_cols), outputCol=output, handleInvalid=invalid).transform(df)


def scale_vec_col(df: DataFrame, columns: str | list[str], name_output_col: str, invalid: str = "error") -> DataFrame:
    """Columns replaced by one vector column, each scaled to 0..1 by its minimum and maximum.

    A constant column becomes 0.5.
    """
    names = _names(df, columns)
    assembled = vector_assembler(df, names, "_assembled", invalid)
    scaled = MinMaxScaler(inputCol="_assembled", outputCol=name_output_col).fit(assembled).transform(assembled)
    return scaled.drop("_assembled", *names)


def normalizer(df: DataFrame, input_cols: str | list[str], p: float = 2.0) -> DataFrame:
    """Vector columns scaled to unit p-norm as <column>_normalized."""
    stages = [Normalizer(inputCol=c, outputCol=f"{c}_normalized", p=p) for c in _names(df, input_cols)]
    return Pipeline(stages=stages).fit(df).transform(df)


def string_to_index(df: DataFrame, input_cols: str | list[str], invalid: str = "error") -> DataFrame:
    """Columns indexed as <column>_index: the most frequent value is 0, ties by value."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid=invalid) for c in _names(df, input_cols)]
    return Pipeline(stages=stages).fit(df).transform(df)


def index_to_string(df: DataFrame, input_cols: str | list[str]) -> DataFrame:
    """Indexed columns mapped back to their values as <column>_string."""
    stages = [IndexToString(inputCol=c, outputCol=f"{c}_string") for c in _names(df, input_cols)]
    return Pipeline(stages=stages).fit(df).transform(df)


def one_hot_encoder(df: DataFrame, input_cols: str | list[str]) -> DataFrame:
    """Index columns as binary vectors <column>_encoded, the last category all zeros."""
    stages = [OneHotEncoder(inputCol=c, outputCol=f"{c}_encoded") for c in _names(df, input_cols)]
    return Pipeline(stages=stages).fit(df).transform(df)
