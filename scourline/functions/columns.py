"""Resolution of column arguments: a name, a list of names, or '*'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Names of type families and the types they stand for.
FAMILIES = {
    "string": (T.StringType, T.CharType, T.VarcharType),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType,),
    "double": (T.DoubleType, T.DecimalType),
    "numeric": (T.NumericType,),
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "boolean": (T.BooleanType,),
}
# Other names of the families that column arguments accept.
ALIASES = {
    "str": "string", "String": "string", "int": "integer", "long": "integer", "bigint": "integer",
    "Double": "double", "timestamp": "date",
}


def family(name: str) -> tuple[type, ...]:
    """The types of a family; ValueError for an unknown name."""
    key = ALIASES.get(name, name)
    if key not in FAMILIES:
        raise ValueError(f"unknown type {name!r}; one of {sorted([*FAMILIES, *ALIASES])}")
    return FAMILIES[key]


def columns_of_type(df: DataFrame, name: str) -> list[str]:
    """Names of the columns whose type belongs to the family, in the order of the table."""
    types = family(name)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def resolve_columns(
    df: DataFrame, columns: str | list[str] | tuple[str, ...], types: str | None = None, skip_others: bool = False
) -> list[str]:
    """The columns an argument stands for.

    '*' stands for all columns of the type family. A name that isn't in the table is an error; a
    named column of another type is an error too, or is passed over with ``skip_others``.
    """
    if not isinstance(columns, (str, list, tuple)):
        raise TypeError("columns must be a name, a list of names or '*'")
    fitting = columns_of_type(df, types) if types else list(df.columns)
    if columns == "*":
        return fitting
    names = [columns] if isinstance(columns, str) else list(columns)
    unknown = [c for c in names if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    wrong = [c for c in names if c not in fitting]
    if wrong and not skip_others:
        raise ValueError(f"columns that aren't {types}: {wrong}")
    return [c for c in names if c in fitting]


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, for F.col."""
    return "`" + name.replace("`", "``") + "`"
