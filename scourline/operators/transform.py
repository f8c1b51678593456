"""Column and row cleaning: pure functions on DataFrames, and a fluent wrapper over them.

No function runs a job unless it says so, nulls pass through, and columns keep their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.columns import columns_of_type, family, quoted, resolve_columns
from ..storage import cut_lineage, stage

#: Entries of a lookup from which it becomes a join instead of an expression.
LOOKUP_EXPRESSION_SIZE = 500
#: Operators of a Cleaner after which it writes its table and cuts the lineage, if asked to.
CHECKPOINT_EVERY = 50


def _apply(df: DataFrame, names: Iterable[str], function: Callable[[Column], Column]) -> DataFrame:
    chosen = set(names)
    return df.select(*[function(F.col(quoted(c))).alias(c) if c in chosen else F.col(quoted(c)) for c in df.columns])


# ---- projections


def select(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """Columns by name, in the order given."""
    return df.select(*[F.col(quoted(c)) for c in resolve_columns(df, columns)])


def select_positions(df: DataFrame, positions: list[int]) -> DataFrame:
    """Columns by position."""
    if not isinstance(positions, (list, tuple)):
        raise TypeError("positions must be a list")
    return df.select(*[F.col(quoted(df.columns[k])) for k in positions])


def keep_columns(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """The named columns in the order of the table."""
    names = set(resolve_columns(df, columns))
    return df.select(*[F.col(quoted(c)) for c in df.columns if c in names])


def drop_columns(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """All but the named columns; an unknown name is an error."""
    names = set(resolve_columns(df, columns))
    return df.select(*[F.col(quoted(c)) for c in df.columns if c not in names])


def rename_columns(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Columns renamed from old to new."""
    if not isinstance(pairs, (list, tuple)) or not all(isinstance(p, (list, tuple)) and len(p) == 2 for p in pairs):
        raise TypeError("pairs must be a list of (old, new)")
    resolve_columns(df, [old for old, _ in pairs])
    return df.withColumnsRenamed(dict(pairs))


def move_column(df: DataFrame, column: str, ref_column: str, position: str) -> DataFrame:
    """A column put just 'after' or 'before' another one."""
    if position not in ("after", "before"):
        raise ValueError("position must be 'after' or 'before'")
    resolve_columns(df, [column, ref_column])
    rest = [c for c in df.columns if c != column]
    if column != ref_column:
        rest.insert(rest.index(ref_column) + (position == "after"), column)
        return df.select(*[F.col(quoted(c)) for c in rest])
    return df


_CASTS = {"string": "string", "integer": "int", "float": "float", "double": "double"}


def cast_columns(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Columns cast to string, integer, float or double; values that don't fit become null."""
    targets = {}
    for name, kind in pairs:
        family(kind)
        key = {"str": "string", "String": "string", "int": "integer", "Double": "double"}.get(kind, kind)
        if key not in _CASTS:
            raise ValueError(f"cannot cast to {kind!r}")
        targets[name] = _CASTS[key]
    resolve_columns(df, list(targets))
    return df.select(*[F.col(quoted(c)).try_cast(targets[c]).alias(c) if c in targets else F.col(quoted(c)) for c in df.columns])


def set_columns(df: DataFrame, columns: str | list[str], function: Callable, data_type: str, python: bool = False) -> DataFrame:
    """A function applied to columns of a type.

    ``function`` maps a Column to a Column. With ``python`` it maps Python values, none of them null, in Arrow batches,
    which is slower.
    """
    names = resolve_columns(df, columns, data_type)
    if python:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        apply = lambda kind: F.udf(lambda v: None if v is None else function(v), kind, useArrow=True)
        built = {c: apply(kinds[c])(F.col(quoted(c))) for c in names}
    else:
        built = {c: function(F.col(quoted(c))) for c in names}
        if any(not isinstance(x, Column) for x in built.values()):
            raise TypeError("function must return a Column; for one of Python values say python=True")
    return df.select(*[built[c].alias(c) if c in built else F.col(quoted(c)) for c in df.columns])


def split_column(df: DataFrame, column: str, names: list[str], mark: str) -> DataFrame:
    """A text column split at a literal mark into one column for each name, in its place.

    Parts beyond the names are dropped, missing ones are null.
    """
    resolve_columns(df, column, "string")
    if not isinstance(names, (list, tuple)) or not names:
        raise TypeError("names must be a list of strings")
    if not mark:
        raise ValueError("mark must not be empty")
    parts = F.split(F.col(quoted(column)), "\\Q" + mark.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    out: list[Column] = []
    for c in df.columns:
        out += [F.get(parts, k).alias(n) for k, n in enumerate(names)] if c == column else [F.col(quoted(c))]
    return df.select(*out)


def add_primary_key(df: DataFrame, name: str = "id", function: Callable[[], Column] = F.monotonically_increasing_id) -> DataFrame:
    """An id column from a function; the default gives unique ids that depend on the partitions."""
    return df.withColumn(name, function())


def add_ordered_key(df: DataFrame, order: list[str | Column], name: str = "id") -> DataFrame:
    """Ids 0, 1, 2, ... in the given order, with ties in the order of arrival.

    Rows are range-partitioned, sorted and written to the shared folder with their partition and
    place, then numbered by the sizes of the partitions before them, so that no task gets all rows
    and a repeated task can't change the numbers. Runs jobs to write and to count the partitions.
    """
    at = F.monotonically_increasing_id()
    part, place = F.shiftright(at, 33), at.bitwiseAND((1 << 33) - 1)
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stage(ordered.select("*", part.cast("long").alias("#part"), place.alias("#place")), "ordered-key")
    counts = ordered.groupBy("#part").count().orderBy("#part").collect()  # one row a partition
    before, seen = [], 0
    for r in counts:
        before.append((r["#part"], seen))
        seen += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "`#part` long, `#before` long")
    keyed = ordered.join(F.broadcast(offsets), "#part")
    return keyed.select(*[F.col(quoted(c)) for c in df.columns], (F.col("#place") + F.col("#before")).alias(name))


def add_count(df: DataFrame, name: str = "counts", initial: int = 0) -> DataFrame:
    """A constant column."""
    return df.withColumn(name, F.lit(initial))


def sql(df: DataFrame, statement: str) -> DataFrame:
    """A SQL statement over the table, written __THIS__ in it."""
    if not isinstance(statement, str):
        raise TypeError("statement must be a string")
    escaped = statement.replace("{", "{{").replace("}", "}}").replace("__THIS__", "{this}")
    return df.sparkSession.sql(escaped, this=df)


# ---- filters and null handling


def filter_rows(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which the condition is true."""
    return df.filter(condition)


def filter_by_type(df: DataFrame, column: str, type_to_delete: str) -> DataFrame:
    """Rows but those whose value reads as 'integer', 'float', 'string' or 'null'."""
    if type_to_delete not in ("integer", "float", "string", "null"):
        raise ValueError("type_to_delete must be integer, float, string or null")
    resolve_columns(df, column)
    return df.filter(X.value_type(F.col(quoted(column))) != type_to_delete)


def remove_empty_rows(df: DataFrame, how: str = "all") -> DataFrame:
    """Rows but those with 'any' or 'all' values null (or not a number)."""
    if how not in ("any", "all"):
        raise ValueError("how must be 'any' or 'all'")
    return df.dropna(how)


def replace_nulls(df: DataFrame, value: Any, columns: str | list[str] | None = None) -> DataFrame:
    """Nulls filled with a value, or by a dictionary of column to value; columns of another type stay."""
    if not isinstance(value, (int, float, str, dict)):
        raise TypeError("value must be a number, a string or a dictionary")
    names = None if columns in (None, "*") else resolve_columns(df, columns)
    return df.fillna(value, subset=names)


def impute(df: DataFrame, columns: list[str], out_columns: list[str], strategy: str, accuracy: int = 1_000_000) -> DataFrame:
    """New columns with nulls and NaN replaced by the mean or median of the column. Runs one job.

    The median is the lower one and exact up to about ``accuracy`` distinct values.
    """
    if strategy not in ("mean", "median"):
        raise ValueError("strategy must be 'mean' or 'median'")
    if not isinstance(columns, (list, tuple)) or not isinstance(out_columns, (list, tuple)) or len(columns) != len(out_columns):
        raise TypeError("columns and out_columns must be lists of one length")
    resolve_columns(df, columns, "numeric")
    known = {c: _known(df, c) for c in columns}
    centre = {
        c: F.avg(x) if strategy == "mean" else F.percentile_approx(x, 0.5, accuracy).cast("double") for c, x in known.items()
    }
    found = df.agg(*[x.alias(f"c{k}") for k, x in enumerate(centre.values())]).first()
    return df.select(
        "*", *[F.coalesce(known[c].cast("double"), F.lit(found[k])).alias(o) for k, (c, o) in enumerate(zip(columns, out_columns, strict=True))]
    )


def _known(df: DataFrame, column: str) -> Column:
    c = F.col(quoted(column))
    return F.when(~F.isnan(c), c) if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)) else c


def empty_to_text(df: DataFrame, columns: str | list[str], custom: str) -> DataFrame:
    """Empty texts and nulls replaced by a text; columns of another type stay."""
    if not isinstance(custom, str):
        raise TypeError("custom must be a string")
    return _apply(df, resolve_columns(df, columns, "string", skip_others=True), lambda c: F.when(c != "", c).otherwise(custom))


def replace_value(df: DataFrame, search: Any, change_to: Any, columns: str | list[str]) -> DataFrame:
    """One value replaced by another of its type in columns of that type."""
    if type(search) is not type(change_to) or not isinstance(search, (str, int, float)):
        raise TypeError("search and change_to must both be texts, integers or floats")
    if isinstance(search, str):
        names = resolve_columns(df, columns, "string")
    elif isinstance(search, int):
        names = resolve_columns(df, columns, "integer")
    else:
        real = {*columns_of_type(df, "float"), *columns_of_type(df, "double")}
        names = [c for c in df.columns if c in real] if columns == "*" else resolve_columns(df, columns)
        if wrong := [c for c in names if c not in real]:
            raise ValueError(f"columns that aren't float or double: {wrong}")
    return _apply(df, names, lambda c: F.when(c == F.lit(search), F.lit(change_to)).otherwise(c)) if names else df


def lookup(df: DataFrame, column: str, target: str | dict[str, list[str]], values: list[str] | None = None) -> DataFrame:
    """Values replaced by ``target``; or by a dictionary of target to the values it replaces.

    Targets of a dictionary are tried in order on what the one before made of a value, so chains
    are followed in that order.
    """
    resolve_columns(df, column, "string")
    if isinstance(target, dict):
        if not target or values is not None:
            raise ValueError("a dictionary must not be empty and goes without values")
        mapping: dict[str, str] = {}
        for name, olds in target.items():
            for old, now in mapping.items():
                if now in olds:
                    mapping[old] = name
            for old in olds:
                mapping.setdefault(old, name)
    else:
        if not values:
            raise ValueError("values must be a list that isn't empty")
        mapping = {old: target for old in values}
    changed = {old: new for old, new in mapping.items() if old != new}
    if not changed:
        return df
    if len(changed) <= LOOKUP_EXPRESSION_SIZE:
        table = F.create_map(*[F.lit(x) for pair in changed.items() for x in pair])
        return _apply(df, [column], lambda c: F.coalesce(F.try_element_at(table, c), c))
    pairs = df.sparkSession.createDataFrame(list(changed.items()), "_old string, _new string")
    joined = df.join(pairs, F.col(quoted(column)) == F.col("_old"), "left")
    return joined.select(*[F.coalesce("_new", F.col(quoted(c))).alias(c) if c == column else F.col(quoted(c)) for c in df.columns])


def replace_by_id(df: DataFrame, value: Any, column: str, ids: list | DataFrame, id_column: str = "id") -> DataFrame:
    """A column set to a value in the rows with the given ids, a list or a DataFrame of one column."""
    resolve_columns(df, [column, id_column])
    kind = df.schema[column].dataType
    if isinstance(ids, DataFrame) or len(ids) > LOOKUP_EXPRESSION_SIZE:
        if not isinstance(ids, DataFrame):
            ids = df.sparkSession.createDataFrame([(x,) for x in ids], T.StructType([T.StructField("_id", df.schema[id_column].dataType)]))
        marks = ids.toDF("_id").distinct().withColumn("_hit", F.lit(True))
        hit, df_ = F.col("_hit").isNotNull(), df.join(marks, F.col(quoted(id_column)) == F.col("_id"), "left")
    else:
        hit, df_ = F.col(quoted(id_column)).isin(list(ids)), df
    return df_.select(
        *[F.when(hit, F.lit(value).cast(kind)).otherwise(F.col(quoted(c))).alias(c) if c == column else F.col(quoted(c)) for c in df.columns]
    )


def replace_in_groups(df: DataFrame, fixes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Within rows that match a fix on ``keys``, each of ``columns`` that equals bad_<column> becomes good_<column>.

    ``fixes`` has one row for each key. Replacement is by column, so new combinations may arise.
    """
    joined = df.join(fixes.withColumn("_fix", F.lit(True)), keys, "left")
    return joined.select(
        *[
            F.when(F.col("_fix").isNotNull() & F.col(quoted(c)).eqNullSafe(F.col(quoted(f"bad_{c}"))), F.col(quoted(f"good_{c}")))
            .otherwise(F.col(quoted(c))).alias(c)
            if c in columns else F.col(quoted(c))
            for c in df.columns
        ]
    )


def replace_sub_table(df: DataFrame, bad: DataFrame, good: DataFrame, keys: list[str]) -> DataFrame:
    """Within the rows whose keys are those of ``bad``, values of its first row become those of the first row of ``good``.

    Both have one schema; their first rows are the smallest by all columns. Replacement is by column; other rows stay.
    Where ``bad`` holds several keys, each takes its own first rows, and a key without a good row stays as it is.
    """
    if bad.columns != good.columns:
        raise ValueError("both tables must have the same columns")
    resolve_columns(bad, keys)
    columns = [c for c in bad.columns if c not in keys]
    if not columns:
        return df
    first = lambda t, name: t.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.min(F.struct(*[F.col(quoted(c)) for c in columns])).alias(name))
    fixes = first(bad, "#bad").join(first(good, "#good"), list(keys))
    wide = [F.col(f"#{side}.{quoted(c)}").alias(f"{side}_{c}") for side in ("bad", "good") for c in columns]
    return replace_in_groups(df, fixes.select(*[F.col(quoted(k)) for k in keys], *wide), list(keys), columns)


# ---- texts and dates


def lower_case(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return _apply(df, resolve_columns(df, columns, "string"), F.lower)


def upper_case(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return _apply(df, resolve_columns(df, columns, "string"), F.upper)


def trim(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """Without spaces at both ends; other white space stays, as do columns of another type."""
    return _apply(df, resolve_columns(df, columns, "string", skip_others=True), F.trim)


def clear_accents(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return _apply(df, resolve_columns(df, columns, "string"), X.clear_accents)


def remove_special_chars(df: DataFrame, columns: str | list[str]) -> DataFrame:
    return _apply(df, resolve_columns(df, columns, "string"), X.remove_punctuation)


def remove_special_chars_regex(df: DataFrame, columns: str | list[str], regex: str) -> DataFrame:
    return _apply(df, resolve_columns(df, columns, "string"), lambda c: X.remove_regex(c, regex))


def transform_dates(df: DataFrame, columns: str | list[str], current_format: str, output_format: str) -> DataFrame:
    return _apply(df, resolve_columns(df, columns, "string"), lambda c: X.reformat_date(c, current_format, output_format))


def calculate_age(df: DataFrame, column: str, dates_format: str, name: str, as_of: str | None = None) -> DataFrame:
    """A column of years since a date text, as text with four decimals; ``as_of`` is an ISO date, today if not given."""
    resolve_columns(df, column, "string")
    return df.withColumn(name, X.age_in_years(F.col(quoted(column)), dates_format, None if as_of is None else F.lit(as_of).cast("date")))


# ---- rows


def count_items(df: DataFrame, id_column: str, search_column: str, name: str, search: str) -> DataFrame:
    """For each id the number of its rows whose column equals a text; ids without such a row are absent."""
    resolve_columns(df, id_column)
    resolve_columns(df, search_column)
    hit = F.col(quoted(search_column)) == search
    return df.filter(hit & F.col(quoted(id_column)).isNotNull()).groupBy(id_column).agg(F.count(F.lit(1)).alias(name)).orderBy(id_column)


def remove_duplicates(df: DataFrame, columns: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """One row for each combination of the columns (all if not given): any, or the first in ``order``."""
    if columns is not None and not isinstance(columns, (list, tuple)):
        raise TypeError("columns must be a list")
    if order is None:
        return df.dropDuplicates(list(columns) if columns else None)
    keys = list(columns or df.columns)
    resolve_columns(df, keys)
    # min_by is combined before the shuffle, so that a key of very many rows costs one row a task
    kept = df.groupBy(*[F.col(quoted(c)).alias(f"_k{k}") for k, c in enumerate(keys)]).agg(
        F.min_by(F.struct(*[F.col(quoted(c)) for c in df.columns]), F.struct(*order)).alias("_row")
    )
    return kept.select(*[F.col(f"_row.{quoted(c)}").alias(c) for c in df.columns])


class Cleaner:
    """A DataFrame with the operators as chainable methods; every method returns a new wrapper.

    With ``checkpoint_every`` the table is written into the checkpoint folder after so many operators, so that plans of very
    long chains stay small; CHECKPOINT_EVERY is a usual number. The default is never, as chains of expressions
    become one projection.
    """

    def __init__(self, df: DataFrame, checkpoint_every: int | None = None, applied: int = 0) -> None:
        if not isinstance(df, DataFrame):
            raise TypeError("df must be a DataFrame")
        self._df, self._every, self._applied = df, checkpoint_every, applied

    def _then(self, function: Callable, *args: Any, **kwargs: Any) -> Cleaner:
        df, applied = function(self._df, *args, **kwargs), self._applied + 1
        if self._every is not None and applied > self._every:
            df, applied = cut_lineage(df), 0
        return Cleaner(df, self._every, applied)

    @property
    def df(self) -> DataFrame:
        return self._df

    def get_dataframe(self) -> DataFrame:
        return self._df

    def set_data_frame(self, df: DataFrame) -> Cleaner:
        return Cleaner(df, self._every)

    def show(self, n: int = 10, truncate: bool = True) -> None:
        self._df.show(n, truncate)

    def collect(self) -> list:
        return self._df.collect()

    def check_point(self) -> Cleaner:
        """Write the table into the checkpoint folder and cut its lineage. Runs a job."""
        return Cleaner(cut_lineage(self._df), self._every)

    execute = check_point

    def string_to_index(self, input_cols: str | list[str]) -> Cleaner:
        from .features import string_to_index

        return self._then(string_to_index, input_cols)

    def index_to_string(self, input_cols: str | list[str]) -> Cleaner:
        from .features import index_to_string

        return self._then(index_to_string, input_cols)

    def one_hot_encoder(self, input_cols: str | list[str]) -> Cleaner:
        from .features import one_hot_encoder

        return self._then(one_hot_encoder, input_cols)

    def vector_assembler(self, input_cols: str | list[str]) -> Cleaner:
        from .features import vector_assembler

        return self._then(vector_assembler, input_cols)

    def normalizer(self, input_cols: str | list[str], p: float = 2.0) -> Cleaner:
        from .features import normalizer

        return self._then(normalizer, input_cols, p)

    def scale_vec_col(self, columns: str | list[str], name_output_col: str) -> Cleaner:
        from .features import scale_vec_col

        return self._then(scale_vec_col, columns, name_output_col)

    def to_csv(self, path_name: str, header: str | bool = "true", mode: str = "overwrite", sep: str = ",", **options: Any) -> None:
        from ..sources.io import write_csv

        write_csv(self._df, path_name, header, mode, sep, **options)

    def write_df_as_json(self, path: str) -> None:
        from ..sources.io import write_json_array

        write_json_array(self._df, path)


def _method(function: Callable) -> Callable:
    def call(self: Cleaner, *args: Any, **kwargs: Any) -> Cleaner:
        return self._then(function, *args, **kwargs)

    call.__doc__ = function.__doc__
    call.__name__ = function.__name__
    return call


for _name, _function in {
    "select": select, "select_idx": select_positions, "iloc": select_positions, "keep_col": keep_columns,
    "drop_col": drop_columns, "rename_col": rename_columns, "move_col": move_column, "cast_func": cast_columns,
    "set_col": set_columns, "split_str_col": split_column, "addPrimaryKey": add_primary_key,
    "add_ordered_key": add_ordered_key, "addCount": add_count, "sql": sql, "filter_rows": filter_rows,
    "delete_row": filter_rows, "row_filter_by_type": filter_by_type, "remove_empty_rows": remove_empty_rows,
    "replace_na": replace_nulls, "impute_missing": impute, "empty_str_to_str": empty_to_text,
    "replace_col": replace_value, "lookup": lookup, "replace_by_id": replace_by_id, "replace_sub_df": replace_sub_table, "replace_in_groups": replace_in_groups,
    "lower_case": lower_case, "upper_case": upper_case, "trim_col": trim, "clear_accents": clear_accents,
    "remove_special_chars": remove_special_chars, "remove_special_chars_regex": remove_special_chars_regex,
    "date_transform": transform_dates, "age_calculate": calculate_age, "remove_duplicates": remove_duplicates,
}.items():
    setattr(Cleaner, _name, _method(_function))


def _count_items(self: Cleaner, *args: Any, **kwargs: Any) -> DataFrame:
    """As count_items; returns a DataFrame, not a wrapper."""
    return count_items(self._df, *args, **kwargs)


Cleaner.count_items = _count_items
