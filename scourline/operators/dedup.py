"""Clusters of values that mean the same, matched records, and their repair.

Values are counted before anything is compared, so work grows with the distinct values, and results
are DataFrames in long form: one row for each variant of a cluster, never an array of all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted, resolve_columns
from ..functions.similarity import LENGTH_BOUND, hamming_budget, similarity
from ..functions.text import fingerprint
from ..storage import stage

#: Distinct values of a block from which its pairs are made by several tasks.
CELL_VALUES = 1000
#: Values are joined by segments up to this length, and from this threshold: there, segments are few and not too short.
SEGMENT_LENGTH, SEGMENT_LEAST = 64, 0.75
#: Parts into which the rows of an all-pairs join are cut on each side.
PAIR_PARTS = 16


def value_counts(df: DataFrame, column: str, id_column: str) -> DataFrame:
    """(value, n, first): each distinct value that isn't null, its rows, and its smallest id."""
    resolve_columns(df, [column, id_column])
    c = F.col(quoted(column))
    return df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col(quoted(id_column))).alias("first"))


def _key(value: Column) -> Column:
    """The fingerprint of a value that isn't null, which Catalyst can tell isn't null either.

    Else a join on it would filter its nulls, at every row instead of every distinct value.
    """
    return F.coalesce(fingerprint(value), F.lit(""))


def _best(value: Column) -> Column:
    """The most frequent value, of several the one with the smallest first id."""
    return F.max_by(value, F.struct(F.col("n"), (-F.col("first")).alias("f")))


def key_collision(df: DataFrame, column: str, id_column: str) -> DataFrame:
    """Clusters of distinct values with one fingerprint: (key, value, n, canonical, canonical_n, total).

    One row for each variant; only keys with two or more distinct values are clusters. ``canonical`` is
    the most frequent variant, of several the one that comes first by id. Null values are in no cluster.
    """
    counts = value_counts(df, column, id_column).withColumn("key", _key(F.col("value")))
    groups = counts.groupBy("key").agg(
        _best(F.col("value")).alias("canonical"), F.max("n").alias("canonical_n"), F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("_variants"),
    ).where("_variants > 1")
    return counts.join(groups, "key").select("key", "value", "n", "canonical", "canonical_n", "total")


def _in_cells(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of the values of a block: equal in block, i and j for every two values of a block.

    A block of more than ``size`` values becomes a grid of cells by hashed values, so that no task gets all its pairs.
    At most one in ``size`` rows is such a block's, so their sizes are broadcast. Blocks of one hash count together.
    """
    sizes = rows.groupBy(F.xxhash64("block").alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > size)
    parts = F.coalesce(F.ceil(F.col("_n") / size), F.lit(1)).cast("int")
    cut = rows.join(F.broadcast(sizes), F.xxhash64("block") == F.col("_hash"), "left").withColumn("_parts", parts).drop("_n", "_hash")
    own, every = F.pmod(F.xxhash64("value"), F.col("_parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    return cut.withColumn("_i", own).withColumn("_j", every), cut.withColumn("_j", own).withColumn("_i", every)


def _segment(value: Column, part: Column, parts: Column, size: Column) -> Column:
    """One of the parts of nearly equal length into which the first ``size`` characters of a value are cut."""
    start = F.floor(size * part / parts).cast("int")
    return F.substring(value, start + 1, F.floor(size * (part + 1) / parts).cast("int") - start)


def _in_segments(values: DataFrame, threshold: float) -> DataFrame:
    """The values by what two of them more alike than a Hamming threshold share: (..., block, _short, _part, _cuts, _most, _side).

    Values of the lengths short <= long may differ at _most positions, of which those beyond the shorter one are some. If
    its characters are cut into one part more than may differ among them, the two are equal in a part: that, with its
    place and both lengths, is a block. _side is 1 in the longer value, 2 in the shorter one, 0 if they are of one length.
    Pairs with a value over SEGMENT_LENGTH share one of their ``blocks`` as it stands, with _part -1.
    """
    plan = []
    for long in range(1, SEGMENT_LENGTH + 1):
        most = hamming_budget(long, threshold)
        for short in range(long - most, long + 1) if most else ():  # distinct values differ somewhere
            parts = most - (long - short) + 1
            for size, side in [(long, 0)] if short == long else [(long, 1), (short, 2)]:
                plan += [(size, short, long, part, parts, most, side) for part in range(parts)]
    names = ("_size", "_short", "_long", "_part", "_cuts", "_most", "_side")
    places = values.sparkSession.createDataFrame(plan, ", ".join(f"{c} int" for c in names))
    segment = _segment(F.col("value"), F.col("_part"), F.col("_cuts"), F.col("_short"))
    cut = values.join(F.broadcast(places), F.length("value") == F.col("_size"))
    cut = cut.withColumn("block", F.concat_ws("\0", segment, "_short", "_long", "_part")).drop("_size", "_long")
    whole = values.where(F.length("value") > threshold * SEGMENT_LENGTH).select("*", F.explode("blocks").alias("block"))
    fixed = {"_short": 0, "_part": -1, "_cuts": 0, "_most": 0, "_side": 0}
    return cut.unionByName(whole.withColumns({c: F.lit(x) for c, x in fixed.items()}))


def blocked_pairs(
    df: DataFrame, column: str, id_column: str, block_size: int = 6, method: str = "levenshtein", threshold: float = 0.81
) -> DataFrame:
    """Pairs of distinct values that share a block and are more alike than the threshold.

    (value_l, value_r, similarity, canonical, canonical_n, total). The fingerprint is cut into
    consecutive blocks of ``block_size`` characters, a trailing shorter one is dropped; a fingerprint of
    at most that length is a block. Values are compared as they stand, in the first block they share
    alone, however many they share. Where the method's value is bounded by the lengths, pairs that can't reach
    the threshold are dropped within the join; blocks of very many values are joined cell by cell. With Hamming and a
    high threshold only values with a segment in common meet, of which no pair is missed. The rows of a
    pair are given by pair_rows. Runs a job that writes the values with their blocks.
    """
    measure = similarity(method)
    if block_size < 1:
        raise ValueError("block_size must be at least 1")
    counts = value_counts(df, column, id_column).withColumn("value", F.col("value").cast("string")).withColumn("_key", _key(F.col("value")))
    size = F.length("_key")
    cut = F.transform(F.sequence(F.lit(0), F.floor(size / block_size).cast("int") - 1), lambda k: F.substring(F.col("_key"), k * block_size + 1, F.lit(block_size)))
    blocks = F.array_distinct(F.when(size > block_size, cut).otherwise(F.array("_key")))
    # read three times: by both sides and for the sizes of blocks. Written before blocks are exploded, else Catalyst
    # tests that there are any, for which it takes the fingerprint of every row instead of every distinct value
    values = stage(counts.select("value", "n", "first", blocks.alias("blocks")), "similar-blocks")
    segments = method == "hamming" and threshold >= SEGMENT_LEAST
    rows = _in_segments(values, threshold) if segments else values.select("*", F.explode("blocks").alias("block"))
    left, right = _in_cells(rows, CELL_VALUES)
    if segments:
        left, right = left.where("_side <> 2"), right.where("_side <> 1").drop("_short", "_part", "_cuts", "_most", "_side")
    left = left.drop("_parts").withColumnsRenamed({c: f"{c}_l" for c in ("value", "n", "first", "blocks")})
    right = right.drop("_parts").withColumnsRenamed({c: f"{c}_r" for c in ("value", "n", "first", "blocks")})
    a, b = F.col("value_l"), F.col("value_r")
    near = a < b
    if method in LENGTH_BOUND:
        near = near & (F.least(F.length(a), F.length(b)) > threshold * F.greatest(F.length(a), F.length(b)))
    once = F.array_min(F.array_intersect("blocks_l", "blocks_r")) == F.col("block")
    if segments:
        whole = F.col("_part") < 0
        edits = F.call_function("levenshtein", a, b, F.col("_most"))  # -1 if more; never more than the positions that differ
        within = ((F.col("_side") == 1) | (a < b)) & (edits >= 0) & F.arrays_overlap("blocks_l", "blocks_r")
        near = F.when(whole, near & (F.greatest(F.length(a), F.length(b)) > SEGMENT_LENGTH)).otherwise(within)
        before = F.sequence(F.lit(0), F.col("_part") - 1)
        equal = lambda k: _segment(a, k, F.col("_cuts"), F.col("_short")) == _segment(b, k, F.col("_cuts"), F.col("_short"))
        once = F.when(whole, once).when(F.col("_part") == 0, True).otherwise(~F.exists(before, equal))
    pairs = left.join(right, ["block", "_i", "_j"]).where(near)
    if not segments:
        pairs = pairs.where(once)
    scored = pairs.withColumn("similarity", measure(a, b)).where(F.col("similarity") > threshold)
    if segments:  # few are left for what is no built-in loop
        scored = scored.where(once)
    first = (F.col("n_l") > F.col("n_r")) | ((F.col("n_l") == F.col("n_r")) & (F.col("first_l") < F.col("first_r")))
    same = (F.col("n_l") == F.col("n_r")) & (F.col("first_l") == F.col("first_r"))
    return scored.select(
        F.least(a, b).alias("value_l"), F.greatest(a, b).alias("value_r"), "similarity",
        F.when(first, a).when(same, F.greatest(a, b)).otherwise(b).alias("canonical"),
        F.greatest("n_l", "n_r").alias("canonical_n"), (F.col("n_l") + F.col("n_r")).alias("total"),
    )


def pair_rows(df: DataFrame, column: str, pairs: DataFrame, id_column: str) -> DataFrame:
    """(value_l, value_r, id): the rows that hold one of the two values of each pair."""
    members = pairs.select("value_l", "value_r", F.explode(F.array("value_l", "value_r")).alias("_value"))
    rows = df.select(F.col(quoted(column)).cast("string").alias("_value"), F.col(quoted(id_column)).alias(id_column))
    return rows.join(members, "_value").select("value_l", "value_r", id_column)


def mapping(clusters: DataFrame) -> DataFrame:
    """(value, canonical) for each variant that changes, from clusters or pairs.

    A value in several pairs takes the canonical value of the pair with the most rows, then the
    smallest canonical value.
    """
    if "value_l" in clusters.columns:
        sides = clusters.select(F.explode(F.array("value_l", "value_r")).alias("value"), "canonical", "total")
    else:
        sides = clusters.select("value", "canonical", "total")
    best = sides.where(F.col("value") != F.col("canonical")).groupBy("value").agg(F.min(F.struct((-F.col("total")).alias("t"), "canonical")).alias("b"))
    return best.select("value", F.col("b.canonical").alias("canonical"))


def resolve(df: DataFrame, column: str, clusters: DataFrame) -> DataFrame:
    """Every variant replaced by the canonical value of its cluster, in one join."""
    names = df.columns
    changes = mapping(clusters).withColumnsRenamed({"value": "_old", "canonical": "_new"})
    joined = df.join(changes, F.col(quoted(column)) == F.col("_old"), "left")
    return joined.select(*[F.coalesce("_new", F.col(quoted(c))).alias(c) if c == column else F.col(quoted(c)) for c in names])


def preview(clusters: DataFrame, num: int = -1) -> DataFrame:
    """The clusters with the most rows first, all or ``num`` of them."""
    order = [F.col("total").desc()] + [F.col(c) for c in ("key", "value", "value_l", "value_r") if c in clusters.columns]
    if num <= 0:
        return clusters.orderBy(*order)
    if "key" not in clusters.columns:
        return clusters.orderBy(*order).limit(num)
    keys = clusters.select("key", "total").distinct().orderBy(F.col("total").desc(), "key").limit(num).select("key")
    return clusters.join(keys, "key", "left_semi").orderBy(*order)


def rows_affected(clusters: DataFrame) -> DataFrame:
    """(rows): the rows in all clusters, those with the canonical value included."""
    if "key" in clusters.columns:
        clusters = clusters.groupBy("key").agg(F.max("total").alias("total"))
    return clusters.agg(F.coalesce(F.sum("total"), F.lit(0).cast("long")).alias("rows"))


def _filled(columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(quoted(c)).isNotNull()
    return out


def record_key(columns: list[str]) -> Column:
    """The fingerprints of some columns, '' for nulls; rows with a null are to be left out by _filled."""
    return F.array(*[_key(F.col(quoted(c))) for c in columns])


def record_matching(df: DataFrame, match_columns: list[str], fix_columns: list[str], id_column: str) -> DataFrame:
    """For groups of records whose match columns have equal fingerprints, what their fix columns should be.

    (key, column, canonical, canonical_n, total), values as text, one row for each column of a group
    that isn't unanimous; ``canonical`` is the most frequent value (null counts as one), of several the
    one that comes first by id. Records with a null match column are in no group.

    Equal records are counted first, so fingerprints are taken of distinct ones only.
    """
    resolve_columns(df, [*match_columns, *fix_columns, id_column])
    keys = [F.col(quoted(c)).alias(f"_k{n}") for n, c in enumerate(match_columns)]
    cells = [F.col(quoted(c)).cast("string").alias(f"_v{n}") for n, c in enumerate(fix_columns)]
    distinct = df.where(_filled(match_columns)).groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col(quoted(id_column))).alias("_id"))
    made = distinct.select(record_key([f"_k{n}" for n in range(len(keys))]).alias("key"), "_n", "_id", *[f"_v{n}" for n in range(len(cells))])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_v{n}").alias("value")) for n, c in enumerate(fix_columns)])
    long = made.select("key", "_n", "_id", F.explode(pairs).alias("x"))
    counts = long.groupBy("key", "x.column", "x.value").agg(F.sum("_n").alias("n"), F.min("_id").alias("first"))
    groups = counts.groupBy("key", "column").agg(
        _best(F.col("value")).alias("canonical"), F.max("n").alias("canonical_n"), F.sum("n").alias("total")
    )
    return groups.where(F.col("canonical_n") < F.col("total"))


def resolve_records(df: DataFrame, match_columns: list[str], fix_columns: list[str], fixes: DataFrame) -> DataFrame:
    """The fix columns of each matched group set to their canonical values, in one join."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    wide = fixes.groupBy("key").agg(
        *[
            F.max(F.when(F.col("column") == c, F.struct(F.col("canonical").cast(kinds[c]).alias("v")))).alias(f"_fix{k}")
            for k, c in enumerate(fix_columns)
        ]
    )
    key = F.when(_filled(match_columns), record_key(match_columns))
    joined = df.withColumn("_key", key).join(wide.withColumnRenamed("key", "_group"), F.col("_key") == F.col("_group"), "left")
    at = {c: k for k, c in enumerate(fix_columns)}
    return joined.select(
        *[
            F.when(F.col(f"_fix{at[c]}").isNotNull(), F.col(f"_fix{at[c]}.v")).otherwise(F.col(quoted(c))).alias(c)
            if c in at else F.col(quoted(c))
            for c in df.columns
        ]
    )


def matched_rows(df: DataFrame, match_columns: list[str], fixes: DataFrame, id_column: str) -> DataFrame:
    """(key, id) of the rows of the groups that have a fix."""
    keyed = df.where(_filled(match_columns)).select(record_key(match_columns).alias("key"), F.col(quoted(id_column)).alias(id_column))
    return keyed.join(fixes.select("key").distinct(), "key", "left_semi")


def record_variants(df: DataFrame, match_columns: list[str], fixes: DataFrame) -> DataFrame:
    """(key, column, value, n): the values of the columns of each group that have a fix, and how many rows hold them."""
    columns = [c for c in df.columns if c not in match_columns]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns])
    rows = df.where(_filled(match_columns)).select(record_key(match_columns).alias("key"), F.explode(cells).alias("x"))
    return rows.groupBy("key", "x.column", "x.value").agg(F.count(F.lit(1)).alias("n")).join(fixes.select("key", "column"), ["key", "column"], "left_semi")


def build_pairs(df: DataFrame, columns: list[str], id_column: str = "id", block: str | None = None, parts: int = PAIR_PARTS) -> DataFrame:
    """Unordered pairs of rows: the columns and the id, and those of the other row with '_' before their names.

    With ``block``, pairs of rows with an equal, not null block value; otherwise all pairs, whose number is
    the square of the rows: for small tables. All pairs are made cell by cell of a grid of hashed ids,
    an equi-join whose tasks hold a part of the rows each.
    """
    names = [*resolve_columns(df, columns), id_column]
    resolve_columns(df, id_column)
    key = [] if block is None else [F.col(quoted(block)).alias("#b")]
    rows = df.select(*key, *[F.col(quoted(c)) for c in names])
    other = rows.select(*([F.col("#b")] if key else []), *[F.col(quoted(c)).alias(f"_{c}") for c in names])
    later = F.col(quoted(id_column)) < F.col(quoted(f"_{id_column}"))
    wanted = [F.col(quoted(c)) for c in names] + [F.col(quoted(f"_{c}")) for c in names]
    if key:
        return rows.join(other, "#b").where(later).select(*wanted)
    all_parts = F.array(*[F.lit(k) for k in range(parts)])
    left = rows.withColumn("#i", F.pmod(F.xxhash64(F.col(quoted(id_column))), F.lit(parts)).cast("int")).withColumn("#j", F.explode(all_parts))
    right = other.withColumn("#j", F.pmod(F.xxhash64(F.col(quoted(f"_{id_column}"))), F.lit(parts)).cast("int")).withColumn("#i", F.explode(all_parts))
    return left.join(right, ["#i", "#j"]).where(later).select(*wanted)


class Deduplicator:
    """A DataFrame whose values and records are clustered and repaired; methods return new wrappers or DataFrames.

    Without an ``id_column`` an id is generated; it depends on the partitions of the table, so ties
    between equally frequent values are then only broken repeatably for the same layout.
    """

    def __init__(self, df: DataFrame, id_column: str | None = None) -> None:
        self._own = id_column is None
        self._id = id_column or "_row_id"
        self._df = df.withColumn(self._id, F.monotonically_increasing_id()) if self._own else df

    def _with(self, df: DataFrame) -> Deduplicator:
        out = Deduplicator(df, self._id)
        out._own = self._own
        return out

    def key_collision_clustering(self, column: str) -> DataFrame:
        return key_collision(self._df, column, self._id)

    def locality_sensitive_hashing(self, column: str, block_size: int = 6, method: str = "levenshtein", threshold: float = 0.81) -> DataFrame:
        return blocked_pairs(self._df, column, self._id, block_size, method, threshold)

    def preview(self, clusters: DataFrame, num: int = -1) -> DataFrame:
        return preview(clusters, num)

    def pair_rows(self, column: str, pairs: DataFrame) -> DataFrame:
        return pair_rows(self._df, column, pairs, self._id)

    def rows_affected(self, clusters: DataFrame) -> int:
        return rows_affected(clusters).first()[0]

    def resolve(self, column: str, clusters: DataFrame) -> Deduplicator:
        return self._with(resolve(self._df, column, clusters))

    def record_matching(self, match_columns: list[str], fix_columns: list[str]) -> DataFrame:
        return record_matching(self._df, match_columns, fix_columns, self._id)

    def preview_records(self, fixes: DataFrame, num: int = -1, match_columns: list[str] | None = None) -> DataFrame:
        """The fixes of the largest groups first; with the match columns one row for each row of a group, with its id."""
        ordered = fixes.orderBy(F.col("total").desc(), "key", "column")
        shown = ordered if num <= 0 else ordered.limit(num)
        if match_columns is None:
            return shown
        return shown.join(matched_rows(self._df, match_columns, shown, self._id), "key").orderBy(F.col("total").desc(), "key", "column", self._id)

    def record_variants(self, match_columns: list[str], fixes: DataFrame) -> DataFrame:
        return record_variants(self._df.drop(self._id), match_columns, fixes)

    def resolve_records(self, match_columns: list[str], fix_columns: list[str], fixes: DataFrame) -> Deduplicator:
        return self._with(resolve_records(self._df, match_columns, fix_columns, fixes))

    def build_pairs(self, columns: list[str], block: str | None = None) -> DataFrame:
        return build_pairs(self._df, columns, self._id, block)

    def remove_duplicates(self, columns: list[str] | None = None) -> Deduplicator:
        from .transform import remove_duplicates

        names = columns or [c for c in self._df.columns if c != self._id or not self._own]
        return self._with(remove_duplicates(self._df, names, [F.col(quoted(self._id))]))

    def show(self, n: int = 10, truncate: bool = True, with_id: bool = False) -> None:
        (self._df if with_id else self.get_dataframe()).show(n, truncate)

    def get_dataframe(self) -> DataFrame:
        return self._df.drop(self._id) if self._own else self._df
