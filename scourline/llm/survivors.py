"""One surviving record for each group of duplicate records: by precedence, or by token-level consensus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from ..storage import stage
from .codepoints import folded_hashes, missing

#: Distinct values of a group's field from which their votes are counted by many tasks.
BLOCK_VALUES = 1024
#: Decimals of weights, so that sums don't depend on the order of the rows.
WEIGHT_DIGITS = 6

_TOKEN = re.compile(r"\w+|[^\w\s]")
#: The token of a column that a value has nothing in.
GAP = ""


def tokens(value: str) -> list[str]:
    """Words and single other characters; a value without any is one token."""
    return _TOKEN.findall(value) or [value]


def align(centre: list[str], words: list[str]) -> list[tuple[int, int]]:
    """The column (slot, place) of each word: (k, 0) is that of the centre's token k, (k, n) the n-th put in before it.

    A global alignment: equal tokens score 2, different ones in one column and gaps 1 below nothing; of equally good
    ones that which takes tokens together as far to the right as it can.
    """
    n, m = len(centre), len(words)
    score = [[-i - j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        above, row, own = score[i - 1], score[i], centre[i - 1]
        for j in range(1, m + 1):
            row[j] = max(above[j - 1] + (2 if own == words[j - 1] else -1), above[j] - 1, row[j - 1] - 1)
    at: list[int | None] = [None] * m
    i, j = n, m
    while i and j:
        if score[i][j] == score[i - 1][j - 1] + (2 if centre[i - 1] == words[j - 1] else -1):
            i, j = i - 1, j - 1
            at[j] = i
        elif score[i][j] == score[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    out, slot, put = [], 0, 0
    for place in at:
        if place is None:
            put += 1
            out.append((slot, put))
        else:
            out.append((place, 0))
            slot, put = place + 1, 0
    return out


def winners(votes: dict[tuple[int, int], dict[str, float]], total: float) -> dict[tuple[int, int], tuple[str, float]]:
    """The heaviest token of each column, gaps included, with its weight; ties go to the greatest token."""
    out = {}
    for column, own in votes.items():
        gap = round(total - sum(own.values()), WEIGHT_DIGITS)
        weight, token = max([(round(w, WEIGHT_DIGITS), t) for t, w in own.items()] + [(gap, GAP)])
        out[column] = (token, weight)
    return out


def consensus(values: list[tuple[str, float]]) -> int:
    """Index of the value closest to the consensus of the weighted values.

    The first value is the centre, to which all are aligned one after the other; once a column is there it stays. Each
    value casts its weight for its token, or for a gap, in every column, and the consensus takes the
    heaviest vote of each. The value that agrees with it in the columns of most weight is closest, the earlier one on
    a tie.
    """
    if len(values) == 1:
        return 0
    centre = tokens(values[0][0])
    rows = [dict(zip(align(centre, words), words, strict=True)) for words in (tokens(v) for v, _ in values)]
    votes: dict[tuple[int, int], dict[str, float]] = {}
    for row, (_, weight) in zip(rows, values, strict=True):
        for column, word in row.items():
            own = votes.setdefault(column, {})
            own[word] = own.get(word, 0.0) + weight
    best = winners(votes, sum(w for _, w in values))
    agreed = [round(sum(w for column, (token, w) in best.items() if row.get(column, GAP) == token), WEIGHT_DIGITS) for row in rows]
    return max(range(len(values)), key=lambda k: (agreed[k], -k))


def _present(texts: list[bool]):
    """Rows ending in values: texts that are missing become null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = batch.num_columns - len(texts)
            columns = batch.columns[:lead]
            for column, text in zip(batch.columns[lead:], texts, strict=True):
                if text:
                    coded = column.dictionary_encode()
                    words = coded.dictionary
                    kept = [None if gone else k for k, gone in enumerate(missing(words, folded_hashes(words)))]
                    column = words.take(pa.array(kept, pa.int64())).take(coded.indices)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _rows(df: DataFrame, group_col: str, id_col: str, fields: list[str], order: list[Column], weight: Column | None) -> DataFrame:
    """(g, o, w, v0, v1, ...): group, what the row is ordered by with the id last, weight, and values that are present."""
    types = dict(df.dtypes)
    texts = [types[c] == "string" for c in fields]
    present = [F.col(c) if t else F.when(F.col(c) > 0, F.col(c)) for c, t in zip(fields, texts, strict=True)]
    last = F.lit((1 << 63) - 1)
    rows = df.where(F.col(group_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(group_col).alias("g"),
        F.array(*[F.coalesce(o.cast("long"), last) for o in order], F.col(id_col).cast("long")).alias("o"),
        F.round(F.coalesce(F.lit(1.0) if weight is None else weight.cast("double"), F.lit(1.0)), WEIGHT_DIGITS).alias("w"),
        *[p.cast("string").alias(f"v{n}") for n, p in enumerate(present)],
    )
    return map_in_arrow(rows, _present(texts), f"g {types[group_col]}, o array<long>, w double, " + ", ".join(f"v{n} string" for n in range(len(fields))))


def surviving_fields(df: DataFrame, group_col: str, id_col: str, fields: list[str], order: list[Column]) -> DataFrame:
    """For each group with two or more rows: group_col, n_rows, and <field>_row_id and <field> for each field.

    Each field survives on its own, from the row where it is present that comes first in the given ``order``
    (numeric columns, lower is better, nulls last; then the smallest id). One aggregation that combines before the
    shuffle, so a group of very many rows costs one row a task.

    Texts that are null, blank or a filler are not present, nor are null or not positive numbers. A field
    without any present value gives nulls; values come back as strings. Rows without a group or id are left
    out; an empty table gives no row.
    """
    rows = _rows(df, group_col, id_col, fields, order, None)
    best = [F.min(F.when(F.col(f"v{n}").isNotNull(), F.struct("o", F.col(f"v{n}").alias("v")))).alias(f"b{n}") for n in range(len(fields))]
    found = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *best).where("n > 1")
    return found.select(
        F.col("g").alias(group_col), F.col("n").alias("n_rows"),
        *[x for n, c in enumerate(fields) for x in (F.element_at(f"b{n}.o", -1).alias(f"{c}_row_id"), F.col(f"b{n}.v").alias(c))],
    )


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, f, values: list of (weight, order, value)) to (g, f, order and value of the one closest to the consensus)."""
    for batch in batches:
        kept = []
        for own in batch.column(2).to_pylist():
            own = sorted(own, key=lambda x: (-x["w"], x["o"]))
            kept.append(own[consensus([(x["v"], x["w"]) for x in own])])
        columns = [pa.array([x["o"] for x in kept], pa.list_(pa.int64())), pa.array([x["v"] for x in kept], pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["g", "f", "o", "v"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, f, w, o, v, centre) to one row (g, f, w, o, v, slot, place, token) for each token of the value."""
    for batch in batches:
        rows, slots, places, words = [], [], [], []
        for k, (value, centre) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            own = tokens(value)
            for (slot, place), word in zip(align(tokens(centre), own), own, strict=True):
                rows.append(k)
                slots.append(slot)
                places.append(place)
                words.append(word)
        taken = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*[c.take(taken) for c in batch.columns[:5]], pa.array(slots, pa.int32()), pa.array(places, pa.int32()), pa.array(words, pa.string())],
            names=["g", "f", "w", "o", "v", "slot", "place", "token"],
        )


def _voted_apart(values: DataFrame, kind: str) -> DataFrame:
    """(g, f, o, v): what _vote gives, for groups of very many distinct values, every step spread over tasks."""
    totals = values.groupBy("g", "f").agg(
        F.round(F.sum("w"), WEIGHT_DIGITS).alias("total"), F.min(F.struct((-F.col("w")).alias("n"), "o", "v")).alias("c")
    ).select("g", "f", "total", F.col("c.v").alias("centre"))
    joined = values.join(totals.select("g", "f", "centre"), ["g", "f"]).select("g", "f", "w", "o", "v", "centre")
    cast = stage(map_in_arrow(joined, _aligned, f"g {kind}, f int, w double, o array<long>, v string, slot int, place int, token string"), "survivor-votes")
    column = ["g", "f", "slot", "place"]
    votes = cast.groupBy(*column, "token").agg(F.round(F.sum("w"), WEIGHT_DIGITS).alias("w"))
    heaviest = votes.groupBy(*column).agg(F.sum("w").alias("all"), F.max(F.struct("w", "token")).alias("top")).join(totals.select("g", "f", "total"), ["g", "f"])
    gap = F.round(F.col("total") - F.col("all"), WEIGHT_DIGITS)
    top = F.greatest(F.col("top"), F.struct(gap.alias("w"), F.lit(GAP).alias("token")))
    best = stage(heaviest.select(*column, top.alias("top")).select(*column, F.col("top.w").alias("won"), F.col("top.token").alias("winner")), "survivor-winners")
    # a value agrees with a gap wherever it has no token: all gaps less those in columns that it fills
    gaps = best.where(F.col("winner") == GAP).groupBy("g", "f").agg(F.sum("won").alias("gaps"))
    own = F.when(F.col("winner") == GAP, -F.col("won")).when(F.col("token") == F.col("winner"), F.col("won")).otherwise(0.0)
    agreed = cast.join(best, column).groupBy("g", "f", "o", "v", "w").agg(F.sum(own).alias("own")).join(gaps, ["g", "f"], "left")
    agreed = agreed.withColumn("agreed", F.round(F.col("own") + F.coalesce("gaps", F.lit(0.0)), WEIGHT_DIGITS))
    return agreed.groupBy("g", "f").agg(F.min(F.struct((-F.col("agreed")).alias("a"), (-F.col("w")).alias("n"), "o", "v")).alias("b")).select("g", "f", "b.o", "b.v")


def consensus_fields(
    df: DataFrame, group_col: str, id_col: str, fields: list[str], order: list[Column], weight: Column | None = None
) -> DataFrame:
    """For each group with two or more rows: group_col, n_rows, and <field>_row_id and <field> for each field.

    Each field survives on its own. Equal values of a group add their ``weight`` (1 where it is null or not given) and
    stand for their best row: the first in ``order`` (numeric, lower is better, nulls last), then by id.
    The heaviest value, of several that with the best row, is the centre of a progressive alignment token by token;
    every value votes with its weight in every column, and the value closest to the consensus survives (see consensus).

    What is present is told as in surviving_fields, as are rows without a group or id and empty tables. Votes are
    of distinct values, which are made before the shuffle; groups with more than BLOCK_VALUES of them have their
    votes and agreements counted by many tasks, with the same result.
    """
    kind = dict(df.dtypes)[group_col]
    counts = df.where(F.col(group_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(group_col).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.where("n > 1"), "survivor-counts")
    # only rows that have another one in their group go on
    several = df.join(counts.select(F.col("g").alias(group_col)), group_col, "left_semi")
    rows = _rows(several, group_col, id_col, fields, order, weight)
    cells = F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"v{n}").alias("v")) for n in range(len(fields))])
    long = rows.select("g", "o", "w", F.explode(cells).alias("x")).where("x.v is not null").select("g", "x.f", "x.v", "o", "w")
    values = stage(long.groupBy("g", "f", "v").agg(F.round(F.sum("w"), WEIGHT_DIGITS).alias("w"), F.min("o").alias("o")), "survivor-values")
    sizes = values.groupBy("g", "f").agg(F.count(F.lit(1)).alias("k"))
    large = stage(sizes.where(F.col("k") > BLOCK_VALUES).select("g", "f"), "survivor-large")  # one for every BLOCK_VALUES values at most
    some = not large.isEmpty()
    small = values.join(large, ["g", "f"], "left_anti") if some else values
    # at most BLOCK_VALUES values each
    held = small.groupBy("g", "f").agg(F.collect_list(F.struct("w", "o", "v")).alias("values"))
    alone = held.where(F.size("values") == 1).select("g", "f", F.col("values")[0]["o"].alias("o"), F.col("values")[0]["v"].alias("v"))
    found = alone.unionByName(map_in_arrow(held.where(F.size("values") > 1), _vote, f"g {kind}, f int, o array<long>, v string"))
    if some:
        found = found.unionByName(_voted_apart(values.join(large, ["g", "f"], "left_semi"), kind))
    cells = [F.max(F.when(F.col("f") == n, F.struct(F.element_at("o", -1).alias("i"), "v"))).alias(f"b{n}") for n in range(len(fields))]
    wide = found.groupBy("g").agg(*cells)
    return counts.join(wide, "g", "left").select(
        F.col("g").alias(group_col), F.col("n").alias("n_rows"),
        *[x for n, c in enumerate(fields) for x in (F.col(f"b{n}.i").alias(f"{c}_row_id"), F.col(f"b{n}.v").alias(c))],
    )
