"""Mergeable percentile sketches with multiplicative rank error, and medians that disagree."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from ..storage import stage

#: Groups of one task from which its sketches are handed on.
FLUSH_GROUPS = 20_000
#: Parts in which the sketches of one group are merged before the last merge.
MERGE_PARTS = 64


class RelativeCompactors:
    """Relative-rank compactors: level h holds items of weight 2**h.

    A full level sorts itself and promotes every other item of its unprotected part; the protected
    tail (the high one by default) stays, and the lower a section lies the more often it is
    compacted. The rank error of an item is therefore a share of its distance to the protected end.
    Every compaction moves the rank of an item by at most 2**h, and not at all above the highest
    item compacted, so ``error`` is a bound that always holds. Up to ``capacity(0)`` items are exact.
    """

    def __init__(self, k: int = 64, protect_high: bool = True) -> None:
        self.k, self.high, self.n = k, protect_high, 0
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.states, self.tops = [0], [-math.inf]

    def capacity(self) -> int:
        return 2 * self.k * max(3, math.ceil(math.log2(max(self.n, 1) / self.k + 1)))

    def update(self, values: np.ndarray) -> None:
        """Add finite values."""
        self.levels[0] = np.concatenate([self.levels[0], values if self.high else -values])
        self.n += len(values)
        self._compress()

    def merge(self, other: RelativeCompactors) -> None:
        for h, items in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
                self.states.append(0)
                self.tops.append(-math.inf)
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.states[h] += other.states[h]
            self.tops[h] = max(self.tops[h], other.tops[h])
        self.n += other.n
        self._compress()

    def _compress(self) -> None:
        capacity, h = self.capacity(), 0
        while h < len(self.levels):
            if len(self.levels[h]) >= capacity:
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                    self.states.append(0)
                    self.tops.append(-math.inf)
                items, state = np.sort(self.levels[h]), self.states[h]
                sections = capacity // (2 * self.k)
                compacted = min((~state & (state + 1)).bit_length(), sections)  # trailing ones and one more
                keep = capacity // 2 + (sections - compacted) * self.k
                size = (len(items) - keep) & ~1
                odd = (state * 0x9E3779B1 + h * 0x85EBCA6B >> 7) & 1
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[odd:size:2]])
                self.levels[h] = items[size:]
                self.tops[h] = max(self.tops[h], float(items[size - 1]))
                self.states[h] += 1
            h += 1

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(self.levels)
        weights = np.repeat(2 ** np.arange(len(self.levels)), [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def error(self, value: float) -> int:
        """Bound of the rank error at a value of the inner order."""
        return sum(state << h for h, (state, top) in enumerate(zip(self.states, self.tops, strict=True)) if state and value <= top)

    def bounds(self, rank: int) -> tuple[float, float]:
        """Values between which the item of this rank (0 is the smallest) lies."""
        if not self.high:
            lo, hi = self._inner(self.n - 1 - rank)
            return -hi, -lo
        return self._inner(rank)

    def _inner(self, rank: int) -> tuple[float, float]:
        values, until = self._weighted()
        top = len(values) - 1
        spread = self.error(float(values[min(np.searchsorted(until, rank, "right"), top)]))
        while True:  # the bound at the lower end may be larger than the one at the rank
            low = int(np.searchsorted(until, rank - spread, "right")) if rank >= spread else -1
            wider = self.error(float(values[max(low, 0)]))
            if wider <= spread:
                break
            spread = wider
        high = min(int(np.searchsorted(until, rank + spread, "right")), top)
        return (-math.inf if low < 0 else float(values[min(low, top)])), (
            float(values[high]) if rank + spread < self.n or not spread else math.inf
        )

    def quantile(self, q: float) -> float:
        """Value of rank q * (n - 1), rounded down; nan without values."""
        if not self.n:
            return math.nan
        values, until = self._weighted()
        rank = math.floor((q if self.high else 1 - q) * (self.n - 1) + 1e-9)
        value = float(values[min(int(np.searchsorted(until, rank, "right")), len(values) - 1)])
        return value if self.high else -value

    def median_bounds(self) -> tuple[float, float]:
        """Between these lies the mean of the two middle items; equal if it is known exactly."""
        a, b = self.bounds((self.n - 1) // 2), self.bounds(self.n // 2)
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2

    def to_bytes(self) -> bytes:
        head = struct.pack("<iBqi", self.k, self.high, self.n, len(self.levels))
        levels = [struct.pack("<qdi", s, t, len(x)) + x.astype("<f8").tobytes() for x, s, t in zip(self.levels, self.states, self.tops, strict=True)]
        return head + b"".join(levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> RelativeCompactors:
        k, high, n, count = struct.unpack_from("<iBqi", data)
        out = cls(k, bool(high))
        out.n, out.levels, out.states, out.tops, at = n, [], [], [], struct.calcsize("<iBqi")
        for _ in range(count):
            state, top, size = struct.unpack_from("<qdi", data, at)
            at += struct.calcsize("<qdi")
            out.levels.append(np.frombuffer(data, "<f8", size, at).copy())
            out.states.append(state)
            out.tops.append(top)
            at += 8 * size
        return out


def _build(k: int, protect_high: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[tuple, RelativeCompactors] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(sketches)
            for lo in range(0, len(keys), 1000):
                part = keys[lo : lo + 1000]
                columns = [pa.array([key[c] for key in part], t) for c, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([sketches[key].to_bytes() for key in part])], names=names)
            sketches.clear()

        types: list[pa.DataType] = []
        names: list[str] = []
        for batch in batches:
            types = [c.type for c in batch.columns[:-1]]
            names = [*batch.schema.names[:-1], "sketch"]
            values = batch.columns[-1].to_numpy(zero_copy_only=False).astype(np.float64)
            code = np.zeros(len(values), np.int64)
            for column in batch.columns[:-1]:
                coded = column.dictionary_encode("encode")
                code = code * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            heads = np.flatnonzero(np.r_[len(code) > 0, np.diff(code[order]) != 0]) if len(code) else []
            for lo, hi in zip(heads, [*heads[1:], len(order)], strict=True):
                key = tuple(c[int(order[lo])].as_py() for c in batch.columns[:-1])
                if key not in sketches:
                    sketches[key] = RelativeCompactors(k, protect_high)
                sketches[key].update(values[order[lo:hi]])
            if len(sketches) > FLUSH_GROUPS:
                yield from flush()
        yield from flush()

    return run


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the sketches of equal keys in a stream sorted by the keys."""
    last, merged, names, types = None, None, [], []
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = [pa.array([d[c] for d in done], t) for c, t in enumerate(types)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        names, types = batch.schema.names, [c.type for c in batch.columns]
        for *key, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if merged is not None and key == last:
                merged.merge(RelativeCompactors.from_bytes(data))
                continue
            if merged is not None:
                done.append((*last, merged.to_bytes()))
            last, merged = key, RelativeCompactors.from_bytes(data)
        if len(done) > 1000:
            yield out()
            done.clear()
    if merged is not None:
        done.append((*last, merged.to_bytes()))
    if done:
        yield out()


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch (column ``sketch``) per distinct ``keys`` from sketches of partitions, days or batches.

    The sketches of one group are first merged in parts, so that no task gets all sketches of a
    group that every partition holds.
    """
    types = {f.name: f.dataType.simpleString() for f in sketches.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", sketch binary"
    part = F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))
    parts = sketches.select(*keys, "sketch", part.alias("_part")).repartition(*keys, "_part").sortWithinPartitions(*keys)
    once = map_in_arrow(parts.select(*keys, "sketch"), _merge_sorted, schema)
    return map_in_arrow(once.repartition(*keys).sortWithinPartitions(*keys), _merge_sorted, schema)


def quantile_sketches(df: DataFrame, keys: list[str], value: str, k: int = 64, protect_high: bool = True) -> DataFrame:
    """A sketch (columns ``keys`` and ``sketch``) of the values of each group.

    Null and non-finite values are left out; null keys form groups of their own; an empty table
    gives no row. The rank error of an item is bounded by RelativeCompactors.error.
    """
    inner = [F.col(c).alias(f"k{n}") for n, c in enumerate(keys)]
    number = F.col(value).cast("double")
    rows = df.select(*inner, number.alias("value")).where("value is not null and not isnan(value) and abs(value) < double('Infinity')")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"k{n} {types[c]}" for n, c in enumerate(keys)) + ", sketch binary"
    local = map_in_arrow(rows, _build(k, protect_high), schema)
    merged = merge_sketches(local, [f"k{n}" for n in range(len(keys))])
    return merged.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keys)], "sketch")


def sketch_medians(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, median_lo, median_hi, low, high) of each sketch.

    The median lies between the first two; both of the middle items lie between ``low`` and ``high``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["median_lo", "median_hi", "low", "high"]
        for batch in batches:
            made = [RelativeCompactors.from_bytes(x) for x in batch.columns[-1].to_pylist()]
            found = [(*s.median_bounds(), s.bounds((s.n - 1) // 2)[0], s.bounds(s.n // 2)[1]) for s in made]
            columns = [pa.array([s.n for s in made], pa.int64()), *[pa.array([f[k] for f in found], pa.float64()) for k in range(4)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "n", *names])

    types = {f.name: f.dataType.simpleString() for f in sketches.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", n long, median_lo double, median_hi double, low double, high double"
    return map_in_arrow(sketches.select(*keys, "sketch"), run, schema)


def sketch_quantiles(sketches: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """(keys, n, q, value, low, high) for each sketch and each q.

    ``value`` estimates the value of rank q * (n - 1), rounded down, which lies between ``low`` and ``high``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [RelativeCompactors.from_bytes(x) for x in batch.columns[-1].to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(made)), len(qs)))
            columns = [
                pa.array(np.repeat([s.n for s in made], len(qs)), pa.int64()),
                pa.array(qs * len(made), pa.float64()),
                pa.array([s.quantile(q) for s in made for q in qs], pa.float64()),
                *[pa.array([s.bounds(math.floor(q * (s.n - 1) + 1e-9))[k] for s in made for q in qs], pa.float64()) for k in (0, 1)],
            ]
            keep = [c.take(rows) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*keep, *columns], names=[*batch.schema.names[:-1], "n", "q", "value", "low", "high"])

    types = {f.name: f.dataType.simpleString() for f in sketches.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in keys) + ", n long, q double, value double, low double, high double"
    return map_in_arrow(sketches.select(*keys, "sketch"), run, schema)


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ending in (low, high, inner rank, sketch) with the bounds of the inner rank, where these are closer."""
    for batch in batches:
        at = batch.num_columns - 4
        lows, highs, inner, sketches = (c.to_pylist() for c in batch.columns[at:])
        found = [RelativeCompactors.from_bytes(x).bounds(r) for x, r in zip(sketches, inner, strict=True)]
        columns = [
            pa.array([max(a, f[0]) for a, f in zip(lows, found, strict=True)], pa.float64()),
            pa.array([min(a, f[1]) for a, f in zip(highs, found, strict=True)], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], *columns], names=batch.schema.names[: at + 2])


def _same(left: str, right: str, count: int) -> Column:
    out = F.lit(True)
    for n in range(count):
        out = out & F.col(f"{left}{n}").eqNullSafe(F.col(f"{right}{n}"))
    return out


def exact_ranks(df: DataFrame, keys: list[str], value: str, wanted: DataFrame, k: int = 64) -> DataFrame:
    """(keys, rank, exact): the value of each wanted rank (0 is the smallest) of its group.

    ``wanted`` has (keys, rank, low, high), the bounds being infinite or values of the group with
    low <= wanted value <= high, as sketches give them. Each pass counts the values below and at the bounds, which
    settles ranks that fall on them, and sketches what lies strictly between, which bounds the others more
    closely; ever larger sketches end exact. All steps combine before they shuffle, so no task sees all values
    of a group. Null and non-finite values are disregarded; null keys are groups of their own.
    """
    inner = [f"_k{n}" for n in range(len(keys))]
    rows = df.select(*[F.col(c).alias(i) for c, i in zip(keys, inner, strict=True)], F.col(value).cast("double").alias("_v"))
    rows = rows.where("_v is not null and not isnan(_v) and abs(_v) < double('Infinity')")
    asked = [F.col(c).alias(f"_w{n}") for n, c in enumerate(keys)]
    open_ = stage(wanted.select(*asked, F.col("rank").cast("long").alias("_rank"), F.col("low").alias("_low"), F.col("high").alias("_high")).distinct(), "quantile-open")
    names = [f"_w{n}" for n in range(len(keys))]
    types = dict(open_.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", _rank long, _low double, _high double"
    done = None
    while True:
        joined = rows.join(open_, _same("_k", "_w", len(keys)))
        count = lambda x: F.sum(F.when(x, 1).otherwise(0))
        placed = joined.groupBy(*names, "_rank", "_low", "_high").agg(
            count(F.col("_v") < F.col("_low")).alias("_below"), count(F.col("_v") == F.col("_low")).alias("_at"),
            count((F.col("_v") > F.col("_low")) & (F.col("_v") < F.col("_high"))).alias("_inside"),
        )
        left = F.col("_rank") - F.col("_below") - F.col("_at")
        placed = stage(placed.withColumn("_left", left), "quantile-placed")
        settled = placed.where("_left < 0 or _left >= _inside").select(
            *names, "_rank", F.when(F.col("_left") < 0, F.col("_low")).otherwise(F.col("_high")).alias("exact")
        )
        done = settled if done is None else done.unionByName(settled)
        rest = placed.where("_left >= 0 and _left < _inside")
        if rest.isEmpty():
            break
        k *= 2
        part = rows.join(rest.select(*names, "_rank", "_low", "_high"), _same("_k", "_w", len(keys))).where("_v > _low and _v < _high")
        sketches = quantile_sketches(part, [*names, "_rank"], "_v", k)
        again = sketches.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(names)], F.col("_rank").alias("_r"), "sketch")
        both = rest.join(again, _same("_w", "_k", len(keys)) & (F.col("_rank") == F.col("_r")))
        open_ = stage(map_in_arrow(both.select(*names, "_rank", "_low", "_high", "_left", "sketch"), _narrowed, schema), "quantile-open")
    return done.select(*[F.col(i).alias(c) for c, i in zip(keys, names, strict=True)], F.col("_rank").alias("rank"), "exact")


def exact_medians(df: DataFrame, keys: list[str], value: str, windows: DataFrame) -> DataFrame:
    """(keys, median) for the groups of ``windows`` (keys, n, low, high): the mean of the two middle values."""
    n = F.col("n")
    middle = F.explode(F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2))))
    ranks = exact_ranks(df, keys, value, windows.select(*keys, middle.alias("rank"), "low", "high"))
    return ranks.groupBy(*keys).agg(F.avg("exact").alias("median"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], k: int = 64) -> DataFrame:
    """(keys, n, q, value, low, high, exact): what sketch_quantiles gives, and the exact value of that rank.

    The exact values are found from the bounds of the sketches by exact_ranks; where the bounds meet
    they need no further pass than the one that counts.
    """
    rough = stage(sketch_quantiles(quantile_sketches(df, keys, value, k), keys, qs), "quantile-rough")
    rank = F.floor(F.col("q") * (F.col("n") - 1) + 1e-9)
    ranks = exact_ranks(df, keys, value, rough.select(*keys, rank.alias("rank"), "low", "high"), k)
    ranks = ranks.select(*[F.col(c).alias(f"_w{n}") for n, c in enumerate(keys)], F.col("rank").alias("_rank"), "exact")
    numbered = rough.select("*", *[F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)], rank.alias("_r"))
    found = numbered.join(ranks, _same("_k", "_w", len(keys)) & (F.col("_r") == F.col("_rank")))
    return found.select(*keys, "n", "q", "value", "low", "high", "exact")


def disagreeing_parts(
    df: DataFrame, group: str, part: str, value: str, factor: float = 8.0, least_rows: int = 20, k: int = 64
) -> DataFrame:
    """(group, part) whose median is more than ``factor`` times the median of its group, or less than 1/factor.

    Parts with fewer than ``least_rows`` values are no case, nor are rows without a part, which count for
    their group all the same. Medians come from the sketches of the parts and, merged, of the groups; only
    where the error bounds leave a case open are the exact medians of that part and its group computed. A
    median is the mean of the two middle values.
    """
    rows = df.where(F.col(group).isNotNull()).select(
        F.col(group).alias("_group"), F.col(part).alias("_part"), F.col(value).cast("double").alias("_value")
    )
    names = {"_group": group, "_part": part}
    parts = stage(quantile_sketches(rows, ["_group", "_part"], "_value", k), "quantile-parts")
    whole = sketch_medians(merge_sketches(parts, ["_group"]), ["_group"]).withColumnsRenamed(
        {"n": "_n", "median_lo": "_lo", "median_hi": "_hi", "low": "_low", "high": "_high"}
    )
    own = sketch_medians(parts.where("_part is not null"), ["_group", "_part"]).where(F.col("n") >= least_rows)
    medians = stage(own.join(whole, "_group"), "quantile-medians")
    above = F.col("median_lo") > factor * F.col("_hi")
    below = F.col("median_hi") < F.col("_lo") / factor
    never = (F.col("median_hi") <= factor * F.col("_lo")) & (F.col("median_lo") >= F.col("_hi") / factor)
    found = medians.where(above | below).select("_group", "_part")
    open_ = medians.where(~(above | below) & ~never)
    if open_.isEmpty():
        return found.withColumnsRenamed(names)
    own = exact_medians(rows, ["_group", "_part"], "_value", open_)
    wholes = open_.select("_group", F.col("_n").alias("n"), F.col("_low").alias("low"), F.col("_high").alias("high")).distinct()
    all_ = exact_medians(rows, ["_group"], "_value", wholes).withColumnRenamed("median", "_whole")
    off = (F.col("median") > factor * F.col("_whole")) | (F.col("median") < F.col("_whole") / factor)
    return found.unionByName(own.join(all_, "_group").where(off).select("_group", "_part")).withColumnsRenamed(names)
