"""Documents laid into containers of fixed capacity with little unused space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from ..storage import stage

#: Documents that are packed together: the unused space of a group's last containers is a small share.
GROUP_ITEMS = 20_000


class Tournament:
    """A tournament tree over bins: the first bin with enough room is found in log(bins) steps."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def place(self, item: int) -> int:
        """Put the item into the first bin with room for it; the bin's number."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < item:
                at += 1
        bin_ = at - self.size
        room[at] -= item
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, none larger than the capacity; bins are numbered from 0 without gaps."""
    order = np.argsort(-sizes, kind="stable")
    tree = Tournament(len(sizes), capacity)
    out = np.zeros(len(sizes), np.int64)
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        out[k] = tree.place(size)
    return out


def _pack(capacity: int):
    """Over items (group, id, size, copies) sorted by group: the pieces of each and their containers."""

    def close(group: int, ids: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((sizes, ids))  # the same containers whatever the order of arrival
        ids, sizes = ids[order], sizes[order]
        full = np.where(sizes > capacity, sizes // capacity, 0)
        rest = sizes - full * capacity
        packed = np.flatnonzero((rest > 0) | (full == 0))
        bins = first_fit_decreasing(rest[packed], capacity)
        opened = int(bins.max()) + 1 if len(bins) else 0
        # pieces that fill a container, then what is left of the document or the whole of it
        doc = np.r_[np.repeat(np.arange(len(ids)), full), packed]
        before = np.r_[0, np.cumsum(full)[:-1]] if len(full) else full
        number = np.r_[np.arange(full.sum()) - np.repeat(before, full), full[packed]]
        size = np.r_[np.full(full.sum(), capacity), rest[packed]]
        container = np.r_[opened + np.arange(full.sum()), bins]
        parts = full + np.isin(np.arange(len(ids)), packed)
        for lo in range(0, len(doc), 50_000):
            own = slice(lo, lo + 50_000)
            d = doc[own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[d]), pa.array(number[own].astype(np.int32)), pa.array(parts[d].astype(np.int32)),
                 pa.array(number[own] * capacity), pa.array(size[own]), pa.array(np.full(len(d), group)), pa.array(container[own])],
                names=["id", "part", "parts", "begin", "tokens", "group_no", "container"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sizes = None, [], []
        for batch in batches:
            g, i, s, n = (c.to_numpy() for c in batch.columns)
            g, i, s = np.repeat(g, n), np.repeat(i, n), np.repeat(s, n)
            cuts = np.flatnonzero(np.r_[False, g[1:] != g[:-1]])
            for lo, hi in zip([0, *cuts], [*cuts, len(g)], strict=True):
                if lo == hi:
                    continue
                if g[lo] != group and ids:
                    yield from close(group, np.concatenate(ids), np.concatenate(sizes))
                    ids, sizes = [], []
                group = int(g[lo])
                ids.append(i[lo:hi])
                sizes.append(s[lo:hi])
        if ids:
            yield from close(group, np.concatenate(ids), np.concatenate(sizes))

    return run


def pack(
    df: DataFrame, id_col: str, size: str | object, capacity: int = 8192, seed: int = 42, group_items: int = GROUP_ITEMS
) -> DataFrame:
    """(id, part, parts, begin, tokens, group_no, container): the pieces of each item and their containers.

    ``size`` is a column of sizes. Items are spread by a seeded hash of their ids and sizes over groups of
    about ``group_items``, each packed on its own by first-fit decreasing; a container is named by
    (group_no, container). Only an item larger than the capacity is split: into pieces that fill
    containers, and a rest that is packed like any other item. The result depends on the items and the
    parameters alone, not on the order or partitions of the table.

    Items without an id or a size are left out; an empty item is a piece of size 0; repeated ids are
    items of their own, those with equal sizes dealt evenly to the groups; an empty table gives no row. Groups
    have like sizes whatever the data.
    """
    column = F.col(size) if isinstance(size, str) else size
    items = df.select(F.col(id_col).cast("long").alias("id"), column.cast("long").alias("size")).where("id is not null and size is not null")
    counted = stage(items.groupBy("id", "size").agg(F.count(F.lit(1)).alias("n")), "packing-items")
    groups = max(1, round((counted.agg(F.sum("n")).first()[0] or 0) / group_items))
    # the k-th of equal items goes to the k-th group from the hashed one on, in rounds
    turn = F.explode(F.sequence(F.lit(0), F.least("n", F.lit(groups)).cast("int") - 1))
    dealt = counted.select("id", "size", "n", turn.alias("k"))
    group = F.pmod(F.pmod(F.xxhash64(F.lit(seed), "id", "size"), F.lit(groups)) + F.col("k"), F.lit(groups))
    copies = F.expr(f"n div {groups} + if(k < n % {groups}, 1, 0)")
    sorted_ = dealt.select(group.alias("g"), "id", "size", copies.alias("copies")).repartition("g").sortWithinPartitions("g")
    return map_in_arrow(
        sorted_, _pack(capacity), "id long, part int, parts int, begin long, tokens long, group_no long, container long"
    ).withColumnRenamed("id", id_col)


def containers(packed: DataFrame, capacity: int = 8192) -> DataFrame:
    """(group_no, container, pieces, used, unused) of each container."""
    used = packed.groupBy("group_no", "container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("used"))
    return used.withColumn("unused", F.lit(capacity) - F.col("used"))
