"""Records that are equal but for white space, letter case, punctuation or the order of two fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from ..storage import stage
from .codepoints import folded_hashes, missing, mix, same_but_layout

#: Members of one group in one Arrow batch from which they are kept apart from the merge.
INLINE_MEMBERS = 32
#: Members of one group in one Arrow batch from which the task keeps the group open for later batches; and
#: members and groups that a task keeps open at once.
OPEN_FROM, OPEN_MEMBERS, OPEN_GROUPS = 8, 1_000_000, 10_000

_LOCAL = "key long, local_first long, exact string, texts array<string>, n int, members array<long>"
_MERGED = "first long, group long, head boolean, n int, members array<long>"


def _same(a: tuple, b: tuple, any_order: bool) -> bool:
    """Whether two records (exact part, texts) are equal but for their layout."""
    if a[0] != b[0]:
        return False
    if not any_order:
        return all(map(same_but_layout, a[1], b[1]))
    rest = list(b[1])
    for x in a[1]:
        for k, y in enumerate(rest):
            if same_but_layout(x, y):
                del rest[k]
                break
        else:
            return False
    return True


class _OpenGroups:
    """Groups of a task that had many members in a batch, kept so that each reaches the merge once, not once a batch."""

    def __init__(self, any_order: bool) -> None:
        self.any_order, self.held = any_order, 0
        self.groups: dict[int, list[list]] = {}  # by key: [record, arrays of ids]

    def add(self, key: int, row: tuple, ids: np.ndarray, start: bool) -> bool:
        """Whether the group of this record is open and took its ids; ``start`` opens one."""
        for group in self.groups.get(key, []):
            if _same(group[0], row, self.any_order):
                group[1].append(ids)
                self.held += len(ids)
                return True
        if start:
            self.groups.setdefault(key, []).append([row, [ids]])
            self.held += len(ids)
        return start

    def full(self) -> bool:
        return self.held > OPEN_MEMBERS or len(self.groups) > OPEN_GROUPS

    def close(self) -> Iterator[tuple]:
        for key, own in self.groups.items():
            for (exact, texts), ids in own:
                members = np.sort(np.concatenate(ids))
                yield key, int(members[0]), exact, texts, len(members), members.tolist()
        self.groups, self.held = {}, 0


def _local_groups(any_order: bool):
    """Per task: hash the records, verify equal hashes, one row for each local group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("key", pa.int64()), ("local_first", pa.int64()), ("exact", pa.string()), ("texts", pa.list_(pa.string())),
            ("n", pa.int32()), ("members", pa.list_(pa.int64())),
        ])
        open_ = _OpenGroups(any_order)

        def closed() -> Iterator[pa.RecordBatch]:
            rows = list(open_.close())
            for lo in range(0, len(rows), 1000):
                part = rows[lo : lo + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            texts = batch.columns[2:]
            hashes = [folded_hashes(t) for t in texts]
            gone = np.any([missing(t, h) for t, h in zip(texts, hashes, strict=True)], axis=0)
            parts = np.sort(hashes, axis=0) if any_order else np.array(hashes)
            key = folded_hashes(batch.column(1))
            for part in parts:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
            at = np.flatnonzero(~gone)
            if not len(at):
                continue
            ids = batch.column(0).to_numpy()[at]
            key = key[at].view(np.int64)
            order = np.lexsort((ids, key))
            at, ids, key = at[order], ids[order], key[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[heads, len(key)])
            kept, first, members = np.ones(len(heads), bool), list(heads), [None] * len(heads)
            waiting = np.isin(key[heads], np.fromiter(open_.groups, np.int64, len(open_.groups))) if open_.groups else np.zeros(len(heads), bool)
            for g in np.flatnonzero((sizes > 1) | waiting).tolist():
                lo, hi = heads[g], heads[g] + sizes[g]
                rows = [(batch.column(1)[i].as_py(), [t[i].as_py() for t in texts]) for i in at[lo:hi].tolist()]
                classes: list[list[int]] = []
                for k, row in enumerate(rows):
                    for c in classes:
                        if _same(rows[c[0]], row, any_order):
                            c.append(k)
                            break
                    else:
                        classes.append([k])
                left = [c for c in classes if not open_.add(int(key[lo]), rows[c[0]], ids[lo + np.array(c)], len(c) >= OPEN_FROM)]
                kept[g] = bool(left)
                if left:
                    first[g] = lo + left[0][0]
                    members[g] = [int(ids[lo + k]) for k in left[0]]
                for c in left[1:]:  # records that only share the hash
                    first.append(lo + c[0])
                    members.append([int(ids[lo + k]) for k in c])
            kept = np.r_[kept, np.ones(len(first) - len(kept), bool)]
            first = np.array(first)[kept]
            members = [m for m, k in zip(members, kept.tolist(), strict=True) if k]
            rows = pa.array(at[first])
            columns = [t.take(rows) for t in texts]
            width = len(columns)
            flat = pa.concat_arrays(columns).take(pa.array(np.arange(len(first) * width).reshape(width, -1).T.ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[first]), pa.array(ids[first]), batch.column(1).take(rows),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * width), flat),
                    pa.array([1 if m is None else len(m) for m in members], pa.int32()),
                    pa.array([None if m is None or len(m) == 1 else m for m in members], pa.list_(pa.int64())),
                ],
                schema=schema,
            )
            if open_.full():
                yield from closed()
        yield from closed()

    return run


def _merge(any_order: bool):
    """Over local groups sorted by (key, local_first): which of them are one group, and which is its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("first", pa.int64()), ("group", pa.int64()), ("head", pa.bool_()), ("n", pa.int32()), ("members", pa.list_(pa.int64()))])
        last, classes = None, []
        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            same = key[1:] == key[:-1]
            busy = (n > 1) | np.r_[False, same] | np.r_[same, False]
            if len(key) and last is not None:
                busy[0] |= key[0] == last
            if len(key):
                busy[-1] = True  # its group may go on in the next batch
            out = []
            for i in np.flatnonzero(busy).tolist():
                if key[i] != last:
                    last, classes = key[i], []
                row = (batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                local = batch.column(1)[i].as_py()
                first = next((c[2] for c in classes if _same(c, row, any_order)), None)
                head = first is None
                if head:
                    first = local
                    classes.append((*row, local))
                    if n[i] == 1:
                        continue
                out.append((first, batch.column(6)[i].as_py(), head, int(n[i]), batch.column(5)[i].as_py() or [local]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def layout_duplicates(
    df: DataFrame, id_col: str, text_cols: list[str], exact_cols: list[str] | None = None, any_order: bool = True
) -> DataFrame:
    """One row (first_row_id, copy_row_id) for each further row of a set of records that say the same.

    Records say the same if the exact columns are equal and the texts are equal once white space,
    letter case and punctuation are disregarded, with ``any_order`` whichever column holds which text.
    The first row of a set is the one with the smallest id.

    Rows with a missing text (null, blank, filler), a null exact column or a null id take no part. A
    repeated id counts as a further row. Other columns are ignored whatever their names; an empty
    table gives an empty result; texts of any length are hashed whole.

    Each task first collapses its own copies: those of one Arrow batch, and for sets with OPEN_FROM or more in a
    batch those of all its batches, so that a set that holds a third of all rows reaches the merge as one row for
    every task or OPEN_MEMBERS copies. Members of large local groups stay out of the merge and are joined to its
    result on the unique id of their local group.
    """
    exact = [F.col(c) for c in exact_cols or []]
    rows = df.where(F.col(id_col).isNotNull())
    for c in exact:
        rows = rows.where(c.isNotNull())
    rows = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.concat_ws("\u0001", F.lit(""), *[c.cast("string") for c in exact]).alias("exact"),
        *[F.col(c).cast("string").alias(f"text{k}") for k, c in enumerate(text_cols)],
    )
    local = map_in_arrow(rows, _local_groups(any_order), _LOCAL).withColumn("group", F.monotonically_increasing_id())
    local = stage(local, "layout-local")
    inline = F.when(F.col("n") <= INLINE_MEMBERS, F.col("members"))
    by_key = (
        local.select("key", "local_first", "exact", "texts", "n", inline.alias("members"), "group")
        .repartition("key")
        .sortWithinPartitions("key", "local_first")
    )
    merged = stage(map_in_arrow(by_key, _merge(any_order), _MERGED), "layout-merged")
    small = merged.where(F.col("n") <= INLINE_MEMBERS).select("first", "head", "members")
    large = (
        local.where(F.col("n") > INLINE_MEMBERS)
        .select("group", "members")
        .join(merged.where(F.col("n") > INLINE_MEMBERS).select("first", "group", "head"), "group")
        .select("first", "head", "members")
    )
    # members are sorted; in the set's own first group the first of them is the set's first row
    own = F.when(F.col("head"), F.expr("slice(members, 2, size(members))")).otherwise(F.col("members"))
    return small.unionByName(large).select(
        F.col("first").alias("first_row_id"), F.explode(own).alias("copy_row_id")
    )


def layout_records(
    df: DataFrame, id_col: str, text_cols: list[str], exact_cols: list[str] | None = None, any_order: bool = True
) -> DataFrame:
    """One row for each record (id of its first row, texts and exact columns of that row, n_rows it stands for).

    Rows that take no part in layout_duplicates are records of their own. Ids are taken to be unique.
    """
    copies = layout_duplicates(df, id_col, text_cols, exact_cols, any_order)
    counts = copies.groupBy("first_row_id").agg((F.count(F.lit(1)) + 1).alias("n_rows"))
    kept = [id_col, *text_cols, *(exact_cols or [])]
    return (
        df.select(*kept)
        .join(copies.select(F.col("copy_row_id").alias("_copy")), F.col(id_col) == F.col("_copy"), "left_anti")
        .join(counts.withColumnRenamed("first_row_id", "_first"), F.col(id_col) == F.col("_first"), "left")
        .select(*kept, F.coalesce("n_rows", F.lit(1).cast("long")).alias("n_rows"))
    )
