"""Occurrences of every distinct term, the records that hold it, and marks for useless terms."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow

#: Between terms: ASCII white space and the 32 ASCII punctuation characters.
SEPARATORS = r"[\t-\r !-/:-@\[-`{-~]+"

#: Distinct terms of one task from which its counters are handed on.
FLUSH_TERMS = 500_000


def last_seen(codes: np.ndarray, records: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and records of each of n terms, from tokens in the order of their records.

    A token opens a new record of its term exactly if the term was last seen in another record; a
    stable sort by term puts each token behind the one where its term was last seen.
    """
    occurrences = np.bincount(codes, minlength=n)
    order = np.argsort(codes, kind="stable")
    c, r = codes[order], records[order]
    new = np.r_[True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])] if len(c) else np.zeros(0, bool)
    return occurrences, np.bincount(c[new], minlength=n)


def _counters(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: list[dict[str, list[int]]] = [{} for _ in fields]

        def flush() -> Iterator[pa.RecordBatch]:
            for k, own in enumerate(counters):
                names, counts = list(own), list(own.values())
                for lo in range(0, len(names), 50_000):
                    part = counts[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([fields[k]] * len(part)), pa.array(names[lo : lo + 50_000], pa.string()),
                         pa.array([c[0] for c in part], pa.int64()), pa.array([c[1] for c in part], pa.int64())],
                        names=["field_name", "term", "occurrences", "records"],
                    )
                own.clear()

        for batch in batches:
            for k, values in enumerate(batch.columns):
                pieces = pc.split_pattern_regex(values, SEPARATORS)
                records = pc.list_parent_indices(pieces)
                terms = pc.list_flatten(pieces)
                filled = pc.not_equal(terms, "")
                terms, records = terms.filter(filled).dictionary_encode(), records.filter(filled).to_numpy()
                lowered: dict[str, int] = {}
                code = np.array([lowered.setdefault(t.lower(), len(lowered)) for t in terms.dictionary.to_pylist()], np.int64)
                if not len(code):
                    continue
                occurrences, seen = last_seen(code[terms.indices.to_numpy()], records, len(lowered))
                own = counters[k]
                for term, o, r in zip(lowered, occurrences.tolist(), seen.tolist(), strict=True):
                    c = own.get(term)
                    if c is None:
                        own[term] = [o, r]
                    else:
                        c[0] += o
                        c[1] += r
            if sum(map(len, counters)) > FLUSH_TERMS:
                yield from flush()
        yield from flush()

    return run


def term_frequencies(df: DataFrame, fields: list[str], rare_at_most: int = 2, common_share: float = 0.03) -> DataFrame:
    """(field_name, term, occurrences, records, mark) for every distinct term of the fields.

    A term is a maximal run of characters other than ASCII white space and ASCII punctuation,
    lower-cased. ``mark`` is 'rare' if it occurs at most ``rare_at_most`` times in the field, else
    'common' if more than ``common_share`` of the rows with a non-null field contain it, else null.

    A row is a record and lies in one task, whose tokens come in the order of the records; there
    last-seen counters need one number a term. Counters, not tokens, are then hash-partitioned by
    term and added, so the most frequent term costs one row a task. Null fields and values without a
    term count for nothing but the latter for the rows with a field; an empty table gives no row.
    """
    names = [c.replace("\\", "\\\\").replace("'", "\\'") for c in fields]
    values = df.select(*[F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(fields)])
    counted = (
        map_in_arrow(values, _counters(fields), "field_name string, term string, occurrences long, records long")
        .groupBy("field_name", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    )
    present = df.agg(*[F.count(F.col(c)).alias(f"n{k}") for k, c in enumerate(fields)])
    pairs = ", ".join(f"'{name}', n{k}" for k, name in enumerate(names))
    rows = present.selectExpr(f"stack({len(fields)}, {pairs}) as (field_name, _rows)")  # one row a field
    # an exact share: a term in just that many rows isn't common
    bound = F.lit(Decimal(str(common_share))) * F.col("_rows")
    return counted.join(F.broadcast(rows), "field_name").select(
        "field_name", "term", "occurrences", "records",
        F.when(F.col("occurrences") <= rare_at_most, "rare").when(F.col("records") > bound, "common").alias("mark"),
    )
