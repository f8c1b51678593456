"""Functional dependencies: rules, violations, and their repair.

A rule A, B | C, D says that rows with equal A and B have equal C and D. Rows with a null in A or B
violate nothing; a null in C or D is a value like any other.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted, resolve_columns
from ..storage import cut_lineage
from .transform import replace_in_groups


@dataclass(frozen=True)
class Dependency:
    """Columns on the left determine columns on the right."""

    lhs: tuple[str, ...]
    rhs: tuple[str, ...]

    @classmethod
    def parse(cls, text: str) -> Dependency:
        sides = text.split("|")
        if len(sides) != 2:
            raise ValueError(f"a rule has two sides: {text!r}")
        lhs, rhs = (tuple(x.strip() for x in side.split(",")) for side in sides)
        if not all(lhs) or not all(rhs):
            raise ValueError(f"a rule names columns on both sides: {text!r}")
        return cls(lhs, rhs)


def parse_rules(source: str | Path | dict) -> list[Dependency]:
    """The rules of a JSON file, text or object {"rules": [{"type": "fd", "value": ["A | B", ...]}, ...]}."""
    if isinstance(source, dict):
        rules = source
    else:
        text = str(source)
        rules = json.loads(text if text.lstrip().startswith("{") else Path(text).read_text())
    if list(rules) != ["rules"]:
        raise ValueError("the only top-level key must be 'rules'")
    found = []
    for rule in rules["rules"]:
        if rule.get("type") != "fd":
            raise ValueError(f"unknown rule type {rule.get('type')!r}")
        values = rule["value"]
        found += [Dependency.parse(v) for v in ([values] if isinstance(values, str) else values)]
    return found


def _cols(names) -> list[Column]:
    return [F.col(quoted(c)) for c in names]


def _filled(names) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(quoted(c)).isNotNull()
    return out


def _counts(df: DataFrame, fd: Dependency) -> DataFrame:
    resolve_columns(df, [*fd.lhs, *fd.rhs])
    return df.where(_filled(fd.lhs)).groupBy(*_cols([*fd.lhs, *fd.rhs])).agg(F.count(F.lit(1)).alias("count"))


def violations(df: DataFrame, fd: Dependency) -> DataFrame:
    """(left columns, num): the left values that go with more than one combination of right values."""
    return _counts(df, fd).groupBy(*_cols(fd.lhs)).agg(F.count(F.lit(1)).alias("num")).where("num > 1")


def histogram(df: DataFrame, fd: Dependency) -> DataFrame:
    """(left and right columns, count) of the violating left values."""
    counts = _counts(df, fd)
    bad = counts.groupBy(*_cols(fd.lhs)).agg(F.count(F.lit(1)).alias("num")).where("num > 1").drop("num")
    return counts.join(bad, list(fd.lhs), "left_semi")


def row_rules(df: DataFrame, fds: list[Dependency], id_column: str) -> DataFrame:
    """(id, rules): the numbers of the rules that each violating row violates, ascending."""
    found = None
    for k, fd in enumerate(fds):
        rows = df.join(violations(df, fd), list(fd.lhs), "left_semi").select(F.col(quoted(id_column)).alias(id_column), F.lit(k).alias("_rule"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no rules")
    # an id has at most as many rows as there are rules
    return found.groupBy(id_column).agg(F.array_sort(F.collect_set("_rule")).alias("rules"))


def greedy_fixes(df: DataFrame, fd: Dependency) -> DataFrame:
    """For each violating left value the rarest right values and what they become: bad_<c> and good_<c>.

    The rarest and the most frequent combination; of several the smallest by its values. Left values
    whose combinations are all equally frequent can't be fixed and are left out.
    """
    counts = histogram(df, fd)
    rhs = _cols(fd.rhs)
    groups = counts.groupBy(*_cols(fd.lhs)).agg(
        F.min(F.struct(F.col("count").alias("#n"), *rhs)).alias("#bad"),
        F.min(F.struct((-F.col("count")).alias("#n"), *rhs)).alias("#good"),
    )
    fixable = groups.where(F.col("#bad.#n") != -F.col("#good.#n"))
    return fixable.select(
        *_cols(fd.lhs),
        *[F.col(f"#bad.{quoted(c)}").alias(f"bad_{c}") for c in fd.rhs],
        *[F.col(f"#good.{quoted(c)}").alias(f"good_{c}") for c in fd.rhs],
    )


def repair_greedy(df: DataFrame, fds: list[Dependency], passes: int = 1) -> DataFrame:
    """Of each violating left value the rarest right values replaced by the most frequent ones, column by column.

    The fixes of all rules come from the table as it was before the pass and are applied one rule
    after the other. More passes fix further combinations, one a pass; each is written to the
    checkpoint folder, and they end early when nothing is left to fix.
    """
    for k in range(passes):
        fixes = [(fd, greedy_fixes(df, fd)) for fd in fds]
        if k and all(f.isEmpty() for _, f in fixes):
            break
        for fd, f in fixes:
            df = replace_in_groups(df, f, list(fd.lhs), list(fd.rhs))
        if passes > 1:
            df = cut_lineage(df)
    return df


def repair_holistic(df: DataFrame, fds: list[Dependency], id_column: str) -> DataFrame:
    """Rows that violate two rules which share right columns get the likeliest values of those columns.

    For each pair of rules in order, the shared columns of such a row become what the most frequent
    combination of the first rule says; a row whose own combination is as frequent keeps its values,
    of others the smallest is taken. All suggestions come from the table as it was; of several for
    one column the last pair wins.
    """
    names = df.columns
    pairs = [
        (i, j, [c for c in fds[i].rhs if c in fds[j].rhs]) for i in range(len(fds)) for j in range(i + 1, len(fds))
    ]
    pairs = [p for p in pairs if p[2]]
    resolve_columns(df, id_column)
    if not pairs:
        return df
    rows = df
    used = sorted({k for i, j, _ in pairs for k in (i, j)})
    for k in used:
        fd = fds[k]
        counts = histogram(df, fd)
        best = counts.groupBy(*_cols(fd.lhs)).agg(F.min(F.struct((-F.col("count")).alias("#n"), *_cols(fd.rhs))).alias(f"#best{k}"))
        rows = rows.join(best, list(fd.lhs), "left")
        if any(i == k for i, _, _ in pairs):
            # right columns compare null-safely, left ones of violating rows aren't null
            own = counts.select(*[F.col(quoted(c)).alias(f"#{k}{c}") for c in [*fd.lhs, *fd.rhs]], F.col("count").alias(f"#own{k}"))
            same = F.lit(True)
            for c in fd.lhs:
                same = same & (F.col(quoted(c)) == F.col(quoted(f"#{k}{c}")))
            for c in fd.rhs:
                same = same & F.col(quoted(c)).eqNullSafe(F.col(quoted(f"#{k}{c}")))
            rows = rows.join(own, same, "left").drop(*[f"#{k}{c}" for c in [*fd.lhs, *fd.rhs]])
    new = {c: F.col(quoted(c)) for c in names}
    for i, j, shared in pairs:
        wrong = F.col(f"#best{i}").isNotNull() & F.col(f"#best{j}").isNotNull() & (F.col(f"#own{i}") < -F.col(f"#best{i}.#n"))
        for c in shared:
            new[c] = F.when(wrong, F.col(f"#best{i}.{quoted(c)}")).otherwise(new[c])
    return rows.select(*[new[c].alias(c) for c in names])


class ConstraintCorrector:
    """Rules over a table: checked, shown and repaired. ``df`` may be a DataFrame or a Cleaner."""

    def __init__(self, df, id_column: str | None = None) -> None:
        df = df if isinstance(df, DataFrame) else df.df
        self._own = id_column is None
        self._id = id_column or "t_identifier"
        self._df = df.withColumn(self._id, F.monotonically_increasing_id()) if self._own else df
        self.rules: list[Dependency] = []

    def parse_ic(self, source: str | Path | dict) -> ConstraintCorrector:
        self.rules = parse_rules(source)
        return self

    def check_violations(self) -> list[DataFrame]:
        """One DataFrame of violating left values for each rule."""
        return [violations(self._df, fd) for fd in self.rules]

    def histograms(self) -> list[DataFrame]:
        return [histogram(self._df, fd).orderBy(*fd.lhs) for fd in self.rules]

    def row_rules(self) -> DataFrame:
        return row_rules(self._df, self.rules, self._id)

    def display_violation_rows(self, n: int = 1000) -> None:
        """Print the violating combinations of each rule, at most ``n`` of them, which all pass through the driver."""
        for fd, counts in zip(self.rules, self.histograms(), strict=True):
            print(", ".join(fd.lhs), "|", ", ".join(fd.rhs))
            counts.show(n, False)

    def correct_violations(self, fix_rule: str, passes: int = 1) -> ConstraintCorrector:
        """Repair by 'single_fd_greedy' or 'holistic'."""
        if fix_rule == "single_fd_greedy":
            self._df = repair_greedy(self._df, self.rules, passes)
        elif fix_rule == "holistic":
            self._df = repair_holistic(self._df, self.rules, self._id)
        else:
            raise ValueError("fix_rule must be 'single_fd_greedy' or 'holistic'")
        return self

    def get_dataframe(self) -> DataFrame:
        return self._df.drop(self._id) if self._own else self._df
