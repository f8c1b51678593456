import math
import random
from statistics import median

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scourline.llm import quantiles as Q
from scourline.llm.quantiles import RelativeCompactors


def rank_range(values, x):
    return np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right") - 1


@pytest.mark.parametrize("high", [True, False])
def test_error_is_multiplicative_at_the_protected_tail(high):
    rng = np.random.default_rng(5)
    values = rng.lognormal(10, 2, 300_000)
    sketch = RelativeCompactors(64, high)
    for part in np.array_split(values, 97):
        other = RelativeCompactors(64, high)
        other.update(part)
        sketch.merge(RelativeCompactors.from_bytes(other.to_bytes()))
    values.sort()
    assert sketch.n == len(values) and sum(map(len, sketch.levels)) < 20_000
    for tail in (1e-5, 1e-4, 1e-3, 1e-2, 0.1, 0.5):
        q = 1 - tail if high else tail
        got, want = rank_range(values, sketch.quantile(q))[0], q * (len(values) - 1)
        assert abs(got - want) <= 0.03 * tail * len(values) + 2, tail


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=400), st.integers(2, 4), st.booleans(), st.integers(1, 9))
def test_bounds_always_hold(values, k, high, parts):
    sketch = RelativeCompactors(k, high)
    for part in np.array_split(np.array(values, float), parts):
        other = RelativeCompactors(k, high)
        other.update(part)
        sketch.merge(other)
    values = sorted(values)
    assert sketch.n == len(values) == sum(len(x) << h for h, x in enumerate(sketch.levels))
    for rank in {0, len(values) // 2, len(values) - 1}:
        lo, hi = sketch.bounds(rank)
        assert lo <= values[rank] <= hi
    lo, hi = sketch.median_bounds()
    assert lo <= median(values) <= hi


def test_small_groups_are_exact():
    sketch = RelativeCompactors()
    sketch.update(np.array([3.0, 1.0, 2.0, 10.0]))
    assert sketch.median_bounds() == (2.5, 2.5) and sketch.quantile(1.0) == 10.0 and math.isnan(RelativeCompactors().quantile(0.5))


def test_disagreeing_parts_against_brute_force(spark):
    rng, rows = random.Random(6), []
    for n in range(6000):
        c, b = rng.choice("ABC"), rng.randrange(8)
        rows.append((None if n % 50 == 0 else c, b, rng.lognormvariate(5, 1) * (9 if (c, b) == ("A", 3) else 1 / 8.5 if (c, b) == ("B", 1) else 8 if b == 5 else 1)))
    rows += [("A", 99, 1e9)] * 19 + [("A", 98, 1e9)] * 20 + [("A", 97, None)] * 30 + [("A", None, 1e9)] * 5
    groups, parts = {}, {}
    for g, p, v in rows:
        if g is not None and v is not None:
            groups.setdefault(g, []).append(v)
            if p is not None:
                parts.setdefault((g, p), []).append(v)
    want = sorted(k for k, v in parts.items() if len(v) >= 20 and not median(groups[k[0]]) / 8 <= median(v) <= 8 * median(groups[k[0]]))
    df = spark.createDataFrame(rows, "n string, median_lo long, v double").repartition(5)
    for k in (64, 2):  # with small sketches the bounds leave cases open
        got = Q.disagreeing_parts(df, "n", "median_lo", "v", k=k)
        assert sorted(map(tuple, got.collect())) == want and got.columns == ["n", "median_lo"]


def test_rows_without_a_part_count_for_their_group(spark):
    rows = [("g", 1, 10.0)] * 30 + [("g", 2, 100.0)] * 30 + [("g", None, 1000.0)] * 200
    df = spark.createDataFrame(rows, "g string, p long, v double")
    assert sorted(map(tuple, Q.disagreeing_parts(df, "g", "p", "v").collect())) == [("g", 1), ("g", 2)]


def test_exact_medians(spark):
    values = [5, 1, 1, 9, 7, 7, 3, 8]
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    window = spark.createDataFrame([("a", 8, 3.0, 8.0)], "g string, n long, low double, high double")
    assert [tuple(r) for r in Q.exact_medians(df, ["g"], "v", window).collect()] == [("a", 6.0)]


@pytest.mark.parametrize("kind", ["wide", "ties", "two"])
def test_exact_ranks_narrow_from_any_bounds(spark, kind):
    rng = random.Random(15)
    draw = {"wide": lambda: rng.lognormvariate(3, 2), "ties": lambda: float(rng.randrange(4)), "two": lambda: rng.choice([1.0, 2.0])}[kind]
    groups = {g: sorted(draw() for _ in range(n)) for g, n in (("a", 5000), (None, 700), ("b", 1))}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "low string, v double").repartition(5)
    wanted = [(g, r, -math.inf, math.inf) for g, own in groups.items() for r in {0, len(own) // 3, len(own) // 2, len(own) - 1}]
    asked = spark.createDataFrame(wanted, "low string, rank long, lo double, high double").select("low", "rank", F.col("lo"), "high")
    got = Q.exact_ranks(df.withColumnRenamed("low", "g"), ["g"], "v", asked.withColumnsRenamed({"low": "g", "lo": "low"}), k=2)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((g, r, groups[g][r])) for g, r, _, _ in wanted)


def test_quantiles_lie_within_their_bounds(spark):
    rng = random.Random(14)
    values = sorted(rng.lognormvariate(3, 2) for _ in range(20_000))
    df = spark.createDataFrame([("g", v) for v in rng.sample(values, len(values))], "g string, v double").repartition(6)
    for r in Q.sketch_quantiles(Q.quantile_sketches(df, ["g"], "v"), ["g"], [0.0, 0.3, 0.5, 0.99, 1.0]).collect():
        want = values[math.floor(r.q * 19_999 + 1e-9)]
        assert r.low <= want <= r.high and r.low <= r.value <= r.high
    exact = Q.exact_quantiles(df, ["g"], "v", [0.0, 0.3, 0.5, 0.99, 1.0], k=8).collect()
    assert {r.q: r.exact for r in exact} == {q: values[math.floor(q * 19_999 + 1e-9)] for q in (0.0, 0.3, 0.5, 0.99, 1.0)}


def test_edges(spark):
    empty = spark.createDataFrame([], "g string, v int")
    assert Q.quantile_sketches(empty, ["g"], "v").count() == 0 and Q.disagreeing_parts(empty, "g", "g", "v").count() == 0
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), ("x", None), ("x", float("inf")), ("x", 2.0)], "g string, v double")
    got = {r.g: (r.n, r.value) for r in Q.sketch_quantiles(Q.quantile_sketches(df, ["g"], "v"), ["g"], [0.5]).collect()}
    assert got == {None: (1, 1.0), "x": (1, 2.0)}
    hot = spark.range(50_000).select(F.lit("h").alias("g"), F.col("id").alias("v"))
    row = Q.sketch_medians(Q.quantile_sketches(hot.repartition(9), ["g"], "v"), ["g"]).first()
    assert row.n == 50_000 and row.median_lo <= 24_999.5 <= row.median_hi and row.median_hi - row.median_lo < 20_000
