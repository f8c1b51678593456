import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scourline.llm.terms import term_frequencies

BREAK = re.compile(r"[\t-\r !-/:-@\[-`{-~]+")


def brute(values):
    occurrences, records = Counter(), Counter()
    for v in values:
        terms = [t.lower() for t in BREAK.split(v) if t] if v is not None else []
        occurrences.update(terms)
        records.update(set(terms))
    return {(t, occurrences[t], records[t]) for t in occurrences}


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Nova", "nova", "NOVA", "Bay", "Ü", "ü", "x y", "a", "…", "​"]
    rows = [(None if i % 13 == 0 else " -.".join(rng.choice(words) for _ in range(rng.randrange(4))) + str(rng.randrange(300)) * (i % 2),) for i in range(3000)]
    df = spark.createDataFrame(rows, "city string").repartition(7)
    got = term_frequencies(df, ["city"]).collect()
    assert {(r.term, r.occurrences, r.records) for r in got} == brute([r[0] for r in rows])
    assert len(got) == len({r.term for r in got})
    present = sum(r[0] is not None for r in rows)
    for r in got:
        assert r["mark"] == ("rare" if r.occurrences <= 2 else "common" if r.records > 0.03 * present else None)


def test_repeats_in_one_record_and_two_fields(spark):
    df = spark.createDataFrame([("a a b", "a"), ("A", None), ("", " ")], "x string, `it's` string")
    got = {(r.field_name, r.term): (r.occurrences, r.records) for r in term_frequencies(df, ["x", "it's"]).collect()}
    assert got == {("x", "a"): (3, 2), ("x", "b"): (1, 1), ("it's", "a"): (1, 1)}


@pytest.mark.parametrize("hits, mark", [(3, None), (4, "common")])
def test_the_share_is_exact(spark, hits, mark):
    df = spark.range(100).select(F.when(F.col("id") < hits, "hit").otherwise("x").alias("v"))
    assert [r["mark"] for r in term_frequencies(df, ["v"]).where("term = 'hit'").collect()] == [mark]


def test_edges(spark):
    empty = spark.createDataFrame([], "x string, term string, records long")
    assert term_frequencies(empty, ["x", "term"]).count() == 0
    nulls = spark.createDataFrame([(None,)], "x string")
    assert term_frequencies(nulls, ["x"]).count() == 0
    hot = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("hot t"), "id")).otherwise("hot").alias("term"))
    rows = {r.term: r for r in term_frequencies(hot, ["term"]).where("mark = 'common'").collect()}
    assert list(rows) == ["hot"] and rows["hot"].records == 20_000
    long = spark.createDataFrame([("w " * 200_000,)], "x string")
    assert [(r.occurrences, r.records) for r in term_frequencies(long, ["x"]).collect()] == [(200_000, 1)]
