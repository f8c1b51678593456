import random

import pytest
from pyspark.sql import functions as F

from scourline.llm import survivors as V

SCHEMA = "g long, i long, trust int, at long, city string, country string, people int"


def brute(rows):
    groups = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            groups.setdefault(r[0], []).append(r)
    out = []
    for g, own in groups.items():
        if len(own) < 2:
            continue
        own.sort(key=lambda r: (r[2] if r[2] is not None else 1 << 62, -r[3] if r[3] is not None else 1 << 62, r[1]))
        line = [g, len(own)]
        for f in (4, 5):
            line.append(next((r[1] for r in own if r[f] not in (None, "", "n/a", " ")), None))
        line.append(next((r[1] for r in own if r[6] is not None and r[6] > 0), None))
        out.append(tuple(line))
    return sorted(out)


def run(df):
    order = [F.col("trust"), -F.col("at")]
    got = V.surviving_fields(df, "g", "i", ["city", "country", "people"], order)
    return sorted(tuple(r) for r in got.select("g", "n_rows", "city_row_id", "country_row_id", "people_row_id").collect())


def sample(n, groups, seed=7):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    return [
        (None if i % 41 == 0 else groups(rng), i, pick(1, 2, 3, None), pick(10, 20, None), pick("Nova Bay", "Nova", "NOVA BAY!", "n/a", None, "", "x y z"),
         pick("Tib", "Tibb", " ", None), pick(5, 6, 0, -3, None))
        for i in range(n)
    ]


def test_precedence_against_brute_force(spark):
    rows = sample(4000, lambda rng: rng.randrange(1500))
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(6)) == brute(rows)


def test_hot_groups(spark):
    rows = sample(6000, lambda rng: rng.choice([1, 1, rng.randrange(2, 900)]))
    assert run(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_consensus_takes_the_existing_value_most_votes_agree_with():
    values = [("San Marino Bay", 1), ("Saint Marino Bay", 1), ("San Marino", 1)]
    assert V.consensus(values) == 0  # San and Bay have two votes each
    assert V.consensus([("c", 5), ("a b", 1)]) == 0
    assert V.consensus([("x", 1), ("y", 1)]) in (0, 1)
    assert V.consensus([("", 1)]) == 0
    # no value is the consensus "Nova Bay West"; the one that agrees in most columns wins, which isn't the heaviest
    assert V.consensus([("Nova Boy East", 2), ("Nova Bay West", 1.5), ("Nova Bay West Dock", 1), ("Novo Bay West", 1)]) == 1


def test_alignment():
    assert V.align(["Nova", "Bay"], ["Nova", "Big", "Bay"]) == [(0, 0), (1, 1), (1, 0)]
    assert V.align([], ["a"]) == [(0, 1)] and V.align(["a"], []) == [] and V.align(["a", "b"], ["b", "c", "d"]) == [(1, 0), (2, 1), (2, 2)]


def independent(rows, weight):
    """Survivors of city and country by tables of aligned rows, one for each group and field."""
    groups, out = {}, {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            groups.setdefault(r[0], []).append(r)
    for g, own in groups.items():
        if len(own) < 2:
            continue
        line = [len(own)]
        for f in (4, 5):
            held = {}
            for r in sorted(own, key=lambda r: (r[2] if r[2] is not None else 1 << 62, -r[3] if r[3] is not None else 1 << 62, r[1])):
                if r[f] not in (None, "", "n/a", " ") and r[f].strip("- "):
                    held.setdefault(r[f], [0.0, r[1], len(held)])[0] += weight(r)
            values = sorted(held.items(), key=lambda x: (-round(x[1][0], 6), x[1][2]))
            if not values:
                line.append(None)
                continue
            centre = V.tokens(values[0][0])
            placed = [dict(zip(V.align(centre, V.tokens(v)), V.tokens(v), strict=True)) for v, _ in values]
            columns = sorted(set().union(*placed))
            table = [[p.get(c, "") for c in columns] for p in placed]
            consensus, heavy = [], []
            for k in range(len(columns)):
                votes = {}
                for row, (_, (w, *_)) in zip(table, values, strict=True):
                    votes[row[k]] = votes.get(row[k], 0) + w
                consensus.append(max(votes, key=lambda t: (round(votes[t], 6), t)))
                heavy.append(round(votes[consensus[-1]], 6))
            agreed = [round(sum(h for x, y, h in zip(row, consensus, heavy, strict=True) if x == y), 6) for row in table]
            line.append(values[agreed.index(max(agreed))][1][1])
        out[g] = tuple(line)
    return out


def voted(df):
    got = V.consensus_fields(df, "g", "i", ["city", "country"], [F.col("trust"), -F.col("at")], F.lit(1.0) / F.col("trust"))
    return {r.g: (r.n_rows, r.city_row_id, r.country_row_id) for r in got.collect()}


@pytest.mark.parametrize("values", [1024, 4, 1])
def test_votes_against_an_independent_count_with_and_without_blocks(spark, monkeypatch, values):
    monkeypatch.setattr(V, "BLOCK_VALUES", values)
    rng = random.Random(17)
    words = ["Nova", "Novo", "Bay", "Boy", "West", "of", "the", "-"]
    rows = [
        (*r[:4], rng.choice([r[4], " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))]), *r[5:])
        for r in sample(2500, lambda rng: rng.choice([1, rng.randrange(2, 500)]))
    ]
    want = independent(rows, lambda r: 1 / r[2] if r[2] else 1.0)
    assert voted(spark.createDataFrame(rows, SCHEMA).repartition(5)) == want
    first = brute(rows)
    assert sum(want[g][1] != city for g, _, city, _, _ in first) > 100  # the votes decide


def test_votes_by_weight(spark):
    rows = [(1, 1, 1, 1, "Nova Bay", "a", 1), (1, 2, 2, 1, "Nova Boy", "a", 1), (1, 3, 3, 1, "Nova Boy", None, None), (1, 4, 4, 1, "Nova", "b", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = V.consensus_fields(df, "g", "i", ["city", "country", "people"], [F.col("trust")]).first()
    assert (got.city, got.city_row_id, got.country_row_id, got.people) == ("Nova Boy", 2, 1, "1")
    heavy = V.consensus_fields(df, "g", "i", ["city"], [F.col("trust")], F.when(F.col("i") == 1, 10.0)).first()
    assert heavy.city == "Nova Bay"


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert run(df) == [] and voted(df) == {}
    rows = [(1, 1, 1, 1, "w " * 50, None, None), (1, 1, 1, 1, "w " * 50, None, None), (2, 5, 1, 1, "a", "b", 1), (3, None, 1, 1, "a", "b", 1)]
    assert run(spark.createDataFrame(rows, SCHEMA)) == [(1, 2, 1, None, None)] and voted(spark.createDataFrame(rows, SCHEMA)) == {1: (2, 1, None)}
    clash = spark.createDataFrame([("k", 1, "x"), ("k", 2, None)], "g string, i long, v0 string")
    got = V.surviving_fields(clash, "g", "i", ["v0"], []).first()
    assert (got.g, got.n_rows, got.v0_row_id, got.v0) == ("k", 2, 1, "x")


@pytest.mark.parametrize("value", ["a", "a b", "-", "ü ü"])
def test_tokens_cover_the_value(value):
    assert "".join(V.tokens(value)).replace(" ", "") == value.replace(" ", "")
