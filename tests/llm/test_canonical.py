import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scourline.llm import canonical as C

CITIES = ["Nova Boüxthorn", "Saint Tywàdal", "Libeze", "Ясннаринск", "Old Zotrio", "Nougro", "Keisgaloux", "Port Grebroona", "Twin Hills"]
PLACES = [(k + 1, c, "Glemsou" if k == 2 else None, 1 + k % 2, "") for k, c in enumerate(CITIES)] + [(50, "Twin Hills", None, 2, ""), (51, "Moucyrland", None, 1, "")]
COUNTRIES = [(1, "Tëibrieia", "TEI"), (2, "Moucyrnland", "MOU")]


@pytest.fixture
def lists(spark):
    return (
        spark.createDataFrame(PLACES, "place_id long, city string, alt_name string, country_id long, country string"),
        spark.createDataFrame(COUNTRIES, "country_id long, country string, code string"),
    )


CASES = [
    ("nova boüxthorn", "Tëibrieia", {"city": 1}), ("NovaBouxthorn!", "TEI", {"city": 1, "country": 1}), ("Boüxthorn, Nova", "t.e.i.", {"city": 1, "country": 1}),
    ("N. Boüxthorn", "Tebrieia", {"city": 1, "country": 1}), ("Νονa Boüxthοrn", "Tëibrieia", {"city": 1}), ("St Tywadal", "Moucyrnland", {"city": 2}),
    ("Glemsou", "Tëibrieia", {"city": 3}), ("Lbieze", "Tëibrieia", {"city": 3}), ("Яснаринск", "Kingdom of Moucyrnland", {"city": 4, "country": 2}),
    ("City of Nougro", "Moucyrnland", {"city": 6}), ("nourgo", "MOU", {"city": 6, "country": 2}), ("TEI Keisgaloux", "Tëibrieia", {"city": 7}),
    ("depot 31", "Tëibrieia", {"city": -1}), ("Furngeff", "Flygirmark", {"city": -1, "country": -1}), ("Twin hills", None, {"city": 9}),
    ("twin hills", "Moucyrnland", {"city": 50}), ("twin hills", "Tëibrieia", {"city": 9}), ("Libeze", "Tëibrieia", {}), ("n/a", "--", {}), (None, "TEI", {"country": 1}),
    ("", None, {}), ("Tëibrieia", "Libeze", {}), ("tëibrieia.", "LIBEZE", {}), ("Tëibrieia", "Moucyrland", {}), ("MOU", "moucyrland!", {}), ("Nougro", "unknown", {}), ("Old Zotrio municipality", "none", {"city": 5}),
]


@pytest.mark.parametrize("size", [C.INDEX_BYTES, 0])
def test_cases(spark, lists, monkeypatch, size):
    monkeypatch.setattr(C, "INDEX_BYTES", size)
    rows = [(k, a, b, "x", 1) for k, (a, b, _) in enumerate(CASES)] * 2  # repeated rows give repeated cases
    df = spark.createDataFrame(rows, "row_id long, town string, land string, city string, ref_id long")
    got = C.canonical_places(df, "row_id", *lists, city="town", country="land").collect()
    found = {}
    for r in got:
        found.setdefault(r.row_id, {})[r.field_name] = r.ref_id
    want = {k: c for k, (_, _, c) in enumerate(CASES) if c}
    assert found == want and len(got) == 2 * sum(map(len, want.values()))


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def similarity(a, b):
    a, b = (Counter([*x, *zip("^" + x, x + "$", strict=True)]) for x in (a, b))
    return sum((a & b).values()) / sum((a | b).values())


def brute(values, entries, least=C.LEAST_ALIKE):
    """The closest entry of each value among all, by the definition alone."""
    out = {}
    for v, scope in values:
        best = None
        for ref, e, own in entries:
            if scope is not None and own != scope:
                continue
            longer, d = max(len(v), len(e)), osa(v, e)
            if similarity(v, e) < C.LEAST_JACCARD - 1e-9 or d > ((1 - least) * longer + 1e-9 if longer >= C.SHORTEST else 0):
                continue
            found = (1 - d / longer, similarity(v, e), -ref)
            if best is None or found > best:
                best = found
        if best:
            out[v, scope] = (-best[2], round(best[1], 9), round(best[0], 9))
    return out


@pytest.mark.parametrize("size", [C.INDEX_BYTES, 0])
def test_the_closest_of_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(C, "INDEX_BYTES", size)
    rng = random.Random(8)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))

    def typo(x):
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(x))
            x = rng.choice([x[:k] + x[k + 1 :], x[:k] + "q" + x[k:], x[:k] + "z" + x[k + 1 :], x[:k] + x[k : k + 2][::-1] + x[k + 2 :]]) or "a"
        return x

    names = sorted({word("abcde", rng.randrange(1, 13)) for _ in range(150)})
    entries = [(k, n, 1 + k % 2) for k, n in enumerate(names)] + [(500, names[5], 2), (501, names[6], None)]
    values = {(typo(rng.choice(names)), rng.choice([None, 1, 2])) for _ in range(500)} | {(word("abcde", rng.randrange(1, 9)), None) for _ in range(200)}
    got = C.map_values(
        spark.createDataFrame(sorted(values, key=str), "value string, scope long"), spark.createDataFrame(entries, "ref_id long, text string, scope long"), affixes=[]
    )
    found = {(r.value, r.scope): (r.ref_id, round(r.jaccard, 9), round(r.share, 9)) for r in got.collect()}
    assert found == brute(values, entries) and len(found) > 300


@pytest.mark.parametrize("value, entries, ref", [
    ("Rmoe", ["Rome"], 0), ("utemruc", ["utemrucit", "uetmruc"], 1), ("tei", ["tex"], None), ("TEI", ["tei"], 0), ("a", ["a", "A"], 0),
    ("x" * 3000 + "y", ["x" * 3000], 0), ("--", ["--"], None), ("Roma", ["Rome", "Romas"], 1),
])
@pytest.mark.parametrize("size", [C.INDEX_BYTES, 0])
def test_closest(spark, monkeypatch, size, value, entries, ref):
    monkeypatch.setattr(C, "INDEX_BYTES", size)
    listed = spark.createDataFrame(list(enumerate(entries)), "ref_id long, text string").withColumn("scope", F.lit(None).cast("long"))
    got = C.map_values(spark.createDataFrame([(value, None), (None, 1)], "value string, scope long"), listed).collect()
    assert [r.ref_id for r in got] == ([] if ref is None else [ref])


def test_edits():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        assert C.edits(a, b) == osa(a, b)
    assert C.edits("a" * 100, "a" * 70 + "b" * 30) == 30


@pytest.mark.parametrize("size", [C.INDEX_BYTES, 0])
def test_edges(spark, lists, monkeypatch, size):
    monkeypatch.setattr(C, "INDEX_BYTES", size)
    places, countries = lists
    empty = spark.createDataFrame([], "row_id long, city string, country string")
    assert C.canonical_places(empty, "row_id", places, countries).count() == 0
    df = spark.createDataFrame([(1, "x" * 50_000, "TEI"), (None, "libezee", "TEI")], "row_id long, city string, country string")
    assert sorted(map(tuple, C.canonical_places(df, "row_id", places, countries).collect())) == [(1, "city", -1), (1, "country", 1)]
    assert sorted(map(tuple, C.canonical_places(df, "row_id", places.limit(0), countries.limit(0)).collect())) == [(1, "city", -1), (1, "country", -1)]


def test_a_hot_value_is_matched_once(spark, lists):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("LIBEZE ")).otherwise(F.lit("Libeze")).alias("city"), F.lit("Tëibrieia").alias("country"))
    got = C.canonical_places(df, "id", *lists)
    assert got.count() == 2000 and got.where("ref_id <> 3").count() == 0
