import pytest
from pyspark.sql import functions as F

from scourline import Cleaner, Deduplicator
from scourline.functions import similarity as S
from scourline.operators import dedup as D
from scourline.sources.io import load_demo


@pytest.fixture
def demo(spark):
    rows = [(k, *r) for k, r in enumerate(load_demo(spark).collect())]
    return spark.createDataFrame(rows, "id long, city string, country string, population int")


def test_key_collision_golden(demo, rows):
    out = D.key_collision(demo, "city", "id")
    assert rows(out, "value", "n", "canonical", "total") == [
        ("Bogota", 1, "Bogota", 2), ("Bogotá", 1, "Bogota", 2), ("New York", 2, "New York", 3), ("New York  ", 1, "New York", 3),
    ]
    assert D.rows_affected(out).first()[0] == 5
    assert [r.city for r in D.resolve(demo, "city", out).orderBy("id").collect()][4:] == ["New York", "New York", "Bogota"]


def test_blocked_pairs_golden(demo):
    assert D.blocked_pairs(demo, "country", "id", 2, threshold=0.9).count() == 0
    pair = D.blocked_pairs(demo, "country", "id", 2, threshold=0.8).collect()
    assert [(r.value_l, r.value_r, r.canonical, r.total) for r in pair] == [("Amarica", "America", "America", 3)]
    assert round(pair[0].similarity, 3) == 0.857


@pytest.mark.parametrize("cell", [1000, 7])
def test_hot_blocks_in_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(D, "CELL_VALUES", cell)
    values = [f"abcdef {k:03d}" for k in range(60)] + ["abc", None, "", "zzz zzz"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values * 2)], "id long, v string")
    got = D.blocked_pairs(df, "v", "id", 3, "hamming", 0.85)
    want = {(a, b) for a in values[:60] for b in values[:60] if a < b and sum(x != y for x, y in zip(a, b, strict=True)) / 10 < 0.15}
    assert {(r.value_l, r.value_r) for r in got.collect()} == want and got.count() == len(want)
    rows = D.pair_rows(df, "v", got, "id")
    assert rows.count() == 4 * len(want) and rows.where("value_l = 'abcdef 000' and value_r = 'abcdef 001'").count() == 4


def test_hot_block_of_unlike_values(spark, monkeypatch):
    """Values of one block are compared if they have a segment in common, not each with each."""
    calls = spark.sparkContext.accumulator(0)

    def measure(a, b):
        @F.udf("double")
        def run(x, y):
            calls.add(1)
            return 1 - (sum(p != q for p, q in zip(x, y, strict=False)) + abs(len(x) - len(y))) / max(len(x), len(y))

        return run(a, b)

    values = [f"nova {k * 7919 % 100003:05d}{k * 104729 % 100003:05d}" for k in range(300)]
    values += [v[:-1] + "x" for v in values[:20]] + [v + "y" for v in values[10:30]] + ["nova " + "z" * 70, "nova " + "z" * 69 + "w"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    monkeypatch.setattr(D, "similarity", lambda method: measure)
    got = D.blocked_pairs(df, "v", "id", 4, "hamming", 0.85).collect()
    exact = lambda x, y: 1 - (sum(p != q for p, q in zip(x, y, strict=False)) + abs(len(x) - len(y))) / max(len(x), len(y))
    want = {(a, b): exact(a, b) for a in values for b in values if a < b and exact(a, b) > 0.85}
    assert {(r.value_l, r.value_r): r.similarity for r in got} == want and len(got) == len(want) > 50
    assert calls.value < 20 * len(want)


def test_previews(spark, demo, capsys):
    dd = Deduplicator(demo, "id")
    fixes = dd.record_matching(["city"], ["population"])
    shown = dd.preview_records(fixes, 1, ["city"]).collect()
    assert [(r.column, r.total, r.id) for r in shown] == [("population", 3, 1), ("population", 3, 4), ("population", 3, 5)]
    assert dd.record_variants(["city"], fixes).where("column = 'population'").count() == 2
    dd.show(2)
    assert "Bogota" in capsys.readouterr().out
    assert dd.preview(dd.key_collision_clustering("city"), 1).count() == 2


def test_record_matching_golden(spark, demo):
    fixed = Cleaner(demo).remove_special_chars("city").clear_accents("*").trim_col("*").df
    fixed = D.resolve(fixed, "country", D.blocked_pairs(fixed, "country", "id", 2, threshold=0.8))
    fixes = D.record_matching(fixed, ["city", "country"], ["population"], "id")
    assert [(r.column, r.canonical, r.canonical_n, r.total) for r in fixes.collect()] == [("population", "19795791", 2, 3)]
    assert sorted(r.id for r in D.matched_rows(fixed, ["city", "country"], fixes, "id").collect()) == [1, 4, 5]
    done = D.resolve_records(fixed, ["city", "country"], ["population"], fixes)
    assert done.columns == demo.columns and done.dtypes == demo.dtypes
    assert Deduplicator(done, "id").remove_duplicates(["city", "country", "population"]).get_dataframe().count() == 4


def test_generated_ids(spark):
    dd = Deduplicator(load_demo(spark))
    dd = dd.resolve("city", dd.key_collision_clustering("city"))
    assert dd.get_dataframe().columns == ["city", "country", "population"]
    assert dd.rows_affected(dd.key_collision_clustering("city")) == 0


def test_resolve_is_idempotent(demo):
    once = D.resolve(demo, "city", D.key_collision(demo, "city", "id"))
    again = D.resolve(once, "city", D.key_collision(once, "city", "id"))
    assert once.orderBy("id").collect() == again.orderBy("id").collect()


def test_nulls_empty_and_hot_values(spark):
    df = spark.createDataFrame([], "id long, v string")
    assert D.key_collision(df, "v", "id").count() == 0 and D.rows_affected(D.key_collision(df, "v", "id")).first()[0] == 0
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 2 == 0, "A b").otherwise("a B.").alias("v"))
    out = D.key_collision(df, "v", "id").collect()
    assert {(r.value, r.n, r.total) for r in out} == {("A b", 1000, 2000), ("a B.", 1000, 2000)}
    assert {r.canonical for r in out} == {"a B."}  # ties go to the first id
    assert D.blocked_pairs(df, "v", "id", 2, threshold=0.1).count() == 1


def test_all_pairs(spark):
    df = spark.range(40).select("id", F.col("id").cast("string").alias("v"))
    pairs = D.build_pairs(df, ["v"])
    assert pairs.columns == ["v", "id", "_v", "_id"]
    assert {(r.id, r["_id"]) for r in pairs.collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()


PAIRS = [("kitten", "sitting"), ("america", "amarica"), ("", ""), ("", "abc"), ("aab", "aba"), ("Byrne", "Boern"), ("same", "same"), ("größe", "grosse")]


def model(method, a, b):
    from collections import Counter
    from math import sqrt

    size, both = max(len(a), len(b)), sum((Counter(a) & Counter(b)).values())
    wrong = sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))
    if not size:
        return 1.0
    if method == "hamming":
        return 1 - wrong / size
    if method == "mlipns":
        return float(any(size <= m or (wrong - m) / (size - m) <= 0.25 for m in range(3)))
    if method == "jaccard":
        return both / (len(a) + len(b) - both)
    if min(len(a), len(b)) == 0:
        return 0.0
    if method == "overlap":
        return both / min(len(a), len(b))
    if method == "cosine":
        return both / sqrt(len(a) * len(b))

    def lev(i, j):
        return i + j if not i or not j else min(lev(i - 1, j) + 1, lev(i, j - 1) + 1, lev(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    def seq(i, j):
        return 0 if not i or not j else seq(i - 1, j - 1) + 1 if a[i - 1] == b[j - 1] else max(seq(i - 1, j), seq(i, j - 1))

    if method == "levenshtein":
        return 1 - lev(len(a), len(b)) / size
    if method == "lcsseq":
        return seq(len(a), len(b)) / size
    return max(k for k in range(size + 1) for i in range(len(a) - k + 1) if a[i : i + k] in b) / size


@pytest.mark.parametrize("method", [m for m in S.METHODS if m != "mra"])
def test_similarities_against_models(spark, method):
    df = spark.createDataFrame([*PAIRS, (None, "a")], "a string, b string")
    got = [r[0] for r in df.select(S.similarity(method)(F.col("a"), F.col("b"))).collect()]
    assert got[:-1] == pytest.approx([model(method, a, b) for a, b in PAIRS])
    assert got[-1] is None


def test_match_rating():
    assert S.rating_code("Smith") == "SMTH" and S.rating_code("Catherine") == "CTHRN" and S.rating_code("Kathryn") == "KTHRYN"
    assert S.match_rating("Byrne", "Boern") == 0.75  # BYRN and BRN: Y is left over
    assert S.match_rating("", "") == 1.0 and S.match_rating("Al", "Frederick") == 0.0
    with pytest.raises(ValueError):
        S.similarity("soundalike")
