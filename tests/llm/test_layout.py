import random
import string
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scourline.llm import layout
from scourline.llm.codepoints import folded_hashes, missing, same_but_layout


def folded(text):
    return "".join(
        c for c in text.lower() if not (c.isspace() or c in string.punctuation or unicodedata.category(c)[0] == "P")
    )


def brute(rows, any_order=True):
    sets = {}
    for i, a, b, n in rows:
        if i is None or n is None or a is None or b is None or folded(a) in ("", "na", "unknown") or folded(b) in ("", "na", "unknown"):
            continue
        pair = (folded(a), folded(b))
        sets.setdefault((n, tuple(sorted(pair)) if any_order else pair), []).append(i)
    return sorted((min(ids), i) for ids in sets.values() for k, i in enumerate(sorted(ids)) if k)


def dirty(rng, text):
    text = "".join(rng.choice([c.upper(), c.lower()]) for c in text)
    at = rng.randrange(len(text) + 1)
    return text[:at] + rng.choice(["", " ", "\t", "!", "“", "　", " - "]) + text[at:]


@pytest.mark.parametrize("any_order", [True, False])
def test_against_brute_force(spark, any_order):
    rng, rows = random.Random(1), []
    for i in range(600):
        pair = [dirty(rng, rng.choice(["Ärlon", "Nova Bay", "Ясн", "x𝒳y", "ß"])), dirty(rng, rng.choice(["Tib", "Ko", "Ärlon"]))]
        rng.shuffle(pair)
        rows.append((i, pair[0] if i % 17 else None, pair[1] if i % 19 else "n/a", i % 3 if i % 23 else None))
    df = spark.createDataFrame(rows, "i long, a string, b string, n int").repartition(5)
    got = layout.layout_duplicates(df, "i", ["a", "b"], ["n"], any_order)
    assert sorted(map(tuple, got.collect())) == brute(rows, any_order)


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    rows = [(i, f"name {i % 7}", "c", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, a string, b string, n int").coalesce(1)
    # equal hashes for everything: verification alone must separate the sets
    import numpy as np

    local, merge = layout._local_groups(True), layout._merge(True)
    monkeypatch.setattr(layout, "folded_hashes", lambda texts: np.full(len(texts), 7, np.uint64))
    ids, a, b = pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])
    batch = pa.RecordBatch.from_arrays([ids, pa.array(["1"] * 60), a, b], names=["id", "exact", "t0", "t1"])
    groups = list(local(iter([batch, batch.slice(0, 0)])))
    assert sum(g.num_rows for g in groups) == 7
    groups = [pa.RecordBatch.from_arrays([*g.columns, pa.array(range(g.num_rows))], names=[*g.schema.names, "group"]) for g in groups]
    merged = list(merge(iter(groups)))
    assert sum(m.column("n")[k].as_py() for m in merged for k in range(m.num_rows)) == 60
    assert layout.layout_duplicates(df, "i", ["a", "b"], ["n"]).count() == 53


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_a_task_keeps_hot_sets_open(monkeypatch, most):
    import numpy as np

    monkeypatch.setattr(layout, "OPEN_MEMBERS", most)
    rng, rows = random.Random(3), []
    for i in range(900):
        rows.append((1000 - i, dirty(rng, "Hot") if i % 3 == 0 else dirty(rng, "Warm") if i % 50 == 1 else f"u{i}", "c"))
    table = pa.table({"id": [r[0] for r in rows], "exact": ["1"] * 900, "a": [r[1] for r in rows], "b": [r[2] for r in rows]})
    groups = [g for g in layout._local_groups(True)(iter(table.to_batches(max_chunksize=90)))]
    found = [(f, n, m) for g in groups for f, n, m in zip(g.column("local_first").to_pylist(), g.column("n").to_pylist(), g.column("members").to_pylist(), strict=True)]
    hot = [m for _, n, m in found if n >= 30 * (most > 40)  and m and m[0] % 3 == 1 and (1000 - m[0]) % 3 == 0]
    assert sorted(np.concatenate(hot).tolist()) == sorted(r[0] for k, r in enumerate(rows) if k % 3 == 0)
    assert (len(hot) == 1) == (most > 40) and all(f == min(m) for f, _, m in found if m)
    assert sum(n for _, n, _ in found) == 900


def test_repeated_ids_in_large_sets_of_several_tasks(spark):
    df = spark.range(400).select((F.col("id") % 5).alias("id"), F.lit("A").alias("a"), F.lit("b").alias("b")).repartition(4)
    got = layout.layout_duplicates(df, "id", ["a", "b"])
    assert got.count() == 399 and {r["count"] for r in got.where("copy_row_id > 0").groupBy("copy_row_id").count().collect()} == {80}


def test_hot_set_goes_in_one_row_a_task(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Hot"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")))).otherwise(F.concat(F.lit("u"), "id")).alias("a"), F.lit("c").alias("b"))
    got = layout.layout_duplicates(df.repartition(6), "id", ["a", "b"])
    assert got.count() == 9_999 and got.where("first_row_id <> 0").count() == 0
    records = layout.layout_records(df, "id", ["a", "b"])
    assert records.count() == 20_001 and records.where("n_rows = 10000").count() == 1


def test_edges(spark):
    empty = spark.createDataFrame([], "i long, a string, b string")
    assert layout.layout_duplicates(empty, "i", ["a", "b"]).count() == 0 and layout.layout_records(empty, "i", ["a", "b"]).count() == 0
    long = "x" * 300_000
    rows = [(1, long, "b", 0), (2, long + " !", "B", 0), (2, long, "b", 0), (None, long, "b", 0), (3, "", "b", 0), (4, "", "b", 0)]
    df = spark.createDataFrame(rows, "id long, text0 string, key string, n int")  # names used inside the operator
    assert sorted(map(tuple, layout.layout_duplicates(df, "id", ["text0", "key"]).collect())) == [(1, 2), (1, 2)]


def test_two_pointers_and_hashes_agree():
    rng = random.Random(2)
    alphabet = "aAäÄ .-–　!ßſéǅ𝒳​"
    for _ in range(2000):
        a, b = ("".join(rng.choice(alphabet) for _ in range(rng.randrange(6))) for _ in range(2))
        h = folded_hashes(pa.array([a, b]))
        assert same_but_layout(a, b) == (h[0] == h[1]), (a, b)


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_span_hashes_do_not_depend_on_the_place(monkeypatch, block):
    import numpy as np

    from scourline.llm import codepoints

    monkeypatch.setattr(codepoints, "BLOCK", block)
    codepoints._powers.cache_clear()
    words = ["abc", "a", "", "abcabcabcabc", "abc", "x" * 40, "abcabcabcabc", ""]
    codes = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    table = codepoints.mix(np.arange(256, dtype=np.uint64))
    got = codepoints.span_hashes(codes, ends - [len(w) for w in words], ends, table)
    codepoints._powers.cache_clear()
    want = [sum(int(table[ord(c)]) * pow(codepoints._BASE, k, 1 << 64) for k, c in enumerate(w)) % (1 << 64) for w in words]
    assert got.tolist() == want


def test_missing():
    texts = pa.array([None, "", " -- ", "N/A", "(blank)", "Not known", "Nablus", "unknown city", "​"])
    assert missing(texts, folded_hashes(texts)).tolist() == [True] * 6 + [False] * 3
    sliced = texts.slice(3, 2)
    assert missing(sliced, folded_hashes(sliced)).tolist() == [True, True]
