import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scourline.llm.packing import containers, first_fit_decreasing, pack


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=80))
def test_tournament_places_like_a_scan(sizes):
    room, want = [], []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((b for b, left in enumerate(room) if left >= sizes[k]), len(room))
        if at == len(room):
            room.append(100)
        room[at] -= sizes[k]
        want.append((k, at))
    assert list(enumerate(first_fit_decreasing(np.array(sizes), 100))) == sorted(want)


@pytest.fixture
def docs(spark):
    return spark.range(5000).select(F.col("id").alias("part"), (F.pmod(F.xxhash64("id"), F.lit(2000)) * F.when(F.col("id") % 50 == 0, 20).otherwise(1)).alias("container"))


@pytest.mark.parametrize("groups", [5000, 700])
def test_every_piece_once_and_nothing_overfull(docs, groups):
    out = pack(docs, "part", "container", 8192, group_items=groups)
    # the id keeps its name even though it is the name of a result column
    rows = out.collect()
    sizes = {r.part: r.container for r in docs.collect()}
    assert out.columns[0] == "part" and len(out.columns) == 7
    pieces, used = {}, {}
    for own, part, parts, begin, tokens, group, container in map(tuple, rows):
        pieces.setdefault(own, []).append((part, parts, begin, tokens))
        used[group, container] = used.get((group, container), 0) + tokens
    assert set(pieces) == set(sizes) and max(used.values()) <= 8192
    for own, ps in pieces.items():
        ps.sort()
        assert [p[0] for p in ps] == list(range(len(ps))) and all(p[1] == len(ps) for p in ps)
        assert [p[2] for p in ps] == [8192 * k for k in range(len(ps))] and sum(p[3] for p in ps) == sizes[own]
        assert (len(ps) > 1) == (sizes[own] > 8192)
    assert len(used) <= 1.02 * -(-sum(sizes.values()) // 8192) + len({g for g, _ in used})


def test_containers_and_edges(spark):
    df = spark.createDataFrame([(1, "a" * 8192), (2, "b" * 8193), (3, ""), (4, None), (None, "x"), (5, "é" * 4096), (5, "c")], "doc_id long, text string")
    out = pack(df, "doc_id", F.octet_length("text"))
    assert sorted((r.doc_id, r.part, r.tokens) for r in out.collect()) == [(1, 0, 8192), (2, 0, 8192), (2, 1, 1), (3, 0, 0), (5, 0, 1), (5, 0, 8192)]
    assert containers(out).count() == 4 and containers(out).where("unused < 0").count() == 0
    assert pack(df.limit(0), "doc_id", F.octet_length("text")).count() == 0


def test_the_result_depends_on_the_items_alone(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 4 == 0, 7).otherwise(F.col("id")).alias("doc_id"), (F.col("id") * 7919 % 900).alias("size"))
    packed = [sorted(map(tuple, pack(d, "doc_id", "size", 1000, group_items=500).collect())) for d in (df.repartition(3), df.repartition(5).orderBy(F.desc("size")))]
    assert packed[0] == packed[1] and len(packed[0]) == 6000


def test_one_id_in_a_third_of_the_rows_is_spread(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("doc_id"), F.lit(10).alias("size"))
    out = pack(df, "doc_id", "size", 1000, group_items=900)
    assert out.count() == 9000 and out.where("doc_id = 0").groupBy("group_no").count().where("count = 300").count() == 10
