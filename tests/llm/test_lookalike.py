import sys
import unicodedata

import pytest

from scourline.llm.lookalike import consistent_form, look_alike_matches

PLACES = [(1, "Nova Boüx", "Tib"), (2, "Ясна", "Kor"), (3, "Coffel", "Tib"), (4, "Twin", "Tib"), (5, "Twin", "Kor"), (6, None, "Kor"), (7, "", "Kor")]


def found(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, city string, country string, key string, form string")
    places = spark.createDataFrame(PLACES, "place_id long, city string, country string")
    got = look_alike_matches(df, "row_id", "city", "country", places, "place_id", "city", "country")
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("city, place", [
    ("Ｎｏｖａ　Ｂｏüｘ", 1), ("Nova Boüx", 1), ("Nova Boüx", 1), ("No​va Boüx", 1), ("Nоvа Воüх", 1), ("Νονa Boüx", 1),
    ("NОVА  BOÜX!", 1), ("νova boüx", 1), ("“Noⅴa Boüx”", 1), ("Яcнa", 2), ("Coﬀel", 3), ("﻿Coffel", 3),
    ("Nova Boüx", None), ("NOVA, boüx…", None), ("Nova Boux", None), ("Nova Boüxx", None), ("Nоva Boux", None), ("Ясна!", None),
    ("", None), (None, None), (" -", None),
])
def test_cases(spark, city, place):
    assert found(spark, [(9, city, "Tib", "x", "y")]) == ([(9, place)] if place else [])


def test_shared_names_go_by_country(spark):
    rows = [(1, "Тwin", "Tib", "", ""), (2, "Тwin", "kor", "", ""), (3, "Тwin", None, "", "")]
    got = dict(found(spark, rows))
    assert got[1] == 4 and got[2] == 5 and got[3] in (4, 5)


def test_forms_compare_equal(spark):
    texts = ["Nova Boüx", "Ｎｏｖａ Ｂｏüｘ", "Nоva Boüx", None, "", "a" * 200_000 + "​"]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, city string")
    rows = sorted(consistent_form(df, "city", ["key"]).toPandas().values.tolist(), key=lambda r: r[0])
    assert [r[1] for r in rows[:3]] == ["Nova Boüx"] * 3
    assert rows[3][1] is None and rows[4][1] == "" and rows[5][1] == "a" * 200_000
    assert consistent_form(df.limit(0), "city", ["key"]).count() == 0


def test_no_compatibility_form_and_no_unseen_character_is_left(spark):
    every = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Co", "Cn")]
    odd = [c for c in every if unicodedata.normalize("NFKC", c) != unicodedata.normalize("NFC", c)]
    unseen = ["\u200b", "\u00ad", "\u3164", "\uffa0", "\u115f", "\ufe0f", *map(chr, range(0xE0020, 0xE0080))]
    texts = [f"a{c}b" for c in odd] + [unicodedata.normalize("NFKC", f"a{c}b") for c in odd] + [f"a{c}b" for c in unseen]
    made = consistent_form(spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4), "t", ["i"])
    form = {r.i: r.form for r in made.collect()}
    n = len(odd)
    assert n > 3000 and [odd[k] for k in range(n) if form[k] != form[n + k]] == []
    assert {form[2 * n + k] for k in range(len(unseen))} == {"ab"}
