import random

import pytest

from scourline import Cleaner, ConstraintCorrector, Dependency, parse_rules
from scourline.operators import constraints as I

# Rules and rows whose violations and repairs are known.
RULES = {"rules": [{"type": "fd", "value": ["ZIPCode | City, State"]}, {"type": "fd", "value": ["ProviderNumber | City, PhoneNumber"]}]}
GROUPS = [
    (1, 35233, 10018.0, "NewYork", "AL", 253258100), (24, 35233, 10018.0, "BIRMINGHAM", "AL", 2053258100),
    (75, 35233, 10019.0, "BIRMINGHAM", "AL", 2053258200), (23, 90028, 50063.0, "LOS ANGELES", "CA", 2134133000),
    (2, 90028, 50063.0, "LOS ANGELES", "CA", 2134133001), (25, 90028, 50064.0, "HOLLYWOOD", "CA", 2134134000),
]


@pytest.fixture
def hospital(spark):
    out = [row for n, *row in GROUPS for _ in range(n)]
    return spark.createDataFrame(
        [(k, *row) for k, row in enumerate(out)], "row_id long, ZIPCode int, ProviderNumber double, City string, State string, PhoneNumber long"
    )


def test_parse_rules(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"rules": [{"type": "fd", "value": ["A, B | C", "A | D"]}]}')
    assert parse_rules(path) == [Dependency(("A", "B"), ("C",)), Dependency(("A",), ("D",))]
    for bad in ({"rule": []}, {"rules": [{"type": "cfd", "value": "A | B"}]}, {"rules": [{"type": "fd", "value": "A"}]}):
        with pytest.raises(ValueError):
            parse_rules(bad)


def test_histogram_golden(hospital, rows):
    first, second = parse_rules(RULES)
    assert rows(I.histogram(hospital, first)) == [
        (35233, "BIRMINGHAM", "AL", 99), (35233, "NewYork", "AL", 1), (90028, "HOLLYWOOD", "CA", 25), (90028, "LOS ANGELES", "CA", 25),
    ]
    assert sorted(r["count"] for r in I.histogram(hospital, second).collect()) == [1, 2, 23, 24]


def test_greedy_golden(hospital):
    out = ConstraintCorrector(Cleaner(hospital), "row_id").parse_ic(RULES).correct_violations("single_fd_greedy").get_dataframe()
    assert out.columns == hospital.columns
    first, second = parse_rules(RULES)
    left = I.histogram(out, first).collect()
    assert {r.ZIPCode for r in left} == {90028}  # a tie stays
    assert I.violations(out, second).count() == 0


def test_holistic_golden(hospital):
    out = ConstraintCorrector(hospital, "row_id").parse_ic(RULES).correct_violations("holistic").get_dataframe()
    changed = [(a.row_id, a.City, b.City) for a, b in zip(hospital.orderBy("row_id").collect(), out.orderBy("row_id").collect(), strict=True) if a != b]
    assert changed == [(0, "NewYork", "BIRMINGHAM")]


def test_more_passes_leave_no_more_violations(spark):
    df = spark.createDataFrame([(k, 1, v) for k, v in enumerate("aaaabbbccd")], "id long, k int, v string")
    fd = [Dependency(("k",), ("v",))]
    once = I.repair_greedy(df, fd)
    assert sorted(r["count"] for r in I.histogram(once, fd[0]).collect()) == [2, 3, 5]
    assert I.violations(I.repair_greedy(df, fd, passes=9), fd[0]).count() == 0


def test_repair_never_adds_violations(spark):
    rng = random.Random(4)
    for _ in range(5):
        rows = [(k, rng.randrange(6), rng.choice("abc"), rng.choice("xy")) for k in range(60)]
        df = spark.createDataFrame(rows, "id long, k int, v string, w string")
        fd = Dependency(("k",), ("v",))
        before = {r.k: r.num for r in I.violations(df, fd).collect()}
        after = {r.k: r.num for r in I.violations(I.repair_greedy(df, [fd]), fd).collect()}
        assert all(n <= before[k] for k, n in after.items())


def test_nulls(spark):
    df = spark.createDataFrame([(0, None, "a"), (1, None, "b"), (2, 1, None), (3, 1, "x"), (4, 1, "x")], "id long, k int, v string")
    fd = Dependency(("k",), ("v",))
    assert [tuple(r) for r in I.violations(df, fd).collect()] == [(1, 2)]
    assert [r.v for r in I.repair_greedy(df, [fd]).orderBy("id").collect()] == ["a", "b", "x", "x", "x"]
    assert [(r.id, r.rules) for r in I.row_rules(df, [fd], "id").orderBy("id").collect()] == [(2, [0]), (3, [0]), (4, [0])]
    empty = df.limit(0)
    assert I.repair_greedy(empty, [fd]).count() == 0 and I.repair_holistic(empty, [fd, fd], "id").count() == 0


def test_unknown_fix_rule(hospital):
    with pytest.raises(ValueError):
        ConstraintCorrector(hospital, "row_id").parse_ic(RULES).correct_violations("min_cells")


def test_display(hospital, capsys):
    ConstraintCorrector(hospital, "row_id").parse_ic(RULES).display_violation_rows()
    out = capsys.readouterr().out
    assert "ZIPCode | City, State" in out and "90028" in out
