"""The most alike names, against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from tideway.operators import joins
from tideway.plans import network


def plain(left, right, top):
    """(left row, rank, right row, ratio)."""
    out = []
    for row in left:
        if row[1] is None:
            continue
        scored = sorted((-SequenceMatcher(None, row[1], r[1]).ratio(), r[1], r[0]) for r in right if r[1] is not None)[:top]
        out += [(row[0], i + 1, r, round(-s, 9)) for i, (s, _, r) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("top", [1, 6])
def test_fuzzy_top(spark, top):
    rng = random.Random(6)
    words = ["紅", "三", "路", "幹線", "Bus", "Red", "line", "12", "A", "b", " ", "延"]
    name = lambda: "".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
    left = [(i, name()) for i in range(40)] + [(100, None), (101, "ζζζ"), (102, "紅三路"), (103, "紅三路")]
    right = [(i, name()) for i in range(60)] + [(200, None), (201, "紅三路"), (202, "紅三路"), (203, "")]
    a, b = spark.createDataFrame(left, "l long, name string"), spark.createDataFrame(right, "r long, t_name string")
    got = sorted((x.l, x["rank"], x.r, round(x.ratio, 9)) for x in joins.fuzzy_top(a, b, "name", "t_name", top).collect())
    assert got == plain(left, right, top)


def test_few_and_no_rows(spark):
    a = spark.createDataFrame([(1, "abc"), (1, "abc")], "l long, name string")
    b = spark.createDataFrame([(1, "xyz"), (2, "cba")], "r long, t_name string")
    got = sorted((x["rank"], x.r, x.ratio) for x in joins.fuzzy_top(a, b, "name", "t_name").collect())
    assert got == [(1, 2, pytest.approx(1 / 3)), (1, 2, pytest.approx(1 / 3)), (2, 1, 0.0), (2, 1, 0.0)]  # equal rows stay apart
    assert joins.fuzzy_top(a, b.limit(0), "name", "t_name").collect() == [] and joins.fuzzy_top(a.limit(0), b, "name", "t_name").collect() == []


def test_match_routes(spark):
    ours = spark.createDataFrame([("Red 1", "Main St", "Harbour")], "name string, first_stop string, last_stop string")
    theirs = spark.createDataFrame([("Red 1", "Main St.", "Harbour"), ("Blue", "Main St", "Hill")], "t_name string, t_first_stop string, t_last_stop string")
    got = network.match_routes(ours, theirs).orderBy("rank").collect()
    assert [r.t_name for r in got] == ["Red 1", "Blue"] and got[0].ratio == 1.0 and got[0].ends > got[1].ends
