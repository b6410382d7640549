from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from callscape.operators import presence as B
from callscape.operators.spatial import attach_region, site

from helpers import REGION_OF, call, calls, random_calls, rows, sites

LABELS = [("hot", "0", "resident"), ("hot", "1", "visitor"), ("hot", "2", "dynamic_resident"),
          ("u1", "0", "commuter"), ("u1", "0", "resident"), ("u1", "0", "resident"), ("u2", "1", "resident"),
          ("stranger", "0", "resident")]


def labels(spark):
    return spark.createDataFrame(LABELS, "user_id string, region string, user_class string")


def at(when, grain):
    if grain == "day":
        return when.replace(hour=0, minute=0, second=0)
    return when.replace(minute=0, second=0) if grain == "hour" else when


@pytest.mark.parametrize("grain", [None, "day", "hour"])
def test_presence_by_brute_force(spark, grain):
    data = random_calls(900)
    users = defaultdict(set)
    for user, cell, when, *_ in data:
        region = REGION_OF.get(cell[:5])
        if region is None:
            continue
        classes = {c for u, r, c in LABELS if (u, r) == (user, region)} or {"not classified"}
        for user_class in classes:
            users[region, at(when, grain), user_class].add(user)
    got = B.presence(calls(spark, data), sites(spark), labels(spark), grain)
    assert rows(got) == sorted(((*k, len(v)) for k, v in users.items()), key=repr)


@pytest.mark.parametrize("grain", [None, "day"])
def test_flows_by_brute_force(spark, grain):
    data = random_calls(900)
    users = defaultdict(set)
    for user, cell, when, *_ in data:
        region = REGION_OF.get(cell[:5])
        if region is None:
            continue
        homes = {r for u, r, c in LABELS if u == user and c in ("resident", "dynamic_resident")}
        for origin in homes or {"outbound"}:
            users[origin, region, at(when, grain)].add(user)
    got = B.od_matrix(calls(spark, data), sites(spark), labels(spark), grain)
    assert rows(got) == sorted(((*k, len(v)) for k, v in users.items()), key=repr)


@pytest.mark.parametrize("grain", [None, "day"])
def test_activity_by_brute_force(spark, grain):
    data = random_calls(900)
    pairs = defaultdict(set)
    for user, cell, when, clock, *_ in data:
        region = REGION_OF.get(cell[:5])
        if region is not None:
            pairs[region, at(when, grain), clock[:2]].add((user, cell))
    got = B.hourly_activity(calls(spark, data), sites(spark), grain, key="prefix")
    expected = [(*k, len(v), sorted({c for _, c in v})) for k, v in pairs.items()]
    assert rows(got) == sorted(expected, key=repr)


def test_repeated_calls_change_nothing(spark):
    data = random_calls(200)
    once, thrice = calls(spark, data), calls(spark, data * 3)
    for run in (
        lambda df: B.presence(df, sites(spark), labels(spark), "day"),
        lambda df: B.od_matrix(df, sites(spark), labels(spark), "day"),
        lambda df: B.hourly_activity(df, sites(spark), "day", key="prefix"),
    ):
        assert rows(run(once)) == rows(run(thrice))


def test_sites(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",), ("abcde",)], "c string")
    got = df.select(site(F.col("c")), site(F.col("c"), strict=True)).collect()
    assert [tuple(r) for r in got] == [("abcde", "abcde"), ("abc", "invalid"), ("abcde", "abcde")]


def test_regions(spark):
    import datetime as dt

    when = dt.datetime(2024, 1, 1)
    df = calls(spark, [call("a", "00001_x", when), call("b", "00001", when), call("c", "001", when)])
    cells = spark.createDataFrame([("00001", "r"), ("001", "s")], "cell_id string, region string")
    picked = lambda **kw: rows(attach_region(df, cells, **kw).select("user_id", "region"))
    assert picked() == [("b", "r"), ("c", "s")]
    assert picked(key="prefix") == [("a", "r"), ("b", "r"), ("c", "s")]
    assert picked(key="prefix", strict_site=True) == [("a", "r"), ("b", "r")]
    with pytest.raises(ValueError):
        picked(key="suffix")
