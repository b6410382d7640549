import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from callscape.operators import publish as O

from helpers import rows

PRESENCE = "region string, date timestamp_ntz, user_class string, n_users bigint"


def presence(spark):
    when = dt.datetime(2024, 3, 10, 2, 30)  # an hour New York does not have
    return spark.createDataFrame(
        [("b", when, "visitor", 3), ("a", when, "visitor", 2), ("a", when, "commuter", 1)], PRESENCE
    )


def test_presence_observations(spark):
    got = {r["_id"]: r.asDict() for r in O.presence_observations(presence(spark)).collect()}
    assert sorted(got) == ["presence-0", "presence-1", "presence-2"]
    assert got["presence-0"] == {
        "_id": "presence-0", "value": "1", "date": "2024-03-10 02:30:00", "region_id": "a",
        "description": "commuter", "indicator_id": "area_presence", "indicator_name": "area_presence",
    }
    assert got["presence-2"]["region_id"] == "b"


def test_flow_observations_name_the_origin_as_region(spark):
    df = spark.createDataFrame(
        [("home", "away", dt.datetime(2024, 1, 1), 4)],
        "origin string, destination string, date timestamp_ntz, n_users bigint",
    )
    got = O.od_observations(df).first()
    assert (got["_id"], got["region_id"], got["description"], got["value"]) == ("od-0", "home", "away", "4")
    assert got["indicator_id"] == "origin_destination"


@pytest.mark.parametrize("legacy", [False, True])
def test_sunday_of_a_week(spark, legacy):
    weeks = [(y, w) for y in range(2013, 2027) for w in (1, 2, 26, 52)]
    df = spark.createDataFrame(weeks, "y int, w int")
    got = {tuple(r)[:2]: r[2] for r in df.select("y", "w", O.week_sunday(F.col("y"), F.col("w"), legacy)).collect()}
    for (y, w), sunday in got.items():
        expected = (
            dt.datetime.strptime(f"{y} {w} 0", "%Y %W %w").date() if legacy else dt.date.fromisocalendar(y, w, 7)
        )
        assert sunday == expected, (y, w)


def test_sociometer_observations(spark):
    df = spark.createDataFrame(
        [(2014, 2, "r", "visitor", 0.25)],
        "window_year int, window_week int, region string, user_class string, share double",
    )
    got = O.sociometer_observations(df).first()
    assert (got["date"], got["value"], got["description"]) == ("2014-01-12 00:00:00", "0.25", "visitor")
    assert O.sociometer_observations(df, legacy_week=True).first()["date"] == "2014-01-19 00:00:00"


def test_api_records(spark):
    observations = O.presence_observations(presence(spark))
    record = {r["_id"]: r for r in O.to_api_records(observations, "Area", 99).collect()}["Area_presence-2"]
    assert record["uri"] == "http://example.com/Area/Area_presence-2"
    assert (record["added_date"], record["location_id"], record["value"]) == ("99", "b", "3")
    utc = dt.datetime(2024, 3, 10, 2, 30, tzinfo=dt.timezone.utc)
    assert record["date"] == str(int(utc.timestamp()))
    rome = O.to_api_records(observations, "Area", 99, time_zone="Europe/Rome").first()
    assert rome["date"] == str(int(utc.timestamp()) - 3600)


def test_api_records_keep_a_target_location(spark):
    observations = O.presence_observations(presence(spark)).withColumn("target_location", F.lit("here"))
    records = O.to_api_records(observations, "Area", 99)
    assert "location_id" not in records.columns and records.first()["target_location"] == "here"


def test_json(spark):
    got = json.loads(O.as_json(O.to_api_records(O.presence_observations(presence(spark)), "A", 1)).first()[0])
    assert got["indicator_name"] == "A" and got["description"] in ("visitor", "commuter")


def test_numbers_follow_the_order_over_many_partitions(spark):
    n = 5000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("region"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("date"),
        F.lit("c").alias("user_class"), F.col("id").alias("n_users"),
    )
    got = O.presence_observations(df.repartition(7)).collect()
    placed = sorted(got, key=lambda r: int(r["_id"].split("-")[1]))
    assert [r["_id"] for r in placed] == [f"presence-{i}" for i in range(n)]
    order = [(r["region_id"], r["date"]) for r in placed]
    assert order == sorted(order)
