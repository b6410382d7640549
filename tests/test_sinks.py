import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from callscape import commit
from callscape.schema import HOURLY_SERIES, PRESENCE_SERIES, WEEK_STATE_SCHEMA
from callscape.sinks import tables, text
from callscape.sources import stored

from helpers import calls, random_calls, rows

PROFILE = "window_year int, window_week int, region string, user_id string, profile array<double>"


def test_windows_are_replaced_one_by_one(spark, tmp_path):
    root = str(tmp_path / "profiles")
    make = lambda *data: spark.createDataFrame(data, PROFILE)
    tables.write_profiles(make((2024, 1, "r", "u", [1.0]), (2024, 5, "r", "u", [2.0])), root, "rome")
    tables.write_profiles(make((2024, 1, "r", "v", [9.0])), root, "milan")
    tables.write_profiles(make((2024, 5, "r", "w", [3.0])), root, "rome")
    back = lambda *a: rows(stored.read_profiles(spark, root, *a).select("window_week", "user_id"))
    assert back("rome") == [(1, "u"), (5, "w")]
    assert back("milan") == [(1, "v")]
    assert back("rome", [(2024, 5), (2024, 9)]) == [(5, "w")]
    assert back("rome", []) == []
    assert "PartitionFilters: [isnotnull(tag" in stored.read_profiles(spark, root, "rome")._jdf.queryExecution().executedPlan().toString()


def test_sociometer_files_are_sorted_by_region(spark, tmp_path):
    root = str(tmp_path / "s")
    data = [(2024, 1, r, c, 0.5) for r in "dbca" for c in ("y", "x")]
    schema = "window_year int, window_week int, region string, user_class string, share double"
    tables.write_sociometer(spark.createDataFrame(data, schema).repartition(4), root, "t")
    got = [tuple(r) for r in stored.read_sociometer(spark, root, "t").select("region", "user_class").collect()]
    assert got == sorted(got) and len(got) == 8


def test_calls_by_week(spark, tmp_path):
    data = random_calls(200)
    df = calls(spark, data)
    for rebalance in (False, True):
        root = str(tmp_path / f"w{rebalance}")
        tables.write_by_week(df, root, rebalance)
        assert rows(spark.read.parquet(root).select(df.columns)) == rows(df)
        week = data[0][4:]
        tables.write_by_week(df.filter((F.col("iso_year") == week[0]) & (F.col("iso_week") == week[1])).limit(1), root)
        left = spark.read.parquet(root)
        assert left.filter((F.col("iso_year") == week[0]) & (F.col("iso_week") == week[1])).count() == 1
        assert left.select("iso_year", "iso_week").distinct().count() == len({r[4:] for r in data})


def test_series_text(spark, tmp_path):
    when = dt.datetime(2024, 3, 10, 2, 30)
    df = spark.createDataFrame([(7, "visitor", when, "r")], "n_users bigint, user_class string, date timestamp_ntz, region string")
    path = str(tmp_path / "p")
    text.write_timeseries(df, path, text.PRESENCE_COLUMNS)
    assert spark.read.text(path).first()[0] == "r;2024-03-10 02:30:00;visitor;7"
    assert rows(stored.read_timeseries(spark, path, PRESENCE_SERIES)) == [("r", "2024-03-10 02:30:00", "visitor", 7)]
    hourly = spark.createDataFrame([("r", when, "02", 2, ["a", "b"])],
                                   "region string, date timestamp_ntz, hour string, n_calls bigint, cells array<string>")
    path = str(tmp_path / "h")
    text.write_timeseries(hourly, path, text.HOURLY_COLUMNS, sep=",")
    assert rows(stored.read_timeseries(spark, path, HOURLY_SERIES, ",")) == [("r", "2024-03-10 02:30:00", "02", 2, "a b")]


def test_observation_lines(spark, tmp_path):
    df = spark.createDataFrame([("presence-0", "1")], "_id string, value string")
    text.write_observations(df, str(tmp_path / "o"))
    (line,) = [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert json.loads(line) == {"_id": "presence-0", "value": "1"}


def test_catalog_tables(spark):
    tables.drop_tables(spark, "t_counts", "t_missing")
    tables.create_table(spark.range(3), "t_counts")
    tables.create_table(spark.range(5), "t_counts")
    assert spark.table("t_counts").count() == 5
    tables.drop_tables(spark, "t_counts", "t_missing")
    assert not spark.catalog.tableExists("t_counts")


def test_a_store_not_written_yet_is_empty_and_reruns_clear_their_windows(spark, tmp_path):
    root = str(tmp_path / "store")
    assert stored.read_profiles(spark, root, "t", [(2024, 1)]).isEmpty()
    schema = "window_year int, window_week int, region string, user_id string, profile array<double>"
    make = lambda *weeks: spark.createDataFrame(
        [(2024, w, "r", f"u{w}", [0.5]) for w in weeks], schema)
    weeks = [(2024, 1), (2024, 5)]
    tables.write_profiles(make(1, 5, 9), root, "t", weeks)
    tables.write_profiles(make(1), root, "01", weeks)
    tables.write_profiles(make(5), root, "t", weeks)
    left = stored.read_profiles(spark, root, "t").select("window_week").collect()
    assert sorted(r[0] for r in left) == [5, 9]
    assert stored.read_profiles(spark, root, "01").count() == 1
    assert stored.read_profiles(spark, root, "1").isEmpty()
    with pytest.raises(ValueError, match="folder"):
        tables.write_profiles(make(1), root, "a/b")


def _weeks_of(spark, root, tag):
    return rows(stored.read_profiles(spark, root, tag).select("window_week", "user_id"))


def test_a_failed_write_leaves_the_store_as_it_was(spark, tmp_path):
    root, weeks = str(tmp_path / "p"), [(2024, 1), (2024, 5)]
    old = spark.createDataFrame([(2024, 1, "r", "u", [1.0]), (2024, 5, "r", "u", [2.0])], PROFILE)
    tables.write_profiles(old, root, "t", weeks)
    dead = old.withColumn("user_id", F.when(F.col("window_week") == 5, F.raise_error(F.lit("lost"))).otherwise("v"))
    with pytest.raises(Exception, match="lost"):
        tables.write_profiles(dead, root, "t", weeks)
    assert _weeks_of(spark, root, "t") == [(1, "u"), (5, "u")]
    assert not [p for p in (tmp_path / "p").iterdir() if p.name.startswith("_staging")]


@pytest.mark.parametrize("steps", [0, 1, 2])
def test_a_commit_that_dies_is_ended_by_the_next_reader(spark, tmp_path, monkeypatch, steps):
    root, weeks = str(tmp_path / "p"), [(2024, 1), (2024, 5), (2024, 9)]
    make = lambda user, *found: spark.createDataFrame([(2024, w, "r", user, [1.0]) for w in found], PROFILE)
    tables.write_profiles(make("u", 1, 5, 9), root, "t", weeks)
    whole = commit._move

    def dies(spark, root, name, journal):
        lines = journal.splitlines(keepends=True)[:steps]
        monkeypatch.setattr(commit, "_JOURNAL", "_none-")  # the journal and the stage stay
        monkeypatch.setattr(commit, "_STAGE", "_staging-")
        files = commit._files(spark, root)
        for line in lines:
            step, part = line.split()
            place = commit._path(spark, root, part)
            files.delete(place, True)
            if step == "replace":
                files.rename(commit._path(spark, root, "_staging-" + name, part), place)
        raise RuntimeError("driver lost")

    monkeypatch.setattr(commit, "_move", dies)
    with pytest.raises(RuntimeError, match="driver lost"):
        tables.write_profiles(make("v", 1, 5), root, "t", weeks)
    monkeypatch.undo()
    assert commit._move is whole
    assert _weeks_of(spark, root, "t") == [(1, "v"), (5, "v")]
    assert [p.name for p in (tmp_path / "p").iterdir() if p.name[0] == "_"] == []
    tables.write_profiles(make("w", 9), root, "t")
    assert _weeks_of(spark, root, "t") == [(1, "v"), (5, "v"), (9, "w")]


def test_a_store_may_be_rewritten_from_itself_in_one_job(spark, tmp_path):
    root = str(tmp_path / "p")
    data = [(2024, w, "r", "u", [1.0]) for w in range(1, 13)]
    tables.write_profiles(spark.createDataFrame(data, PROFILE), root, "t")
    spark.sparkContext.setJobGroup("rewrite", "")
    own = stored.read_profiles(spark, root, "t").filter("window_week > 2")
    tables.write_profiles(own, root, "t", [(2024, w) for w in range(1, 13)])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rewrite")
    spark.sparkContext.setJobGroup("", "")
    assert sorted(w for w, _ in _weeks_of(spark, root, "t")) == list(range(3, 13))
    assert len(jobs) <= 2  # the exchange and the write


def test_weekly_states_are_stored_week_by_week(spark, tmp_path):
    root = str(tmp_path / "w")
    make = lambda *data: spark.createDataFrame(data, WEEK_STATE_SCHEMA)
    assert stored.read_weekly_states(spark, root).count() == 0
    tables.write_weekly_states(make((2024, 1, "r", "u", 3), (2024, 2, "r", "u", 1)), root)
    tables.write_weekly_states(make((2024, 2, "r", "u", 5), (2024, 3, "r", "v", 7)), root)
    assert rows(stored.read_weekly_states(spark, root).select(*WEEK_STATE_SCHEMA.names)) == [
        (2024, 1, "r", "u", 3), (2024, 2, "r", "u", 5), (2024, 3, "r", "v", 7)]
