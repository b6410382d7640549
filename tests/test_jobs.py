"""The command-line jobs, chained through files."""

import json
import re

from callscape.__main__ import main, study_weeks

from helpers import SITES, random_calls


def test_study_weeks():
    assert study_weeks("2015-12-23", "2016-01-13") == [(2015, 52), (2015, 53), (2016, 1), (2016, 2)]


def test_chain(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    with open(p("calls.csv"), "w") as f:
        for user, cell, when, clock, *_ in random_calls(600):
            f.write(f"{user};;;{when};{clock};0;;;;{cell};;V\n")
        f.write("broken line\n")
    with open(p("cells.csv"), "w") as f:
        f.writelines(f"{site}_x;{region}\n" for site, region in SITES)
    period = ["2014-12-22", "2015-01-29"]

    main(["profiling", p("calls.csv"), p("cells.csv"), "t", *period, "--out", p("profiles"), "--quarantine", p("bad")])
    main(["clustering", p("profiles"), "t", *period, "--k", "4", "--out", p("centroids")])
    main(["classification", p("profiles"), p("centroids"), "t", *period, "--out", p("shares"), "--annotations", p("labels")])
    common = [p("calls.csv"), p("cells.csv"), p("labels/t"), "--grain", "day"]
    main(["presence-series", *common, "--out", p("presence")])
    main(["od-series", *common, "--out", p("od")])
    main(["activity", p("calls.csv"), p("cells.csv"), "--out", p("hourly")])
    main(["peaks", p("calls.csv"), "--base-days", "1", "14", "--from-doy", "15", "--min-diff", "0", "--out", p("peaks")])
    main(["observations", "presence", p("presence"), "--out", p("obs")])
    main(["observations", "od", p("od"), "--out", p("obs_od")])
    main(["observations", "sociometer", p("shares"), "--tag", "t", "--out", p("obs_s")])
    main(["api-records", p("obs"), "Area", "--added-date", "5", "--out", p("api")])

    assert [r[0] for r in spark.read.text(p("bad")).collect()] == ["broken line"]
    n_presence = spark.read.text(p("presence")).count()
    records = [json.loads(r[0]) for r in spark.read.text(p("api")).collect()]
    assert len(records) == n_presence > 0
    assert {r["_id"] for r in records} == {f"Area_presence-{i}" for i in range(n_presence)}
    assert spark.read.text(p("od")).count() == spark.read.json(p("obs_od")).count() > 0
    assert spark.read.parquet(p("shares")).count() == spark.read.json(p("obs_s")).count() > 0
    assert spark.read.parquet(p("peaks")).count() > 0
    assert "," in spark.read.text(p("hourly")).first()[0]


def test_other_jobs(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    (tmp_path / "in").mkdir()
    with open(p("in/calls-20150105.csv"), "w") as f:
        for user, cell, when, clock, *_ in random_calls(3000):
            f.write(f"{user};;;{when};{clock};0;;;;{cell};;V\n")
    with open(p("cells.csv"), "w") as f:
        f.writelines(f"{site}_x;{region}\n" for site, region in SITES)
    with open(p("sites.csv"), "w") as f:
        f.writelines(f"{site};{region}\n" for site, region in SITES)
    with open(p("study.txt"), "w") as f:
        f.write(" 00001_x\n 00002_x\n 00002_x\n")
    calls, cells = p("in/calls-20150105.csv"), p("cells.csv")
    main(["sliding-profiling", calls, cells, "t", "2014-12-22", "2015-01-29", "--size", "2", "--out", p("sliding")])
    starts = spark.read.parquet(p("sliding")).select("window_week").distinct().count()
    assert starts > 2
    main(["weekly-profiling", calls, p("sites.csv"), "--weeks", "2", "4", "--strict-site", "--out", p("weekly")])
    assert {r[0] for r in spark.read.parquet(p("weekly")).select("week").distinct().collect()} == {2, 3, 4}
    main(["store-by-week", calls, "--out", p("stored")])
    assert spark.read.parquet(p("stored")).count() == spark.read.text(calls).count()
    main(["week-coverage", p("in"), "--least", "1", "--out", p("weeks")])
    assert [tuple(r) for r in spark.read.csv(p("weeks")).collect()] == [("2015", "2")]
    main(["peaks", calls, "--cells", p("study.txt"), "--start", "2015-01-01", "--end", "2015-01-25",
          "--base-days", "1", "14", "--from-doy", "15", "--min-diff", "0", "--out", p("peaks")])
    found = spark.read.parquet(p("peaks"))
    assert {r[0] for r in found.select("rid").distinct().collect()} == {"00001_x", "00002_x"}
    assert found.agg({"doy": "max"}).first()[0] <= 25


def test_series_in_a_period(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    with open(p("calls.csv"), "w") as f:
        for user, cell, when, clock, *_ in random_calls(600):
            f.write(f"{user};;;{when};{clock};0;;;;{cell};;V\n")
    with open(p("cells.csv"), "w") as f:
        f.writelines(f"{site}_x;{region}\n" for site, region in SITES)
    spark.createDataFrame([("hot", "0", "resident")], "user_id string, region string, user_class string") \
        .write.parquet(p("known"))
    period = ["--grain", "day", "--start", "2015-01-05", "--end", "2015-01-06"]
    main(["activity", p("calls.csv"), p("cells.csv"), *period, "--out", p("hourly")])
    for job in ("presence-series", "od-series"):
        main([job, p("calls.csv"), p("cells.csv"), p("known"), *period, "--out", p(job)])
    for name in ("hourly", "presence-series", "od-series"):
        days = {re.search(r"\d{4}-\d\d-\d\d", r[0])[0] for r in spark.read.text(p(name)).collect()}
        assert days == {"2015-01-05", "2015-01-06"}
