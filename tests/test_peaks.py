import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from callscape.operators import peaks as P
from callscape.plans.peaks import detect_peaks, peak_ratios

from helpers import calls, plan, random_calls, rows

BASE, FROM = (1, 14), 15


def in_2015(data):
    return [r for r in data if r[2].year == 2015]


def expected_ratios(data, cells):
    counts = Counter()
    for _, cell, when, *_ in data:
        if cell in cells:
            counts[cell, when.hour, when.isoweekday(), when.timetuple().tm_yday] += 1
    samples, analysis = defaultdict(list), {}
    for (cell, hour, dow, doy), n in counts.items():
        if BASE[0] <= doy <= BASE[1]:
            samples[cell, hour, dow].append(n)
        if doy >= FROM:
            analysis[cell, hour, doy, dow] = n
    base = {k: sum(v) / len(v) for k, v in samples.items()}
    day, week = Counter(), Counter()
    for (_, _, doy, _), n in analysis.items():
        day[doy] += n
    for (_, _, dow), n in base.items():
        week[dow] += n
    return {
        (c, h, doy, dow): ((n / day[doy]) / (base[c, h, dow] / week[dow]) - 1, n, base[c, h, dow])
        for (c, h, doy, dow), n in analysis.items() if (c, h, dow) in base
    }


@pytest.fixture(scope="module")
def data():
    return in_2015(random_calls(6000, cells=4))


def test_ratios_by_brute_force(spark, data):
    cells = sorted({r[1] for r in data})[:3]
    got = peak_ratios(P.with_peak_calendar(calls(spark, data)), None, BASE, FROM, n_cells=3)
    found = {(r["rid"], r["hour"], r["doy"], r["dow"]): (r["ratio"], r["anum"], r["bnum"]) for r in got.collect()}
    expected = expected_ratios(data, cells)
    assert found.keys() == expected.keys() and len(found) > 100
    for key, values in expected.items():
        assert found[key] == pytest.approx(values)


@pytest.mark.parametrize("positive_only", [True, False])
def test_peaks_by_brute_force(spark, data, positive_only):
    chosen = spark.createDataFrame([("00001_x",), ("00002_x",), ("00002_x",)], "nidt string")
    got = detect_peaks(
        P.with_peak_calendar(calls(spark, data)), chosen, BASE, FROM, min_diff=1, positive_only=positive_only
    )
    expected = []
    for key, (ratio, a, b) in expected_ratios(data, {"00001_x", "00002_x"}).items():
        r = round(ratio, 12)
        if abs(r) >= 0.2 and abs(a - b) >= 1 and (r > 0 or not positive_only):
            x = abs(r / 0.1) - 0.5
            bucket = math.floor(x + 0.5) * 0.1 * math.copysign(1, r)
            expected.append((*key, round(bucket, 6), round(abs(ratio), 6), round(abs(a - b), 6)))
    rounded = got.select("rid", "hour", "doy", "dow", F.round("ratio", 6), F.round("abs_ratio", 6), F.round("abs_diff", 6))
    assert rows(rounded) == sorted(expected, key=repr) and expected


def test_frames_and_sql_agree(spark, data):
    P.with_peak_calendar(calls(spark, data)).createOrReplaceTempView("test_calls")
    chain = spark.sql(f"""
        WITH counts AS (SELECT id, hour, dow, doy, count(*) AS num FROM test_calls GROUP BY ALL),
        picked AS (SELECT DISTINCT id FROM test_calls ORDER BY id LIMIT 10),
        studied AS (SELECT * FROM counts LEFT SEMI JOIN picked USING (id)),
        base AS (SELECT id, hour, dow, avg(num) AS num FROM studied
                 WHERE doy BETWEEN {BASE[0]} AND {BASE[1]} GROUP BY ALL),
        later AS (SELECT * FROM studied WHERE doy >= {FROM})
        SELECT l.id AS rid, l.hour, l.doy, l.dow, round(
                 (l.num / sum(l.num) OVER (PARTITION BY l.doy)) / (b.num / t.num) - 1, 9) AS ratio
        FROM later l LEFT JOIN base b USING (id, hour, dow)
        LEFT JOIN (SELECT dow, sum(num) AS num FROM base GROUP BY dow) t USING (dow)""")
    ratios = peak_ratios(P.with_peak_calendar(calls(spark, data)), None, BASE, FROM)
    got = ratios.select("rid", "hour", "doy", "dow", F.round("ratio", 9))
    assert rows(got) == rows(chain.filter("ratio is not null"))


def test_calls_are_scanned_once(spark, data, tmp_path):
    path = str(tmp_path / "calls")
    calls(spark, data).write.parquet(path)
    ratios = peak_ratios(P.with_peak_calendar(spark.read.parquet(path)), None, BASE, FROM)
    text = plan(ratios)  # everything reads the stored counts
    assert "FileScan" in text and path not in text


def test_buckets(spark):
    values = [0.25, -0.25, 0.2, 1.0, 0.0, 0.349]
    df = spark.createDataFrame([(v,) for v in values], "r double")
    got = [round(r[0], 6) for r in df.select(P.bucket_ratio(F.col("r"))).collect()]
    assert got == [0.2, -0.2, 0.2, 1.0, 0.0, 0.3]


def test_study_cells_are_the_first_in_order(spark, data):
    got = P.study_cells(P.with_peak_calendar(calls(spark, data)), 2).collect()
    assert [r[0] for r in got] == ["00000_x", "00001_x"]


def test_all_cells_are_studied_unless_told(spark):
    data = in_2015(random_calls(4000, cells=25))
    frame = P.with_peak_calendar(calls(spark, data))
    found = {r["rid"] for r in peak_ratios(frame, None, BASE, FROM).select("rid").distinct().collect()}
    assert len(found) > 10
    few = peak_ratios(frame, None, BASE, FROM, n_cells=2).select("rid").distinct().count()
    assert few == 2


def test_years_do_not_multiply_rows(spark, data):
    later = [(u, c, w.replace(year=2016), *rest) for u, c, w, *rest in data if w.month != 2 or w.day != 29]
    frame = P.with_peak_calendar(calls(spark, data + later))
    counts = P.call_counts(frame)
    base = P.peak_base(counts, None, BASE)
    analysis = P.peak_analysis(counts, None, FROM)
    ratios = P.peak_ratio(analysis, base)
    assert ratios.count() <= analysis.count()
    one = peak_ratios(P.with_peak_calendar(calls(spark, data)), None, BASE, FROM)
    both = ratios.filter("year = 2015").select("rid", "hour", "doy", "dow", F.round("ratio", 9))
    assert rows(both) == rows(one.select("rid", "hour", "doy", "dow", F.round("ratio", 9)))


def test_hour_comes_from_the_time_field(spark):
    frame = spark.sql("""
        SELECT 'a' AS start_cell, TIMESTAMP_NTZ '2015-01-05 00:00:00' AS date, time
        FROM VALUES ('142700'), ('20:28'), ('x'), (NULL) AS t(time)""")
    bare = P.with_peak_calendar(frame, clock_in_date=False)
    assert sorted(r["hour"] for r in bare.collect()) == [14, 20]
    assert sorted(r["hour"] for r in P.with_peak_calendar(frame).collect()) == [0, 0, 14, 20]


def test_period(spark, data):
    frame = calls(spark, data)
    by_date = P.with_peak_calendar(P.in_period(frame, "2015-01-03", "2015-01-20"))
    by_calendar = P.during(P.with_peak_calendar(frame), "2015-01-03", "2015-01-20")
    assert rows(by_date) == rows(by_calendar) and 0 < by_date.count() < frame.count()
