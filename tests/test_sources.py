import datetime as dt

import pytest
from pyspark.sql import functions as F

from callscape.operators.cluster import read_archetypes
from callscape.schema import CdrLayout
from callscape.sources import coverage
from callscape.sources.annotations import parse_annotations, read_annotations
from callscape.sources.cdr import parse_cdr, parse_cdr_strict, read_cdr, rejected_lines
from callscape.sources.dimensions import parse_cells, read_cells

from helpers import rows

GOOD = " u1 ;;;2015-06-03 10:11:12;101112;60;;;;00001_a;00002_b;VOICE "


def test_tolerant_parse(lines):
    got = parse_cdr(lines(GOOD)).first().asDict()
    assert got == {
        "user_id": "u1", "date": dt.datetime(2015, 6, 3, 10, 11, 12), "time": "101112",
        "start_cell": "00001_a", "end_cell": "00002_b", "cdr_type": "VOICE",
        "iso_year": 2015, "iso_week": 23,
    }


BAD = [
    "user;a;b;date;time;d;e;f;g;cell;cell;type",          # a header
    "u1;;;2015-06-03 10:11:12;101112;60;;;;00001_a",       # cut short
    "u1;;;2015-06-31 10:11:12;101112;60;;;;c;d;e",         # no such day
    "u1;;;;101112;60;;;;c;d;e",                            # no date
    "",
]


def test_tolerant_parse_sets_bad_lines_apart(lines):
    df = lines(GOOD, *BAD, GOOD)
    assert parse_cdr(df).count() == 2
    assert sorted(r["value"] for r in rejected_lines(df).collect()) == sorted(BAD)


def test_each_line_is_split_once(lines):
    from helpers import plan

    text = plan(parse_cdr(lines(GOOD)))
    assert text.count("split(") == 1
    assert text.count("gettimestamp(") + text.count("try_to_timestamp(") <= 1


def test_operator_layout(lines):
    layout = CdrLayout({"user_id": 1, "date": 3, "time": 4, "start_cell": 9, "end_cell": 11,
                        "cdr_type": 0, "postcode": 20})
    fields = ["SMS", "77", "", "20150603", "235900"] + [""] * 4 + ["00011_c", "22", ""]
    line = ";".join(fields + [""] * 8 + ["00100", "TOWN"])
    got = parse_cdr(lines(line, line[: line.rindex(";00100")]), layout, "%Y%m%d").collect()
    assert len(got) == 1
    assert (got[0]["user_id"], got[0]["end_cell"], got[0]["postcode"]) == ("77", "", "00100")
    assert got[0]["date"] == dt.datetime(2015, 6, 3)


def test_other_separator(lines):
    assert parse_cdr(lines(GOOD.replace(";", "|")), sep="|").first()["user_id"] == "u1"


def test_layout_file(spark, tmp_path):
    (tmp_path / "fields.csv").write_text("user_id,0\ndate,3\ntime,4\nstart_cell,9\n")
    layout = CdrLayout.load(spark, str(tmp_path / "fields.csv"))
    assert layout.fields == {"user_id": 0, "date": 3, "time": 4, "start_cell": 9}
    with pytest.raises(ValueError):
        CdrLayout({"user_id": 0})


def test_read_with_quarantine(spark, tmp_path):
    (tmp_path / "in.csv").write_text("\n".join([GOOD, *BAD[:4], GOOD]) + "\n")
    kept = read_cdr(spark, str(tmp_path / "in.csv"), quarantine_path=str(tmp_path / "bad"))
    assert kept.count() == 2
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "bad")).collect()) == sorted(BAD[:4])
    with pytest.raises(ValueError):
        read_cdr(spark, str(tmp_path / "in.csv"), mode="lax")


STRICT = "u1;;;2015-06-03 10:11:12;101112;60;;;;c1;c2;VOICE"


def test_strict_parse(lines):
    got = parse_cdr_strict(lines(STRICT)).first()
    assert (got["time"], got["end_cell"], got["iso_week"]) == (101112, "c2", 23)


@pytest.mark.parametrize(
    "line",
    [
        STRICT.replace("101112", "10:11"),
        STRICT.replace("10:11:12;", "10:11;"),
        "u1;;;2015-06-03 10:11:12;101112;60;;;;c1;;",  # separators at the end make no fields
        "",
    ],
)
def test_strict_parse_fails_even_if_no_column_is_read(lines, line):
    with pytest.raises(Exception, match="unusable call record"):
        parse_cdr_strict(lines(STRICT, line)).count()


def test_last_cell_line_wins_however_the_file_is_split(spark, tmp_path):
    path = tmp_path / "cells.csv"
    path.write_text("".join(f"{i % 50:05d}x;r{i}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        cells = read_cells(spark, str(path))
        sites = read_cells(spark, str(path), key="prefix")
        got, by_site = rows(cells), rows(sites)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((f"{i:05d}x", f"r{1950 + i}") for i in range(50))
    assert by_site == sorted((f"{i:05d}", f"r{1950 + i}") for i in range(50))


def test_cell_lines(lines):
    numbered = lines(" c1 ; a ", "", "c1;b;more", "c2;c").withColumn("n", F.monotonically_increasing_id())
    assert rows(parse_cells(numbered, F.col("n"))) == [("c1", "b"), ("c2", "c")]
    fan = parse_cells(numbered, F.col("n"), on_duplicate="fanout")
    assert rows(fan) == [("c1", "a"), ("c1", "b"), ("c2", "c")]
    with pytest.raises(Exception, match="without a region"):
        parse_cells(lines("c1;a", "c2"), F.lit(1)).collect()
    with pytest.raises(ValueError):
        parse_cells(numbered, F.col("n"), key="suffix")


def test_annotation_formats(spark, lines, tmp_path):
    got = rows(parse_annotations(lines("((u'1', 'north west'), 'passing by')", "(u'2', '4', 'visitor')",
                                       "(('3', u'5'), u'commuter')")))
    assert got == [("1", "north west", "passing by"), ("2", "4", "visitor"), ("3", "5", "commuter")]
    with pytest.raises(Exception, match="not an annotation"):
        parse_annotations(lines("junk")).collect()
    (tmp_path / "a.txt").write_text("(u'2', '4', 'visitor')\n")
    assert rows(read_annotations(spark, str(tmp_path / "a.txt"), "legacy")) == [("2", "4", "visitor")]
    with pytest.raises(ValueError):
        read_annotations(spark, "x", "csv")


def test_weeks_from_file_names(spark, tmp_path):
    for name in ("calls_20151231.csv", "calls_20160103.csv", "calls_20160104.csv", "notes.txt"):
        (tmp_path / name).write_text("x")
    assert rows(coverage.weeks_in_path(spark, str(tmp_path))) == [(2015, 53), (2016, 1)]
    assert coverage.files_in_path(spark, str(tmp_path)).count() == 3


def test_archetype_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("5;resident; 1.0;0.5\n5;visitor;0.0;0.1\n")
    got = read_archetypes(spark, str(tmp_path / "t.csv")).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(0, "resident", [1.0, 0.5]), (1, "visitor", [0.0, 0.1])]
