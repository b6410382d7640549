"""Call-record views of the given tables.

``events`` serves as call records, ``nation`` as the cell dimension: a site is a five-digit
nation key, its region the region key. Cells outside the known sites exist on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.functions.calendar import iso_week, iso_year
from callscape.operators.windows import assign_tumbling
from callscape.schema import CdrLayout

# The period of the events table.
START = "2024-01-01"
END = "2024-01-30"

# First weeks of its windows.
WINDOWS = [(2024, 1), (2024, 5)]

# Peak periods that fit it.
BASE_DAYS = (1, 21)
FROM_DAY = 22
MIN_DIFF = 2

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


# Known schemas spare the job that would look into the files for them.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def cdr(spark: SparkSession, sf: str) -> DataFrame:
    """Call records. The clock is put together from its parts: formatting a timestamp would go
    through the session time zone."""
    site = F.lpad(F.regexp_extract("props", r'"k":\s*(\d+)', 1), 5, "0")
    clock = F.hour("ts") * 10000 + F.minute("ts") * 100 + F.second("ts")
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws("_", site, "event_type").alias("start_cell"),
        F.col("ts").alias("date"),
        F.lpad(clock.cast("string"), 6, "0").alias("time"),
        F.col("event_type").alias("cdr_type"),
        iso_year(F.col("ts")).alias("iso_year"),
        iso_week(F.col("ts")).alias("iso_week"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Site to region."""
    return table(spark, sf, "nation").select(
        F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("cell_id"),
        F.col("n_regionkey").cast("string").alias("region"),
    )


def full_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Full cell name to region: each site has one cell per event type."""
    kinds = F.explode(F.array(*[F.lit(kind) for kind in EVENT_TYPES])).alias("kind")
    return cells(spark, sf).select("*", kinds).select(
        F.concat_ws("_", "cell_id", "kind").alias("cell_id"), "region"
    )


def cdr_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Call records as text lines: padded fields, and some lines that are cut short or carry a
    date that does not exist."""
    calls = cdr(spark, sf)
    day = F.substring(F.col("date").cast("string"), 1, 19)
    site = F.substring("start_cell", 1, 5).cast("int")
    broken = F.when((F.col("cdr_type") == "error") & (site < 50), F.lit("2024-02-30 00:00:00"))
    blank = F.lit("")
    line = F.concat_ws(
        ";",
        F.concat(F.lit(" "), F.col("user_id")), blank, blank, F.coalesce(broken, day),
        F.concat(F.col("time"), F.lit("\t")), F.lit("0"), blank, blank, blank,
        "start_cell", blank, "cdr_type",
    )
    cut = (F.col("cdr_type") == "signup") & (site >= 90)
    return calls.select("event_id", F.when(cut, F.substring_index(line, ";", 7)).otherwise(line).alias("value"))


def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Call records as well-formed lines for strict reading."""
    day = F.substring(F.col("date").cast("string"), 1, 19)
    blank = F.lit("")
    return cdr(spark, sf).select(
        "event_id",
        F.concat_ws(
            ";", "user_id", blank, blank, day, "time", F.lit("0"), blank, blank, blank,
            "start_cell", "cdr_type", "cdr_type",
        ).alias("value"),
    )


# A layout in which the date has no clock.
SPLIT_CLOCK = CdrLayout(
    {"cdr_type": 0, "user_id": 1, "date": 3, "time": 4, "start_cell": 9, "end_cell": 11})


def split_clock_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Call records as lines of that layout, below a header."""
    day = F.replace(F.substring(F.col("date").cast("string"), 1, 10), F.lit("-"), F.lit(""))
    blank = F.lit("")
    lines = cdr(spark, sf).select(F.concat_ws(
        ";", "cdr_type", "user_id", blank, day, "time", F.lit("0"), blank, blank, blank,
        "start_cell", F.lit("11"), blank).alias("value"))
    header = F.lit("TYPE;USER;;DATE;TIME;;;;;CELL;;")
    return lines.unionByName(spark.range(1).select(header.alias("value")))


def in_study(df: DataFrame) -> DataFrame:
    return assign_tumbling(df, START, END)
