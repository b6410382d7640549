"""Small synthetic call records and plan inspection."""

import datetime as dt
import random

CALL_SCHEMA = (
    "user_id string, start_cell string, date timestamp_ntz, time string, iso_year int, iso_week int"
)


def call(user, cell, when):
    iso = when.isocalendar()
    return user, cell, when, when.strftime("%H%M%S"), iso[0], iso[1]


def random_calls(n, users=6, cells=12, start=dt.datetime(2014, 12, 22), days=40, seed=7):
    """Calls of which a third come from one user, with repeats."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(users)}"
        when = start + dt.timedelta(days=rng.randrange(days), seconds=rng.randrange(86400))
        rows.append(call(user, f"{rng.randrange(cells):05d}_x", when))
    return rows + rows[: n // 4]


def calls(spark, rows):
    return spark.createDataFrame(rows, CALL_SCHEMA)


SITES = [(f"{i:05d}", str(i % 3)) for i in range(8)]


def sites(spark):
    return spark.createDataFrame(SITES, "cell_id string, region string")


REGION_OF = dict(SITES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
