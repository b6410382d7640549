"""Run the registered queries and their SQL counterparts side by side.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import tempfile
import time
from datetime import date
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES


def normalised(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    for column in frame.columns:
        if pd.api.types.is_datetime64_any_dtype(frame[column]):
            frame = frame.assign(**{column: frame[column].astype("datetime64[us]").map(str)})
        elif pd.api.types.is_object_dtype(frame[column]):
            frame = frame.assign(
                **{column: frame[column].map(lambda x: str(pd.Timestamp(x)) if isinstance(x, date) else str(x))}
            )
    return sorted(map(tuple, frame.itertuples(index=False)))


def sql_tables(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def compare(spark: SparkSession, db: duckdb.DuckDBPyConnection, sf: str, name: str) -> str:
    started = time.time()
    result = QUERIES[name](spark, sf)
    types = {f.name: f.dataType.simpleString() for f in result.schema.fields}
    got = result.toPandas()
    took = time.time() - started
    if name not in ORACLE:
        return f"rows-only  {len(got):>7} rows {took:6.2f}s"
    wanted = db.execute(ORACLE[name]).df()
    if sorted(got.columns) != sorted(wanted.columns):
        return f"COLUMNS DIFFER {sorted(got.columns)} {sorted(wanted.columns)}"
    a, b = normalised(got), normalised(wanted)
    if a == b:
        return f"equal      {len(a):>7} rows {took:6.2f}s"
    extra, missing = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"DIFFERS {len(a)} vs {len(b)} rows; only here {extra}; only there {missing}; {types}"


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="callscape-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = sql_tables(sf)
    bad = 0
    for name in names:
        try:
            verdict = compare(spark, db, sf, name)
        except Exception as error:  # report and go on with the next query
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += verdict.split()[0] not in ("equal", "rows-only")
        print(f"{name:32} {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
