"""Call-record text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.functions.calendar import datetime_pattern, iso_week, iso_year, parse_timestamp
from callscape.scale import scratch_path
from callscape.schema import CdrLayout

# The default and the strict date formats, and the field separator.
DATE_FORMAT = "%Y-%m-%d %X"
STRICT_PATTERN = "yyyy-MM-dd HH:mm:ss"
SEPARATOR = ";"

WHITESPACE = " \t\n\r\x0b\x0c"


def _extracted(lines: DataFrame, sep: str, line: Column, fields) -> DataFrame:
    """``lines`` with the columns ``fields`` makes of the split line.

    They come out of a one-row generator. A plain projection would be copied into every
    filter on its results, and each line would be split and its date parsed several times.
    """
    parts = lines.withColumn("_parts", F.split(line, r"\Q" + sep + r"\E", -1))
    record = F.struct(*[column.alias(name) for name, column in fields(F.col("_parts")).items()])
    return parts.select(*lines.columns, F.inline(F.array(record)))


def _all_present(names) -> Column:
    usable = F.lit(True)
    for name in names:
        usable = usable & F.col(name).isNotNull()
    return usable


def _tolerant_fields(lines: DataFrame, layout: CdrLayout, date_format: str, sep: str) -> DataFrame:
    """Every named field as trimmed text, and the date parsed; what is missing is NULL."""
    pattern = datetime_pattern(date_format)

    def fields(parts: Column) -> dict[str, Column]:
        text = {
            name: F.trim(F.get(parts, F.lit(ordinal)), F.lit(WHITESPACE))
            for name, ordinal in layout.fields.items()
        }
        return {**text, "date": parse_timestamp(text["date"], pattern)}

    return _extracted(lines, sep, F.col("value"), fields)


def _with_week(cdr: DataFrame) -> DataFrame:
    return cdr.withColumns({"iso_year": iso_year(F.col("date")), "iso_week": iso_week(F.col("date"))})


def parse_cdr(
    lines: DataFrame,
    layout: CdrLayout | None = None,
    date_format: str = DATE_FORMAT,
    sep: str = SEPARATOR,
) -> DataFrame:
    """Call records from a ``value`` column of text lines; unusable lines are left out.

    Other columns of ``lines`` are carried along.
    """
    layout = layout or CdrLayout.default()
    parsed = _tolerant_fields(lines, layout, date_format, sep)
    return _with_week(parsed.filter(_all_present(layout.fields)).drop("value"))


def rejected_lines(
    lines: DataFrame,
    layout: CdrLayout | None = None,
    date_format: str = DATE_FORMAT,
    sep: str = SEPARATOR,
) -> DataFrame:
    """The lines :func:`parse_cdr` leaves out."""
    layout = layout or CdrLayout.default()
    parsed = _tolerant_fields(lines, layout, date_format, sep)
    return parsed.filter(~_all_present(layout.fields)).select(*lines.columns)


def parse_cdr_strict(
    lines: DataFrame, layout: CdrLayout | None = None, sep: str = SEPARATOR
) -> DataFrame:
    """Call records with an integer ``time``; any unusable line fails the job.

    Nothing is trimmed, and separators at the end of a line do not make fields.
    """
    layout = layout or CdrLayout.default()
    names = [n for n in ("user_id", "start_cell", "end_cell", "date", "time") if n in layout.fields]

    def fields(parts: Column) -> dict[str, Column]:
        text = {name: F.get(parts, F.lit(layout.fields[name])) for name in names}
        return {
            **text,
            "date": parse_timestamp(text["date"], STRICT_PATTERN),
            "time": F.when(text["time"].rlike(r"^[+-]?\d+$"), text["time"].try_cast("int")),
        }

    line = F.regexp_replace("value", "(" + r"\Q" + sep + r"\E" + ")+$", "")
    parsed = _extracted(lines, sep, line, fields)
    message = F.concat(F.lit("unusable call record: "), F.col("value"))
    checked = parsed.filter(
        F.when(_all_present(names), F.lit(True)).otherwise(F.raise_error(message))
    )
    return _with_week(checked.drop("value"))


def read_cdr(
    spark: SparkSession,
    path: str | list[str],
    layout: CdrLayout | None = None,
    date_format: str = DATE_FORMAT,
    sep: str = SEPARATOR,
    mode: str = "tolerant",
    quarantine_path: str | None = None,
) -> DataFrame:
    """Read call-record text files.

    ``mode='tolerant'`` drops unusable lines; ``mode='strict'`` fails on the first one. With a
    ``quarantine_path`` the lines are parsed once into an intermediate table with a folder for
    either kind; the unusable ones are stored from there, and the records read from there.
    """
    lines = spark.read.text(path)
    if mode == "strict":
        return parse_cdr_strict(lines, layout, sep)
    if mode != "tolerant":
        raise ValueError(f"unknown mode {mode!r}")
    if quarantine_path is None:
        return parse_cdr(lines, layout, date_format, sep)
    layout = layout or CdrLayout.default()
    parsed = _tolerant_fields(lines, layout, date_format, sep)
    usable = _all_present(layout.fields)
    both = parsed.withColumn("rejected", ~usable).withColumn(
        "value", F.when(F.col("rejected"), F.col("value")))
    place = scratch_path(spark, "parsed")
    both.write.partitionBy("rejected").parquet(place)
    both = spark.read.schema(both.schema).parquet(place)
    both.filter("rejected").select("value").write.mode("overwrite").text(quarantine_path)
    return _with_week(both.filter("not rejected").drop("value", "rejected"))
