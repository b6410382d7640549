"""Calendar vocabulary over zone-less timestamps."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weekend definitions in use, as ISO days (Monday = 1).
MONDAY_SUNDAY = (7, 1)
SATURDAY_SUNDAY = (6, 7)
MONDAY_TO_FRIDAY = (1, 2, 3, 4, 5)

# Last hour of the night slot and last hour of the day slot.
SLOT_EDGES = (8, 18)

_DIRECTIVES = {
    "Y": ("yyyy", "yyyy"),
    "y": ("yy", "yy"),
    "m": ("M", "MM"),
    "d": ("d", "dd"),
    "j": ("D", "DDD"),
    "H": ("H", "HH"),
    "M": ("m", "mm"),
    "S": ("s", "ss"),
    "b": ("MMM", "MMM"),
    "p": ("a", "a"),
    "I": ("h", "hh"),
    "f": ("SSSSSS", "SSSSSS"),
}
_COMPOSITES = {"%X": "%H:%M:%S", "%T": "%H:%M:%S", "%x": "%m/%d/%y", "%F": "%Y-%m-%d"}


def datetime_pattern(date_format: str) -> str:
    """Translate a ``%Y-%m-%d`` style format to a Spark pattern; Spark patterns pass through.

    Numbers between separators may come without leading zeros, as ``strptime`` allows;
    numbers that touch each other need their full width.
    """
    if "%" not in date_format:
        return date_format
    for short, long in _COMPOSITES.items():
        date_format = date_format.replace(short, long)
    out = []
    tokens = re.findall(r"%.|[^%]+", date_format)
    for i, token in enumerate(tokens):
        if not token.startswith("%"):
            out.append(re.sub(r"([A-Za-z]+)", r"'\1'", token))
            continue
        if token[1] not in _DIRECTIVES:
            raise ValueError(f"unsupported date directive {token}")
        touching = any(
            0 <= j < len(tokens) and tokens[j].startswith("%") for j in (i - 1, i + 1)
        )
        out.append(_DIRECTIVES[token[1]][touching])
    return "".join(out)


def parse_timestamp(text: Column, pattern: str) -> Column:
    """Text to TIMESTAMP_NTZ, NULL when it does not match, whatever the session time zone.

    The text is read as UTC and moved to the zone-less type by its distance from the epoch,
    so local daylight-saving gaps cannot shift an hour.
    """
    instant = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(pattern + " xx"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def epoch_seconds(date: Column) -> Column:
    """Seconds from the epoch to a zone-less timestamp read as UTC."""
    days = F.date_diff(F.to_date(date), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(date) * 3600 + F.minute(date) * 60 + F.second(date)


def iso_year(date: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), date).cast("int")


def iso_week(date: Column) -> Column:
    return F.weekofyear(date)


def day_of_week(date: Column, base: int = 0) -> Column:
    """Day of the week counted from Monday = ``base``."""
    return F.weekday(date) + F.lit(base)


def is_weekend(date: Column, isodow: Iterable[int] = MONDAY_SUNDAY) -> Column:
    """1 on the given ISO days, else 0."""
    return day_of_week(date, 1).isin(*isodow).cast("int")


def slot_hour(time: Column) -> Column:
    """Hour in the first two characters of the time text; NULL when they are no number."""
    return F.replace(time, F.lit(" "), F.lit("")).substr(1, 2).try_cast("int")


def slot_of_hour(hour: Column, edges: tuple[int, int] = SLOT_EDGES) -> Column:
    """0 up to the first edge hour, 1 up to the second, 2 after it; NULL without an hour."""
    return F.when(hour <= edges[0], 0).when(hour <= edges[1], 1).when(hour.isNotNull(), 2)


def day_slot(time: Column, edges: tuple[int, int] = SLOT_EDGES) -> Column:
    """Slot of the hour a time text starts with."""
    return slot_of_hour(slot_hour(time), edges)


def day_slot_sql(ts: Column) -> Column:
    """1, 2, 3 for [00-08), [08-19), [19-24) of a timestamp."""
    hour = F.hour(ts)
    return F.when(hour < 8, 1).when(hour < 19, 2).when(hour.isNotNull(), 3)


def at_grain(date: Column, grain: str | None) -> Column:
    """Truncate to ``day`` or ``hour``, or keep the full timestamp (``None``).

    Built on dates, not ``date_trunc``: that one goes through the session time zone.
    """
    if grain is None:
        return date
    day = F.to_date(date).cast("timestamp_ntz")
    if grain == "day":
        return day
    if grain == "hour":
        return F.timestamp_add("HOUR", F.hour(date), day)
    raise ValueError(f"unknown grain {grain!r}")
