"""Jobs for spark-submit: ``python -m callscape <job> ...``.

Inputs and outputs are paths any executor can reach. Session settings come from the cluster.
"""

from __future__ import annotations

import argparse
import datetime as dt
import re

from pyspark.sql import SparkSession

from callscape.operators import classify, cluster, presence, publish, windows
from callscape.functions.calendar import datetime_pattern
from callscape.operators.peaks import in_period, with_peak_calendar
from callscape.operators.profile import (
    calling_activity,
    merge_weeks,
    profile_vectors,
    untimed_records,
    user_profile_sql,
    weekly_states,
)
from callscape.plans.peaks import detect_peaks
from callscape.scale import cut_lineage
from callscape.schema import OD_SERIES, PRESENCE_SERIES, CdrLayout
from callscape.sinks import tables, text
from callscape.sources import stored
from callscape.sources.annotations import read_annotations
from callscape.sources.cdr import DATE_FORMAT, read_cdr
from callscape.sources.coverage import weeks_in_path
from callscape.sources.dimensions import read_cell_list, read_cells


def study_weeks(start: str, end: str) -> list[tuple[int, int]]:
    """ISO weeks from ``start``, by steps of seven days, up to ``end``."""
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    steps = (last - first).days // 7
    return [(first + dt.timedelta(weeks=i)).isocalendar()[:2] for i in range(steps + 1)]


def _calls(spark, args):
    layout = CdrLayout.load(spark, args.layout) if args.layout else CdrLayout.default()
    return read_cdr(spark, args.cdr, layout, args.date_format, mode=args.mode,
                    quarantine_path=args.quarantine)


def profiling(spark, args):
    cells, calls = read_cells(spark, args.cells, key=args.key), _calls(spark, args)
    if args.quarantine:
        untimed_records(calls).write.mode("overwrite").parquet(f"{args.quarantine}-untimed")
    activity = calling_activity(calls, cells, args.start, args.end, key=args.key,
                                strict_site=args.strict_site)
    weeks = study_weeks(args.start, args.end)
    tables.write_profiles(profile_vectors(activity), args.out, args.tag, weeks)


def sliding_profiling(spark, args):
    """Profiles over overlapping windows of the complete weeks, of which there must be enough."""
    cells = read_cells(spark, args.cells, key=args.key)
    calls = cut_lineage(in_period(_calls(spark, args), args.start, args.end))
    weeks = windows.require_weeks(windows.complete_weeks(calls), args.size)
    states = weekly_states(calls, cells, key=args.key, strict_site=args.strict_site)
    activity = merge_weeks(states, weeks, args.size, args.shift)
    tables.write_profiles(
        profile_vectors(activity), args.out, args.tag, study_weeks(args.start, args.end))


def weekly_profiling(spark, args):
    """Active days per user, area, week, weekend flag and slot."""
    cells = read_cells(spark, args.cells, key="prefix")
    found = user_profile_sql(
        _calls(spark, args), cells, tuple(args.weeks), strict_site=args.strict_site)
    found.write.mode("overwrite").parquet(args.out)


def store_by_week(spark, args):
    tables.write_by_week(_calls(spark, args), args.out, rebalance=not args.ordered)


def week_coverage(spark, args):
    """The weeks that a folder of dated files covers, of which there must be enough."""
    weeks = windows.require_weeks(weeks_in_path(spark, args.files, args.name_regex), args.least)
    weeks.write.mode("overwrite").csv(args.out)


def clustering(spark, args):
    weeks = study_weeks(args.start, args.end)
    profiles = stored.read_profiles(spark, args.profiles, args.tag, weeks)
    typical = cluster.read_archetypes(spark, args.archetypes) if args.archetypes \
        else cluster.archetypes(spark)
    centroids = cluster.fit_clusters(
        profiles, k=args.k, sample_fraction=args.fraction, seed=args.seed
    )
    tables.write_centroids(cluster.label_centroids(centroids, typical), args.out, args.tag, weeks)


def classification(spark, args):
    weeks = study_weeks(args.start, args.end)
    profiles = stored.read_profiles(spark, args.profiles, args.tag, weeks)
    centroids = stored.read_centroids(spark, args.centroids, args.tag, weeks)
    classified = cut_lineage(classify.classify(profiles, centroids))
    tables.write_sociometer(classify.sociometer(classified), args.out, args.tag, weeks)
    tables.write_annotations(classify.annotate_global(classified), args.annotations, args.tag)


def _calls_in_period(spark, args):
    return in_period(_calls(spark, args), args.start, args.end)


def _labelled(spark, args):
    return (
        _calls_in_period(spark, args),
        read_cells(spark, args.cells, key="prefix"),
        read_annotations(spark, args.annotations, args.annotation_format),
    )


def presence_series(spark, args):
    series = presence.presence(
        *_labelled(spark, args), grain=args.grain, strict_site=args.strict_site)
    text.write_timeseries(series, args.out, text.PRESENCE_COLUMNS)


def od_series(spark, args):
    series = presence.od_matrix(
        *_labelled(spark, args), grain=args.grain, strict_site=args.strict_site)
    text.write_timeseries(series, args.out, text.OD_COLUMNS)


def activity(spark, args):
    cells = read_cells(spark, args.cells, key=args.key)
    hourly = presence.hourly_activity(_calls_in_period(spark, args), cells, args.grain, key=args.key,
                                      strict_site=args.strict_site)
    text.write_timeseries(hourly, args.out, text.HOURLY_COLUMNS, sep=",")


def _has_clock(date_format: str) -> bool:
    """Whether dates in this format carry an hour."""
    bare = re.sub(r"'[^']*'", "", datetime_pattern(date_format))
    return bool(re.search("[HhKk]", bare))


def peaks(spark, args):
    calls = _calls_in_period(spark, args)
    found = detect_peaks(
        with_peak_calendar(calls, clock_in_date=_has_clock(args.date_format)),
        read_cell_list(spark, args.cells) if args.cells else None,
        tuple(args.base_days), args.from_doy, args.n_cells,
        min_ratio=args.min_ratio, min_diff=args.min_diff,
    )
    found.write.mode("overwrite").parquet(args.out)


def observations(spark, args):
    if args.kind == "presence":
        found = publish.presence_observations(stored.read_timeseries(spark, args.series, PRESENCE_SERIES))
    elif args.kind == "od":
        found = publish.od_observations(stored.read_timeseries(spark, args.series, OD_SERIES))
    else:
        shares = stored.read_sociometer(spark, args.series, args.tag)
        found = publish.sociometer_observations(shares, args.legacy_week)
    text.write_observations(found, args.out)


def api_records(spark, args):
    names = ["_id", "value", "date", "region_id", "description", "indicator_id", "indicator_name"]
    found = spark.read.schema(", ".join(f"`{n}` string" for n in names)).json(args.observations)
    added = args.added_date or int(dt.datetime.now(dt.timezone.utc).timestamp())
    records = publish.to_api_records(found, args.indicator, added, args.time_zone)
    publish.as_json(records).write.mode("overwrite").text(args.out)


def _add_period(sub):
    sub.add_argument("--start", help="first day")
    sub.add_argument("--end", help="last day")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="callscape")
    jobs = parser.add_subparsers(required=True)

    def job(run, *positional, cdr=False):
        sub = jobs.add_parser(run.__name__.replace("_", "-"))
        sub.set_defaults(run=run)
        for name in positional:
            sub.add_argument(name)
        sub.add_argument("--out", required=True)
        if cdr:
            sub.add_argument("--layout", help="file of name,ordinal lines")
            sub.add_argument("--date-format", default=DATE_FORMAT)
            sub.add_argument("--mode", choices=["tolerant", "strict"], default="tolerant")
            sub.add_argument("--quarantine", help="where unusable lines go")
            sub.add_argument("--strict-site", action="store_true",
                             help="cells shorter than a site have no site")
        return sub

    for run in (profiling, sliding_profiling):
        sub = job(run, "cdr", "cells", "tag", "start", "end", cdr=True)
        sub.add_argument("--key", choices=["exact", "prefix"], default="exact")
    sub.add_argument("--size", type=int, default=windows.WINDOW_WEEKS)
    sub.add_argument("--shift", type=int, default=1)
    job(weekly_profiling, "cdr", "cells", cdr=True).add_argument(
        "--weeks", type=int, nargs=2, default=[8, 12], help="first and last ISO week number")
    job(store_by_week, "cdr", cdr=True).add_argument(
        "--ordered", action="store_true", help="input files hold few weeks each: no shuffle")
    sub = job(week_coverage, "files")
    sub.add_argument("--name-regex", default=r"(\d{8})[^/]*$")
    sub.add_argument("--least", type=int, default=windows.WINDOW_WEEKS)
    sub = job(clustering, "profiles", "tag", "start", "end")
    sub.add_argument("--archetypes", help="file of id;label;values lines")
    sub.add_argument("--k", type=int, default=cluster.CLUSTERS)
    sub.add_argument("--fraction", type=float, default=1.0)
    sub.add_argument("--seed", type=int, default=42)
    job(classification, "profiles", "centroids", "tag", "start", "end").add_argument(
        "--annotations", required=True)
    for run in (presence_series, od_series):
        sub = job(run, "cdr", "cells", "annotations", cdr=True)
        sub.add_argument("--annotation-format", choices=["parquet", "legacy"], default="parquet")
        sub.add_argument("--grain", choices=["day", "hour"])
        _add_period(sub)
    sub = job(activity, "cdr", "cells", cdr=True)
    sub.add_argument("--grain", choices=["day", "hour"])
    _add_period(sub)
    sub.add_argument("--key", choices=["exact", "prefix"], default="exact")
    sub = job(peaks, "cdr", cdr=True)
    sub.add_argument("--base-days", type=int, nargs=2, default=[32, 58])
    sub.add_argument("--from-doy", type=int, default=59)
    sub.add_argument("--cells", help="file of the cells to study; default: all")
    sub.add_argument("--n-cells", type=int, help="study the first cells in order only")
    _add_period(sub)
    sub.add_argument("--min-ratio", type=float, default=0.2)
    sub.add_argument("--min-diff", type=float, default=50)
    sub = job(observations, "kind", "series")
    sub.add_argument("--tag")
    sub.add_argument("--legacy-week", action="store_true")
    sub = job(api_records, "observations", "indicator")
    sub.add_argument("--added-date", type=int)
    sub.add_argument("--time-zone", default="UTC")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    args.run(SparkSession.builder.appName("callscape").getOrCreate(), args)


if __name__ == "__main__":
    main()
