"""Registered queries. Each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscape.functions import calendar as cal
from callscape.functions.vectors import euclidean, nonzero_count, vector_sum
from callscape.operators import classify as C
from callscape.operators import distinct_users as D
from callscape.operators import cluster as K
from callscape.operators import peaks as P
from callscape.operators import presence as B
from callscape.operators import publish as O
from callscape.operators import windows as W
from callscape.operators.profile import (
    calling_activity,
    merge_weeks,
    profile_vectors,
    untimed_records,
    user_profile,
    user_profile_sql,
    weekly_states,
)
from callscape.operators.spatial import attach_region, site
from callscape.plans.peaks import detect_peaks, peak_ratios
from callscape.plans.sociometer import run_sociometer
from callscape.scale import cut_lineage, lookup_join, scratch_path
from callscape.schema import HOURLY_SERIES, OD_SERIES, PASSING_BY, PRESENCE_SERIES
from callscape.sinks import tables as sink
from callscape.sinks import text as text_sink
from callscape.sources import stored
from callscape.sources.annotations import parse_annotations, read_annotations
from callscape.sources.cdr import parse_cdr, parse_cdr_strict, rejected_lines
from callscape.sources.coverage import weeks_in_path
from callscape.sources.dimensions import parse_cells
from checks import standins as S

TAG = "check"
KMEANS_K = 20
ADDED_DATE = 1_700_000_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query, name: str | None = None) -> Query:
    QUERIES[name or fn.__name__] = fn
    return fn


def named(name: str):
    return lambda fn: query(fn, name)


# Shared inputs ------------------------------------------------------------------------------


def _activity(spark, sf):
    return calling_activity(S.cdr(spark, sf), S.cells(spark, sf), S.START, S.END, key="prefix")


def _vectors(spark, sf):
    return profile_vectors(_activity(spark, sf))


def _fixed_centroids(spark):
    """The archetypes as centres of every window, which makes classes deterministic."""
    first_weeks = F.explode(F.array(*[F.struct(*map(F.lit, w)) for w in S.WINDOWS])).alias("w")
    return K.archetypes(spark).select("*", first_weeks).select(
        F.col("w.col1").alias("window_year"), F.col("w.col2").alias("window_week"),
        F.col("ordinal").alias("centroid_id"), "label", "center",
    )


def _classified(spark, sf):
    return C.classify(_vectors(spark, sf), _fixed_centroids(spark))


def _annotations(spark, sf):
    return C.annotate_global(_classified(spark, sf))


def _printable(profile):
    """Fixed-point text of a vector."""
    return F.array_join(F.transform(profile, lambda x: F.format_string("%.1f", x)), " ")


def _presence(spark, sf, grain="day"):
    return B.presence(S.cdr(spark, sf), S.cells(spark, sf), _annotations(spark, sf), grain)


def _od(spark, sf, grain="day"):
    return B.od_matrix(S.cdr(spark, sf), S.cells(spark, sf), _annotations(spark, sf), grain)


def _calls(spark, sf):
    return P.with_peak_calendar(S.cdr(spark, sf), "cdr_type")


def _counts(spark, sf):
    """All calls are of one year."""
    return P.call_counts(_calls(spark, sf)).drop("year")


def _yearly_counts(spark, sf):
    return P.call_counts(_calls(spark, sf))


def _study(spark, sf):
    return P.study_cells(_calls(spark, sf))


# Sources ------------------------------------------------------------------------------------


@query
def cdr_parse(spark, sf):
    return parse_cdr(S.cdr_lines(spark, sf))


@query
def cdr_parse_strict(spark, sf):
    return parse_cdr_strict(S.clean_lines(spark, sf))


@query
def cdr_quarantine(spark, sf):
    return rejected_lines(S.cdr_lines(spark, sf))


def _cell_lines(spark, sf):
    """A cell list with many lines per cell; the later line counts."""
    return S.cdr(spark, sf).select(
        F.concat(F.lit(" "), F.col("start_cell"), F.lit(";"), F.col("user_id")).alias("value"), "event_id"
    )


@query
def cells_dim(spark, sf):
    return parse_cells(_cell_lines(spark, sf), F.col("event_id"))


@query
def sites_dim(spark, sf):
    return parse_cells(_cell_lines(spark, sf), F.col("event_id"), key="prefix")


@query
def annot_legacy(spark, sf):
    calls = S.cdr(spark, sf)
    user, cell, kind = F.col("user_id"), F.col("start_cell"), F.col("cdr_type")
    nested = F.format_string("((u'%s', '%s'), '%s')", user, cell, kind)
    flat = F.format_string("(u'%s', '%s', '%s')", user, cell, kind)
    lines = calls.select(F.when(kind == "view", nested).otherwise(flat).alias("value"))
    return parse_annotations(lines)


@named("weeks_in_path")
def weeks_in_files(spark, sf):
    path = scratch_path(spark, "daily")
    day = F.replace(F.substring(F.col("date").cast("string"), 1, 10), F.lit("-"), F.lit(""))
    S.cdr(spark, sf).select("user_id", day.alias("day")).write.partitionBy("day").text(path)
    return weeks_in_path(spark, path, name_regex=r"day=(\d{8})/")


# Calendar and space -------------------------------------------------------------------------


@query
def calendar_cols(spark, sf):
    date = F.col("date")
    return S.cdr(spark, sf).select(
        "event_id",
        cal.iso_year(date).alias("iso_year"),
        cal.iso_week(date).alias("iso_week"),
        F.year(date).alias("year"),
        cal.day_of_week(date).alias("dow0"),
        cal.day_of_week(date, 1).alias("dow1"),
        cal.is_weekend(date).alias("we_mon_sun"),
        cal.is_weekend(date, cal.SATURDAY_SUNDAY).alias("we_sat_sun"),
        cal.is_weekend(date, cal.MONDAY_TO_FRIDAY).alias("we_mon_fri"),
        cal.day_slot(F.col("time")).alias("slot"),
        cal.day_slot_sql(date).alias("slot_sql"),
        F.dayofyear(date).alias("doy"),
        F.hour(date).alias("hour_of_day"),
        cal.at_grain(date, "day").alias("day"),
        cal.at_grain(date, "hour").alias("full_hour"),
    )


@query
def site_prefix(spark, sf):
    return (
        S.cdr(spark, sf)
        .select(
            site(F.col("start_cell")).alias("site"),
            site(F.col("cdr_type")).alias("kind"),
            site(F.col("cdr_type"), strict=True).alias("kind_strict"),
        )
        .groupBy("site", "kind", "kind_strict")
        .agg(F.count("*").alias("n"))
    )


@query
def region_exact(spark, sf):
    placed = attach_region(S.cdr(spark, sf), S.full_cells(spark, sf), "exact")
    return placed.select("event_id", "user_id", "start_cell", "region")


@query
def region_prefix(spark, sf):
    placed = attach_region(S.cdr(spark, sf), S.cells(spark, sf), "prefix")
    return placed.select("event_id", "user_id", "start_cell", "region")


@query
def region_prefix_shuffled(spark, sf):
    """The lookup as it runs for a dimension too large to broadcast."""
    placed = attach_region(S.cdr(spark, sf), S.cells(spark, sf), "prefix", max_broadcast_rows=0)
    return placed.select("event_id", "user_id", "start_cell", "region")


@query
def region_prefix_prefiltered(spark, sf):
    """The same, after records that cannot have a region were dropped."""
    placed = attach_region(S.cdr(spark, sf), S.cells(spark, sf), "prefix", max_broadcast_rows=0,
                           prefilter=True)
    return placed.select("event_id", "user_id", "start_cell", "region")


# Windows ------------------------------------------------------------------------------------


@query
def week_calendar(spark, sf):
    bounds = S.table(spark, sf, "orders").agg(
        F.min("o_orderdate").alias("begin"), F.max("o_orderdate").alias("until")
    )
    return W.week_calendar(bounds, "begin", "until")


@query
def windows_tumbling(spark, sf):
    return S.in_study(S.cdr(spark, sf)).select(
        "event_id", "window_year", "window_week", "n_weeks", "week_idx"
    )


@query
def windows_tumbling_joined(spark, sf):
    """The same windows through the window dimension."""
    windows = W.tumbling_weeks(W.weeks_between(spark, S.START, S.END))
    return W.in_window(S.cdr(spark, sf), windows).select(
        "event_id", "window_year", "window_week", "n_weeks", "week_idx"
    )


@query
def windows_sliding(spark, sf):
    calls = S.cdr(spark, sf)
    windows = W.sliding_weeks(W.complete_weeks(calls), size=2, shift=1)
    return W.in_window(calls, windows).select(
        "event_id", "window_year", "window_week", "n_weeks", "week_idx"
    )


@query
def complete_weeks(spark, sf):
    return W.complete_weeks(S.cdr(spark, sf))


@query
def weeks_available(spark, sf):
    return W.weeks_available(S.cdr(spark, sf))


# Profiles and classes -----------------------------------------------------------------------


@named("user_profile_sql")
def user_profile_by_week(spark, sf):
    return user_profile_sql(S.cdr(spark, sf), S.cells(spark, sf), weeks=(1, 4))


@named("user_profile")
def user_profile_entries(spark, sf):
    return user_profile(_activity(spark, sf))


@query
def user_profile_sliding(spark, sf):
    """Profiles over overlapping windows of the complete weeks, merged from weekly states."""
    calls = S.cdr(spark, sf)
    states = weekly_states(calls, S.cells(spark, sf), key="prefix")
    return user_profile(merge_weeks(states, W.complete_weeks(calls), size=2, shift=1))


@query
def user_profile_vector(spark, sf):
    return _vectors(spark, sf).withColumn("profile", _printable(F.col("profile")))


@query
def user_profile_vector_documented(spark, sf):
    """Weeks in calendar order."""
    vectors = profile_vectors(_activity(spark, sf), rotate=False)
    return vectors.withColumn("profile", _printable(F.col("profile")))


@query
def archetype_distance(spark, sf):
    typical = F.inline(K.candidates(K.archetypes(spark)))
    return _vectors(spark, sf).select("*", typical).select(
        "window_year", "window_week", "region", "user_id", F.col("rank").alias("ordinal"), "label",
        F.round(euclidean(F.col("profile"), F.col("center")), 6).alias("distance"),
    )


@query
def passing_by(spark, sf):
    profile = F.col("profile")
    return _vectors(spark, sf).select(
        "window_year", "window_week", "region", "user_id",
        nonzero_count(profile).alias("n_active"),
        F.round(vector_sum(profile), 6).alias("total"),
        C.is_passing_by(profile).cast("int").alias("passing_by"),
    )


@query
def label_centroids(spark, sf):
    """Labels of each user's mean profile over the regions."""
    entries = _vectors(spark, sf).select(
        "window_year", "window_week", "user_id", F.posexplode("profile").alias("i", "v")
    )
    means = entries.groupBy("window_year", "window_week", "user_id", "i").agg(F.avg("v").alias("v"))
    centers = means.groupBy("window_year", "window_week", "user_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "v"))).alias("pairs")
    )
    centroids = centers.withColumn("center", F.transform("pairs", lambda p: p["v"]))
    labelled = K.label_centroids(centroids, K.archetypes(spark))
    return labelled.select("window_year", "window_week", "user_id", "label")


@query
def classify(spark, sf):
    return _classified(spark, sf)


@query
def classify_joined(spark, sf):
    """The same classes with the centres in several parts, as when one broadcast cannot hold them."""
    return C.classify(_vectors(spark, sf), _fixed_centroids(spark), max_centroids=7)


@query
def sociometer(spark, sf):
    return C.sociometer(_classified(spark, sf)).withColumn("share", F.round("share", 6))


@query
def annotation_mode(spark, sf):
    return _annotations(spark, sf)


def _squared(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def _fitted(vectors, centroids):
    """What holds for trained centres whatever the random starts were: how many there are, that
    every profile has one, that they cost less than the single mean profile, and that the cost of
    training is what a search over all centres finds.

    Centres and mean of a window are one row, stored and then looked up, so that profiles do not move:
    a join by window would bring all profiles of a window, each with its centres, to one task."""
    keys = ["window_year", "window_week"]
    centers = centroids.groupBy(*keys).agg(
        F.count("*").alias("n_centers"), F.collect_list("center").alias("centers"))
    values = vectors.select(*keys, F.posexplode("profile").alias("i", "v"))
    means = values.groupBy(*keys, "i").agg(F.avg("v").alias("v")).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))
    models = cut_lineage(means.join(centers, keys))
    near = F.array_min(F.transform("centers", lambda c: _squared(F.col("profile"), c)))
    return (
        lookup_join(vectors, models, keys)
        .groupBy(*keys, "n_centers")
        .agg(F.count("*").alias("n_profiles"), F.sum(near).alias("cost"),
             F.sum(_squared(F.col("profile"), F.col("mean"))).alias("mean_cost"))
        .select(*keys, "n_centers", "n_profiles",
                (F.col("cost") < F.col("mean_cost")).cast("int").alias("below_mean"))
    )


@query
def kmeans(spark, sf):
    vectors = _vectors(spark, sf)
    return _fitted(vectors, K.fit_clusters(vectors, k=KMEANS_K))


@query
def kmeans_sampled(spark, sf):
    """Trained on a sample, which the number of centres must not exceed."""
    vectors = _vectors(spark, sf)
    fitted = _fitted(vectors, K.fit_clusters(vectors, k=KMEANS_K, sample_fraction=0.4))
    return fitted.withColumn("n_centers", F.col("n_centers").between(1, KMEANS_K).cast("int"))


@query
def sociometer_trained(spark, sf):
    """The whole chain with trained centres: users and total share by region, and whether all
    classes are known ones."""
    result = run_sociometer(
        S.cdr(spark, sf), S.cells(spark, sf), S.START, S.END, key="prefix", k=KMEANS_K
    )
    keys = ["window_year", "window_week", "region"]
    users = result.classified.groupBy(*keys).agg(F.count("*").alias("n_users"))
    known = [label for label, _ in K.ARCHETYPES] + [PASSING_BY]
    shares = result.shares.groupBy(*keys).agg(
        F.round(F.sum("share"), 6).alias("total"),
        F.min(F.col("user_class").isin(known).cast("int")).alias("known"))
    return users.join(shares, keys)


# Presence, flows, activity ------------------------------------------------------------------


@query
def presence_users(spark, sf):
    return B.presence_users(S.cdr(spark, sf), S.cells(spark, sf), "day")


@query
def presence(spark, sf):
    return _presence(spark, sf)


def _presence_states(spark, sf, grain):
    calls, cells = S.cdr(spark, sf), S.cells(spark, sf)
    numbers = D.number_users(B.presence_users(calls, cells, "day"))
    return cut_lineage(D.presence_states(calls, cells, _annotations(spark, sf), numbers, grain))


@query
def presence_merged(spark, sf):
    return D.presence_from_states(_presence_states(spark, sf, "hour"), "day")


@query
def presence_all_regions(spark, sf):
    states = D.merge_states(_presence_states(spark, sf, None), "hour")
    return D.presence_from_states(states, "day", ("date", "user_class"))


@query
def presence_full_time(spark, sf):
    return _presence(spark, sf, grain=None)


@query
def presence_repeated_labels(spark, sf):
    """Several classes per user and region: every event's type serves as a label."""
    calls = S.cdr(spark, sf)
    labels = attach_region(calls, S.cells(spark, sf), "prefix").select(
        "user_id", "region", F.col("cdr_type").alias("user_class")
    )
    return B.presence(calls, S.cells(spark, sf), labels, "day")


@query
def od_matrix(spark, sf):
    return _od(spark, sf)


@query
def hourly_activity(spark, sf):
    hourly = B.hourly_activity(S.cdr(spark, sf), S.cells(spark, sf), "day", key="prefix")
    return hourly.withColumn("cells", F.array_join("cells", " "))


@query
def hourly_activity_full_time(spark, sf):
    hourly = B.hourly_activity(S.cdr(spark, sf), S.full_cells(spark, sf), key="exact")
    return hourly.withColumn("cells", F.array_join("cells", " "))


# Peaks --------------------------------------------------------------------------------------


@query
def study_cells(spark, sf):
    return P.study_cells(P.with_peak_calendar(S.cdr(spark, sf)))


@query
def peak_counts(spark, sf):
    return _counts(spark, sf)


@query
def peak_base(spark, sf):
    base = P.peak_base(_yearly_counts(spark, sf), _study(spark, sf), S.BASE_DAYS).drop("year")
    return base.withColumn("num", F.round("num", 6))


@query
def peak_analysis(spark, sf):
    counts = _yearly_counts(spark, sf)
    return P.peak_analysis(counts, _study(spark, sf), S.FROM_DAY).drop("year")


@query
def peak_ratio(spark, sf):
    ratios = peak_ratios(_calls(spark, sf), None, S.BASE_DAYS, S.FROM_DAY).drop("year")
    return ratios.withColumns({"ratio": _six("ratio"), "bnum": F.round("bnum", 6)})


def _six(column):
    """Six decimals, after dropping the noise that could tip a tie."""
    return F.round(F.round(column, P.RATIO_DECIMALS), 6)


def _rounded_peaks(found):
    return found.withColumns({c: _six(c) for c in ("ratio", "abs_ratio", "abs_diff")})


@query
def peaks(spark, sf):
    return _rounded_peaks(
        detect_peaks(_calls(spark, sf), None, S.BASE_DAYS, S.FROM_DAY, min_diff=S.MIN_DIFF)
    ).drop("year")


@query
def peaks_by_cell(spark, sf):
    """Both directions, over a given set of cells."""
    calls = P.with_peak_calendar(S.cdr(spark, sf))
    cells = S.full_cells(spark, sf).select(F.col("cell_id").alias("nidt"))
    return _rounded_peaks(
        detect_peaks(calls, cells, S.BASE_DAYS, S.FROM_DAY, min_diff=0, positive_only=False)
    ).drop("year")


def _all_peaks(calls, **period):
    return _rounded_peaks(detect_peaks(
        calls, None, S.BASE_DAYS, S.FROM_DAY, min_diff=0, positive_only=False, **period))


@query
def peaks_all_cells(spark, sf):
    """Every cell, over part of the period."""
    return _all_peaks(P.with_peak_calendar(S.cdr(spark, sf)), start="2024-01-03", end="2024-01-28")


@query
def peaks_split_clock(spark, sf):
    """Records as lines whose dates have no clock; the hour is in a field of its own."""
    calls = parse_cdr(S.split_clock_lines(spark, sf), S.SPLIT_CLOCK, date_format="%Y%m%d")
    return _all_peaks(P.with_peak_calendar(calls, clock_in_date=False))


@query
def peaks_two_years(spark, sf):
    """The calls beside a copy of a year later, in which every other user is missing."""
    calls = S.cdr(spark, sf)
    later = calls.filter(F.col("user_id").cast("long") % 2 == 0).withColumn(
        "date", F.col("date") + F.expr("INTERVAL '1' YEAR"))
    return _all_peaks(P.with_peak_calendar(calls.unionByName(later)))


# Publishing ---------------------------------------------------------------------------------


@query
def obs_presence(spark, sf):
    return O.presence_observations(_presence(spark, sf))


@query
def obs_od(spark, sf):
    return O.od_observations(_od(spark, sf))


@query
def obs_sociometer(spark, sf):
    shares = C.sociometer(_classified(spark, sf))
    rounded = lambda obs: obs.withColumn("value", F.round(F.col("value").cast("double"), 6))
    return rounded(O.sociometer_observations(shares))


@query
def obs_sociometer_legacy(spark, sf):
    shares = C.sociometer(_classified(spark, sf))
    return O.sociometer_observations(shares, legacy_week=True).select("_id", "date", "region_id")


@query
def obs_sociometer_legacy_years(spark, sf):
    """Shares moved to years in which weeks from the first Monday are not the ISO weeks."""
    years = F.explode(F.array(*map(F.lit, [2014, 2015, 2019, 2020])))
    shares = C.sociometer(_classified(spark, sf)).withColumn("window_year", years)
    return O.sociometer_observations(shares, legacy_week=True).select("_id", "date", "region_id")


@query
def api_records(spark, sf):
    return O.to_api_records(O.presence_observations(_presence(spark, sf)), "AreaPresence", ADDED_DATE)


@query
def api_records_json(spark, sf):
    observations = O.od_observations(_od(spark, sf))
    return O.as_json(O.to_api_records(observations, "Flows", ADDED_DATE))


# Sinks: written and read back ---------------------------------------------------------------


@query
def sink_profiles(spark, sf):
    root = scratch_path(spark, "profiles")
    sink.write_profiles(_vectors(spark, sf), root, TAG)
    back = stored.read_profiles(spark, root, TAG, [(2024, 1), (2024, 5)])
    return back.withColumn("profile", _printable(F.col("profile")))


@query
def sink_centroids(spark, sf):
    """Mean profile per region as centres, labelled, stored and read back."""
    root = scratch_path(spark, "centroids")
    entries = _vectors(spark, sf).select(
        "window_year", "window_week", "region", F.posexplode("profile").alias("i", "v")
    )
    means = entries.groupBy("window_year", "window_week", "region", "i").agg(F.avg("v").alias("v"))
    centers = means.groupBy("window_year", "window_week", "region").agg(
        F.sort_array(F.collect_list(F.struct("i", "v"))).alias("pairs")
    )
    centroids = centers.select(
        "window_year", "window_week", F.col("region").cast("int").alias("centroid_id"),
        F.transform("pairs", lambda p: p["v"]).alias("center"),
    )
    sink.write_centroids(K.label_centroids(centroids, K.archetypes(spark)), root, TAG)
    return stored.read_centroids(spark, root, TAG).select(
        "window_year", "window_week", "centroid_id", "label",
        F.size("center").alias("n_values"), F.round(vector_sum(F.col("center")), 6).alias("total"),
    )


@query
def sink_sociometer(spark, sf):
    root = scratch_path(spark, "sociometer")
    sink.write_sociometer(C.sociometer(_classified(spark, sf)), root, TAG)
    return stored.read_sociometer(spark, root, TAG).withColumn("share", F.round("share", 6))


@query
def sink_two_tags(spark, sf):
    """Tags that would be the same number, in one store."""
    root, vectors = scratch_path(spark, "tags"), cut_lineage(_vectors(spark, sf))
    sink.write_profiles(vectors.filter("region <> '0'"), root, "1")
    sink.write_profiles(vectors, root, "01")
    back = [stored.read_profiles(spark, root, t).withColumn("tag", F.lit(t)) for t in ("1", "01")]
    return back[0].unionByName(back[1]).select("tag", "window_year", "window_week", "region", "user_id")


@query
def sink_rewritten_window(spark, sf):
    """A second run over the same weeks that has no rows for one window."""
    root, vectors = scratch_path(spark, "rerun"), cut_lineage(_vectors(spark, sf))
    sink.write_profiles(vectors, root, TAG, S.WINDOWS)
    sink.write_profiles(vectors.filter("window_week <> 5"), root, TAG, S.WINDOWS)
    return stored.read_profiles(spark, root, TAG).select(
        "window_year", "window_week", "region", "user_id")


@query
def profile_rejects(spark, sf):
    """Parsed lines whose time has no hour."""
    lines = S.cdr_lines(spark, sf).withColumn("value", F.when(
        F.col("event_id") % 7 == 0, F.regexp_replace("value", r";\d{6}\t;", ";n/a;")
    ).otherwise(F.col("value")))
    return untimed_records(parse_cdr(lines)).select("event_id", "user_id", "start_cell", "time")


@query
def weeks_required(spark, sf):
    """The complete weeks in order, after the check that there are enough."""
    return W.require_weeks(W.complete_weeks(S.cdr(spark, sf)), 2)


@query
def sink_annotations(spark, sf):
    root = scratch_path(spark, "annotations")
    sink.write_annotations(_annotations(spark, sf), root, TAG)
    return read_annotations(spark, f"{root}/{TAG}")


@query
def sink_presence_series(spark, sf):
    path = scratch_path(spark, "presence")
    text_sink.write_timeseries(_presence(spark, sf), path, text_sink.PRESENCE_COLUMNS)
    return stored.read_timeseries(spark, path, PRESENCE_SERIES)


@query
def sink_od_series(spark, sf):
    path = scratch_path(spark, "od")
    text_sink.write_timeseries(_od(spark, sf), path, text_sink.OD_COLUMNS)
    return stored.read_timeseries(spark, path, OD_SERIES)


@query
def sink_hourly_series(spark, sf):
    path = scratch_path(spark, "hourly")
    hourly = B.hourly_activity(S.cdr(spark, sf), S.cells(spark, sf), "day", key="prefix")
    text_sink.write_timeseries(hourly, path, text_sink.HOURLY_COLUMNS, sep=",")
    return stored.read_timeseries(spark, path, HOURLY_SERIES, sep=",")


@query
def sink_by_week(spark, sf):
    root = scratch_path(spark, "weekly")
    sink.write_by_week(S.cdr(spark, sf), root)
    return spark.read.parquet(root).select("event_id", "user_id", "start_cell", "iso_year", "iso_week")


@query
def sink_by_week_rebalanced(spark, sf):
    root = scratch_path(spark, "weekly")
    sink.write_by_week(S.cdr(spark, sf), root, rebalance=True)
    return spark.read.parquet(root).select("event_id", "user_id", "start_cell", "iso_year", "iso_week")


@query
def sink_observations(spark, sf):
    path = scratch_path(spark, "observations")
    text_sink.write_observations(O.presence_observations(_presence(spark, sf)), path)
    columns = ["_id", "value", "date", "region_id", "description", "indicator_id", "indicator_name"]
    return spark.read.json(path, schema=", ".join(f"{c} string" for c in columns))


@query
def table_lifecycle(spark, sf):
    """A counts table created in the catalog, replaced by itself, read, and dropped again."""
    name, path = "callscape_check_counts", scratch_path(spark, "table")
    sink.drop_tables(spark, name)
    sink.create_table(_counts(spark, sf), name, path)
    rows = cut_lineage(spark.table(name))
    sink.drop_tables(spark, name)
    return rows
