"""Typical profiles: k-means centres and their labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from callscape.functions.vectors import nearest
from callscape.scale import cut_lineage
from callscape.sources.stored import of_windows
from callscape.schema import (
    ARCHETYPE_SCHEMA,
    CENTROID_SCHEMA,
    COMMUTER,
    DYNAMIC_RESIDENT,
    RESIDENT,
    VISITOR,
    WINDOW_KEYS,
)

# The labelled typical profiles, in order. Each gives the level of work days and
# of weekend days for the four weeks of a window; a level fills the three slots of the day.
ARCHETYPES = [
    (RESIDENT, [(1.0, 1.0), (1.0, 1.0), (1.0, 1.0), (1.0, 1.0)]),
    (RESIDENT, [(0.5, 0.5), (0.5, 0.5), (0.5, 0.5), (0.5, 0.5)]),
    (RESIDENT, [(0.1, 0.1), (0.1, 0.1), (0.1, 0.1), (0.1, 0.1)]),
    (DYNAMIC_RESIDENT, [(0.0, 1.0), (0.0, 1.0), (0.0, 1.0), (0.0, 1.0)]),
    (DYNAMIC_RESIDENT, [(0.0, 0.5), (0.0, 0.5), (0.0, 0.5), (0.0, 0.5)]),
    (DYNAMIC_RESIDENT, [(0.0, 0.1), (0.0, 0.1), (0.0, 0.1), (0.0, 0.1)]),
    (COMMUTER, [(1.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 0.0)]),
    (COMMUTER, [(0.5, 0.0), (0.5, 0.0), (0.5, 0.0), (0.5, 0.0)]),
    (COMMUTER, [(0.1, 0.0), (0.1, 0.0), (0.1, 0.0), (0.1, 0.0)]),
    (VISITOR, [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]),
    (VISITOR, [(0.5, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]),
    (VISITOR, [(0.1, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]),
    (RESIDENT, [(1.0, 1.0), (0.5, 0.5), (0.1, 0.1), (0.0, 0.0)]),
    (RESIDENT, [(0.5, 0.5), (0.1, 0.1), (0.0, 0.0), (0.0, 0.0)]),
    (VISITOR, [(0.0, 1.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]),
    (VISITOR, [(0.0, 0.5), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]),
]

# Clusters, iterations and random starts of the training.
CLUSTERS = 100
MAX_ITERATIONS = 20
RESTARTS = 5

TOLERANCE = 1e-4  # distance by which a centre of a settled run moves at most
ASSIGN_ROWS = 4096


def _small_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Driver rows as a local relation, which needs no job of its own."""
    named = [dict(zip(schema.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, to_arrow_schema(schema)), schema)


def archetypes(spark: SparkSession) -> DataFrame:
    """The built-in labelled profiles as ``ordinal, label, center``."""
    rows = [
        (ordinal, label, [level for week in weeks for level in week for _ in range(3)])
        for ordinal, (label, weeks) in enumerate(ARCHETYPES)
    ]
    return _small_frame(spark, rows, ARCHETYPE_SCHEMA)


def read_archetypes(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Labelled profiles from ``id;label;value;value;...`` lines. Their order gives the ordinal, as
    ids may repeat: by path, then block, then line."""
    parts = F.split("value", r"\Q" + sep + r"\E", -1)
    lines = spark.read.text(path).filter("trim(value) <> ''")
    rows = lines.select(
        F.struct("_metadata.file_path", "_metadata.file_block_start",
                 F.monotonically_increasing_id().alias("id")).alias("position"),
        F.trim(F.get(parts, F.lit(1))).alias("label"),
        F.transform(F.slice(parts, F.lit(3), F.size(parts) - 2), lambda x: F.trim(x).cast("double"))
        .alias("center"),
    )
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("position", "label", "center"))).alias("all"))
    return listed.select(F.posexplode("all").alias("ordinal", "entry")).select(
        "ordinal", "entry.label", "entry.center"
    )


def _starts(merged: DataFrame, k: int, seeds: list[int]) -> dict:
    """Random distinct vectors of every (window, seed): the ``k`` of least hash. Partial limits keep
    all but ``k`` rows of a task from the exchange."""
    draws = merged.select(*WINDOW_KEYS, "profile", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    line = Window.partitionBy(*WINDOW_KEYS, "seed").orderBy(F.xxhash64("profile", "seed"), "profile")
    drawn = draws.withColumn("at", F.row_number().over(line)).filter(F.col("at") <= k)
    found: dict = {}
    rows = drawn.drop("at").withColumn("order", F.xxhash64("profile", "seed")).collect()
    for row in sorted(rows, key=lambda r: (r["order"], r["profile"])):  # the first centres
        runs = found.setdefault((row["window_year"], row["window_week"]), {})
        runs.setdefault(row["seed"], []).append(row["profile"])
    return {window: np.array([runs[seed] for seed in seeds]) for window, runs in found.items()}


def _assigned(models: dict):
    """Sums of one task: each weighted vector is given to its nearest centre in every run of its
    window. ``models`` has centres as (run, centre, value) by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {w: np.zeros((c.shape[0] * c.shape[1], c.shape[2] + 2)) for w, c in models.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, ASSIGN_ROWS):
                batch = whole.slice(at, ASSIGN_ROWS)
                year, week, weight = (batch.column(c).to_numpy() for c in (*WINDOW_KEYS, "weight"))
                for window in np.unique(np.stack([year, week], axis=1), axis=0).tolist():
                    mine = np.flatnonzero((year == window[0]) & (week == window[1]))
                    centers = models[tuple(window)]
                    runs, k, d = centers.shape
                    flat = centers.reshape(-1, d)
                    x = batch.column("profile").take(pa.array(mine)).flatten().to_numpy().reshape(-1, d)
                    w = weight[mine]
                    apart = (flat * flat).sum(axis=1) - 2 * (x @ flat.T)
                    apart = apart.reshape(-1, runs, k)
                    near = apart.argmin(axis=2)
                    cost = np.take_along_axis(apart, near[:, :, None], 2)[:, :, 0] + (x * x).sum(axis=1)[:, None]
                    slot = (near + np.arange(runs) * k).ravel()
                    each = lambda v: np.bincount(slot, np.repeat(v, runs), runs * k)
                    total = sums[tuple(window)]
                    total[:, 0] += each(w)
                    total[:, 1] += np.bincount(slot, (np.maximum(cost, 0) * w[:, None]).ravel(), runs * k)
                    for value in range(d):
                        total[:, 2 + value] += each(x[:, value] * w)
        for (year, week), total in sums.items():
            used = np.flatnonzero(total[:, 0])
            if len(used):
                yield pa.RecordBatch.from_pylist(
                    [{"window_year": year, "window_week": week, "slot": int(i), "sums": total[i].tolist()}
                     for i in used], _SUMS)
    return run


_SUMS = pa.schema([("window_year", pa.int32()), ("window_week", pa.int32()), ("slot", pa.int32()),
                   ("sums", pa.list_(pa.float64()))])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of several tasks added per centre; a key's rows are all here."""
    found: dict = {}
    for batch in batches:
        for year, week, slot, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = year, week, slot
            found[key] = found[key] + np.array(sums) if key in found else np.array(sums)
    for (year, week, slot), sums in found.items():
        yield pa.RecordBatch.from_pylist(
            [{"window_year": year, "window_week": week, "slot": slot, "sums": sums.tolist()}], _SUMS)


def _pass(merged: DataFrame, models: dict) -> dict:
    """Weight, cost and vector sums per (run, centre) of every window, in one job."""
    schema = "window_year int, window_week int, slot int, sums array<double>"
    partial = merged.mapInArrow(_assigned(models), schema)
    total = partial.repartition(*WINDOW_KEYS, "slot").mapInArrow(_added, schema)
    found = {w: np.zeros((c.shape[0] * c.shape[1], c.shape[2] + 2)) for w, c in models.items()}
    for row in total.collect():  # a row per centre
        found[row["window_year"], row["window_week"]][row["slot"]] = row["sums"]
    return {w: v.reshape(*models[w].shape[:2], -1) for w, v in found.items()}


def fit_clusters(
    profiles: DataFrame,
    k: int = CLUSTERS,
    max_iter: int = MAX_ITERATIONS,
    restarts: int = RESTARTS,
    sample_fraction: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """K-means centres of the profile vectors, one model per window.

    Profiles take few distinct values, so equal vectors are merged into one weighted vector
    before training: the cost and the updates are the same, over far fewer rows. The merged vectors
    are stored and cached. Random starts are drawn from them, so a window has at most as many
    centres as distinct vectors.

    All windows and restarts are trained together. A pass is one job: each vector meets the centres of
    every run of its window, a task leaves one row of sums per centre, and these are added in a single
    exchange. So the number of jobs depends on ``max_iter`` alone, and what reaches the driver is
    ``restarts * k`` centres per window. Runs whose centres moved less than ``TOLERANCE`` drop out of
    further updates; passes end when none is left.
    """
    spark = profiles.sparkSession
    sampled = profiles if sample_fraction >= 1.0 else profiles.sample(sample_fraction, seed)
    merged = cut_lineage(
        sampled.groupBy(*WINDOW_KEYS, "profile").agg(F.count("*").cast("double").alias("weight"))
    ).persist()
    try:
        models = _starts(merged, k, [seed + run for run in range(restarts)])
        moving = {w: np.ones(len(c), bool) for w, c in models.items()}
        for _ in range(max_iter):
            live = {w: c for w, c in models.items() if moving[w].any()}
            if not live:
                break
            here = merged if len(live) == len(models) else of_windows(merged, live)
            for window, sums in _pass(here, live).items():
                weight = sums[:, :, :1]
                moved = np.where(weight > 0, sums[:, :, 2:] / np.maximum(weight, 1e-300), models[window])
                step = np.sqrt(((moved - models[window]) ** 2).sum(axis=2)).max(axis=1)
                change = moving[window][:, None, None]
                models[window] = np.where(change, moved, models[window])
                moving[window] &= step > TOLERANCE
        costs = {w: s[:, :, 1].sum(axis=1) for w, s in _pass(merged, models).items()} if models else {}
    finally:
        merged.unpersist()
    centers = []
    for window in sorted(models):
        best = models[window][int(np.argmin(costs[window]))]
        centers += [(*window, i, center) for i, center in enumerate(sorted(best.tolist()))]
    return _small_frame(spark, centers, CENTROID_SCHEMA)


def candidates(archetypes: DataFrame) -> Column:
    """The archetypes as one array of ``struct<rank, label, center>``.

    They are configuration (a few labelled rows) and become a constant of the plan.
    """
    entry = F.struct(F.col("ordinal").alias("rank"), "label", "center")
    return archetypes.agg(F.sort_array(F.collect_list(entry)).alias("candidates")).scalar()


def label_centroids(centroids: DataFrame, archetypes: DataFrame) -> DataFrame:
    """Give each centre the label of its nearest archetype; a tie goes to the lower ordinal."""
    return (
        centroids.withColumn("_typical", candidates(archetypes))
        .withColumn("label", nearest(F.col("center"), F.col("_typical")))
        .drop("_typical")
    )
