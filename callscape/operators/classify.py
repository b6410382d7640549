"""User classes and what follows from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscape.functions.vectors import DISTANCE_DECIMALS, nonzero_count, vector_sum
from callscape.operators.aggregates import ordered_mode, share_of_total
from callscape.schema import PASSING_BY, WINDOW_KEYS

# Fixed value: a single active slot below this level means passing by.
PASSING_BY_BELOW = 0.5

CENTRE_BLOCK = 1000
BROADCAST_CENTRES = 200_000  # 40 MB of centres with 24 values


def is_passing_by(profile: Column) -> Column:
    return (nonzero_count(profile) == 1) & (vector_sum(profile) < PASSING_BY_BELOW)


def _nearest_of(rows: list, spark):
    """Vectorised search for the nearest of some centres of a window.

    The centres go to the executors once. An Arrow batch of profiles meets ``CENTRE_BLOCK`` of them
    at a time in a matrix product and keeps the nearest so far, so memory does not grow with their
    number. Vectors are compared over their common length; the lower centroid id wins a tie.
    """
    windows = {}
    for row in sorted(rows, key=lambda r: r["centroid_id"]):
        windows.setdefault((row["window_year"], row["window_week"]), []).append(row)
    shared = spark.sparkContext.broadcast({
        w: (np.array([r["label"] for r in found], dtype=object),
            np.array([r["centroid_id"] for r in found]), np.array([r["center"] for r in found]))
        for w, found in windows.items()})

    @F.pandas_udf("distance double, rank long, label string")
    def nearest(year: pd.Series, week: pd.Series, profile: pd.Series) -> pd.DataFrame:
        n = len(profile)
        best = np.full(n, np.inf)
        rank, label = np.zeros(n, np.int64), np.full(n, None, dtype=object)
        places = pd.Series(np.arange(n))
        keys = [year.to_numpy(), week.to_numpy(), profile.map(len).to_numpy()]
        for (y, w, size), group in places.groupby(keys):
            if (y, w) not in shared.value:
                continue
            labels, ids, centers = shared.value[y, w]
            at = group.to_numpy()
            d = min(size, centers.shape[1])
            vectors = np.stack(profile.to_numpy()[at])[:, :d]
            own = (vectors**2).sum(axis=1)
            for start in range(0, len(centers), CENTRE_BLOCK):
                block = centers[start : start + CENTRE_BLOCK, :d]
                squares = own[:, None] + (block**2).sum(axis=1) - 2 * vectors @ block.T
                squares = np.round(squares, DISTANCE_DECIMALS)
                first = squares.argmin(axis=1)  # the first of equals
                found = squares[np.arange(len(at)), first]
                nearer = found < best[at]
                best[at[nearer]] = found[nearer]
                rank[at[nearer]] = ids[start + first[nearer]]
                label[at[nearer]] = labels[start + first[nearer]]
        return pd.DataFrame({"distance": best, "rank": rank, "label": label})

    return nearest


def classify(
    profiles: DataFrame, centroids: DataFrame, max_centroids: int = BROADCAST_CENTRES
) -> DataFrame:
    """Class of each profile: passing by, else the label of the nearest centre of its window.

    Profiles are neither shuffled nor multiplied by the centres. The centres are sent out in parts
    of about ``max_centroids``; each part finds its nearest and the nearest of those counts.
    Profiles of a window without centres are left out.
    """
    profile, spark = F.col("profile"), profiles.sparkSession
    windows = centroids.select(*WINDOW_KEYS).distinct().collect()  # one row per window
    parts = max(1, -(-centroids.count() // max(max_centroids, 1)))
    covered = F.lit(False)
    for year, week in windows:
        covered = covered | ((F.col("window_year") == year) & (F.col("window_week") == week))
    searched = profiles.filter(covered)
    for part in range(parts):
        mine = F.pmod(F.hash("centroid_id", *WINDOW_KEYS), F.lit(parts)) == part
        nearest = _nearest_of(centroids.filter(mine).collect(), spark)
        searched = searched.withColumn(f"_near_{part}", nearest(*WINDOW_KEYS, "profile"))
    found = [F.col(f"_near_{part}") for part in range(parts)]
    best = found[0] if parts == 1 else F.least(*found)
    user_class = F.when(is_passing_by(profile), F.lit(PASSING_BY)).otherwise(best["label"])
    return searched.select(*WINDOW_KEYS, "region", "user_id", user_class.alias("user_class"))


def sociometer(classified: DataFrame) -> DataFrame:
    """Share of each class among the users of a region, per window."""
    counts = classified.groupBy(*WINDOW_KEYS, "region", "user_class").agg(
        F.count("*").alias("n_users")
    )
    shares = share_of_total(counts, "n_users", [*WINDOW_KEYS, "region"])
    return shares.drop("n_users").orderBy(*WINDOW_KEYS, "region", "user_class")


def annotate_global(classified: DataFrame) -> DataFrame:
    """One class per (user, region): the most frequent over all windows, the earliest on a tie.
    A user and region have at most one row per window."""
    return ordered_mode(
        classified, ["user_id", "region"], "user_class", F.struct(*WINDOW_KEYS), few_per_key=True
    )
