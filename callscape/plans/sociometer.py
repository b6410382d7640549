"""Profiles, typical profiles, classes: the three steps and the whole chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from callscape.operators import classify as C
from callscape.operators import cluster as K
from callscape.operators.profile import calling_activity, profile_vectors
from callscape.scale import cut_lineage


@dataclass(frozen=True)
class Sociometer:
    profiles: DataFrame
    centroids: DataFrame
    classified: DataFrame
    shares: DataFrame
    annotations: DataFrame


def run_sociometer(
    cdr: DataFrame,
    cells: DataFrame,
    start,
    end,
    key: str = "exact",
    archetypes: DataFrame | None = None,
    **clustering,
) -> Sociometer:
    """All windows of the study in one go.

    The profiles are stored once for training and classification, the classes once for both
    summaries, so the call records are read and the profiles classified a single time.
    """
    if archetypes is None:
        archetypes = K.archetypes(cdr.sparkSession)
    profiles = cut_lineage(profile_vectors(calling_activity(cdr, cells, start, end, key=key)))
    centroids = K.label_centroids(K.fit_clusters(profiles, **clustering), archetypes)
    classified = cut_lineage(C.classify(profiles, centroids))
    return Sociometer(
        profiles, centroids, classified, C.sociometer(classified), C.annotate_global(classified)
    )
