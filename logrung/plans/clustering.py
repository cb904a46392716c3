"""Clustering job: filter, mask, embed, reduce, cluster, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrung.functions.levels import UNKNOWN
from logrung.functions.masking import with_masked
from logrung.operators.cluster import (
    cluster_outliers,
    cluster_purity,
    gaussian_axes,
    gaussian_moments,
)
from logrung.operators.embed import embed_messages, fit_embedder, reduce_dims
from logrung.operators.mixture import N_CLUSTERS, SEED, bayes_gmm
from logrung.session import landed

# Widths for clustering and for display.
CLUSTER_DIMS = 100
DISPLAY_DIMS = 3


def filter_level(parsed: DataFrame, level: str = "", include_unknown: bool = True) -> DataFrame:
    """Rows with a message, with ``level`` the upper-cased raw level.

    Optionally without UNKNOWN, optionally of one level only.
    """
    rows = parsed.filter(F.col("message") != "").withColumn(
        "level", F.coalesce(F.nullif(F.upper("line_level"), F.lit("")), F.lit(UNKNOWN))
    )
    if not include_unknown:
        rows = rows.filter(F.col("level") != UNKNOWN)
    return rows.filter(F.col("level") == level.upper()) if level else rows


@dataclass(frozen=True)
class Clustering:
    rows: DataFrame
    purity: DataFrame
    outliers: DataFrame
    gaussians: DataFrame


def cluster_vectors(
    rows: DataFrame,
    vector: str = "embedding",
    row_id: str = "row_id",
    n_components: int = N_CLUSTERS,
    seed: int = SEED,
    **settings,
) -> Clustering:
    """Cluster rows with vectors and report. ``rows``: row_id, level, message."""
    reduced = landed(reduce_dims(rows, CLUSTER_DIMS, vector), "reduced")
    clustered = landed(
        bayes_gmm(reduced, "reduced", n_components=n_components, seed=seed, **settings).drop("reduced"),
        "clustered",
    )
    shown = reduce_dims(clustered, DISPLAY_DIMS, vector, "shown")
    dims = min(DISPLAY_DIMS, len((shown.select("shown").first() or [[]])[0]))
    return Clustering(
        clustered,
        cluster_purity(clustered, row_id=row_id),
        cluster_outliers(clustered, row_id=row_id),
        gaussian_axes(gaussian_moments(shown, "shown", dims), dims),
    )


def cluster_logs(parsed: DataFrame, row_id: str = "row_id", out: str | None = None, **settings) -> Clustering:
    """Embed and cluster parsed log rows; rows of unknown level are left out.

    Rows of a file scan need no ``row_id``: it is then their (file_path, pos).
    """
    if row_id not in parsed.columns and {"file_path", "pos"} <= set(parsed.columns):
        parsed = parsed.withColumn(row_id, F.struct("file_path", "pos"))
    rows = with_masked(filter_level(parsed, include_unknown=False), "message", "_masked")
    rows = landed(
        rows.select(row_id, "level", F.col("_masked").alias("message")), "cluster-rows"
    )
    if rows.isEmpty():
        raise ValueError("no messages of known level to cluster")
    embedded = landed(embed_messages(fit_embedder(rows), rows), "embedded")
    result = cluster_vectors(embedded, row_id=row_id, **settings)
    if out is not None:
        result.outliers.select("outlier").write.mode("overwrite").text(f"{out}/outliers_report")
    return result
