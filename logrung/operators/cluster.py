"""Cluster reports: purity, outliers and Gaussian summaries."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrung.session import landed

# Fewest points for a covariance, and standard deviations drawn.
MIN_POINTS = 4
N_STD = 2.0


def cluster_levels(df: DataFrame, cluster: str = "cluster", level: str = "level", row_id: str = "row_id") -> DataFrame:
    """(cluster, level, n, first_row)."""
    return df.groupBy(F.col(cluster).alias("cluster"), F.col(level).alias("level")).agg(
        F.count("*").alias("n"), F.min(row_id).alias("first_row")
    )


def purity(levels: DataFrame) -> DataFrame:
    """(cluster, size, majority_level, majority_n, purity_pct, level_counts).

    The majority is the most frequent level, ties to the one seen first.
    """
    # The largest count, then the earlier first row, which may be a composite id.
    best = F.struct((-F.col("n")).alias("n"), F.col("first_row"))
    return levels.groupBy("cluster").agg(
        F.sum("n").alias("size"),
        F.min_by("level", best).alias("majority_level"),
        F.max("n").alias("majority_n"),
        (F.max("n") / F.sum("n") * 100).alias("purity_pct"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("level_counts"),
    )


def cluster_purity(df: DataFrame, cluster: str = "cluster", level: str = "level", row_id: str = "row_id") -> DataFrame:
    return purity(cluster_levels(df, cluster, level, row_id))


def cluster_outliers(
    df: DataFrame, cluster: str = "cluster", level: str = "level", message: str = "message", row_id: str = "row_id"
) -> DataFrame:
    """(row_id, cluster, outlier): one report line per row off its majority."""
    majority = cluster_purity(df, cluster, level, row_id).select(
        F.col("cluster").alias("_cluster"), "majority_level"
    )
    majority = landed(majority, "cluster-majority")
    off = df.join(majority, F.col(cluster) == F.col("_cluster")).filter(
        F.col(level) != F.col("majority_level")
    )
    line = F.format_string("[Cluster %d] Tagged as [%s]: %s", F.col(cluster), F.col(level), F.col(message))
    return off.select(row_id, F.col(cluster).alias("cluster"), line.alias("outlier"))


def gaussian_moments(df: DataFrame, vector: str, dims: int, cluster: str = "cluster") -> DataFrame:
    """(cluster, n, mean_i.., cov_i_j..) for clusters with enough points."""
    at = [F.element_at(F.col(vector), i + 1).cast("double") for i in range(dims)]
    means = [F.avg(x).alias(f"mean_{i}") for i, x in enumerate(at)]
    covs = [
        F.covar_samp(at[i], at[j]).alias(f"cov_{i}_{j}")
        for i, j in combinations_with_replacement(range(dims), 2)
    ]
    return (
        df.groupBy(F.col(cluster).alias("cluster"))
        .agg(F.count("*").alias("n"), *means, *covs)
        .filter(F.col("n") >= MIN_POINTS)
    )


def gaussian_axes(moments: DataFrame, dims: int) -> DataFrame:
    """Append eigenvalues (ascending), 2-std radii and unit axes; one row per cluster.

    ``axes`` holds the eigenvectors in the order of their eigenvalues, each
    turned so that its largest component is positive.
    """

    def axes(batches):
        for batch in batches:
            values, vectors = [], []
            for row in batch.itertuples(index=False):
                cov = np.zeros((dims, dims))
                for i, j in combinations_with_replacement(range(dims), 2):
                    cov[i, j] = cov[j, i] = getattr(row, f"cov_{i}_{j}")
                spread, turned = np.linalg.eigh(cov)
                values.append(spread)
                vectors.append([v if v[np.abs(v).argmax()] > 0 else -v for v in turned.T])
            radii = [N_STD * np.sqrt(np.maximum(v, 0)) for v in values]
            yield batch.assign(
                eigenvalues=pd.Series(values, index=batch.index, dtype=object),
                radii=pd.Series(radii, index=batch.index, dtype=object),
                axes=pd.Series(vectors, index=batch.index, dtype=object),
            )

    fields = ", ".join(f"`{n}` {t}" for n, t in moments.dtypes)
    return moments.mapInPandas(axes, f"{fields}, eigenvalues array<double>, radii array<double>, axes array<array<double>>")
