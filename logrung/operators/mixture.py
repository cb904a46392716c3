"""Variational Gaussian mixture with diagonal covariance.

Bishop, "Pattern Recognition and Machine Learning" (2006), section 10.2, with a
stick-breaking weight prior (Blei and Jordan 2006), so that ``n_components`` is
an upper bound. Rows stay on the executors: each pass sends back one block of
sums per partition, components x (2 width + 1) numbers, and all restarts share
the pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from logrung.session import landed

# Job defaults.
N_CLUSTERS = 2
SEED = 94
RESTARTS = 5
VARIANCE_FLOOR = 1e-6
#: Up to this many vectors are fitted one by one; of more, equal ones together, one of so many parts of all at most.
FIT_PARTS = 1 << 20
#: Vectors of a task that fits.
FIT_TASK_ROWS = 1 << 17


def _digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    while (x < 6).any():
        small = x < 6
        shift[small] -= 1.0 / x[small]
        x[small] += 1.0
    inv2 = 1.0 / (x * x)
    series = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return shift + np.log(x) - 0.5 / x - series


_lgamma = np.vectorize(math.lgamma, otypes=[float])


@dataclass
class Mixture:
    """Posterior of one restart (arrays by component)."""

    sticks_a: np.ndarray
    sticks_b: np.ndarray
    precision: np.ndarray
    means: np.ndarray
    freedom: np.ndarray
    variances: np.ndarray
    bound: float = -math.inf
    iterations: int = 0
    converged: bool = False

    def log_weights(self) -> np.ndarray:
        both = _digamma(self.sticks_a + self.sticks_b)
        left = _digamma(self.sticks_b) - both
        return _digamma(self.sticks_a) - both + np.concatenate([[0.0], np.cumsum(left)[:-1]])

    def weights(self) -> np.ndarray:
        share = self.sticks_a / (self.sticks_a + self.sticks_b)
        rest = np.concatenate([[1.0], np.cumprod(1 - share)[:-1]])
        raw = share * rest
        return raw / raw.sum()

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Expected log p(x, component), rows by components."""
        width = x.shape[1]
        inverse = 1.0 / self.variances
        far = (x**2) @ inverse.T - 2 * x @ (self.means * inverse).T + (self.means**2 * inverse).sum(axis=1)
        spread = 0.5 * np.log(self.variances).sum(axis=1)
        log_gauss = -0.5 * (width * math.log(2 * math.pi) + far) - spread
        log_gauss -= 0.5 * width * np.log(self.freedom)
        halves = 0.5 * (self.freedom - np.arange(width)[:, None])
        log_lambda = width * math.log(2.0) + _digamma(halves).sum(axis=0)
        return log_gauss + 0.5 * (log_lambda - width / self.precision) + self.log_weights()

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joint = self.log_joint(x)
        top = joint.max(axis=1, keepdims=True)
        norm = top + np.log(np.exp(joint - top).sum(axis=1, keepdims=True))
        return np.exp(joint - norm), joint - norm


@dataclass(frozen=True)
class _Prior:
    concentration: float
    mean: np.ndarray
    freedom: float
    variance: np.ndarray


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["x"].to_numpy()).astype(float)


def _posterior(prior: _Prior, mass: np.ndarray, first: np.ndarray, second: np.ndarray) -> Mixture:
    """M-step from component sums of r, r x and r x squared."""
    mass = mass + 10 * np.finfo(float).eps
    centre = first / mass[:, None]
    scatter = second / mass[:, None] - centre**2 + VARIANCE_FLOOR
    after = np.concatenate([np.cumsum(mass[::-1])[-2::-1], [0.0]])
    precision = 1.0 + mass
    means = (prior.mean + mass[:, None] * centre) / precision[:, None]
    freedom = prior.freedom + mass
    pull = (centre - prior.mean) ** 2 / precision[:, None]
    variances = (prior.variance + mass[:, None] * (scatter + pull)) / freedom[:, None]
    return Mixture(1.0 + mass, prior.concentration + after, precision, means, freedom, variances)


def _bound(m: Mixture, entropy: float) -> float:
    """Lower bound on the evidence, up to a constant."""
    width = m.means.shape[1]
    log_det = -0.5 * np.log(m.variances).sum(axis=1) - 0.5 * width * np.log(m.freedom)
    halves = 0.5 * (m.freedom - np.arange(width)[:, None])
    wishart = -(
        m.freedom * log_det + m.freedom * width * 0.5 * math.log(2.0) + _lgamma(halves).sum(axis=0)
    )
    betas = -(_lgamma(m.sticks_a) + _lgamma(m.sticks_b) - _lgamma(m.sticks_a + m.sticks_b)).sum()
    return float(-entropy - wishart.sum() - betas - 0.5 * width * np.log(m.precision).sum())


def _pass(rows: DataFrame, models: list[Mixture]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """One E-step over the data for all models: component sums per model."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        sums: list[np.ndarray] | None = None
        for batch in batches:
            if batch.empty:
                continue
            x = _matrix(batch)
            rows_of = batch["w"].to_numpy(dtype=float)[:, None]
            blocks = []
            for model in models:
                r, log_r = model.responsibilities(x)
                r = r * rows_of
                entropy = float((r * log_r).sum())
                blocks.append(
                    np.concatenate([r.sum(axis=0), (r.T @ x).ravel(), (r.T @ x**2).ravel(), [entropy]])
                )
            sums = blocks if sums is None else [a + b for a, b in zip(sums, blocks)]
        if sums is not None:
            size = len(sums[0])
            yield pd.DataFrame(
                {
                    "model": np.repeat(np.arange(len(models)), size),
                    "place": np.tile(np.arange(size), len(models)),
                    "value": np.concatenate(sums),
                }
            )

    # Summed on the executors; the driver sees models x size numbers.
    added = (
        rows.mapInPandas(partial, "model int, place int, value double")
        .groupBy("model", "place")
        .agg(F.sum("value").alias("value"))
        .toPandas()
        .sort_values(["model", "place"])
    )
    out = []
    for i, model in enumerate(models):
        flat = added.loc[added["model"] == i, "value"].to_numpy()
        k, d = model.means.shape
        out.append(
            (flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d : k + 2 * k * d].reshape(k, d), flat[-1])
        )
    return out


def _starts(rows: DataFrame, prior: _Prior, k: int, seed: int, restarts: int) -> list[Mixture]:
    """One start per restart: a short k-means run, its clusters as hard sums."""
    vectors = rows.withColumn("features", array_to_vector(F.col("x")))
    starts = []
    for i in range(restarts):
        fitted = KMeans(k=k, seed=seed + i, maxIter=3, initSteps=2, weightCol="w").fit(vectors)
        centres = np.stack(fitted.clusterCenters())
        held = dict(fitted.transform(vectors).groupBy("prediction").agg(F.sum("w")).collect())
        sizes = np.array([held.get(c, 0.0) for c in range(len(centres))])
        if len(centres) < k:
            # Fewer distinct points than components: the rest start empty.
            centres = np.vstack([centres, np.tile(prior.mean, (k - len(centres), 1))])
            sizes = np.concatenate([sizes, np.zeros(k - len(sizes))])
        order = np.argsort(-sizes, kind="stable")
        centres, sizes = centres[order], sizes[order]
        inner = np.tile(prior.variance, (k, 1))
        starts.append(_posterior(prior, sizes, sizes[:, None] * centres, sizes[:, None] * (inner + centres**2)))
    return starts


def _fit_rows(vectors: DataFrame, parts: int) -> DataFrame:
    """(x, w): vectors and the number of rows that each stands for, at most one of ``parts`` of all.

    Small files can hold very many vectors if few of them differ, so tasks
    are cut by the number of vectors and not by the size of files.
    """
    size = -(-vectors.count() // parts)
    if size <= 1:
        return vectors.withColumn("w", F.lit(1.0))
    counted = landed(vectors.groupBy("x").agg(F.count("*").alias("n")), "mixture-vectors")
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(size).cast("long"))
    apart = counted.withColumn("start", F.explode(starts)).select(
        "x", F.least(F.lit(size), F.col("n") - F.col("start")).cast("double").alias("w")
    )
    tasks = -(-(counted.count() + parts) // FIT_TASK_ROWS)
    return apart.repartition(max(tasks, vectors.sparkSession.sparkContext.defaultParallelism))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample variance of each dimension; two passes, so that no digits cancel."""
    flat = rows.select("w", F.posexplode("x").alias("dim", "value"))
    sums = flat.groupBy("dim").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("value")).alias("s"))
    first = sums.orderBy("dim").toPandas()
    total, mean = first["n"].to_numpy(dtype=float), (first["s"] / first["n"]).to_numpy(dtype=float)
    middle = F.element_at(F.array(*[F.lit(float(m)) for m in mean]), F.col("dim") + 1)
    square = F.col("w") * (F.col("value") - middle) * (F.col("value") - middle)
    second = flat.groupBy("dim").agg(F.sum(square).alias("s")).orderBy("dim").toPandas()
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = np.where(total > 1, second["s"].to_numpy(dtype=float) / (total - 1), 0.0)
    return mean, np.nan_to_num(variance)


def fit_mixture(
    df: DataFrame,
    vector: str = "reduced",
    n_components: int = N_CLUSTERS,
    seed: int = SEED,
    restarts: int = RESTARTS,
    max_iter: int = 100,
    tol: float = 1e-3,
    parts: int = FIT_PARTS,
) -> Mixture:
    """Fit and return the restart with the highest bound; of many rows, equal ones are counted and fitted together."""
    vectors = df.select(F.col(vector).cast("array<double>").alias("x"))
    rows = _fit_rows(vectors, parts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        width = len(rows.first()["x"])
        mean, variance = _moments(rows)
        variance = variance + VARIANCE_FLOOR
        prior = _Prior(1.0 / n_components, mean, float(width), variance)
        models = _starts(rows, prior, n_components, seed, restarts)
        active = list(range(restarts))
        for step in range(1, max_iter + 1):
            for i, (mass, first, second, entropy) in zip(active, _pass(rows, [models[i] for i in active])):
                moved = _posterior(prior, mass, first, second)
                moved.bound = _bound(moved, entropy)
                moved.iterations = step
                moved.converged = abs(moved.bound - models[i].bound) < tol
                models[i] = moved
            active = [i for i in active if not models[i].converged]
            if not active:
                break
        return max(models, key=lambda m: m.bound)
    finally:
        rows.unpersist()


def assign_clusters(df: DataFrame, model: Mixture, vector: str = "reduced", output: str = "cluster") -> DataFrame:
    """Append the most probable component of each row."""

    @F.pandas_udf("int")
    def nearest(xs: pd.Series) -> pd.Series:
        if xs.empty:
            return pd.Series([], dtype="int32")
        joint = model.log_joint(np.stack(xs.to_numpy()).astype(float))
        return pd.Series(joint.argmax(axis=1).astype("int32"))

    return df.withColumn(output, nearest(F.col(vector)))


def bayes_gmm(df: DataFrame, vector: str = "reduced", **settings) -> DataFrame:
    """Fit the mixture on an array column and append ``cluster``."""
    return assign_clusters(df, fit_mixture(df, vector, **settings), vector)
