"""Exact ranks, cuts and running totals without a one-task window.

Every function first counts rows per bucket, where a bucket is a coarse form of
the sort order. Prefix sums over the bucket counts are a small table; the exact
rank is then needed only inside single buckets. A stratum that holds a third of
all rows is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrung.session import landed

HASH_DIGITS = 4
VALUE_BUCKETS = 256
#: Rows of a value bucket on average; larger tables get more buckets.
ROWS_PER_BUCKET = 1_000_000


def hash_key(seed: int, *ids: str | Column) -> Column:
    """A reproducible pseudo-random sort key: md5 of ``seed:id[:id...]``."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_bucket(key: Column, digits: int = HASH_DIGITS) -> Column:
    """The leading hex digits of a hash key: 16**digits even buckets."""
    return F.substring(key, 1, digits)


def with_value_bucket(df: DataFrame, order: str, buckets: int = VALUE_BUCKETS) -> DataFrame:
    """Append ``_bucket``, a number by approximate quantiles of ``order``.

    The bounds only steer the balance; ranks stay exact whatever they are. The
    number of buckets follows the number of rows, ``buckets`` at least, so that
    a bucket stays about as large however long the table. One number for each
    bucket comes to the driver.
    """
    buckets = max(buckets, -(-df.count() // ROWS_PER_BUCKET))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(order, shares, 10 * buckets).alias("b")).first()["b"]
    inner = sorted({float(b) for b in bounds or []}) or [0.0]
    place = Bucketizer(
        splits=[-math.inf, *inner, math.inf], inputCol="_order", outputCol="_bucket", handleInvalid="keep"
    )
    return place.transform(df.withColumn("_order", F.col(order).cast("double"))).drop("_order")


def _before(measure: str | Column, partition: Sequence[str], order: Sequence[str]) -> Column:
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(measure) if isinstance(measure, str) else measure
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def running_totals(
    df: DataFrame, order: str, measures: Sequence[str], buckets: int = VALUE_BUCKETS
) -> DataFrame:
    """Append ``<m>_before`` and ``<m>_total`` for each measure.

    ``<m>_before`` sums the measure over all rows with a smaller ``order``,
    which must be unique: group by it first. Rows never meet in one task:
    each bucket is summed on its own and shifted by the totals before it. The
    input is read four times, so it is written once first.
    """
    df = landed(df, "running-totals")
    rows = with_value_bucket(df, order, buckets)
    totals = rows.groupBy("_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    # One row for each bucket from here to the join. Written, so that its true size decides how it is joined.
    shifts = totals.withColumn("_all", F.lit(0)).select(
        "_bucket",
        *[_before(m, ["_all"], ["_bucket"]).alias(f"_{m}_shift") for m in measures],
        *[F.sum(m).over(Window.partitionBy("_all")).alias(f"{m}_total") for m in measures],
    )
    inside = rows.withColumns({f"_{m}_in": _before(m, ["_bucket"], [order]) for m in measures})
    joined = inside.join(landed(shifts, "bucket-shifts"), "_bucket")
    return joined.withColumns(
        {f"{m}_before": F.col(f"_{m}_in") + F.col(f"_{m}_shift") for m in measures}
    ).drop("_bucket", *[f"_{m}_{s}" for m in measures for s in ("in", "shift")])


def bucket_counts(df: DataFrame, strata: Sequence[str], bucket: Sequence[str]) -> DataFrame:
    """(strata, bucket, _n), written for the passes that follow."""
    return landed(df.groupBy(*strata, *bucket).agg(F.count("*").alias("_n")), "bucket-counts")


def rank_cuts(
    df: DataFrame,
    counts: DataFrame,
    wanted: DataFrame,
    strata: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Sort position of the rows at the wanted ranks.

    ``counts`` comes from :func:`bucket_counts`; ``wanted`` has the strata, a
    ``tag`` and a ``rank`` (from 1). The result has the strata, ``tag`` and
    ``cut``, a struct of (bucket, order) that row positions compare with.
    ``bucket`` must be non-decreasing in sort order and (bucket, order) unique
    within a stratum. Only the buckets in which a wanted rank falls are read.
    """
    # A constant stands in for "no strata", so that both forms share one path.
    keys = list(strata) or ["_all"]
    if not strata:
        df, counts, wanted = (t.withColumn("_all", F.lit(0)) for t in (df, counts, wanted))
    counts = counts.withColumn("_skipped", _before("_n", keys, bucket))
    hit = (
        counts.join(wanted, keys)
        .filter((F.col("_skipped") < F.col("rank")) & (F.col("rank") <= F.col("_skipped") + F.col("_n")))
        .select(*keys, *bucket, "tag", (F.col("rank") - F.col("_skipped")).alias("_nth"))
    )
    # One row per bucket in which a rank falls. Written, so that its true size
    # decides how the join below runs.
    spots = hit.groupBy(*keys, *bucket).agg(F.collect_set(F.struct("tag", "_nth")).alias("_wanted"))
    spots = landed(spots, "rank-buckets")
    w = Window.partitionBy(*keys, *bucket).orderBy(*order)
    inside = (
        df.select(*keys, *bucket, *order)
        .join(spots, [*keys, *bucket])
        .withColumn("_row", F.row_number().over(w))
    )
    chosen = inside.withColumn("_spot", F.explode("_wanted")).filter("_spot._nth = _row")
    cut = F.struct(*bucket, *order).alias("cut")
    return landed(chosen.select(*strata, F.col("_spot.tag").alias("tag"), cut), "rank-cuts")


def take_first(
    df: DataFrame,
    quotas: DataFrame,
    strata: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """The first ``quota`` rows of every stratum in (bucket, order).

    ``quotas`` has the strata and ``quota``; a quota of zero takes nothing and
    one above the supply takes all. The choice is a row-local comparison with
    one cut per stratum. ``df`` is read three times: land it first when it is
    costly.
    """
    keys = list(strata)
    counts = bucket_counts(df, keys, bucket)
    supply = counts.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_supply"))
    if keys:
        wanted = supply.join(quotas, keys)
    else:
        wanted = supply.withColumn("quota", quotas.select("quota").scalar())
    wanted = wanted.select(
        *keys, F.lit("end").alias("tag"), F.least("quota", "_supply").cast("long").alias("rank")
    ).filter("rank > 0")
    cuts = rank_cuts(df, counts, wanted, keys, bucket, order)
    position = F.struct(*bucket, *order)
    if keys:
        return (
            df.join(cuts.select(*keys, "cut"), keys).filter(position <= F.col("cut")).drop("cut")
        )
    return df.filter(position <= cuts.select("cut").scalar())


def global_rank(
    df: DataFrame, bucket: Sequence[str], order: Sequence[str], name: str = "rank"
) -> DataFrame:
    """Append the exact 1-based rank over the whole table."""
    counts = bucket_counts(df, [], bucket).withColumn("_all", F.lit(0))
    shifts = landed(
        counts.select(*bucket, _before("_n", ["_all"], bucket).alias("_shift")), "rank-shifts"
    )
    w = Window.partitionBy(*bucket).orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(w))
        .join(shifts, list(bucket))
        .withColumn(name, F.col("_row") + F.col("_shift"))
        .drop("_row", "_shift")
    )
