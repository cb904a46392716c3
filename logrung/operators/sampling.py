"""Budgets, quotas, samples, chunks and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrung.operators.ranks import (
    HASH_DIGITS,
    bucket_counts,
    global_rank,
    hash_bucket,
    hash_key,
    rank_cuts,
    take_first,
)
from logrung.session import landed

# Job defaults and the floor below which a class is dropped.
SAMPLE_TOTAL = 200_000
LINES_PER_FILE = 50_000
SAMPLE_SEED = 42
SPLIT_SEED = 94
MIN_CLASS_ROWS = 4
SPLIT_RATIOS = (0.8, 0.1, 0.1)


def level_counts(rows: DataFrame) -> DataFrame:
    """(dataset, level, n) over rows with a non-empty line.

    Levels are the upper-cased raw ones, so WARN and WARNING are two strata.
    """
    return (
        rows.filter(F.col("raw_line") != "")
        .groupBy("dataset", F.upper("line_level").alias("level"))
        .agg(F.count("*").alias("n"))
    )


def dataset_budgets(counts: DataFrame, total: int = SAMPLE_TOTAL) -> DataFrame:
    """Near-equal share per dataset; the first ones by name get the rest."""
    names = counts.select("dataset").distinct().withColumn("_all", F.lit(0))
    # One row per first-level directory.
    place = F.row_number().over(Window.partitionBy("_all").orderBy("dataset"))
    n = F.count("*").over(Window.partitionBy("_all"))
    share = F.expr(f"{int(total)} div _n") + F.when(
        F.col("_place") <= F.lit(int(total)) % F.col("_n"), 1
    ).otherwise(0)
    return (
        names.withColumns({"_place": place, "_n": n})
        .select("dataset", share.cast("long").alias("budget"))
    )


def largest_remainder(
    counts: DataFrame, groups: Sequence[str], member: str, budget: str, descending: bool
) -> DataFrame:
    """Append ``quota``: whole shares of ``budget`` in proportion to ``n``.

    Whole parts first; what is left goes to the largest remainders, ties by
    ``member``. The shares of a group sum to min(budget, sum of n).
    """
    group = Window.partitionBy(*groups)
    by_member = F.col(member).desc() if descending else F.col(member).asc()
    return (
        counts.withColumn("_total", F.sum("n").over(group))
        .withColumn("_budget", F.least(F.col(budget), F.col("_total")))
        .withColumn("_share", (F.col("_budget") * F.col("n")).cast("double") / F.col("_total"))
        .withColumn("_whole", F.floor("_share"))
        .withColumn("_left", F.col("_budget") - F.sum("_whole").over(group))
        .withColumn(
            "_place",
            F.row_number().over(
                group.orderBy((F.col("_share") - F.col("_whole")).desc(), by_member)
            ),
        )
        .withColumn(
            "quota",
            F.least(
                F.col("_whole") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0),
                F.col("n"),
            ).cast("long"),
        )
        .drop("_total", "_budget", "_share", "_whole", "_left", "_place")
    )


def level_quotas(counts: DataFrame, budgets: DataFrame) -> DataFrame:
    """(dataset, level, n, budget, quota) by largest remainder."""
    return largest_remainder(counts.join(budgets, "dataset"), ["dataset"], "level", "budget", True)


def with_hash_order(df: DataFrame, seed: int, *ids: str) -> DataFrame:
    """Append the pseudo-random sort key and its bucket."""
    return df.withColumn("_key", hash_key(seed, *ids)).withColumn(
        "_bucket", hash_bucket(F.col("_key"), HASH_DIGITS)
    )


def stratified_sample(
    rows: DataFrame, quotas: DataFrame, ids: Sequence[str], seed: int = SAMPLE_SEED
) -> DataFrame:
    """Quota rows per (dataset, level), drawn without replacement."""
    keyed = with_hash_order(
        rows.filter(F.col("raw_line") != "").withColumn("level", F.upper("line_level")), seed, *ids
    )
    return take_first(
        keyed, quotas.select("dataset", "level", "quota"), ["dataset", "level"], ["_bucket"], ["_key"]
    ).drop("_bucket", "_key")


def uniform_sample(df: DataFrame, n: int, ids: Sequence[str], seed: int = SPLIT_SEED) -> DataFrame:
    """``n`` rows without replacement (all of them when fewer)."""
    keyed = with_hash_order(df, seed, *ids)
    quota = df.sparkSession.createDataFrame([(int(n),)], "quota long")
    return take_first(keyed, quota, [], ["_bucket"], ["_key"]).drop("_bucket", "_key")


def display_sample(df: DataFrame, n: int, ids: Sequence[str], seed: int = SPLIT_SEED) -> DataFrame:
    """A handful of rows to show; small enough for a top-n."""
    return df.orderBy(hash_key(seed, *ids)).limit(n)


def assign_chunks(
    df: DataFrame, ids: Sequence[str], lines_per_file: int = LINES_PER_FILE, seed: int = SAMPLE_SEED
) -> DataFrame:
    """Shuffle globally and append ``position`` (from 1) and ``chunk``.

    Chunks hold exactly ``lines_per_file`` rows but for the last. ``chunk`` is
    zero-padded to three digits, or more when there are more chunks.
    """
    if lines_per_file <= 0:
        raise ValueError("lines_per_file must be positive")
    ranked = global_rank(with_hash_order(df, seed, *ids), ["_bucket"], ["_key"], "position")
    number = F.expr(f"CAST((position - 1) div {int(lines_per_file)} + 1 AS STRING)")
    rows = df.agg(F.count("*").alias("n"))
    chunks = F.expr(f"CAST((n + {int(lines_per_file) - 1}) div {int(lines_per_file)} AS STRING)")
    width = rows.select(F.greatest(F.lit(3), F.length(chunks)).alias("width")).scalar()
    return ranked.withColumn("chunk", F.lpad(number, width, F.lit("0"))).drop("_bucket", "_key")


def first_rows(df: DataFrame, n: int, bucket: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in (bucket, order), e.g. (file, block), position."""
    quota = df.sparkSession.createDataFrame([(int(n),)], "quota long")
    return take_first(df, quota, [], bucket, order)


def kept_class() -> Column:
    return F.col("n") >= MIN_CLASS_ROWS


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class, with ``kept`` false below the floor for splitting."""
    return (
        df.groupBy(label)
        .agg(F.count("*").alias("n"))
        .withColumn("kept", kept_class())
    )


def drop_rare(df: DataFrame, counts: DataFrame, label: str = "label") -> DataFrame:
    """Keep rows whose class is frequent enough (a semi join)."""
    return df.join(counts.filter("kept").select(label), label, "left_semi")


def _up(x: Column) -> Column:
    # Guards the ceiling against the last bits of a ratio such as 0.1 + 0.1.
    return F.ceil(F.round(x, 9))


def split_sizes(
    counts: DataFrame,
    ratios: tuple[float, float, float] = SPLIT_RATIOS,
    label: str = "label",
) -> DataFrame:
    """(label, n, n_train, n_validation, n_test), stratified.

    The held-out part is ceil(n * (validation + test)) rows and the test part
    ceil(held-out * test share); both are shared out by largest remainder.
    """
    train, validation, test = ratios
    if abs(train + validation + test - 1.0) > 1e-5:
        raise ValueError("split ratios must sum to 1")
    held = validation + test
    kept = counts.filter("kept").select(label, "n").withColumn("_all", F.lit(0))
    everything = Window.partitionBy("_all")
    kept = kept.withColumn("_held", _up(F.sum("n").over(everything) * F.lit(held)))
    kept = largest_remainder(kept, ["_all"], label, "_held", False).withColumnRenamed("n", "_rows")
    rest = kept.withColumnRenamed("quota", "n").withColumn(
        "_test", _up(F.sum("n").over(everything) * F.lit(1.0 - validation / held))
    )
    rest = largest_remainder(rest, ["_all"], label, "_test", False)
    return rest.select(
        label,
        F.col("_rows").alias("n"),
        (F.col("_rows") - F.col("n")).alias("n_train"),
        (F.col("n") - F.col("quota")).alias("n_validation"),
        F.col("quota").alias("n_test"),
    )


def stratified_split(
    df: DataFrame,
    ids: Sequence[str],
    ratios: tuple[float, float, float] = SPLIT_RATIOS,
    seed: int = SPLIT_SEED,
    label: str = "label",
) -> DataFrame:
    """Append ``split`` (train / validation / test) after dropping rare classes.

    Two cuts per class decide every row by comparison; no row is shuffled.
    ``df`` is read three times: land it first when it is costly.
    """
    keyed = with_hash_order(df, seed, *ids)
    counts = bucket_counts(keyed, [label], ["_bucket"])
    classes = counts.groupBy(label).agg(F.sum("_n").alias("n")).withColumn("kept", kept_class())
    sizes = landed(split_sizes(classes, ratios, label), "split-sizes")
    train_end, validation_end = F.col("n_train"), F.col("n_train") + F.col("n_validation")
    wanted = sizes.select(
        label,
        F.explode(
            F.array(
                F.struct(F.lit("train").alias("tag"), train_end.alias("rank")),
                F.struct(F.lit("validation").alias("tag"), validation_end.alias("rank")),
            )
        ).alias("w"),
    ).select(label, "w.tag", "w.rank")
    cuts = rank_cuts(keyed, counts, wanted, [label], ["_bucket"], ["_key"])
    by_label = cuts.groupBy(label).agg(
        F.max(F.when(F.col("tag") == "train", F.col("cut"))).alias("_train_cut"),
        F.max(F.when(F.col("tag") == "validation", F.col("cut"))).alias("_validation_cut"),
    )
    position = F.struct("_bucket", "_key")
    # One row per class, written, so that the join goes by its true size.
    bounds = landed(sizes.select(label).join(by_label, label, "left"), "split-bounds")
    bounded = keyed.join(bounds, label)
    return bounded.withColumn(
        "split",
        F.when(position <= F.col("_train_cut"), "train")
        .when(position <= F.col("_validation_cut"), "validation")
        .otherwise("test"),
    ).drop("_bucket", "_key", "_train_cut", "_validation_cut")
