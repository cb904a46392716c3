"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Built-in functions only; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrung.session import landed

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = 20
#: Leading hexadecimal digits of the draw that make a bucket: 16**3 buckets for each source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII space, tab, line feed, vertical tab, form feed, carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """Adds ``weight``, ``target`` to one row per source: (source, source_size).

    Sources by code point, null last, take the weights in turn. Shares of the
    total go by weight; a source stops at ``max_epochs`` times its size and its
    excess is reshared by weight until none is above. With the sources in order
    of cap / weight this needs no rounds: a source is clamped when its cap lies
    below its share of what the sources before it leave, and the first one that
    is not clamped gives the level for all others. Sources of size 0 get 0.

    The windows run over sources, which is one row for each source after
    pre-aggregation, never over documents.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = sources.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    ).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighed.select("*", (left / open_weight).alias("level"))
    clamped = F.col("cap") < F.col("level") * F.col("weight")
    marked = levels.select("*", clamped.alias("clamped"))
    level = F.min_by(
        F.when(~F.col("clamped"), F.col("level")),
        F.when(~F.col("clamped"), F.struct(ratio, F.col("source").isNull(), F.col("source"))),
    ).over(everything)
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(
        F.least(F.col("cap"), level * F.col("weight"))
    )
    return marked.select("source", "source_size", "weight", target.alias("target"))


def draw_of(doc_id: Column, seed: int = SEED) -> Column:
    """The draw of an id: md5 of seed and id as text, a null id as empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def sized_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, draw) of each row, written once; texts are read here only."""
    return landed(
        docs.select(
            F.col("doc_id").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text").cast("string")).alias("size"),
            draw_of(F.col("doc_id"), seed).alias("draw"),
        ),
        "mix-sizes",
    )


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, cut) of each source; see ``copies_of``.

    A source with target t and size s is taken floor(t / s) times whole. For
    the rest, its ids are put in the order of their draws and taken once more
    while the middle of an id's words lies within what is left; ``cut`` is the
    last draw that is taken, so the words taken miss the target by at most half
    of what one id holds.

    No source is ordered as a whole: words are summed by the first digits of
    the draw, prefix sums run over those sums, and only the one bucket in which
    a source's rest ends is ordered by draw.
    """
    ordered = sized.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    buckets = landed(ordered.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    sources = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(rate), F.lit(int(max_epochs)).cast("long"))
    plan = landed(
        source_targets(sources, weights, max_epochs)
        .withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-plan",
    )
    one = plan.select(F.col("source").alias("s"), "rest")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = landed(
        buckets.select("*", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("begin"))
        .join(one, F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("begin") < F.col("rest")) & (F.col("begin") + F.col("bucket_size") >= F.col("rest")))
        .select("source", "bucket", "begin", "rest"),
        "mix-ends",
    )
    cell = ends.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "begin", "rest")
    # An id that many rows repeat is one row here.
    inside = (
        ordered.groupBy("source", "bucket", "draw")
        .agg(F.sum("size").alias("size"))
        .join(cell, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    )
    upto = F.sum("size").over(
        Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    taken = inside.withColumn("upto", F.col("begin") + upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"))
    last = taken.groupBy(F.col("source").alias("s")).agg(F.max("draw").alias("last"))
    cuts = ends.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("cs"), F.coalesce("last", "bucket").alias("cut")
    )
    return landed(
        plan.join(cuts, F.col("source").eqNullSafe(F.col("cs")), "left").select(
            "source", "source_size", "target", "whole", "cut"
        ),
        "mix-cuts",
    )


def copies_of(draw: Column, plan: str = "plan") -> Column:
    """How often a row is taken: the whole rounds of its source, and once more up to the cut."""
    return F.col(f"{plan}.whole") + F.coalesce((draw <= F.col(f"{plan}.cut")).cast("long"), F.lit(0))


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs``.

    The draw depends on the seed and ids only, not on partitions; reruns agree.
    No row is taken more than ``max_epochs`` times. A null source is a source of
    its own; null or empty text has size 0; a null id draws as the empty text;
    rows that repeat an id are taken alike; an empty table gives no rows.
    """
    sized = sized_rows(docs, seed)
    plan = mix_plan(sized, weights, max_epochs).alias("plan")
    joined = sized.alias("rows").join(plan, F.col("rows.source").eqNullSafe(F.col("plan.source")))
    return joined.select(
        "rows.doc_id",
        "rows.size",
        "plan.source_size",
        "plan.target",
        (F.col("rows.size") * copies_of(F.col("rows.draw"))).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with the columns of ``docs``."""
    plan = mix_plan(sized_rows(docs, seed), weights, max_epochs).alias("plan")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = whole.join(plan, F.col("row.source").cast("string").eqNullSafe(F.col("plan.source")))
    copies = copies_of(draw_of(F.col("row.doc_id"), seed))
    repeated = joined.select("row", copies.cast("int").alias("copies")).where("copies > 0")
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
