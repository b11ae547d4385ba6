"""Distinct learners from bitmaps of numbered learners, which merge over days, operations and filters.

Learners get dense numbers once; a number names a bit in a part of 32,768 bits. The rollup has, per day, attributes and
part, the bitmap of the learners who were active, built before anything is shuffled. Any count of distinct learners (of a week,
a period, a school, an operation) is the number of bits of OR-ed bitmaps, so learner ids are shuffled once, for the
rollup, and not for every figure. Counts are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from learnlens.operators.activity import named_buckets
from learnlens.operators.filters import without_null_keys
from learnlens.sources.scratch import written

ATTRIBUTES = ["activity_date", "tenant_name", "school", "grade", "operation"]
ROW_BITS = 33  # fixed value: monotonically_increasing_id holds the partition above these bits, and the row in them


def numbered_learners(activity: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """learner_id and number, from 1 on without gaps; learners of ``known`` keep theirs and new ones follow.

    Rows are numbered where they lie and written; the sizes of the parts, a row for each task, give what to add.
    """
    learners = activity.select("learner_id").where("learner_id IS NOT NULL").distinct()
    first = F.lit(1).cast("bigint")
    if known is not None:
        learners = learners.join(known.select("learner_id"), "learner_id", "left_anti")
        first = F.lit(known.agg(F.coalesce(F.max("number"), F.lit(0)) + 1).first()[0]).cast("bigint")
    placed = written(learners.withColumn("_at", F.monotonically_increasing_id()), "placed-learners").select(
        "learner_id",
        F.shiftright("_at", ROW_BITS).alias("_part"),
        F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"),
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each task that wrote
    numbers = placed.join(starts, "_part").select("learner_id", (F.col("_row") + F.col("_before") + first).alias("number"))
    return numbers if known is None else known.select("learner_id", "number").unionByName(numbers)


def learner_rollup(activity: DataFrame, numbers: DataFrame) -> DataFrame:
    """Per day, attributes and part the bitmap ``learners``; activity without a learner leaves an empty one."""
    attributes = [c for c in ATTRIBUTES if c in activity.columns]
    active = activity.select(*attributes, "learner_id").distinct().join(numbers, "learner_id", "left")
    return active.groupBy(*attributes, F.bitmap_bucket_number("number").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("learners")
    )


def _counted(bucketed: DataFrame, keys: list[str]) -> DataFrame:
    parts = bucketed.groupBy(*keys, "part").agg(F.bitmap_count(F.bitmap_or_agg("learners")).alias("learners"))
    return named_buckets(parts.groupBy(*keys).agg(F.sum("learners").alias("learners")))


def unique_learners(bucketed: DataFrame) -> DataFrame:
    """Learners of each bucket of a rollup, which is put into buckets and filtered as activity is."""
    return _counted(bucketed, ["bucket"])


def unique_learners_by_operation(bucketed: DataFrame) -> DataFrame:
    return _counted(without_null_keys(bucketed, ["operation"]), ["bucket", "operation"])
