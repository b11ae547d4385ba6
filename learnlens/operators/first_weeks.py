"""The first week of each learner as a state that new attempts improve, and new learners per week read from it.

A row of the state says that a learner worked on some operations in a week that was, when it was added, their first. A batch
adds a row only for a learner not known, for an earlier first week than the known one, or for more operations in the same week, so
late batches are taken in and the state grows with learners, not with attempts. Rows without a learner
name the weeks in which anyone worked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from learnlens.functions.calendar import week_start
from learnlens.operators.activity import named_buckets

LAYOUT = "learner_id string, week date, operations array<string>, unknown boolean"


def earliest(weeks: DataFrame) -> DataFrame:
    """One row per learner: the first week, its operations, and whether one of its attempts has none."""
    of_week = weeks.groupBy("learner_id", "week").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("operations")))).alias("operations"), F.bool_or("unknown").alias("unknown")
    )
    first = of_week.groupBy("learner_id").agg(F.min_by(F.struct("week", "operations", "unknown"), "week").alias("first"))
    return first.select("learner_id", "first.week", "first.operations", "first.unknown")


def weeks_worked(attempts: DataFrame) -> DataFrame:
    """Per learner and week the operations worked on; reduced before it is shuffled."""
    dated = attempts.where("learner_id IS NOT NULL AND updated_at IS NOT NULL")
    return dated.groupBy("learner_id", week_start(F.to_date("updated_at")).alias("week")).agg(
        F.array_sort(F.collect_set("operation")).alias("operations"), F.bool_or(F.col("operation").isNull()).alias("unknown")
    )


def improvements(attempts: DataFrame, state: DataFrame) -> DataFrame:
    """The rows that ``attempts`` add to the state."""
    worked = weeks_worked(attempts)
    known = earliest(state.where("learner_id IS NOT NULL")).select(
        "learner_id", *[F.col(c).alias(f"known_{c}") for c in ("week", "operations", "unknown")]
    )
    more = (F.size(F.array_except("operations", "known_operations")) > 0) | (F.col("unknown") & ~F.col("known_unknown"))
    better = F.col("known_week").isNull() | (F.col("week") < F.col("known_week")) | ((F.col("week") == F.col("known_week")) & more)
    learners = earliest(worked).join(known, "learner_id", "left").where(better).select("learner_id", "week", "operations", "unknown")
    seen = state.where("learner_id IS NULL").select("week")
    weeks = worked.select("week").distinct().join(seen, "week", "left_anti")
    none = F.lit(None).cast("string").alias("learner_id")
    return learners.unionByName(weeks.select(none, "week", F.array().cast("array<string>").alias("operations"), F.lit(False).alias("unknown")))


def new_learners(state: DataFrame, distinct_learners: bool = False) -> DataFrame:
    """Per week the learners whose first it was; a learner counts once for each operation of that week unless told otherwise."""
    counted = F.lit(1) if distinct_learners else F.size("operations") + F.col("unknown").cast("int")
    first = earliest(state.where("learner_id IS NOT NULL")).select(F.col("week").alias("bucket"), counted.alias("learners"))
    weeks = state.where("learner_id IS NULL").select(F.col("week").alias("bucket"), F.lit(0).alias("learners"))
    return named_buckets(first.unionByName(weeks).groupBy("bucket").agg(F.sum("learners").cast("bigint").alias("learners")))
