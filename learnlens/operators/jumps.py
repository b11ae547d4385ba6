"""Time on task per day, and the time learners needed before moving to the next grade or operation.

All windows are keyed by learner. The input is first reduced to one row per learner, day and
grade/operation, which bounds a learner's rows by calendar days, and is then partitioned by learner once;
the daily adjustment, totals, previous-step lookup and learner counts all reuse that partitioning.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from learnlens.functions.calendar import seconds_between, week_start
from learnlens.functions.spread import spread
from learnlens.functions.values import grade_rank, operation_rank, round_even
from learnlens.operators.activity import OVERALL_DATE, named_buckets
from learnlens.operators.filters import Period, Selection, without_null_keys
from learnlens.schema import DAY_CAP_SECONDS, GRADE_STEPS, OPERATION_STEPS

GRADE_DAY = ["learner_id", "tenant_name", "school", "grade", "operation", "qset_grade", "activity_date"]
OPERATION_DAY = [c for c in GRADE_DAY if c != "qset_grade"]
ALL_STEPS = "all"


def adjust_daily(days: DataFrame, tie_break: list[str], cap_seconds: int = DAY_CAP_SECONDS) -> DataFrame:
    """Adjust the time of a learner's tasks on days that exceed the cap.

    ``days`` has ``first_at`` and ``seconds``. Each time is capped. Where a learner's capped times of a day
    add up to more than the cap, every time after the day's first task becomes its absolute difference from
    the time before it and the first task keeps its uncapped time; other days keep the capped times. Tasks
    are ordered by first attempt, equal ones by ``tie_break``.
    """
    ordered = Window.partitionBy("learner_id", "activity_date").orderBy("first_at", *tie_break)
    # The sum needs no order, but sharing it lets one sort serve both windows.
    whole_day = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        days.withColumn("_capped", F.least("seconds", F.lit(float(cap_seconds))))
        .select(
            "*",
            F.sum(F.col("_capped").cast("decimal(18,6)")).over(whole_day).alias("_total"),
            F.lag("_capped").over(ordered).alias("_before"),
        )
        .withColumn(
            "time_spent",
            F.when(
                F.col("_total") > cap_seconds,
                F.coalesce(F.abs(F.col("_capped") - F.col("_before")), F.col("seconds")),
            ).otherwise(F.col("_capped")),
        )
        .drop("_capped", "_total", "_before")
    )


def _daily(activity: DataFrame, keys: list[str]) -> DataFrame:
    days = (
        without_null_keys(activity, keys)
        .groupBy(*keys)
        .agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
        .withColumn("seconds", seconds_between(F.col("first_at"), F.col("last_at")))
        .repartition("learner_id")
    )
    task = [c for c in keys if c not in ("learner_id", "activity_date")]
    return adjust_daily(days, task).drop("seconds")


def grade_time_daily(activity: DataFrame) -> DataFrame:
    """Adjusted daily time per learner, operation and question-set grade, diagnostics left out."""
    return _daily(activity.where(~F.col("diagnostic")), GRADE_DAY).withColumns(
        {
            "operation_order": operation_rank(F.col("operation")),
            "grade_order": grade_rank(F.col("qset_grade")),
        }
    )


def operation_time_daily(activity: DataFrame) -> DataFrame:
    """Adjusted daily time per learner and operation, diagnostics included."""
    return _daily(activity, OPERATION_DAY).withColumn(
        "operation_order", operation_rank(F.col("operation"))
    )


def _jumps(totals: DataFrame, within: list[str], order: list[str], step: str) -> DataFrame:
    """Steps that follow another one of the same learner, with the time the previous step took."""
    before = Window.partitionBy(*within).orderBy(*order)
    return (
        totals.select(
            "*",
            F.lag(step).over(before).alias("step"),
            F.lag("total_time").over(before).alias("_previous"),
        )
        .where(F.col("_previous").isNotNull())
        .select(
            "learner_id",
            "step",
            F.col(step).alias("reached"),
            round_even(F.col("_previous") / 60.0, 2).alias("minutes"),
            "first_at",
        )
    )


def _totals(daily: DataFrame, keys: list[str]) -> DataFrame:
    return (
        without_null_keys(daily, keys)
        .groupBy(*keys)
        .agg(
            F.sum(F.col("time_spent").cast("decimal(18,6)")).cast("double").alias("total_time"),
            F.min("first_at").alias("first_at"),
        )
    )


def grade_jumps(activity: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """One row per learner and grade step within an operation.

    ``step`` is the grade left, which is the previous one *attempted* and may lie more than one class below
    the grade ``reached``. The selection is applied after the daily adjustment.
    """
    daily = selection.apply(grade_time_daily(activity))
    totals = _totals(
        daily, ["learner_id", "operation", "qset_grade", "operation_order", "grade_order"]
    )
    return _jumps(totals, ["learner_id", "operation"], ["grade_order"], "qset_grade")


def operation_jumps(activity: DataFrame, selection: Selection = Selection()) -> DataFrame:
    """One row per learner and step from one operation to the next attempted one."""
    daily = selection.any_operation().apply(operation_time_daily(activity))
    totals = _totals(daily, ["learner_id", "operation", "operation_order"])
    return _jumps(totals, ["learner_id"], ["operation_order"], "operation")


def place_jumps(
    jumps: DataFrame,
    period: Period = Period(),
    as_of: dt.date | None = None,
    overall: bool = True,
    weekly: bool = True,
) -> DataFrame:
    """Jumps in the buckets and steps they count for, with ``learners`` 1 on each learner's first row.

    The date rule looks at the first attempt of the step reached, so the step before it may lie outside.
    Weekly buckets cover the last weeks up to ``as_of`` unless both ends of the period are set.
    """
    day = F.to_date("first_at")
    buckets = []
    if overall:
        buckets.append(F.lit(OVERALL_DATE))
    if weekly:
        in_weeks = period.or_lookback(as_of) if as_of else period
        buckets.append(F.when(in_weeks.open_ended(day), week_start(day)))
    placed = (
        jumps.where(period.closed(day))
        .withColumn("bucket", F.explode(F.array_compact(F.array(*buckets))))
        .withColumn("step", F.explode(F.array(F.lit(ALL_STEPS), F.col("step"))))
    )
    once = Window.partitionBy("learner_id", "bucket", "step").orderBy("first_at", "minutes")
    return placed.select(
        "bucket",
        "step",
        "minutes",
        (F.row_number().over(once) == 1).cast("bigint").alias("learners"),
    )


def jump_medians(placed: DataFrame) -> DataFrame:
    """Median minutes and number of learners per bucket, for all steps together and for each step."""
    medians = spread(placed, ["bucket", "step"], {"minutes": 10.0}, ["learners"])
    return named_buckets(
        medians.select(
            "bucket",
            "step",
            round_even(F.col("minutes_median"), 2).alias("median_minutes"),
            "learners",
        )
    )


def grade_steps(activity: DataFrame, selection: Selection, period: Period, **buckets) -> DataFrame:
    """Placed grade jumps; the steps shown leave class-one to class-five."""
    placed = place_jumps(grade_jumps(activity, selection), period, **buckets)
    return placed.where(F.col("step").isin([ALL_STEPS, *GRADE_STEPS]))


def operation_steps(
    activity: DataFrame, selection: Selection, period: Period, **buckets
) -> DataFrame:
    """Placed operation jumps; Division is the last operation, so no step leaves it."""
    placed = place_jumps(operation_jumps(activity, selection), period, **buckets)
    return placed.where(F.col("step").isin([ALL_STEPS, *OPERATION_STEPS]))
