"""The master metrics table: 24 rows of figures, overall and per week."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from learnlens.functions.calendar import default_start, week_ids
from learnlens.functions.spread import spread
from learnlens.functions.values import lookup, median_count_text, number_text, percentage, round_even
from learnlens.operators import activity as act
from learnlens.operators.filters import Period, Selection
from learnlens.operators.jumps import ALL_STEPS, grade_steps, operation_steps
from learnlens.operators.reshape import pivot_buckets
from learnlens.schema import GRADE_STEPS, OPERATION_STEPS, OPERATIONS, PROMOTED_GRADE
from learnlens.sources.scratch import written_by, written_together

# ---------------------------------------------------------------------------
# The rows of the report, in order.
# ---------------------------------------------------------------------------
LEARNERS = "Active Learners"
NEW_LEARNERS = "New Learners Added"
LOGINS = "Logged In Learners"
SESSIONS = "Sessions"
TIME = "Total Time Spent (In Min)"
TIME_PER_LEARNER = "Average Time Spent Per Learner (In Min)"
GRADE_JUMP = "Median Time (In Min) For A Grade Jump"
OPERATION_JUMP = "Median Time (In Min) For An Operator Jump"
WORK = "Work Done"
WORK_PER_LEARNER = "Work Done Per Learner"
MEDIAN_WORK = "Median Work Done Per Learner"
MEDIAN_ACCURACY = "Median Accuracy Of Learners"

GRADE_JUMP_NAMES = {g: f"{g} to {PROMOTED_GRADE[g]}" for g in GRADE_STEPS}
OPERATION_JUMP_NAMES = {
    step: f"{step} to {following}" for step, following in zip(OPERATION_STEPS, OPERATIONS[1:])
}
ROWS = [
    (LEARNERS, None),
    *[(LEARNERS, operation) for operation in OPERATIONS],
    (NEW_LEARNERS, None),
    (LOGINS, None),
    (SESSIONS, None),
    (TIME, None),
    (TIME_PER_LEARNER, None),
    (GRADE_JUMP, None),
    *[(GRADE_JUMP, name) for name in GRADE_JUMP_NAMES.values()],
    (OPERATION_JUMP, None),
    *[(OPERATION_JUMP, name) for name in OPERATION_JUMP_NAMES.values()],
    (WORK, None),
    (WORK_PER_LEARNER, None),
    (MEDIAN_WORK, None),
    (MEDIAN_ACCURACY, None),
]
# Overall figure when no attempt is selected.
EMPTY_OVERALL = {
    LEARNERS: "0",
    LOGINS: "0",
    SESSIONS: "0",
    TIME: "0",
    TIME_PER_LEARNER: "0",
    GRADE_JUMP: "",
    OPERATION_JUMP: "",
    WORK: "0",
    WORK_PER_LEARNER: "0",
}
# ---------------------------------------------------------------------------


def _skeleton(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(
            F.lit(order).alias("metric_order"),
            F.lit(metric).alias("metrics"),
            F.lit(sub).cast("string").alias("sub_metrics"),
        )
        for order, (metric, sub) in enumerate(ROWS)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _cells(df: DataFrame, metric: str, value: Column, sub: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(metric).alias("metrics"),
        (sub if sub is not None else F.lit(None)).cast("string").alias("sub_metrics"),
        "bucket",
        value.cast("string").alias("value"),
    )


def _ranked(df: DataFrame, metric: str, value: Column, step: Column, learners: Column) -> DataFrame:
    """Values of learners of which the report shows the median."""
    return df.select(
        F.lit(metric).alias("metrics"),
        step.cast("string").alias("sub_metrics"),
        "bucket",
        value.cast("double").alias("value"),
        learners.cast("bigint").alias("learners"),
    )


def _jump_values(daily: DataFrame, selection: Selection, period: Period, as_of: dt.date) -> DataFrame:
    def of(steps, metric: str, names: dict[str, str]) -> DataFrame:
        step = F.when(F.col("step") != ALL_STEPS, lookup(names, F.col("step")))
        return _ranked(steps(daily, selection, period, as_of=as_of), metric, F.col("minutes"), step, F.col("learners"))

    return of(grade_steps, GRADE_JUMP, GRADE_JUMP_NAMES).unionByName(of(operation_steps, OPERATION_JUMP, OPERATION_JUMP_NAMES))


def _median_cells(jumps: DataFrame, learners: DataFrame) -> DataFrame:
    """All medians of the report, ranked together. Overall median work is of the weeks shown."""
    worked = learners.where("learner_id IS NOT NULL")
    of_weeks = worked.where(F.col("bucket") != F.lit(act.OVERALL_DATE)).select("learner_id", "bucket", "work")
    overall = of_weeks.groupBy("learner_id").agg(F.sum("work").alias("work"))
    work = of_weeks.unionByName(overall.withColumn("bucket", F.lit(act.OVERALL_DATE)))
    accuracy = percentage(F.col("score"), F.col("scored"))
    none = F.lit(None)
    ranked = jumps.unionByName(_ranked(work, MEDIAN_WORK, F.col("work"), none, none)).unionByName(
        _ranked(worked, MEDIAN_ACCURACY, accuracy, none, none)
    )
    medians = spread(ranked, ["metrics", "sub_metrics", "bucket"], {"value": 10.0}, ["learners"])
    median = round_even(F.col("value_median"), 2)
    text = F.when(F.col("learners").isNull(), number_text(median)).otherwise(
        median_count_text(median, F.col("learners"))
    )
    return act.named_buckets(medians.select("metrics", "sub_metrics", "bucket", text.alias("value")))


def _stacked(df: DataFrame, values: dict[tuple[str, str | None], Column], where_known: Sequence[str]) -> DataFrame:
    """Several figures of one frame as report cells, without reading the frame again; figures of ``where_known`` only if there are any."""
    cells = [
        F.struct(
            F.lit(metric).alias("metrics"), F.lit(sub).cast("string").alias("sub_metrics"), value.cast("string").alias("value")
        )
        for (metric, sub), value in values.items()
    ]
    stacked = df.select("bucket", F.inline(F.array(*cells))).select("metrics", "sub_metrics", "bucket", "value")
    optional = F.col("metrics").isin(list(where_known)) | F.col("sub_metrics").isNotNull()
    return stacked.where(~optional | F.col("value").isNotNull())


def shown_period(period: Period, as_of: dt.date) -> Period:
    """The range given, or the default weeks with no end when it is incomplete."""
    return period if period.start and period.end else Period(start=default_start(as_of))


def master_report_long(
    attempts: DataFrame,
    logins: DataFrame,
    as_of: dt.date,
    period: Period = Period(),
    selection: Selection = Selection(),
) -> DataFrame:
    """One row per report row and bucket that has a figure, and all overall figures.

    The attempts are read once, into daily activity that is written to the shared folder in buckets of learners, so that what
    is grouped or ordered by learner is not shuffled again. One aggregate of it by bucket and
    learner, written too, gives all figures of learners, time, work and accuracy; sessions and jumps, which need other keys,
    read the daily activity, jumps at the same time. Logins, sessions and operation jumps take no operation filter. Overall figures cover all time unless
    both ends of the period are given, except median work, which covers the weeks shown.
    """
    period = shown_period(period, as_of)
    daily = written_by(act.activity_daily(attempts), "activity", "learner_id")
    chosen = selection.apply(daily)
    any_operation = selection.any_operation().apply(daily)
    stored = written_together(
        learner_buckets=act.learner_buckets(act.overall_and_weekly(chosen, period)),
        jump_values=_jump_values(daily, selection, period, as_of),
    )
    learners = stored["learner_buckets"]
    logged_in = act.logged_in(
        act.overall_and_weekly(
            selection.any_operation().apply(act.login_days(logins)), period
        )
    )
    sessions = act.sessions(act.overall_and_weekly(any_operation, period))
    figures = {
        (LEARNERS, None): F.col("learners"),
        **{(LEARNERS, operation): F.col(f"of_{operation}") for operation in OPERATIONS},
        (TIME, None): number_text(F.col("minutes")),
        (TIME_PER_LEARNER, None): number_text(F.col("minutes_per_learner")),
        (WORK, None): F.col("work_done"),
        (WORK_PER_LEARNER, None): F.col("work_per_learner"),
    }
    parts = [
        _stacked(act.bucket_summary(learners), figures, [TIME, TIME_PER_LEARNER]),
        _cells(act.new_learners_of(learners, daily, period), NEW_LEARNERS, F.col("learners")),
        _cells(logged_in, LOGINS, F.col("logins")),
        _cells(sessions, SESSIONS, F.col("sessions")),
        _median_cells(stored["jump_values"], learners),
    ]
    cells = reduce(DataFrame.unionByName, parts)

    # The skeleton has 24 constant rows, so broadcasting it is safe at any data size.
    skeleton = F.broadcast(_skeleton(attempts.sparkSession))
    same_row = (cells["metrics"] == skeleton["metrics"]) & cells["sub_metrics"].eqNullSafe(
        skeleton["sub_metrics"]
    )
    figures = cells.join(skeleton, same_row).select(
        "metric_order", skeleton["metrics"], skeleton["sub_metrics"], "bucket", "value"
    )
    blanks = _skeleton(attempts.sparkSession).select(
        "metric_order",
        "metrics",
        "sub_metrics",
        F.lit(act.OVERALL).alias("bucket"),
        F.when(F.col("sub_metrics").isNull(), lookup(EMPTY_OVERALL, F.col("metrics"))).alias("value"),
        F.lit(0).alias("found"),
    )
    # At most one figure and one blank meet in a cell; the figure wins.
    return (
        figures.withColumn("found", F.lit(1))
        .unionByName(blanks)
        .groupBy("metric_order", "metrics", "sub_metrics", "bucket")
        .agg(F.max_by("value", "found").alias("value"))
    )


def master_report_wide(
    attempts: DataFrame,
    logins: DataFrame,
    as_of: dt.date,
    period: Period = Period(),
    selection: Selection = Selection(),
) -> DataFrame:
    """The report as it is shown: one row per metric, an overall column and one column per week."""
    shown = shown_period(period, as_of)
    weeks = week_ids(shown.start, shown.end or as_of)
    cells = master_report_long(attempts, logins, as_of, period, selection)
    return (
        pivot_buckets(
            cells, [act.OVERALL, *weeks], "value", ["metric_order", "metrics", "sub_metrics"]
        )
        .withColumnRenamed(act.OVERALL, "overall_count")
        .orderBy("metric_order")
    )
