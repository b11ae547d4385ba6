"""Learner activity: learners, new learners, logins, sessions, work, time and accuracy.

Every metric reads an *activity* frame: either one row per attempt (:func:`activity_rows`, a projection)
or one row per learner, day and attribute combination (:func:`activity_daily`, a much smaller table that a
report of many metrics shares). Counts, sums, minima and maxima combine, so both give the same figures.

A metric is defined once per *bucket*. :func:`overall`, :func:`weekly` and :func:`overall_and_weekly`
put rows into buckets under the date rule that belongs to each; the result has one row per bucket. Until the
result, a bucket is the Monday of its week (a fixed early date for the overall one): days group far faster
than texts, and only the few result rows get their name.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from learnlens.functions.calendar import seconds_between, week_label, week_start
from learnlens.functions.spread import spread
from learnlens.functions.values import percentage, round_even
from learnlens.operators.filters import Period, without_null_keys
from learnlens.schema import (
    DAY_CAP_SECONDS,
    DIAGNOSTIC,
    LOW_TIME_MINUTES,
    NO_SCHOOL,
    OPERATIONS,
    SESSION_MIN_LEARNERS,
)

OVERALL = "overall"
OVERALL_DATE = dt.date(1900, 1, 1)
ATTRIBUTES = ["learner_id", "tenant_name", "school", "grade", "operation", "qset_grade"]
DAY = "activity_date"


def _attributes(attempts: DataFrame) -> list[str]:
    return [c for c in ATTRIBUTES if c in attempts.columns]


def activity_rows(attempts: DataFrame) -> DataFrame:
    """Attempts in the shape of activity: no rows are combined, nothing is shuffled."""
    counted = F.col("attempts_count").isNotNull().cast("bigint")
    scored = F.col("score").isNotNull().cast("bigint")
    return attempts.select(
        *_attributes(attempts),
        F.col("purpose").eqNullSafe(DIAGNOSTIC).alias("diagnostic"),
        F.to_date("updated_at").alias("activity_date"),
        F.col("updated_at").alias("first_at"),
        F.col("updated_at").alias("last_at"),
        F.lit(1).cast("bigint").alias("rows"),
        counted.alias("work"),
        F.col("score").cast("bigint").alias("score"),
        scored.alias("scored"),
    )


def activity_daily(attempts: DataFrame) -> DataFrame:
    """Activity per learner, day and attributes; partial sums are made before the shuffle."""
    return (
        activity_rows(attempts)
        .groupBy(*_attributes(attempts), "diagnostic", "activity_date")
        .agg(
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            *[F.sum(c).alias(c) for c in ("rows", "work", "score", "scored")],
        )
    )


# --- buckets ---------------------------------------------------------------------------------------


def overall(df: DataFrame, period: Period = Period(), day: str = DAY) -> DataFrame:
    return df.where(period.closed(F.col(day))).withColumn("bucket", F.lit(OVERALL_DATE))


def weekly(df: DataFrame, period: Period = Period(), day: str = DAY) -> DataFrame:
    dated = df.where(F.col(day).isNotNull()).where(period.open_ended(F.col(day)))
    return dated.withColumn("bucket", week_start(F.col(day)))


def overall_and_weekly(df: DataFrame, period: Period = Period(), day: str = DAY) -> DataFrame:
    """Each row once for the overall bucket and once for its week, as far as the two rules admit it."""
    date = F.col(day)
    buckets = F.array(
        F.when(period.closed(date), F.lit(OVERALL_DATE)),
        F.when(period.open_ended(date), week_start(date)),
    )
    return df.withColumn("bucket", F.explode(F.array_compact(buckets)))


def named_buckets(metric: DataFrame) -> DataFrame:
    """Replace the date of each bucket by its name."""
    bucket = F.col("bucket")
    name = F.when(bucket == F.lit(OVERALL_DATE), F.lit(OVERALL)).otherwise(week_label(bucket))
    return metric.withColumn("bucket", name)


def at_least_overall(metric: DataFrame, default: float | int | None = 0) -> DataFrame:
    """Make sure the overall bucket is there, with ``default`` where no row fell into it or none counted."""
    values = [f for f in metric.schema.fields if f.name != "bucket"]
    blank = metric.sparkSession.range(1).select(
        F.lit(OVERALL).alias("bucket"),
        *[F.lit(default).cast(f.dataType).alias(f.name) for f in values],
        F.lit(0).alias("_found"),
    )
    filled = metric.withColumn("_found", F.lit(1)).unionByName(blank)
    return filled.groupBy("bucket").agg(
        *[
            F.coalesce(F.max_by(f.name, "_found"), F.lit(default).cast(f.dataType)).alias(f.name)
            for f in values
        ]
    )


# --- one aggregate for a report ----------------------------------------------------------------------


def learner_buckets(bucketed: DataFrame, cap_seconds: int = DAY_CAP_SECONDS) -> DataFrame:
    """One row per bucket and learner, from which learners, time, work and accuracy are all read.

    Days are put together first, so that time is capped per day; both steps aggregate before they shuffle. ``seconds`` is null
    for a missing learner and where no attempt has a time; ``operations`` are those worked on, ``unknown`` tells whether one
    attempt had none. A missing learner is a row too: its work counts.
    """
    of_day = bucketed.groupBy("bucket", "learner_id", "activity_date").agg(
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        *[F.sum(c).alias(c) for c in ("rows", "work", "score", "scored")],
        F.collect_set("operation").alias("operations"),
        F.bool_or(F.col("operation").isNull()).alias("unknown"),
    )
    capped = F.least(seconds_between(F.col("first_at"), F.col("last_at")), F.lit(float(cap_seconds)))
    timed = F.col("learner_id").isNotNull() & F.col("activity_date").isNotNull()
    return (
        of_day.withColumn("seconds", F.when(timed, capped).cast("decimal(18,6)"))
        .groupBy("bucket", "learner_id")
        .agg(
            *[F.sum(c).alias(c) for c in ("seconds", "rows", "work", "score", "scored")],
            F.array_distinct(F.flatten(F.collect_set("operations"))).alias("operations"),
            F.bool_or("unknown").alias("unknown"),
        )
    )


def bucket_summary(learners: DataFrame) -> DataFrame:
    """Per bucket, in one pass over :func:`learner_buckets`: learners, time, work, and learners of each operation.

    ``of_<operation>`` is null where nobody worked on the operation, and minutes are null where no attempt has a time.
    """
    known = F.col("learner_id").isNotNull()
    counted = F.when(F.col("bucket") == F.lit(OVERALL_DATE), F.col("rows")).otherwise(F.col("work"))
    minutes = _minutes(F.col("seconds"))
    n = F.count("learner_id")

    def of(operation: str) -> Column:
        worked = F.array_contains("operations", operation)
        return F.when(F.bool_or(worked), F.count_if(worked & known)).alias(f"of_{operation}")

    summary = learners.groupBy("bucket").agg(
        n.alias("learners"),
        *[of(operation) for operation in OPERATIONS],
        minutes.alias("minutes"),
        round_even(F.try_divide(minutes, F.count("seconds").cast("double")), 2).alias("minutes_per_learner"),
        F.sum(counted).alias("work_done"),
        F.floor(F.try_divide(F.sum(counted).cast("double"), n.cast("double"))).alias("work_per_learner"),
    )
    return named_buckets(summary)


# --- learners --------------------------------------------------------------------------------------


def unique_learners(bucketed: DataFrame) -> DataFrame:
    return named_buckets(
        bucketed.groupBy("bucket").agg(F.count_distinct("learner_id").alias("learners"))
    )


def unique_learners_by_operation(bucketed: DataFrame) -> DataFrame:
    return named_buckets(
        without_null_keys(bucketed, ["operation"])
        .groupBy("bucket", "operation")
        .agg(F.count_distinct("learner_id").alias("learners"))
    )


def unique_learners_with_operations(bucketed: DataFrame) -> DataFrame:
    """Learners of each bucket in total (operation null) and per operation, in one pass."""
    rollup = bucketed.select(
        "bucket",
        "learner_id",
        F.explode(F.array_distinct(F.array(F.lit("*"), F.coalesce("operation", F.lit("*"))))).alias(
            "operation"
        ),
    )
    return named_buckets(
        rollup.groupBy("bucket", "operation")
        .agg(F.count_distinct("learner_id").alias("learners"))
        .withColumn("operation", F.nullif("operation", F.lit("*")))
    )


def on_operation_domain(by_operation: DataFrame) -> DataFrame:
    """All four operations for every bucket that occurs, null where an operation has no figure."""
    buckets = by_operation.select("bucket").distinct()
    domain = buckets.select(
        "bucket", F.explode(F.array(*[F.lit(o) for o in OPERATIONS])).alias("operation")
    )
    return domain.join(by_operation, ["bucket", "operation"], "left")


def learners_before(activity: DataFrame, period: Period) -> DataFrame:
    """Learners active before the period, whatever their school, grade, operation or tenant."""
    return activity.where(period.before(F.col(DAY))).select("learner_id").distinct()


def new_learners(
    selected: DataFrame,
    everything: DataFrame,
    period: Period = Period(),
    distinct_learners: bool = False,
) -> DataFrame:
    """Learners per week who were active neither before the period nor in an earlier week of it.

    ``selected`` is the filtered activity, ``everything`` the unfiltered one. By default a new learner
    counts once for each operation they worked on in their first week (an unknown operation is one more);
    ``distinct_learners=True`` counts each once. Attempts without a time belong to no week.
    """
    weeks = (
        selected.where(F.col(DAY).isNotNull())
        .where(period.open_ended(F.col(DAY)))
        .where(F.col("learner_id").isNotNull())
        .groupBy("learner_id", week_start(F.col(DAY)).alias("week"))
        .agg(
            (F.count_distinct("operation") + F.max(F.col("operation").isNull().cast("int"))).alias(
                "operations"
            )
        )
    )
    return _first_weeks(weeks, everything, period, F.lit(1) if distinct_learners else F.col("operations"))


def new_learners_of(learners: DataFrame, everything: DataFrame, period: Period = Period()) -> DataFrame:
    """New learners per week from :func:`learner_buckets`, counted once for each operation of their first week."""
    weeks = learners.where(F.col("bucket") != F.lit(OVERALL_DATE)).where(F.col("learner_id").isNotNull())
    operations = F.size("operations") + F.col("unknown").cast("int")
    return _first_weeks(weeks.select("learner_id", F.col("bucket").alias("week"), operations.alias("operations")), everything, period, F.col("operations"))


def _first_weeks(weeks: DataFrame, everything: DataFrame, period: Period, counted: Column) -> DataFrame:
    # A learner has one row per week, so this window stays small however many attempts they made.
    first = F.min("week").over(Window.partitionBy("learner_id"))
    flagged = weeks.withColumn("new", F.col("week") == first)
    if period.start:
        known = learners_before(everything, period).withColumn("known", F.lit(True))
        flagged = flagged.join(known, "learner_id", "left").withColumn(
            "new", F.col("new") & F.col("known").isNull()
        )
    return named_buckets(
        flagged.groupBy(F.col("week").alias("bucket")).agg(
            F.sum(F.when(F.col("new"), counted).otherwise(0)).cast("bigint").alias("learners")
        )
    )


# --- logins and sessions ---------------------------------------------------------------------------


def login_days(logins: DataFrame) -> DataFrame:
    """Login events in the shape of activity (school filled in)."""
    return logins.select(
        "learner_id",
        "tenant_name",
        F.coalesce("school", F.lit(NO_SCHOOL)).alias("school"),
        "grade",
        F.to_date("created_on").alias("activity_date"),
    )


def logged_in(bucketed: DataFrame) -> DataFrame:
    """Learner-days with a login: a learner counts once per day, not once per bucket."""
    return named_buckets(
        bucketed.select("bucket", "learner_id", "activity_date")
        .distinct()
        .groupBy("bucket")
        .agg(F.count("learner_id").alias("logins"))
    )


def sessions(bucketed: DataFrame, min_learners: int = SESSION_MIN_LEARNERS) -> DataFrame:
    """Class days (date, school, grade) on which at least ``min_learners`` learners worked."""
    class_days = (
        without_null_keys(bucketed, ["school", "grade", "activity_date"])
        .groupBy("bucket", "activity_date", "school", "grade")
        .agg(F.count_distinct("learner_id").alias("learners"))
    )
    return named_buckets(
        class_days.groupBy("bucket").agg(
            F.sum((F.col("learners") >= min_learners).cast("bigint")).alias("sessions")
        )
    )


# --- work ------------------------------------------------------------------------------------------


def work_summary(bucketed: DataFrame) -> DataFrame:
    """Work done, and work divided by learners rounded down.

    Work is the number of attempt records overall, and of those with an attempts count per week.
    """
    counted = F.when(F.col("bucket") == F.lit(OVERALL_DATE), F.col("rows")).otherwise(F.col("work"))
    per_learner = bucketed.groupBy("bucket", "learner_id").agg(F.sum(counted).alias("work"))
    learners = F.count("learner_id").cast("double")
    return named_buckets(
        per_learner.groupBy("bucket").agg(
            F.sum("work").alias("work_done"),
            F.floor(F.try_divide(F.sum("work").cast("double"), learners)).alias("work_per_learner"),
        )
    )


def work_done(bucketed: DataFrame) -> DataFrame:
    """Attempt records overall; per week the records that have an attempts count."""
    counted = F.when(F.col("bucket") == F.lit(OVERALL_DATE), F.col("rows")).otherwise(F.col("work"))
    return named_buckets(bucketed.groupBy("bucket").agg(F.sum(counted).alias("work_done")))


def work_per_learner(bucketed: DataFrame) -> DataFrame:
    return work_summary(bucketed).drop("work_done")


def learner_work(bucketed: DataFrame) -> DataFrame:
    """Counted attempts of each learner."""
    return (
        without_null_keys(bucketed, ["learner_id"])
        .groupBy("bucket", "learner_id")
        .agg(F.sum("work").alias("work"))
    )


def median_work(bucketed: DataFrame) -> DataFrame:
    """Median over learners of the number of counted attempts."""
    medians = spread(learner_work(bucketed), ["bucket"], {"work": 10.0})
    return named_buckets(medians.select("bucket", F.col("work_median").alias("median_work")))


# --- time ------------------------------------------------------------------------------------------


def learner_days(bucketed: DataFrame, cap_seconds: int = DAY_CAP_SECONDS) -> DataFrame:
    """Seconds between a learner's first and last attempt of a day, at most ``cap_seconds``.

    Attempts without a time belong to no day.
    """
    return (
        without_null_keys(bucketed, ["learner_id", "activity_date"])
        .groupBy("bucket", "learner_id", "activity_date")
        .agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
        .select(
            "bucket",
            "learner_id",
            "activity_date",
            F.least(
                seconds_between(F.col("first_at"), F.col("last_at")), F.lit(float(cap_seconds))
            ).alias("seconds"),
        )
    )


def _minutes(seconds: Column) -> Column:
    exact = F.sum(seconds.cast("decimal(18,6)")).cast("double")
    return round_even(exact / 60.0, 2)


def time_spent(bucketed: DataFrame) -> DataFrame:
    """Minutes spent by all learners."""
    minutes = _minutes(F.col("seconds")).alias("minutes")
    return named_buckets(learner_days(bucketed).groupBy("bucket").agg(minutes))


def time_summary(bucketed: DataFrame) -> DataFrame:
    """Minutes spent, and minutes divided by learners; both the total and the quotient are rounded."""
    per_learner = (
        learner_days(bucketed)
        .groupBy("bucket", "learner_id")
        .agg(F.sum(F.col("seconds").cast("decimal(18,6)")).alias("seconds"))
    )
    minutes = _minutes(F.col("seconds"))
    return named_buckets(
        per_learner.groupBy("bucket").agg(
            minutes.alias("minutes"),
            round_even(minutes / F.count(F.lit(1)).cast("double"), 2).alias("minutes_per_learner"),
        )
    )


def time_per_learner(bucketed: DataFrame) -> DataFrame:
    return time_summary(bucketed).drop("minutes")


def low_time(time: DataFrame, threshold: float = LOW_TIME_MINUTES) -> DataFrame:
    return time.withColumn("low_time", F.col("minutes") < threshold)


# --- accuracy --------------------------------------------------------------------------------------


def learner_accuracy(bucketed: DataFrame) -> DataFrame:
    """Percentage of correct answers of each learner."""
    return (
        without_null_keys(bucketed, ["learner_id"])
        .groupBy("bucket", "learner_id")
        .agg(percentage(F.sum("score"), F.sum("scored")).alias("accuracy"))
    )


def median_accuracy(bucketed: DataFrame) -> DataFrame:
    """Median over learners of the percentage of correct answers.

    Percentages have two decimals, so a group has at most 10,001 distinct ones.
    """
    median = round_even(F.median("accuracy"), 2).alias("median_accuracy")
    return named_buckets(learner_accuracy(bucketed).groupBy("bucket").agg(median))
