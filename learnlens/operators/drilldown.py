"""Lists behind a figure of the master report: its learners, and one learner's question sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from learnlens.functions.calendar import seconds_between
from learnlens.functions.values import percentage, round_even
from learnlens.operators.filters import Period, Selection, in_list, without_null_keys
from learnlens.schema import DAY_CAP_SECONDS, GRADES

IN_PROGRESS = "in progress"


def chosen_operation(clicked: str, child: str | None, parent: str | None) -> list[str]:
    """Operations a learner list is narrowed by: the list's own filter replaces the clicked row;
    without one, the report's operation filter applies besides the clicked row."""
    if child:
        return [child]
    return [clicked, parent] if parent else [clicked]


def learner_list(
    attempts: DataFrame,
    operation: str,
    period: Period = Period(),
    parent: Selection = Selection(),
    child: Selection = Selection(),
    purposes: Sequence[str] | None = None,
    grades: Sequence[str] = GRADES,
) -> DataFrame:
    """Per learner the attempts and accuracy in each question-set grade, one column pair per grade.

    School and grade of ``child`` replace those of ``parent``. Grade, name and username are those of the
    learner's latest attempt.
    """
    rows = attempts
    for op in chosen_operation(operation, child.operation, parent.operation):
        rows = rows.where(F.col("operation") == F.lit(op))
    rows = rows.where(period.open_ended(F.to_date("updated_at")))
    rows = Selection(
        school=child.school or parent.school,
        grade=child.grade or parent.grade,
        tenant=parent.tenant,
    ).apply(rows)
    rows = in_list(rows, "purpose", purposes)

    # The first step reduces the attempts and only counts and adds, which Spark does without sorting them.
    group = ["learner_id", "learner_username", "grade", "qset_grade"]
    per_grade = (
        without_null_keys(rows, group)
        .groupBy(*group, "learner_name")
        .agg(
            F.count("attempts_count").alias("attempted"),
            F.sum("score").alias("score"),
            F.count("score").alias("scored"),
            F.max("updated_at").alias("latest_at"),
        )
        .groupBy(*group)
        .agg(
            F.sum("attempted").alias("attempted"),
            percentage(F.sum("score"), F.sum("scored")).alias("accuracy"),
            F.max_by("learner_name", "latest_at").alias("learner_name"),
            F.max("latest_at").alias("latest_at"),
        )
    )

    def in_grade(column: str, grade: str):
        return F.avg(F.when(F.col("qset_grade") == grade, F.col(column)))

    return per_grade.groupBy("learner_id").agg(
        *[in_grade("attempted", g).alias(g) for g in grades],
        *[in_grade("accuracy", g).alias(f"{g}-avg") for g in grades],
        F.max_by("grade", "latest_at").alias("grade"),
        F.max_by("learner_name", "latest_at").alias("learner_name"),
        F.max_by("learner_username", "latest_at").alias("learner_username"),
    )


def learner_detail(
    attempts: DataFrame,
    positions: DataFrame,
    learner_id: str | None = None,
    username: str | None = None,
    qset_grade: str | None = None,
    operation: str | None = None,
    purposes: Sequence[str] | None = None,
    cap_seconds: int = DAY_CAP_SECONDS,
) -> DataFrame:
    """Per learner and question set: questions attempted, accuracy, time, last date and wrong answers.

    A username replaces the learner id; with neither, every learner is listed. Time is capped per day. Wrong
    answers are listed by position within each day, days in order. Attempts without a time belong to no day and are left
    out. The question set a learner id touched last is shown as in progress, once for each id of a username.
    """
    rows = attempts
    if username:
        rows = rows.where(F.col("learner_username") == F.lit(username))
    elif learner_id:
        rows = rows.where(F.col("learner_id") == F.lit(learner_id))
    if qset_grade:
        rows = rows.where(F.col("qset_grade") == F.lit(qset_grade))
    if operation:
        rows = rows.where(F.col("operation") == F.lit(operation))
    rows = in_list(rows, "purpose", purposes)

    keys = ["learner_id", "question_set_id", "qset_name"]
    placed = without_null_keys(rows, [*keys, "updated_at"]).select(
        *keys, "question_id", "attempts_count", "score", "updated_at"
    ).join(
        positions.select("question_id", "question_set_id", "sequence"),
        ["question_id", "question_set_id"],
        "left",
    )
    # Counted per position first, so that only positions, and not attempts, are gathered into lists.
    by_position = placed.groupBy(*keys, F.to_date("updated_at").alias("day"), "sequence").agg(
        F.count("attempts_count").alias("attempted"),
        F.sum("score").alias("score"),
        F.min("updated_at").alias("first_at"),
        F.max("updated_at").alias("last_at"),
        F.max((F.col("score") == 0).cast("int")).alias("missed"),
    )
    wrong = F.array_sort(F.collect_list(F.when(F.col("missed") == 1, F.col("sequence"))))
    days = by_position.groupBy(*keys, "day").agg(
        F.sum("attempted").alias("attempted"),
        F.sum("score").alias("score"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.array_join(wrong.cast("array<string>"), ",").alias("wrong"),
    )
    seconds = F.least(
        seconds_between(F.col("first_at"), F.col("last_at")), F.lit(float(cap_seconds))
    ).cast("decimal(18,6)")
    by_day = F.array_sort(
        F.collect_list(F.when(F.col("wrong") != "", F.struct("day", "wrong")))
    )
    sets = days.groupBy(*keys).agg(
        F.sum("attempted").alias("total_questions_attempted"),
        F.coalesce(F.sum("score"), F.lit(0)).cast("bigint").alias("total_score"),
        F.max("day").alias("last_day"),
        round_even(F.sum(seconds).cast("double") / 60.0, 2).alias("time_taken"),
        F.max("last_at").alias("last_at"),
        F.array_join(F.transform(by_day, lambda d: d["wrong"]), ",").alias("incorrect_attempts"),
    )
    newest = Window.partitionBy("learner_id").orderBy(
        F.col("last_at").desc(), "question_set_id", "qset_name"
    )
    return (
        sets.withColumn("_newest", F.row_number().over(newest) == 1)
        .select(
            *keys,
            "total_questions_attempted",
            "total_score",
            percentage(F.col("total_score"), F.col("total_questions_attempted")).alias("accuracy"),
            "time_taken",
            F.when(F.col("_newest"), F.lit(IN_PROGRESS))
            .otherwise(F.col("last_day").cast("string"))
            .alias("attempted_date"),
            "incorrect_attempts",
            F.col("last_at").alias("max_timestamp"),
        )
        .orderBy("learner_id", "max_timestamp", "question_set_id")
    )
