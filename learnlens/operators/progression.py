"""How far learners have come on the ladder of grades of each operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from learnlens.functions.values import grade_rank, lookup, operation_rank, round_even, share_text
from learnlens.operators.filters import non_diagnostic, without_null_keys
from learnlens.operators.reshape import domain_order
from learnlens.schema import GRADE_STEPS, GRADES, PROMOTED_GRADE, TARGET_ACHIEVED, TARGET_GRADE

LAST_QUESTION_KEYS = ["operation", "qset_grade", "question_set_id", "question_id"]
CURRENT_GRADES = [*GRADES, TARGET_ACHIEVED]


def mark_last_question(attempts: DataFrame, last_questions: DataFrame) -> DataFrame:
    """Attempts with ``is_found``: whether the question is the last one of its operation and grade.

    There is one last question per operation and grade. Pass them stored, so that Spark knows how small they are
    and leaves the attempts where they lie.
    """
    last = last_questions.select(*LAST_QUESTION_KEYS).distinct().withColumn("_found", F.lit(True))
    return attempts.join(last, LAST_QUESTION_KEYS, "left").withColumn(
        "is_found", F.coalesce("_found", F.lit(False))
    ).drop("_found")


def grade_ladder(
    attempts: DataFrame, last_questions: DataFrame, school: str | None = None
) -> DataFrame:
    """One row per learner, operation and question-set grade attempted outside diagnostics.

    ``next_grade`` is the learner's next row across all operations; ``target_grade`` is the class below the
    learner's own, for class-two to class-six.
    """
    practice = non_diagnostic(attempts)
    if school:
        practice = practice.where(F.col("school") == school)
    keys = ["learner_id", "grade", "operation", "qset_grade"]
    ladder = (
        without_null_keys(mark_last_question(practice, last_questions), keys)
        .groupBy(*keys)
        .agg(F.bool_or("is_found").alias("is_last"))
        .withColumns(
            {
                "operation_order": operation_rank(F.col("operation")),
                "qset_grade_order": grade_rank(F.col("qset_grade")),
                "target_grade": lookup(TARGET_GRADE, F.col("grade")),
            }
        )
    )
    along = Window.partitionBy("learner_id").orderBy(
        F.col("operation_order").asc_nulls_last(),
        F.col("qset_grade_order").asc_nulls_last(),
        "grade",
        "operation",
        "qset_grade",
    )
    return ladder.withColumn("next_grade", F.lead("qset_grade").over(along))


def current_grades(ladder: DataFrame) -> DataFrame:
    """Where each learner stands in each operation, with the grade they started at.

    The highest row decides. If the learner finished it, or went on to anything after it, they have achieved
    the target when it is the target grade and stand one class higher otherwise. Learners without a target
    grade have no standing.
    """
    group = ["learner_id", "operation", "grade", "target_grade"]
    rank = F.struct(
        F.coalesce("operation_order", F.lit(len(GRADES) + 1)),
        F.coalesce("qset_grade_order", F.lit(len(GRADES) + 1)),
    )
    latest = F.max_by(F.struct("qset_grade", "is_last", "next_grade"), rank)
    standing = (
        without_null_keys(ladder, group)
        .groupBy(*group)
        .agg(latest.alias("last"), F.min_by("qset_grade", rank).alias("starting_grade"))
    )
    reached = F.col("last.qset_grade")
    moved_on = F.col("last.is_last") | F.col("last.next_grade").isNotNull()
    current = (
        F.when(~moved_on, reached)
        .when(reached == F.col("target_grade"), F.lit(TARGET_ACHIEVED))
        .otherwise(F.coalesce(lookup(PROMOTED_GRADE, reached), reached))
    )
    return standing.select(*group, "starting_grade", current.alias("current_grade"))


def progress_matrix(current: DataFrame) -> DataFrame:
    """Percent of the learners of each operation, starting and target grade in each current grade.

    ``learners_count`` is the size of the cell, ``total_count`` that of the operation and starting grade.
    A learner has one row per operation and target grade, so counting rows counts distinct learners.
    """
    cell = ["operation", "starting_grade", "target_grade"]
    counts = current.groupBy(*cell).agg(
        F.count("learner_id").alias("learners_count"),
        *[F.count_if(F.col("current_grade") == g).alias(f"_{g}") for g in CURRENT_GRADES],
    )
    total = Window.partitionBy("operation", "starting_grade")
    shares = {
        g: F.when(
            F.col(f"`_{g}`") > 0,
            round_even(F.col(f"`_{g}`") / F.col("learners_count").cast("double"), 2) * 100.0,
        )
        for g in CURRENT_GRADES
    }
    return counts.select(
        *cell,
        *[share.alias(g) for g, share in shares.items()],
        "learners_count",
        F.sum("learners_count").over(total).alias("total_count"),
    )


def progress_report(matrix: DataFrame) -> DataFrame:
    """The matrix with percentages as text, in operation and grade order."""
    shown = [*GRADE_STEPS, TARGET_ACHIEVED]
    return matrix.withColumns(
        {g: share_text(F.round(F.col(f"`{g}`"), 2)) for g in shown}
    ).orderBy(
        *domain_order("operation", "starting_grade"),
        grade_rank(F.col("target_grade")).asc_nulls_last(),
    )
