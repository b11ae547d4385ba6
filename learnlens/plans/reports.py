"""The content and progress reports, each from its source tables or the attempt fact to shown rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from learnlens.operators import content, progression
from learnlens.operators.filters import completed
from learnlens.schema import HIGH_SCORE, LOW_SCORE
from learnlens.sources import extracts
from learnlens.sources.scratch import written


def grade_performance_report(
    tables: extracts.Tables,
    purpose: str | None = None,
    repository: str | None = None,
    low: float = LOW_SCORE,
    high: float = HIGH_SCORE,
) -> DataFrame:
    """Scores per operation and grade with easy and hard question sets.

    Journeys and results are joined once; their score counts are stored and read by both halves.
    """
    results = extracts.set_results(tables, purpose, repository)
    counts = written(content.result_counts(results), "result-counts")
    return content.grade_performance(counts, low, high)


def learner_progress_report(
    attempts: DataFrame, last_questions: DataFrame, school: str | None = None
) -> DataFrame:
    """Where learners stand, by operation, starting and target grade."""
    stored = written(last_questions, "last-questions")
    ladder = progression.grade_ladder(attempts, stored, school)
    return progression.progress_report(
        progression.progress_matrix(progression.current_grades(ladder))
    )


def qset_performance_report(
    attempts: DataFrame,
    repository: str | None = None,
    qsets: Sequence[str] | None = None,
    operation: str | None = None,
    l2_skill: str | None = None,
    l3_skill: str | None = None,
    purpose: str | None = None,
) -> DataFrame:
    """Difficulty of question sets; nothing is shown until some filter is chosen."""
    chosen = [repository, qsets, operation, l2_skill, l3_skill, purpose]
    rows = completed(attempts, *chosen)
    if not any(chosen):
        rows = rows.where(F.lit(False))
    return content.qset_report(content.qset_performance_of(rows))


def question_performance_report(tables: extracts.Tables, qset_uid: str | None) -> DataFrame:
    """Difficulty of the questions of one question set; nothing is shown until one is chosen."""
    rows = extracts.question_answers(tables, qset_uid)
    if not qset_uid:
        rows = rows.where(F.lit(False))
    return content.question_report(
        content.question_performance_of(rows, extracts.set_labels(tables), extracts.question_labels(tables))
    )
