"""Pivots with known columns, domain orders and ordered value lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from learnlens.functions.values import grade_rank, operation_rank


def pivot_buckets(
    metric: DataFrame, buckets: Sequence[str], value: str, index: Sequence[str] = ()
) -> DataFrame:
    """Buckets as columns. The columns are given, so no job runs to find them."""
    return metric.groupBy(*index).pivot("bucket", list(buckets)).agg(F.first(value))


def domain_order(
    operation: str | None = None, grade: str | None = None, *then: str
) -> list[Column]:
    """Sort columns: operation order, grade order, then plain columns; unknown values come last."""
    ranks = []
    if operation:
        ranks.append(operation_rank(F.col(operation)).asc_nulls_last())
    if grade:
        ranks.append(grade_rank(F.col(grade)).asc_nulls_last())
    return [*ranks, *[F.col(c).asc_nulls_last() for c in then]]


def dim_values(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Sorted distinct values of a dimension column."""
    rows = df.where(where) if where is not None else df
    return rows.select(column).distinct().orderBy(F.col(column).asc_nulls_last())


def learner_labels(learners: DataFrame) -> DataFrame:
    """Sorted distinct ``username-name`` captions; a missing part is left empty."""
    label = F.concat(
        F.coalesce("user_name", F.lit("")), F.lit("-"), F.coalesce("name", F.lit(""))
    )
    return (
        learners.select("user_name", label.alias("learners_name"))
        .groupBy("learners_name")
        .agg(F.min("user_name").alias("user_name"))
        .orderBy(F.col("user_name").asc_nulls_last(), "learners_name")
        .select("learners_name")
    )
