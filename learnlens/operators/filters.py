"""Filters of the reports. Conditions are plain columns, so Spark pushes them into the scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from learnlens.functions.calendar import default_start
from learnlens.schema import COMPLETED, DIAGNOSTIC, NO_SCHOOL


@dataclass(frozen=True)
class Selection:
    """Optional equality filters; an unset or empty one is not applied."""

    school: str | None = None
    grade: str | None = None
    operation: str | None = None
    tenant: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        chosen = {
            "school": self.school,
            "grade": self.grade,
            "operation": self.operation,
            "tenant_name": self.tenant,
        }
        for column, value in chosen.items():
            if value:
                df = df.where(F.col(column) == F.lit(value))
        return df

    def any_operation(self) -> Selection:
        """The same selection for metrics that take no operation filter."""
        return replace(self, operation=None)


@dataclass(frozen=True)
class Period:
    """A date range. Overall figures use it only when both ends are set, weekly ones use each end."""

    start: dt.date | None = None
    end: dt.date | None = None

    def closed(self, day: Column) -> Column:
        if self.start and self.end:
            return day.between(F.lit(self.start), F.lit(self.end))
        return F.lit(True)

    def open_ended(self, day: Column) -> Column:
        inside = F.lit(True)
        if self.start:
            inside = inside & (day >= F.lit(self.start))
        if self.end:
            inside = inside & (day <= F.lit(self.end))
        return inside

    def before(self, day: Column) -> Column:
        return day < F.lit(self.start) if self.start else F.lit(False)

    def or_lookback(self, as_of: dt.date) -> Period:
        """This range if both ends are set, else the default weeks up to ``as_of``, open-ended."""
        if self.start and self.end:
            return self
        return Period(start=default_start(as_of))


def in_list(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    return df.where(F.col(column).isin(list(values))) if values else df


def non_diagnostic(attempts: DataFrame) -> DataFrame:
    """Attempts that are not diagnostic; an unknown purpose counts as not diagnostic."""
    return attempts.where(~F.col("purpose").eqNullSafe(F.lit(DIAGNOSTIC)))


def without_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have a value in every grouping key; the others belong to no group.

    One plain condition per column, which is what a Parquet scan can take over.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def completed(
    attempts: DataFrame,
    repository: str | None = None,
    qsets: Sequence[str] | None = None,
    operation: str | None = None,
    l2_skill: str | None = None,
    l3_skill: str | None = None,
    purpose: str | None = None,
) -> DataFrame:
    """Attempts of completed journeys, narrowed by whatever is given."""
    df = attempts.where(F.col("status") == COMPLETED)
    chosen = {
        "repo_name": repository,
        "l1_skill": operation,
        "l2_skill": l2_skill,
        "l3_skill": l3_skill,
        "purpose": purpose,
    }
    for column, value in chosen.items():
        if value:
            df = df.where(F.col(column) == F.lit(value))
    return in_list(df, "qset_uid", qsets)


def of_school(df: DataFrame, school: str | None) -> DataFrame:
    """Rows of one school, where ``No School`` stands for a missing one."""
    if not school:
        return df
    if school == NO_SCHOOL:
        return df.where(F.col("school").isNull())
    return df.where(F.col("school") == F.lit(school))
