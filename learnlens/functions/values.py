"""Scalar expressions: lookups, half-even rounding, JSON text and report formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from learnlens.schema import GRADE_BY_ID, GRADE_RANK, OPERATION_RANK


def _literal(value: str | int) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"


def lookup(mapping: Mapping, key: Column) -> Column:
    """Value of ``key`` in a small constant dictionary, null where it is missing."""
    items = ", ".join(_literal(item) for pair in mapping.items() for item in pair)
    return F.expr(f"map({items})")[key]


def grade_label(grade_id: Column) -> Column:
    return lookup(GRADE_BY_ID, grade_id)


def grade_rank(grade: Column) -> Column:
    return lookup(GRADE_RANK, grade)


def operation_rank(operation: Column) -> Column:
    return lookup(OPERATION_RANK, operation)


def json_text(document: Column | str, path: str) -> Column:
    return F.get_json_object(document, f"$.{path}")


def json_fields(document: Column | str, layout: str) -> Column:
    """A document read once, as a struct of ``layout``; what it lacks, or holds in another shape, is null.

    The mode is stated so that the parse stays one: without options the optimizer makes a parse of its own for each field.
    """
    return F.from_json(document, layout, {"mode": "PERMISSIVE"})


def round_even(value: Column, places: int = 0) -> Column:
    """Round a double with ties to the even digit (``F.round`` sends ties away from zero)."""
    scale = F.lit(float(10**places))
    return F.rint(value * scale) / scale


def percentage(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` with two decimals; null when ``whole`` is zero."""
    return round_even(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, 2)


def number_text(value: Column) -> Column:
    """A number with at most two decimals as text: 35.0, 2.5, 12.25."""
    return F.regexp_replace(value.cast("decimal(24,2)").cast("string"), "0$", "")


def percent_text(fraction: Column) -> Column:
    """0.125 as ``12 %``: whole percents, ties to even."""
    return F.concat(F.rint(fraction * 100.0).cast("bigint").cast("string"), F.lit(" %"))


def share_text(percent: Column) -> Column:
    """33.0 as ``33.0 %``."""
    return F.concat(number_text(percent), F.lit(" %"))


def median_count_text(median: Column, learners: Column) -> Column:
    """``median (learners)``, or blank when there is no median."""
    text = F.concat(number_text(median), F.lit(" ("), learners.cast("string"), F.lit(")"))
    return F.coalesce(text, F.lit(""))
