"""Lookup decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def decode_lookup(
    df: DataFrame, ref: DataFrame, left_key: str, right_key: str, value: str, name: str
) -> DataFrame:
    """Replace ``left_key`` by the ``value`` that ``ref`` gives for it, as column ``name``."""
    codes = ref.select(F.col(right_key).alias(left_key), F.col(value).alias(name))
    return df.join(codes, left_key, "left").drop(left_key)
