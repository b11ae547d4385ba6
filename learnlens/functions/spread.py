"""Exact medians and means of groups that may be far larger than one task can hold.

``F.median`` keeps every distinct value of a group in the memory of one task. Here a group is first
reduced to counts per distinct value, spread over all tasks. Bins of the value range are then ranked, parts of the
one or two bins that hold the middle ranks likewise, and only the parts with those ranks are looked at value by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTS = 4096


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    pairs = (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns)
    return reduce(lambda a, b: a & b, pairs)


def _quoted(columns: Sequence[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def _middle_parts(binned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of those parts of the bins that hold the middle ranks, with the number of smaller values."""
    upto_part = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    parts = (
        binned.groupBy(*keys, "_part")
        .agg(F.sum("_valid").alias("_in"), *[F.max(c).alias(c) for c in ("_before", "_low", "_high")])
        .withColumn("_upto", F.col("_before") + F.sum("_in").over(upto_part))
        .where("_upto >= _low and _upto - _in < _high")
        .select(*keys, "_part", (F.col("_upto") - F.col("_in")).alias("_smaller"))
    )
    joined = binned.alias("v").join(parts.alias("p"), _same("v", "p", [*keys, "_part"]))
    return joined.select(*[f"v.{c}" for c in binned.columns if c != "_before"], F.col("p._smaller").alias("_before"))


def spread(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, float],
    tallies: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Per group: ``rows``, sums of ``tallies`` and, per measure, its count, mean and exact median.

    ``measures`` maps a numeric column to the bin width its values are ranked with; the width affects
    speed only. Nulls in a measure are left out of its count, mean and median. Null keys form a group. A
    ``weight`` column makes a row stand for that many equal ones. Means are of values times weights rounded to ten
    decimal places, which makes them the same in any order of the rows; products may have up to 28 digits before the point.
    The output columns of measure ``m`` are ``m_count``, ``m_mean`` and ``m_median``.
    """
    group = [*keys, "_measure"]
    summed = ["_n", "_valid", "_sum", *[f"_t_{t}" for t in tallies]]

    stacked = ", ".join(
        f"named_struct('_measure', '{name}', '_width', {float(width)}D, '_value', cast(`{name}` as double))"
        for name, width in measures.items()
    )
    carried = [f"cast(`{t}` as bigint) as _t_{t}" for t in tallies]
    number = f"cast(`{weight}` as bigint)" if weight else "1L"
    counts = (
        df.selectExpr(*_quoted(keys), f"{number} as _w", *carried, f"inline(array({stacked}))")
        .groupBy(*group, "_width", "_value")
        .agg(
            F.expr("sum(_w) as _n"),
            F.expr("sum(if(_value is null, 0L, _w)) as _valid"),
            F.expr("sum(cast(_value * _w as decimal(38, 10))) as _sum"),
            *[F.expr(f"sum(_t_{t}) as _t_{t}") for t in tallies],
        )
        .withColumn("_bin", F.expr("floor(_value / _width)"))
    )
    # Both uses of the counts below need all their columns, whatever the caller reads of the result, so that
    # Spark runs them as one shuffle and what lies before it once. The condition names every column and holds for any hash.
    counts = counts.where(F.xxhash64(*summed) >= F.lit(-(1 << 63)))

    by_group = Window.partitionBy(*group)
    upto_bin = by_group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    middle = "_upto >= _low and _upto - _valid < _high"
    middle_bins = (
        counts.groupBy(*group, "_bin")
        .agg(*[F.sum(c).alias(c) for c in summed])
        .select(
            "*",
            F.sum("_valid").over(upto_bin).alias("_upto"),
            *[F.sum(c).over(by_group).alias(f"_all{c}") for c in summed],
        )
        .selectExpr(
            "*",
            "floor((_all_valid + 1) / 2) as _low",
            "floor((_all_valid + 2) / 2) as _high",
            "_upto - _valid as _before",
        )
        .where(middle)
        .drop("_upto", *summed)
    )

    within_part = (
        Window.partitionBy(*group, "_bin", "_part")
        .orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    totals = [f"_all{c}" for c in summed]
    summary = (
        counts.alias("c")
        .join(middle_bins.alias("b"), _same("c", "b", [*group, "_bin"]))
        .select("c.*", "b._before", "b._low", "b._high", *[f"b.{t}" for t in totals])
        .withColumn("_part", F.expr(f"floor((_value / _width - _bin) * {PARTS})"))
    )
    summary = (
        _middle_parts(summary, [*group, "_bin"])
        .withColumn("_upto", F.col("_before") + F.sum("_valid").over(within_part))
        .where(middle)
        .groupBy(*group)
        .agg(
            F.expr("(min(_value) + max(_value)) / 2 as _median"),
            *[F.max(t).alias(t) for t in totals],
        )
    )

    first = next(iter(measures))
    mean = "try_divide(cast(_all_sum as double), cast(_all_valid as double))"
    if len(measures) == 1:
        return summary.selectExpr(
            *_quoted(keys),
            "_all_n as rows",
            *[f"_all_t_{t} as `{t}`" for t in tallies],
            f"_all_valid as `{first}_count`",
            f"{mean} as `{first}_mean`",
            f"_median as `{first}_median`",
        )

    def of(measure: str, value: str, name: str) -> Column:
        return F.expr(f"max(if(_measure = '{measure}', {value}, null)) as `{name}`")

    return summary.groupBy(*keys).agg(
        of(first, "_all_n", "rows"),
        *[of(first, f"_all_t_{t}", t) for t in tallies],
        *[of(m, "_all_valid", f"{m}_count") for m in measures],
        *[of(m, mean, f"{m}_mean") for m in measures],
        *[of(m, "_median", f"{m}_median") for m in measures],
    )
