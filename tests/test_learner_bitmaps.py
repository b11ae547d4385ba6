"""Distinct learners by bitmaps against distinct counts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from learnlens.operators import activity as act, learner_bitmaps as lb
from learnlens.operators.filters import Period, Selection
from helpers import at, attempts, rows_of


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    made = [
        {
            "learner_id": rng.choice([None, *[f"l{k}" for k in range(40)]]),
            "updated_at": rng.choice([None, *[at(d) for d in range(1, 29)]]),
            "operation": rng.choice(["Addition", "Division", None]),
            "school": rng.choice(["A", "B"]),
            "grade": rng.choice(["class-two", None]),
        }
        for _ in range(900)
    ]
    made.append({"learner_id": None, "updated_at": at(31), "school": "C"})
    return act.activity_rows(attempts(spark, *made))


@pytest.fixture(scope="module")
def rollup(rows):
    return lb.learner_rollup(rows, lb.numbered_learners(rows)).cache()


@pytest.mark.parametrize("period", [Period(), Period(dt.date(2024, 1, 4), dt.date(2024, 1, 19)), Period(dt.date(2024, 1, 9))])
@pytest.mark.parametrize("selection", [Selection(), Selection(school="A", grade="class-two"), Selection(operation="Division"), Selection(school="none")])
def test_counts_agree_for_every_filter(rows, rollup, period, selection):
    chosen, merged = selection.apply(rows), selection.apply(rollup)
    for place in (act.overall, act.weekly, act.overall_and_weekly):
        assert rows_of(lb.unique_learners(place(merged, period))) == rows_of(act.unique_learners(place(chosen, period)))
        ours, theirs = (f(place(x, period)) for f, x in ((lb.unique_learners_by_operation, merged), (act.unique_learners_by_operation, chosen)))
        assert rows_of(ours, "bucket", "operation", "learners") == rows_of(theirs, "bucket", "operation", "learners")


def test_numbers_are_dense_and_stay(spark):
    ids = spark.range(70_000, numPartitions=7).select((F.col("id") % 60_000).cast("string").alias("learner_id"))
    first = lb.numbered_learners(ids)
    numbers = sorted(r["number"] for r in first.collect())
    assert numbers == list(range(1, 60_001))
    more = spark.range(59_990, 60_010).select(F.col("id").cast("string").alias("learner_id"))
    both = lb.numbered_learners(more, first)
    assert sorted(r["number"] for r in both.collect()) == list(range(1, 60_011))
    assert both.join(first, ["learner_id", "number"]).count() == 60_000
    # more learners than a part has bits, on two days
    activity = ids.withColumn("activity_date", F.date_add(F.lit(dt.date(2024, 1, 8)), (F.col("learner_id").cast("int") % 2)))
    merged = lb.learner_rollup(activity, first)
    assert rows_of(lb.unique_learners(act.weekly(merged))) == [("2024-01-08,2024-01-14", 60_000)]
    assert merged.select("part").distinct().count() == 2


def test_weeks_shuffle_bitmaps_and_no_learner_ids(rollup, spark, tmp_path):
    rollup.write.parquet(str(tmp_path / "rollup"))
    stored = spark.read.parquet(str(tmp_path / "rollup"))
    plan = lb.unique_learners(act.weekly(stored))._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_or_agg" in plan and "learner_id" not in plan


def test_nothing(spark, rows):
    none = rows.limit(0)
    assert lb.unique_learners(act.weekly(lb.learner_rollup(none, lb.numbered_learners(none)))).collect() == []
