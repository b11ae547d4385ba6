import datetime as dt

import pytest

from learnlens.operators import activity as act
from learnlens.operators import jumps
from learnlens.operators.filters import Period, Selection
from helpers import at, attempts, rows_of

START = dt.datetime(2024, 1, 8, 8, 0)


def span(seconds, start_minute=0, day=8, **fields):
    """Two attempts ``seconds`` apart."""
    start = dt.datetime(2024, 1, day, 6, 0) + dt.timedelta(minutes=start_minute)
    return [
        {"updated_at": start, **fields},
        {"updated_at": start + dt.timedelta(seconds=seconds), **fields},
    ]


def activity(spark, *groups):
    return act.activity_rows(attempts(spark, *[row for group in groups for row in group]))


def times(daily):
    return {r["operation"]: r["time_spent"] for r in daily.collect()}


def test_days_over_the_cap_use_differences(spark):
    frame = activity(
        spark,
        span(5000, 0, operation="Addition"),
        span(100, 100, operation="Subtraction"),
        span(2700, 200, operation="Multiplication"),
    )
    assert times(jumps.operation_time_daily(frame)) == {
        "Addition": 5000.0,
        "Subtraction": 2600.0,
        "Multiplication": 2600.0,
    }


def test_day_at_exactly_the_cap_is_unchanged(spark):
    frame = activity(
        spark, span(2000, 0, operation="Addition"), span(700, 60, operation="Subtraction")
    )
    assert times(jumps.operation_time_daily(frame)) == {"Addition": 2000.0, "Subtraction": 700.0}


def test_day_just_over_the_cap(spark):
    frame = activity(
        spark, span(2000, 0, operation="Addition"), span(701, 60, operation="Subtraction")
    )
    assert times(jumps.operation_time_daily(frame)) == {"Addition": 2000.0, "Subtraction": 1299.0}


def test_equal_start_times_are_settled_by_attributes(spark):
    frame = activity(
        spark, span(2000, 0, operation="Subtraction"), span(1000, 0, operation="Addition")
    )
    assert times(jumps.operation_time_daily(frame)) == {"Addition": 1000.0, "Subtraction": 1000.0}


def test_microseconds_count(spark):
    frame = activity(spark, [{"updated_at": at(8)}, {"updated_at": at(8, 10, 0, 1, micro=900000)}])
    assert times(jumps.operation_time_daily(frame)) == {"Addition": 1.9}


def test_diagnostics_count_for_operations_only(spark):
    frame = activity(spark, span(60, purpose="Main Diagnostic"), span(30, 60, purpose=None))
    assert jumps.grade_time_daily(frame).collect()[0]["time_spent"] == 30.0
    # One task of 3,630 s: capped, and alone it does not exceed the cap.
    assert jumps.operation_time_daily(frame).collect()[0]["time_spent"] == 2700.0


def test_attempts_without_tenant_or_operation_are_left_out(spark):
    frame = activity(spark, span(60, tenant_name=None), span(60, 30, operation=None))
    assert jumps.operation_time_daily(frame).count() == 0


def learner(number, first_minutes):
    """Class-one on day 8, class-three on day 9, in one operation."""
    return [
        span(first_minutes * 60, day=8, learner_id=str(number), qset_grade="class-one"),
        span(60, day=9, learner_id=str(number), qset_grade="class-three"),
    ]


def test_step_is_the_grade_attempted_before(spark):
    frame = activity(spark, *learner(1, 10))
    assert rows_of(jumps.grade_jumps(frame), "learner_id", "step", "reached", "minutes") == [
        ("1", "class-one", "class-three", 10.0)
    ]


def test_medians_and_learner_counts(spark):
    second = span(60, day=16, learner_id="1", qset_grade="class-one", operation="Division")
    third = span(60, day=17, learner_id="1", qset_grade="class-two", operation="Division")
    frame = activity(spark, *learner(1, 10), *learner(2, 21), second, third)
    medians = jumps.jump_medians(
        jumps.grade_steps(frame, Selection(), Period(), as_of=dt.date(2024, 1, 30))
    )
    assert rows_of(medians, "bucket", "step", "median_minutes", "learners") == [
        ("2024-01-08,2024-01-14", "all", 15.5, 2),
        ("2024-01-08,2024-01-14", "class-one", 15.5, 2),
        ("2024-01-15,2024-01-21", "all", 1.0, 1),
        ("2024-01-15,2024-01-21", "class-one", 1.0, 1),
        ("overall", "all", 10.0, 2),
        ("overall", "class-one", 10.0, 2),
    ]


def test_date_rule_looks_at_the_step_reached(spark):
    frame = activity(spark, *learner(1, 10))
    on_day_9 = Period(dt.date(2024, 1, 9), dt.date(2024, 1, 9))
    on_day_8 = Period(dt.date(2024, 1, 8), dt.date(2024, 1, 8))
    assert jumps.grade_steps(frame, Selection(), on_day_9).count() > 0
    assert jumps.grade_steps(frame, Selection(), on_day_8).count() == 0


def test_incomplete_period_means_the_default_weeks(spark):
    frame = activity(spark, *learner(1, 10))
    early_start = Period(dt.date(2024, 1, 1))
    placed = jumps.grade_steps(frame, Selection(), early_start, as_of=dt.date(2024, 3, 20))
    assert {r["bucket"] for r in act.named_buckets(placed).collect()} == {"overall"}


def test_last_steps_are_counted_but_not_shown(spark):
    frame = activity(
        spark,
        span(60, day=8, qset_grade="class-six"),
        span(60, day=9, qset_grade="class-seven"),
    )
    steps = jumps.grade_steps(frame, Selection(), Period(), weekly=False)
    assert rows_of(steps, "step") == [("all",)]


def test_selection_is_applied_after_the_daily_adjustment(spark):
    frame = activity(
        spark,
        span(2000, 0, day=8, operation="Addition", qset_grade="class-one"),
        span(1000, 60, day=8, operation="Division", qset_grade="class-one"),
        span(60, day=9, operation="Division", qset_grade="class-two"),
    )
    division = jumps.grade_jumps(frame, Selection(operation="Division"))
    assert rows_of(division, "step", "minutes") == [("class-one", 16.67)]


def test_operation_jumps_ignore_the_operation_filter(spark):
    frame = activity(
        spark, span(600, day=8, operation="Addition"), span(60, day=9, operation="Division")
    )
    jumped = jumps.operation_jumps(frame, Selection(operation="Division"))
    assert rows_of(jumped, "step", "reached", "minutes") == [("Addition", "Division", 10.0)]


@pytest.mark.parametrize("steps", [jumps.grade_steps, jumps.operation_steps])
def test_jumps_of_activity_in_buckets_of_learners_need_no_shuffle(spark, steps):
    from learnlens.operators.activity import activity_daily, learner_buckets, weekly
    from learnlens.sources import binding
    from learnlens.sources.scratch import written_by

    daily = activity_daily(binding.attempts(spark, "/root/testdata/sf0.001", shared_devices=True))
    stored = written_by(daily, "activity", "learner_id", 4)

    def placed(activity):
        return steps(activity, Selection(), Period(), as_of=dt.date(2024, 1, 30))

    found = placed(stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    assert rows_of(found) == rows_of(placed(daily)) and found.count() > 0
    # only the medians and counts of buckets are shuffled, and learners per bucket not at all
    assert "Exchange" not in learner_buckets(weekly(stored))._jdf.queryExecution().executedPlan().toString()
