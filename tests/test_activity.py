import datetime as dt

import pytest

from learnlens.operators import activity as act
from learnlens.operators.filters import Period, Selection, non_diagnostic
from helpers import at, attempts, one, rows_of

WEEK_1 = "2024-01-01,2024-01-07"
WEEK_2 = "2024-01-08,2024-01-14"
WEEK_3 = "2024-01-15,2024-01-21"


def activity(spark, *rows):
    return act.activity_rows(attempts(spark, *rows))


def both_grains(spark, *rows):
    """Row-level and daily activity must give the same figures."""
    frame = attempts(spark, *rows)
    return [act.activity_rows(frame), act.activity_daily(frame)]


def test_weeks_start_on_monday(spark):
    sunday_and_monday = activity(spark, {"updated_at": at(7, 23, 59)}, {"updated_at": at(8, 0, 0)})
    assert rows_of(act.unique_learners(act.weekly(sunday_and_monday))) == [(WEEK_1, 1), (WEEK_2, 1)]


NEW = [
    {"learner_id": "1", "operation": "Addition", "updated_at": at(8)},
    {"learner_id": "1", "operation": "Subtraction", "updated_at": at(9)},
    {"learner_id": "2", "operation": "Addition", "updated_at": at(9)},
    {"learner_id": "3", "operation": None, "updated_at": at(16)},
    {"learner_id": "1", "operation": "Division", "updated_at": at(16)},
]


def test_new_learner_counts_once_per_operation_or_once(spark):
    for frame in both_grains(spark, *NEW):
        assert rows_of(act.new_learners(frame, frame)) == [(WEEK_2, 3), (WEEK_3, 1)]
        distinct = act.new_learners(frame, frame, distinct_learners=True)
        assert rows_of(distinct) == [(WEEK_2, 2), (WEEK_3, 1)]


def test_learner_seen_before_anywhere_is_not_new(spark):
    frame = activity(spark, {"learner_id": "1", "school": "Other", "updated_at": at(2)}, *NEW)
    chosen = Selection(school="S").apply(frame)
    new = act.new_learners(chosen, frame, Period(dt.date(2024, 1, 8)), distinct_learners=True)
    assert rows_of(new) == [(WEEK_2, 1), (WEEK_3, 1)]


def test_week_without_new_learners_shows_zero(spark):
    frame = activity(spark, {"updated_at": at(8)}, {"updated_at": at(16)})
    assert rows_of(act.new_learners(frame, frame)) == [(WEEK_2, 1), (WEEK_3, 0)]


@pytest.mark.parametrize("learners, expected", [("12", 0), ("1122", 0), ("123", 1), ("1223", 1)])
def test_session_needs_three_learners(spark, learners, expected):
    frame = activity(spark, *[{"learner_id": x} for x in learners])
    assert one(act.sessions(act.overall(frame)), "sessions") == expected
    assert rows_of(act.sessions(act.weekly(frame))) == [(WEEK_2, expected)]


def test_session_is_per_school_and_grade(spark):
    frame = activity(
        spark, {"learner_id": "1"}, {"learner_id": "2"}, {"learner_id": "3", "grade": "class-one"}
    )
    assert one(act.sessions(act.overall(frame)), "sessions") == 0


def test_time_is_capped_per_learner_and_day(spark):
    frames = both_grains(
        spark,
        {"learner_id": "1", "updated_at": at(8, 10, 0)},
        {"learner_id": "1", "updated_at": at(8, 10, 50), "operation": "Division"},
        {"learner_id": "2", "updated_at": at(8, 10, 0)},
        {"learner_id": "2", "updated_at": at(8, 10, 10)},
    )
    for frame in frames:
        assert one(act.time_spent(act.overall(frame)), "minutes") == 55.0
        assert one(act.time_per_learner(act.overall(frame)), "minutes_per_learner") == 27.5
        summary = act.time_summary(act.overall(frame)).collect()[0]
        assert (summary["minutes"], summary["minutes_per_learner"]) == (55.0, 27.5)


def test_work_per_learner_is_rounded_down(spark):
    rows = [{"learner_id": str(i % 2)} for i in range(7)]
    for frame in both_grains(spark, *rows):
        assert one(act.work_per_learner(act.overall(frame)), "work_per_learner") == 3


def test_work_counts_records_overall_and_counted_attempts_weekly(spark):
    frame = activity(spark, {"attempts_count": None}, {"attempts_count": 40})
    assert one(act.work_done(act.overall(frame)), "work_done") == 2
    assert rows_of(act.work_done(act.weekly(frame))) == [(WEEK_2, 1)]


def test_unknown_operation_counts_as_work_but_not_as_operation(spark):
    frame = activity(spark, {"operation": None}, {"operation": "Addition"})
    assert one(act.work_done(act.overall(frame)), "work_done") == 2
    assert rows_of(act.unique_learners_by_operation(act.overall(frame))) == [("overall", "Addition", 1)]
    assert rows_of(act.unique_learners_with_operations(act.overall(frame))) == [
        ("overall", "Addition", 1),
        ("overall", None, 1),
    ]


def test_operation_domain_is_complete(spark):
    frame = activity(spark, {"operation": "Division"})
    filled = act.on_operation_domain(act.unique_learners_by_operation(act.weekly(frame)))
    assert dict(rows_of(filled, "operation", "learners")) == {
        "Addition": None,
        "Subtraction": None,
        "Multiplication": None,
        "Division": 1,
    }


def test_median_work_over_learners(spark):
    rows = [{"learner_id": "1"}] * 1 + [{"learner_id": "2"}] * 4 + [{"learner_id": "3"}] * 2
    rows += [{"learner_id": "4", "attempts_count": None}]
    for frame in both_grains(spark, *rows):
        assert one(act.median_work(act.overall(frame)), "median_work") == 1.5


def test_accuracy_ignores_missing_scores_and_rounds_half_to_even(spark):
    learner_1 = [{"learner_id": "1", "score": int(i < 1)} for i in range(32)]  # 3.125 %
    learner_1.append({"learner_id": "1", "score": None})
    for frame in both_grains(spark, *learner_1):
        assert one(act.median_accuracy(act.overall(frame)), "median_accuracy") == 3.12


def test_learner_without_scores_has_no_accuracy(spark):
    frame = activity(spark, {"learner_id": "1", "score": None}, {"learner_id": "2", "score": 1})
    assert one(act.median_accuracy(act.overall(frame)), "median_accuracy") == 100.0


def test_overall_needs_both_ends_and_weekly_uses_each(spark):
    frame = activity(spark, {"updated_at": at(1)}, {"updated_at": at(9)}, {"updated_at": at(16)})
    start_only = Period(dt.date(2024, 1, 8))
    assert one(act.work_done(act.overall(frame, start_only)), "work_done") == 3
    assert rows_of(act.work_done(act.weekly(frame, start_only))) == [(WEEK_2, 1), (WEEK_3, 1)]
    closed = Period(dt.date(2024, 1, 8), dt.date(2024, 1, 9))
    assert one(act.work_done(act.overall(frame, closed)), "work_done") == 1
    together = act.work_done(act.overall_and_weekly(frame, start_only))
    assert rows_of(together) == [(WEEK_2, 1), (WEEK_3, 1), ("overall", 3)]


def test_empty_selection(spark):
    nothing = Selection(school="none").apply(activity(spark, {}))
    for metric in (act.sessions, act.work_done, act.time_spent, act.work_per_learner):
        row = act.at_least_overall(metric(act.overall(nothing))).collect()[0]
        assert list(row)[1] == 0
        assert metric(act.weekly(nothing)).count() == 0
    for metric in (act.median_accuracy, act.median_work):
        row = act.at_least_overall(metric(act.overall(nothing)), None).collect()[0]
        assert list(row)[1] is None
    assert act.new_learners(nothing, nothing).count() == 0


def test_logins_count_learner_days(spark):
    days = attempts(
        spark,
        {"learner_id": "1", "updated_at": at(8, 9)},
        {"learner_id": "1", "updated_at": at(8, 11)},
        {"learner_id": "1", "updated_at": at(9)},
        {"learner_id": None, "updated_at": at(9)},
        {"learner_id": "2", "updated_at": at(16), "school": None},
    ).withColumnRenamed("updated_at", "created_on")
    logins = act.login_days(days)
    assert one(act.logged_in(act.overall(logins)), "logins") == 3
    assert rows_of(act.logged_in(act.weekly(logins))) == [(WEEK_2, 2), (WEEK_3, 1)]
    assert rows_of(logins.where("learner_id = '2'"), "school") == [("No School",)]


def test_unknown_purpose_is_not_diagnostic(spark):
    frame = attempts(
        spark, {"purpose": None}, {"purpose": "Main Diagnostic"}, {"purpose": "Practice"}
    )
    assert rows_of(non_diagnostic(frame), "purpose") == [("Practice",), (None,)]


def test_low_time_flag(spark):
    frame = activity(
        spark,
        {"updated_at": at(8, 10)},
        {"updated_at": at(8, 10, 40)},
        {"updated_at": at(16, 10)},
        {"updated_at": at(16, 10, 20)},
    )
    assert rows_of(act.low_time(act.time_spent(act.weekly(frame)))) == [
        (WEEK_2, 40.0, False),
        (WEEK_3, 20.0, True),
    ]


TIMELESS = [{"learner_id": str(i), "updated_at": None} for i in range(1, 8)]


def test_attempts_without_a_time_spend_no_time_and_make_no_session(spark):
    for frame in both_grains(spark, *TIMELESS):
        assert rows_of(act.time_spent(act.overall(frame))) == []
        assert rows_of(act.sessions(act.overall(frame), 1)) == []
        assert rows_of(act.time_per_learner(act.overall_and_weekly(frame))) == []


def test_attempts_without_a_time_make_no_week(spark):
    for frame in both_grains(spark, *TIMELESS, {"learner_id": "9", "updated_at": at(8)}):
        for metric in (act.unique_learners, act.work_done, act.work_per_learner, act.median_accuracy):
            assert [bucket for bucket, *_ in rows_of(metric(act.weekly(frame)))] == [WEEK_2]
        assert rows_of(act.time_spent(act.weekly(frame))) == [(WEEK_2, 0.0)]
