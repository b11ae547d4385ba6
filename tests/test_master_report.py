import datetime as dt

import pytest

from learnlens.operators import activity as act
from learnlens.operators.filters import Period, Selection
from learnlens.plans import master_report as report
from learnlens.sources import binding, extracts
from helpers import at, attempts

SF = "/root/testdata/sf0.001"
AS_OF = dt.date(2024, 1, 30)


@pytest.fixture(scope="module")
def inputs(spark):
    frame = binding.attempts(spark, SF, shared_devices=True)
    logins = extracts.logins(binding.source_tables(spark, SF, shared_devices=True))
    return frame, logins


def cells(df):
    return {(r["metrics"], r["sub_metrics"], r["bucket"]): r["value"] for r in df.collect()}


def test_report_agrees_with_single_metrics(spark, inputs):
    frame, logins = inputs
    selection = Selection(school="NATION_2", operation="Addition")
    period = Period(dt.date(2024, 1, 3), dt.date(2024, 1, 25))
    found = cells(report.master_report_long(frame, logins, AS_OF, period, selection))
    rows = act.activity_rows(frame)
    chosen = selection.apply(rows)
    for bucketed in (act.overall(chosen, period), act.weekly(chosen, period)):
        for metric, name, column in (
            (act.unique_learners, report.LEARNERS, "learners"),
            (act.work_done, report.WORK, "work_done"),
            (act.work_per_learner, report.WORK_PER_LEARNER, "work_per_learner"),
        ):
            for row in metric(bucketed).collect():
                assert found[(name, None, row["bucket"])] == str(row[column])
        for metric, name, column in (
            (act.time_spent, report.TIME, "minutes"),
            (act.time_per_learner, report.TIME_PER_LEARNER, "minutes_per_learner"),
            (act.median_accuracy, report.MEDIAN_ACCURACY, "median_accuracy"),
        ):
            for row in metric(bucketed).collect():
                assert float(found[(name, None, row["bucket"])]) == row[column]


def test_operation_filter_leaves_sessions_and_logins_alone(spark, inputs):
    frame, logins = inputs
    narrowed = cells(report.master_report_long(frame, logins, AS_OF, selection=Selection(operation="Division")))
    everything = cells(report.master_report_long(frame, logins, AS_OF))
    for name in (report.SESSIONS, report.LOGINS):
        assert narrowed[(name, None, "overall")] == everything[(name, None, "overall")]
    assert narrowed[(report.LEARNERS, "Addition", "overall")] is None
    assert int(narrowed[(report.WORK, None, "overall")]) < int(everything[(report.WORK, None, "overall")])


def test_wide_report_of_nothing(spark, inputs):
    frame, logins = inputs
    wide = report.master_report_wide(frame, logins, AS_OF, selection=Selection(school="none")).collect()
    assert len(wide) == 24
    overall = {(r["metrics"], r["sub_metrics"]): r["overall_count"] for r in wide}
    assert overall[(report.WORK, None)] == "0" and overall[(report.TIME, None)] == "0"
    assert overall[(report.GRADE_JUMP, None)] == "" and overall[(report.MEDIAN_ACCURACY, None)] is None
    assert overall[(report.LEARNERS, "Addition")] is None
    assert list(wide[0].asDict())[3:] == [
        "overall_count",
        "2024-01-29,2024-02-04",
        "2024-01-22,2024-01-28",
        "2024-01-15,2024-01-21",
        "2024-01-08,2024-01-14",
        "2024-01-01,2024-01-07",
        "2023-12-25,2023-12-31",
    ]


def test_rows_are_in_report_order():
    order = [i for i, (_, sub) in enumerate(report.ROWS) if sub]
    assert order == [1, 2, 3, 4, 11, 12, 13, 14, 15, 17, 18, 19]
    assert report.ROWS[8][0] == report.TIME and len(report.ROWS) == 24


def test_overall_covers_all_time_and_median_work_the_weeks_shown(spark, inputs):
    _, logins = inputs
    frame = attempts(
        spark,
        {"updated_at": at(1, month=6), "learner_id": "1"},
        {"updated_at": at(8), "learner_id": "1"},
        {"updated_at": at(8), "learner_id": "1"},
    )
    found = cells(report.master_report_long(frame, logins, dt.date(2024, 6, 3)))
    assert found[(report.WORK, None, "overall")] == "3"
    assert found[(report.MEDIAN_WORK, None, "overall")] == "1.0"


def test_result_does_not_depend_on_partitions(spark, inputs):
    frame, logins = inputs
    one = cells(report.master_report_long(frame.repartition(1), logins, AS_OF))
    many = cells(report.master_report_long(frame.repartition(13), logins, AS_OF))
    assert one == many


def test_weekly_figures_are_consistent_with_overall(spark, inputs):
    frame, logins = inputs
    found = cells(report.master_report_long(frame, logins, AS_OF))
    weekly = {
        name: [int(v) for (m, s, b), v in found.items() if (m, s) == (name, None) and b != "overall"]
        for name in (report.LEARNERS, report.SESSIONS, report.LOGINS)
    }
    assert max(weekly[report.LEARNERS]) <= int(found[(report.LEARNERS, None, "overall")])
    for name in (report.SESSIONS, report.LOGINS):
        assert sum(weekly[name]) == int(found[(name, None, "overall")])
