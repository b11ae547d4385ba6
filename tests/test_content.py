import random

import pytest
from pyspark.sql import functions as F

from learnlens.functions import values as val
from learnlens.functions.spread import spread
from learnlens.operators import content, drilldown, filters, reshape
from learnlens.operators.filters import Selection
from learnlens.plans import reports
from learnlens.sources import extracts
from helpers import at, attempts, one, rows_of

QUESTION_LEVEL = (
    "question_set_id string, question_set_uid string, qs_seq int, question_id string,"
    " question_uid string, q_seq int, learner_id string, score int, updated_at timestamp_ntz,"
    " updated_date date"
)


def answers(spark, *rows):
    """(question number, learner, score, time); the position in the set is the question number."""
    full = [
        ("s", "U", 1, f"q{n}", f"Q{n}", n, learner, score, time, time.date())
        for n, learner, score, time in rows
    ]
    return spark.createDataFrame(full, QUESTION_LEVEL)


def test_question_time_follows_positions_and_may_be_negative(spark):
    timed = content.question_times(
        answers(spark, (1, "a", 1, at(8, 10, 5)), (2, "a", 1, at(8, 10, 0)), (3, "a", 1, at(9, 10, 0)))
    )
    assert rows_of(timed, "q_seq", "question_time_taken") == [(1, 0.0), (2, -300.0), (3, 0.0)]


def test_question_time_of_rows_without_learner_is_zero(spark):
    timed = content.question_times(
        answers(spark, (1, None, 1, at(8, 10, 0)), (2, None, 0, at(8, 10, 5)))
    )
    assert rows_of(timed, "question_time_taken") == [(0.0,), (0.0,)]


def test_question_performance(spark):
    timed = content.question_times(
        answers(
            spark,
            (1, "a", 1, at(8, 10, 0)),
            (1, "b", 0, at(8, 10, 0)),
            (1, "c", None, at(8, 10, 0)),
            (1, "b", 1, at(9, 10, 0)),
            (2, "a", 0, at(8, 10, 1)),
        )
    )
    performance = content.question_performance(timed)
    assert rows_of(
        performance, "q_seq", "learners_count", "median_accuracy", "average_time_taken"
    ) == [(1, 3, 1.0, 0.0), (2, 1, 0.0, 60.0)]
    shown = rows_of(content.question_report(performance), "q_seq", "average_accuracy")
    assert shown == [(1, "67 %"), (2, "0 %")]


def test_reports_show_nothing_until_something_is_chosen(spark):
    frame = attempts(spark, {})
    assert reports.qset_performance_report(frame).count() == 0
    assert reports.qset_performance_report(frame, repository="R").count() == 1


def test_qset_time_is_uncapped_and_summed_over_days(spark):
    frame = attempts(
        spark,
        {"updated_at": at(8, 10)},
        {"updated_at": at(8, 11)},
        {"updated_at": at(9, 10), "score": 0},
        {"updated_at": at(9, 10, 30), "score": 0},
        {"updated_at": at(9, 10), "l3_skill": None},
        {"updated_at": at(9, 10), "l2_skill": None},
    )
    learners = content.qset_learners(filters.completed(frame))
    assert rows_of(learners, "total_time", "total_score", "total_count", "accuracy") == [
        (5400.0, 2, 4, 0.5)
    ]
    performance = content.qset_performance(learners)
    assert rows_of(performance, "count_of_learners", "median_accuracy", "median_time", "mean_time") == [
        (1, 0.5, 90.0, 90.0)
    ]


def test_question_sets_by_identifiers_equal_those_by_names(spark):
    """A set that was renamed, or lies in two grades, counts once for each state of its attributes."""
    rng = random.Random(5)
    frame = attempts(
        spark,
        *[
            {
                "learner_id": str(rng.randrange(9)),
                "question_set_id": f"s{rng.randrange(3)}",
                "qset_name": rng.choice(["Old", "New"]),
                "qset_grade": rng.choice(["class-one", "class-two", None]),
                "l2_skill": rng.choice(["L2", "L2", None]),
                "updated_at": at(rng.randrange(8, 12), 10, rng.randrange(60)),
                "score": rng.choice([0, 1, None]),
            }
            for _ in range(400)
        ],
    )
    by_name = content.qset_performance(content.qset_learners(frame))
    by_id = content.qset_performance_of(frame)
    assert by_id.columns == by_name.columns and by_id.count() == 12
    assert rows_of(by_id) == rows_of(by_name)


def test_texts_of_question_sets_are_not_shuffled_with_learners(spark):
    """Every exchange that carries learners or their measures hashes and holds identifiers only."""
    plan = content.qset_performance_of(attempts(spark, {}))._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line and "learner_id" in line]
    assert grouped and not any("qset_name" in line or "l2_skill" in line for line in grouped)


def test_questions_by_identifiers_equal_those_by_names(spark):
    rng = random.Random(6)
    facts = [
        (rng.choice(["s1", "s2", "gone", None]), rng.choice(["q1", "q2", "q3", None]), rng.choice("abcd"), rng.choice([0, 1, None]), at(rng.randrange(8, 10), 10, rng.randrange(60)))
        for _ in range(300)
    ]
    facts = spark.createDataFrame(facts, "question_set_id string, question_id string, learner_id string, score int, updated_at timestamp_ntz")
    tables = {
        "question_attempts": facts,
        "question_set": spark.createDataFrame([("s1", "U1", 1), ("s2", "U2", None)], "identifier string, x_id string, sequence int"),
        "question_set_question_mapping": spark.createDataFrame(
            [("s1", "q1", 1), ("s1", "q2", 2), ("s2", "q1", 1), ("gone", "q1", 1), ("s1", "q4", 3), ("s1", "q3", 9), ("s1", "q3", 10)],
            "question_set_id string, question_id string, sequence int",
        ),
        "question": spark.createDataFrame([(f"q{k}", f"Q{k}") for k in (1, 2, 3, 4)], "identifier string, x_id string"),
    }
    for chosen in (None, "U1"):
        by_name = content.question_performance(content.question_times(extracts.question_level(tables, chosen)))
        by_id = content.question_performance_of(
            extracts.question_answers(tables, chosen), extracts.set_labels(tables), extracts.question_labels(tables)
        )
        assert by_id.columns == by_name.columns and by_id.count() == 4
        assert rows_of(by_id) == rows_of(by_name)


def test_incomplete_journeys_do_not_count(spark):
    frame = attempts(spark, {"status": "in-progress"}, {"status": None})
    assert filters.completed(frame).count() == 0


RESULTS = "operation string, qset_grade string, question_set_id string, qset_name string, score double"


def results(spark):
    rows = [("Addition", "class-one", "1", "b", 0.1)] * 300
    rows += [("Addition", "class-one", "2", "a", 0.0), ("Addition", "class-one", "3", "a", 0.1)]
    rows += [("Addition", "class-one", "4", "c", 1.0), ("Addition", "class-one", "5", "d", 0.2)]
    rows += [(None, None, None, "x", None), ("Addition", "class-one", None, "y", None)]
    return spark.createDataFrame(rows, RESULTS)


@pytest.mark.parametrize("counted", [False, True])
def test_grade_performance(spark, counted):
    frame = content.result_counts(results(spark)) if counted else results(spark)
    report = content.grade_performance(frame).collect()
    known, unknown = report
    assert known["attempts_count"] == 305  # more than eight bits hold
    assert (known["median"], known["avg"]) == ("10 %", "10 %")
    assert known["qsets_score_less_than_20"] == "a, \nb"
    assert known["qsets_score_more_than_90"] == "c"
    assert unknown["operation"] is None and unknown["attempts_count"] == 1
    assert unknown["median"] is None and unknown["qsets_score_less_than_20"] is None


@pytest.mark.parametrize("fraction, text", [(0.125, "12 %"), (0.135, "14 %"), (1.0, "100 %"), (None, None)])
def test_percent_text(spark, fraction, text):
    frame = spark.createDataFrame([(fraction,)], "x double")
    assert one(frame.select(val.percent_text(F.col("x")).alias("t")), "t") == text


@pytest.mark.parametrize(
    "number, text", [(35.0, "35.0"), (2.5, "2.5"), (12.25, "12.25"), (10.0, "10.0"), (12345678.9, "12345678.9")]
)
def test_number_text(spark, number, text):
    frame = spark.createDataFrame([(number,)], "x double")
    assert one(frame.select(val.number_text(F.col("x")).alias("t")), "t") == text


def test_median_count_text_is_blank_without_a_median(spark):
    frame = spark.createDataFrame([(None, 0), (3.5, 2)], "m double, n bigint")
    shown = frame.select(val.median_count_text(F.col("m"), F.col("n")).alias("t"))
    assert rows_of(shown) == [("",), ("3.5 (2)",)]


def test_lookup_misses_give_null(spark):
    frame = spark.createDataFrame([("Addition",), ("Modulo",), (None,)], "x string")
    assert rows_of(frame.select(val.operation_rank(F.col("x")).alias("r"))) == [(0,), (None,), (None,)]


# --- exact medians ---------------------------------------------------------------------------------


def expected_median(values):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2


@pytest.mark.parametrize("width", [0.01, 1.0, 1000.0])
def test_spread_matches_brute_force(spark, width):
    rng = random.Random(7)
    groups = {"a": 1, "b": 2, "c": 301, None: 40}
    rows = [
        (g, None if rng.random() < 0.1 else round(rng.choice([rng.uniform(-5, 5), 3.0]), 2), rng.randint(0, 1))
        for g, n in groups.items()
        for _ in range(n)
    ] + [("empty", None, 1)]
    frame = spark.createDataFrame(rows, "g string, v double, t int").repartition(5)
    found = {r["g"]: r for r in spread(frame, ["g"], {"v": width}, ["t"]).collect()}
    assert set(found) == {r[0] for r in rows}
    for g in found:
        values = [v for k, v, _ in rows if k == g]
        known = [v for v in values if v is not None]
        assert found[g]["v_median"] == expected_median(values)
        assert found[g]["rows"] == len(values) and found[g]["v_count"] == len(known)
        assert found[g]["t"] == sum(t for k, _, t in rows if k == g)
        if known:
            assert found[g]["v_mean"] == pytest.approx(sum(known) / len(known), abs=1e-9)


def test_spread_of_two_measures_and_weights(spark):
    rows = [("a", 1.0, 10.0, 3), ("a", 2.0, None, 2), ("a", 9.0, 30.0, 1)]
    frame = spark.createDataFrame(rows, "g string, x double, y double, n int")
    (row,) = spread(frame, ["g"], {"x": 1.0, "y": 1.0}, weight="n").collect()
    assert (row["rows"], row["x_count"], row["y_count"]) == (6, 6, 4)
    assert (row["x_median"], row["y_median"]) == (1.5, 10.0)
    assert (row["x_mean"], row["y_mean"]) == (16 / 6, 15.0)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_spread_keeps_negative_tallies_and_large_products(spark, ansi):
    rows = [("a", 1.0, -1, 1), ("a", 2.0, 0, 1), ("a", 3.0, 2, 1), ("b", 2e10, -5, 3), ("b", 3e10, 1, 1)]
    frame = spark.createDataFrame(rows, "g string, v double, t int, w int")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        found = {r["g"]: r for r in spread(frame, ["g"], {"v": 1.0}, ["t"], "w").collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert (found["a"]["rows"], found["a"]["t"], found["a"]["v_median"], found["a"]["v_mean"]) == (3, 1, 2.0, 2.0)
    assert (found["b"]["rows"], found["b"]["t"], found["b"]["v_median"], found["b"]["v_mean"]) == (4, -4, 2e10, 2.25e10)


def test_spread_of_values_in_one_bin(spark):
    rng = random.Random(11)
    values = [1000 + rng.randrange(10**6) / 10**6 for _ in range(2000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("'g' as g", "v")
    (row,) = spread(frame, ["g"], {"v": 60.0}).collect()
    assert row["v_median"] == expected_median(values) and row["v_count"] == 2000


def test_attempts_without_a_time_belong_to_no_day_of_a_question_set(spark):
    rows = attempts(spark, *[{"learner_id": str(i), "updated_at": None} for i in range(3)], {"learner_id": "9"})
    found = content.qset_learners(rows).collect()
    assert [(r["learner_id"], r["total_time"], r["total_count"]) for r in found] == [("9", 0.0, 1)]


def test_spread_reads_its_input_once(spark, tmp_path):
    path = str(tmp_path / "values")
    spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) as v").write.parquet(path)
    frame = spread(spark.read.parquet(path), ["g"], {"v": 10.0}).select("g", "v_median")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 1


# --- drill-downs -----------------------------------------------------------------------------------


def test_wrong_answers_by_day(spark):
    frame = attempts(
        spark,
        {"question_id": "q10", "score": 0, "updated_at": at(8, 10)},
        {"question_id": "q9", "score": 0, "updated_at": at(8, 11)},
        {"question_id": "q10", "score": 0, "updated_at": at(8, 12)},
        {"question_id": "unplaced", "score": 0, "updated_at": at(8, 12)},
        {"question_id": "q2", "score": 1, "updated_at": at(9, 10)},
        {"question_id": "q2", "score": 0, "updated_at": at(10, 10)},
        {"question_set_id": "s0", "qset_name": "Old", "question_id": "q1", "updated_at": at(2, 10)},
    )
    positions = spark.createDataFrame(
        [("q10", "s1", 10), ("q9", "s1", 9), ("q2", "s1", 2)],
        "question_id string, question_set_id string, sequence int",
    )
    old, new = drilldown.learner_detail(frame, positions, learner_id="1").collect()
    assert new["incorrect_attempts"] == "9,10,2"
    assert new["time_taken"] == 45.0 and new["total_questions_attempted"] == 6
    assert new["accuracy"] == 16.67
    assert (old["attempted_date"], new["attempted_date"]) == ("2024-01-02", "in progress")
    assert drilldown.learner_detail(frame, positions, username="nobody").count() == 0


def test_learner_list_filters_and_columns(spark):
    frame = attempts(
        spark,
        {"learner_id": "1", "qset_grade": "class-one", "score": 1},
        {"learner_id": "1", "qset_grade": "class-one", "score": 0, "school": "B"},
        {"learner_id": "1", "qset_grade": "class-three", "grade": "class-four", "updated_at": at(20)},
        {"learner_id": "2", "operation": "Division"},
    )
    (row,) = drilldown.learner_list(frame, "Addition").collect()
    assert (row["class-one"], row["class-one-avg"], row["class-three"], row["class-two"]) == (2.0, 50.0, 1.0, None)
    assert row["grade"] == "class-four"
    narrowed = drilldown.learner_list(
        frame, "Addition", parent=Selection(school="S"), child=Selection(school="B")
    )
    assert rows_of(narrowed, "`class-one`", "`class-one-avg`") == [(1.0, 0.0)]
    replaced = drilldown.learner_list(frame, "Addition", child=Selection(operation="Division"))
    assert rows_of(replaced, "learner_id") == [("2",)]
    both = drilldown.learner_list(frame, "Addition", parent=Selection(operation="Division"))
    assert both.count() == 0


def test_learner_labels_keep_missing_parts_empty(spark):
    learners = spark.createDataFrame(
        [("1", "u2", "B", None), ("2", None, "A", "S"), ("3", "u1", None, "S"), ("4", "u1", None, "S")],
        "identifier string, user_name string, name string, school string",
    )
    assert [r[0] for r in reshape.learner_labels(learners).collect()] == ["u1-", "u2-B", "-A"]
    assert [r[0] for r in reshape.learner_labels(filters.of_school(learners, "No School")).collect()] == ["u2-B"]
    assert reshape.learner_labels(filters.of_school(learners, "S")).count() == 2


def test_a_group_of_very_many_names_is_listed_in_pieces(spark):
    """One group holds 100,000 names; the text is that of a plain sort, and no task gathers the names of the group."""
    n = 100_000
    scores = spark.range(n).select(
        F.lit("Addition").alias("operation"),
        F.lit("class-one").alias("qset_grade"),
        F.concat(F.lit("Set "), (F.col("id") * 7919 % n).cast("string")).alias("qset_name"),
        F.when(F.col("id") % 3 == 0, 0.05).otherwise(0.95).alias("avg_score"),
    )
    more = [("Addition", "class-one", "Set 0", 0.99), ("Addition", "class-two", "B", 0.5), ("Addition", "class-two", None, 0.1), (None, "class-two", "C", 0.1)]
    scores = scores.unionByName(spark.createDataFrame(more, "operation string, qset_grade string, qset_name string, avg_score double"))
    rows = {r["qset_grade"]: r for r in content.easy_and_hard(scores).collect()}
    names = {"hard": {f"Set {k * 7919 % n}" for k in range(0, n, 3)}, "easy": {f"Set {k * 7919 % n}" for k in range(n) if k % 3} | {"Set 0"}}
    assert rows["class-one"]["qsets_score_less_than_20"] == ", \n".join(sorted(names["hard"]))
    assert rows["class-one"]["qsets_score_more_than_90"] == ", \n".join(sorted(names["easy"]))
    assert tuple(rows["class-two"])[2:] == ("", "") and len(rows) == 2
    spread_out = content.easy_and_hard_names(scores).repartitionByRange(4, "operation", "qset_grade", "list", "qset_name")
    most = spread_out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < n / 2
