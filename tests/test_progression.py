import pytest

from learnlens.operators import progression as prog
from helpers import attempts, rows_of

LAST = [("Addition", "class-two", "s2", "q9"), ("Addition", "class-one", "s1", "q9")]


def last_questions(spark):
    return spark.createDataFrame(LAST, prog.LAST_QUESTION_KEYS)


def ladder(spark, *rows, school=None):
    return prog.grade_ladder(attempts(spark, *rows), last_questions(spark), school)


def standing(spark, *rows):
    return rows_of(prog.current_grades(ladder(spark, *rows)), "operation", "starting_grade", "current_grade")


DONE_TWO = {"qset_grade": "class-two", "question_set_id": "s2", "question_id": "q9"}
DONE_ONE = {"qset_grade": "class-one", "question_set_id": "s1", "question_id": "q9"}


def test_target_achieved(spark):
    assert standing(spark, {"grade": "class-three", **DONE_TWO}) == [
        ("Addition", "class-two", "target-achieved")
    ]


def test_finished_grade_below_the_target_promotes(spark):
    assert standing(spark, {"grade": "class-three", **DONE_ONE}) == [
        ("Addition", "class-one", "class-two")
    ]


def test_unfinished_grade_stays(spark):
    assert standing(spark, {"grade": "class-three", "qset_grade": "class-one"}) == [
        ("Addition", "class-one", "class-one")
    ]


@pytest.mark.parametrize("grade", ["class-one", "class-seven"])
def test_learner_without_target_has_no_standing(spark, grade):
    assert standing(spark, {"grade": grade, **DONE_ONE}) == []


def test_going_on_to_another_operation_counts_as_finished(spark):
    rows = [
        {"grade": "class-four", "qset_grade": "class-one"},
        {"grade": "class-four", "qset_grade": "class-one", "operation": "Subtraction"},
    ]
    assert standing(spark, *rows) == [
        ("Addition", "class-one", "class-two"),
        ("Subtraction", "class-one", "class-one"),
    ]


def test_class_five_promotes_to_class_six(spark):
    rows = [
        {"grade": "class-two", "qset_grade": "class-five"},
        {"grade": "class-two", "qset_grade": "class-one", "operation": "Division"},
    ]
    assert standing(spark, *rows)[0] == ("Addition", "class-five", "class-six")


def test_any_attempt_at_the_last_question_counts(spark):
    rows = [{"grade": "class-three", **DONE_TWO}, {"grade": "class-three", "qset_grade": "class-two"}]
    assert rows_of(ladder(spark, *rows), "qset_grade", "is_last") == [("class-two", True)]


def test_diagnostics_and_unknown_keys_are_left_out(spark):
    rows = [
        {"purpose": "Main Diagnostic"},
        {"operation": None},
        {"qset_grade": None},
        {"grade": None},
        {"purpose": None, "qset_grade": "class-three"},
    ]
    assert rows_of(ladder(spark, *rows), "qset_grade") == [("class-three",)]


def test_school_filter(spark):
    rows = [{"school": "A", "learner_id": "1"}, {"school": "B", "learner_id": "2"}]
    assert rows_of(ladder(spark, *rows, school="B"), "learner_id") == [("2",)]


def test_matrix_shares_and_counts(spark):
    rows = [{"learner_id": str(i), "grade": "class-three", "qset_grade": "class-one"} for i in range(2)]
    rows += [{"learner_id": "9", "grade": "class-three", **DONE_ONE}]
    rows += [{"learner_id": "8", "grade": "class-two", **DONE_ONE}]
    matrix = prog.progress_matrix(prog.current_grades(ladder(spark, *rows)))
    assert rows_of(
        matrix, "target_grade", "`class-one`", "`class-two`", "`target-achieved`", "learners_count", "total_count"
    ) == [
        ("class-one", None, None, 100.0, 1, 4),
        ("class-two", 67.0, 33.0, None, 3, 4),
    ]
    shown = prog.progress_report(matrix).collect()
    assert shown[0]["target-achieved"] == "100.0 %" and shown[1]["class-two"] == "33.0 %"
