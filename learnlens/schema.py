"""Table layouts and the vocabulary the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names, orders, thresholds and labels that reports depend on.
# ---------------------------------------------------------------------------
GRADES = [
    "class-one",
    "class-two",
    "class-three",
    "class-four",
    "class-five",
    "class-six",
    "class-seven",
    "class-eight",
    "class-nine",
    "class-ten",
]
OPERATIONS = ["Addition", "Subtraction", "Multiplication", "Division"]
GRADE_STEPS = ["class-one", "class-two", "class-three", "class-four", "class-five"]
OPERATION_STEPS = ["Addition", "Subtraction", "Multiplication"]
TARGET_GRADE = {
    "class-two": "class-one",
    "class-three": "class-two",
    "class-four": "class-three",
    "class-five": "class-four",
    "class-six": "class-five",
}
PROMOTED_GRADE = {
    "class-one": "class-two",
    "class-two": "class-three",
    "class-three": "class-four",
    "class-four": "class-five",
    "class-five": "class-six",
}
TARGET_ACHIEVED = "target-achieved"
DIAGNOSTIC = "Main Diagnostic"
NO_SCHOOL = "No School"
COMPLETED = "completed"
LOGIN_EVENT = "learner_logged_in"
SESSION_MIN_LEARNERS = 3
DAY_CAP_SECONDS = 2700
LOOKBACK_WEEKS = 5
LOW_SCORE = 0.2
HIGH_SCORE = 0.9
LOW_TIME_MINUTES = 30
DISPLAY_ZONE = "Asia/Kolkata"
# ---------------------------------------------------------------------------

GRADE_BY_ID = dict(enumerate(GRADES, start=1))
GRADE_RANK = {grade: rank for rank, grade in GRADE_BY_ID.items()}
OPERATION_RANK = {operation: rank for rank, operation in enumerate(OPERATIONS)}


TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(columns: str) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


SOURCE_SCHEMAS = {
    "question_attempts": _struct(
        "learner_id string, question_id string, question_set_id string, updated_at timestamp_ntz,"
        " attempts_count int, score int, taxonomy string"
    ),
    "question_set_results": _struct(
        "question_set_id string, learner_id string, score double, taxonomy string"
    ),
    "question_set": _struct(
        "identifier string, title string, x_id string, purpose string, repository string,"
        " taxonomy string, sequence int"
    ),
    "question_set_question_mapping": _struct(
        "question_id string, question_set_id string, sequence int"
    ),
    "question": _struct("identifier string, x_id string"),
    "learner": _struct(
        "identifier string, name string, username string, class_id string, school_id string,"
        " tenant_id string"
    ),
    "learner_journey": _struct("question_set_id string, learner_id string, status string"),
    "class_master": _struct("identifier string, id int, name string"),
    "school": _struct("identifier string, name string"),
    "tenant": _struct("identifier string, id int, name string"),
    "repository": _struct("identifier string, name string"),
    "skill_master": _struct("identifier string, name string, type string"),
    "telemetry_data": _struct(
        "id string, level string, learner_id string, created_on timestamp_ntz, event_type string"
    ),
}

ATTEMPTS = _struct(
    "tenant_name string, school string, grade string, learner_name string, learner_username string,"
    " learner_id string, question_id string, question_set_id string, updated_at timestamp_ntz,"
    " attempts_count int, score int, qset_name string, qset_uid string, purpose string, sequence int,"
    " status string, qset_grade string, operation string, l1_skill string, l2_skill string,"
    " l3_skill string, repo_name string"
)
