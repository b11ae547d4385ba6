"""Small attempt tables for tests."""

import datetime as dt

from learnlens.schema import ATTEMPTS

DEFAULTS = {
    "tenant_name": "T",
    "school": "S",
    "grade": "class-two",
    "learner_name": "Name",
    "learner_username": "user",
    "learner_id": "1",
    "question_id": "q1",
    "question_set_id": "s1",
    "updated_at": dt.datetime(2024, 1, 8, 10, 0),
    "attempts_count": 1,
    "score": 1,
    "qset_name": "Set",
    "qset_uid": "U1",
    "purpose": "Practice",
    "sequence": 1,
    "status": "completed",
    "qset_grade": "class-one",
    "operation": "Addition",
    "l1_skill": "Addition",
    "l2_skill": "L2",
    "l3_skill": "L3",
    "repo_name": "R",
}


def attempts(spark, *rows):
    """Attempts with the given fields; the rest take default values."""
    full = [tuple({**DEFAULTS, **row}[name] for name in ATTEMPTS.names) for row in rows]
    return spark.createDataFrame(full, ATTEMPTS)


def at(day, hour=10, minute=0, second=0, month=1, micro=0):
    return dt.datetime(2024, month, day, hour, minute, second, micro)


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: [(v is None, str(v)) for v in r])


def one(df, column):
    (row,) = df.collect()
    return row[column]
