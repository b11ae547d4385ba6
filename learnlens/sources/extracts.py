"""The flattened extracts every report starts from.

``tables`` is the mapping of source tables from :mod:`learnlens.sources.readers`. Joins carry no
broadcast hints: Spark broadcasts a side only when its measured size is under the session's threshold,
and adaptive execution splits a skewed question set or learner otherwise.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from learnlens.functions.calendar import instant
from learnlens.functions.values import grade_label, json_fields, json_text
from learnlens.operators.joins import decode_lookup
from learnlens.schema import ATTEMPTS, COMPLETED, LOGIN_EVENT, NO_SCHOOL
from learnlens.sources.scratch import written_together

Tables = Mapping[str, DataFrame]

#: What is read of the taxonomy of an attempt, of a question set, and for names.
ATTEMPT_TAXONOMY = "class struct<identifier: string>, l1_skill struct<identifier: string>"
SET_TAXONOMY = (
    "l1_skill struct<identifier: string>, l2_skill array<struct<identifier: string>>,"
    " l3_skill array<struct<identifier: string>>"
)
NAMED_TAXONOMY = "class struct<name: struct<en: string>>, l1_skill struct<name: struct<en: string>>"
SET_NAMES = ["l1_skill", "l2_skill", "l3_skill", "repo_name"]


def learner_profiles(tables: Tables) -> DataFrame:
    """Learners with the names of their class, school and tenant (null where unknown)."""
    learner = tables["learner"]
    classes = tables["class_master"].select(
        F.col("identifier").alias("class_id"), json_text("name", "en").alias("grade")
    )
    schools = tables["school"].select(
        F.col("identifier").alias("school_id"), F.col("name").alias("school")
    )
    tenants = tables["tenant"].select(
        F.col("identifier").alias("tenant_id"), json_text("name", "en").alias("tenant_name")
    )
    return (
        learner.join(classes, "class_id", "left")
        .join(schools, "school_id", "left")
        .join(tenants, "tenant_id", "left")
        .select(
            F.col("identifier").alias("learner_id"),
            F.col("name").alias("learner_name"),
            F.col("username").alias("learner_username"),
            "grade",
            "school",
            "tenant_name",
        )
    )


def _question_sets(tables: Tables) -> DataFrame:
    sets = tables["question_set"].withColumn("taxonomy", json_fields("taxonomy", SET_TAXONOMY))
    return sets.select(
        F.col("identifier").alias("question_set_id"),
        json_text("title", "en").alias("qset_name"),
        F.col("x_id").alias("qset_uid"),
        "purpose",
        json_text("repository", "identifier").alias("repo_name_identifier"),
        F.col("taxonomy.l1_skill.identifier").alias("l1_skill_identifier"),
        F.get("taxonomy.l2_skill", F.lit(0))["identifier"].alias("l2_skill_identifier"),
        F.get("taxonomy.l3_skill", F.lit(0))["identifier"].alias("l3_skill_identifier"),
        "sequence",
    )


def _decoded_sets(tables: Tables) -> DataFrame:
    """Question sets with the names of their skills and repository."""
    skill = skills(tables)
    sets = _question_sets(tables)
    for level in ("l1_skill", "l2_skill", "l3_skill"):
        of_level = skill.where(F.col("type") == level)
        sets = decode_lookup(sets, of_level, f"{level}_identifier", "identifier", "skill", level)
    return decode_lookup(
        sets, repositories(tables), "repo_name_identifier", "identifier", "repo_name", "repo_name"
    )


def _decoded_codes(facts: DataFrame, tables: Tables) -> DataFrame:
    """Attempt records with operation and ``qset_grade`` in place of the identifiers of :func:`_with_codes`."""
    operations = skills(tables).where("type = 'l1_skill'")
    decoded = decode_lookup(facts, operations, "operation_identifier", "identifier", "skill", "operation")
    return decode_lookup(
        decoded, _grade_ids(tables), "qset_grade_identifier", "identifier", "grade", "qset_grade"
    )


def _canonical_grade(profiles: DataFrame) -> DataFrame:
    """The learner's grade as a canonical label."""
    return profiles.withColumn("grade", grade_label(F.col("grade").try_cast("int")))


def _named_school(attempts: DataFrame) -> DataFrame:
    """A missing school as ``No School``."""
    return attempts.withColumn("school", F.coalesce("school", F.lit(NO_SCHOOL)))


def _with_codes(facts: DataFrame) -> DataFrame:
    """Attempt records with the identifiers in their taxonomy."""
    return (
        facts.withColumn("taxonomy", json_fields("taxonomy", ATTEMPT_TAXONOMY))
        .withColumns(
            {
                "qset_grade_identifier": F.col("taxonomy.class.identifier"),
                "operation_identifier": F.col("taxonomy.l1_skill.identifier"),
            }
        )
        .drop("taxonomy")
    )


def _grade_ids(tables: Tables) -> DataFrame:
    return tables["class_master"].select("identifier", grade_label(F.col("id")).alias("grade"))


def attempts_flat(tables: Tables, since: dt.datetime | None = None) -> DataFrame:
    """One row per attempt record with learner and question-set attributes.

    ``since`` keeps records updated at or after it. A learner with several journey rows for a question
    set gets one output row per journey row, as a left join gives.
    """
    facts = tables["question_attempts"]
    if since is not None:
        facts = facts.where(F.col("updated_at") >= instant(since))
    return (
        _with_codes(facts)
        .join(_question_sets(tables), "question_set_id", "left")
        .join(learner_profiles(tables), "learner_id", "left")
        .join(tables["learner_journey"], ["question_set_id", "learner_id"], "left")
        .select(
            "tenant_name",
            "school",
            "grade",
            "learner_name",
            "learner_username",
            "learner_id",
            "question_id",
            "question_set_id",
            "updated_at",
            "attempts_count",
            "score",
            "qset_grade_identifier",
            "operation_identifier",
            "qset_name",
            "qset_uid",
            "purpose",
            "repo_name_identifier",
            "l1_skill_identifier",
            "l2_skill_identifier",
            "l3_skill_identifier",
            "sequence",
            "status",
        )
    )


def last_questions(tables: Tables) -> DataFrame:
    """The last question of the highest-sequence question set of each operation and grade.

    The grade is given as the canonical label, the form attempts carry. Equal sequences are settled by
    identifier so that the answer is the same on every run.
    """
    named = tables["question_set"].withColumn("taxonomy", json_fields("taxonomy", NAMED_TAXONOMY))
    sets = named.select(
        "identifier",
        F.col("taxonomy.l1_skill.name.en").alias("operation"),
        F.col("taxonomy.class.name.en").alias("class_name"),
        "sequence",
    )
    top_set = Window.partitionBy("class_name", "operation").orderBy(
        F.col("sequence").desc_nulls_first(), "identifier"
    )
    top_question = Window.partitionBy("question_set_id").orderBy(
        F.col("sequence").desc_nulls_first(), "question_id"
    )
    top_sets = sets.withColumn("rank", F.row_number().over(top_set)).where("rank = 1")
    top_questions = (
        tables["question_set_question_mapping"]
        .withColumn("rank", F.row_number().over(top_question))
        .where("rank = 1")
        .select("question_set_id", "question_id")
    )
    return top_sets.join(
        top_questions, top_sets["identifier"] == top_questions["question_set_id"]
    ).select(
        "operation",
        grade_label(F.col("class_name").try_cast("int")).alias("qset_grade"),
        "question_set_id",
        "question_id",
    )


def all_learners(tables: Tables) -> DataFrame:
    learner, school = tables["learner"], tables["school"]
    return (
        learner.join(school, learner["school_id"] == school["identifier"], "left")
        .select(
            learner["identifier"],
            learner["username"].alias("user_name"),
            learner["name"],
            school["name"].alias("school"),
        )
        .distinct()
    )


def grades(tables: Tables) -> DataFrame:
    return tables["class_master"].select(
        "identifier", "id", json_text("name", "en").alias("grade")
    )


def grades_list(tables: Tables) -> DataFrame:
    """Grade ids with their canonical labels."""
    return tables["class_master"].select("id", grade_label(F.col("id")).alias("grade"))


def schools(tables: Tables) -> DataFrame:
    names = tables["school"].select(F.col("name").alias("school_name"))
    none = names.sparkSession.range(1).select(F.lit(NO_SCHOOL).alias("school_name"))
    return names.unionByName(none)


def qset_types(tables: Tables) -> DataFrame:
    return tables["question_set"].select("purpose").distinct()


def repositories(tables: Tables) -> DataFrame:
    return tables["repository"].select("identifier", json_text("name", "en").alias("repo_name"))


def skills(tables: Tables) -> DataFrame:
    return tables["skill_master"].select(
        "identifier", json_text("name", "en").alias("skill"), "type"
    )


def tenants(tables: Tables) -> DataFrame:
    return tables["tenant"].select("id", json_text("name", "en").alias("tenant_name")).distinct()


def login_records(tables: Tables) -> DataFrame:
    """Login events as they are recorded."""
    events = tables["telemetry_data"].where(F.col("event_type") == LOGIN_EVENT)
    return events.select("id", "level", "learner_id", "created_on")


def login_profiles(tables: Tables) -> DataFrame:
    """What a login event shows of its learner: school, grade and tenant.

    The grade is canonicalised (the raw class name is a number as text), so the same grade filter works
    here as on attempts.
    """
    return learner_profiles(tables).select(
        "learner_id",
        "school",
        grade_label(F.col("grade").try_cast("int")).alias("grade"),
        "tenant_name",
    )


def logins(tables: Tables) -> DataFrame:
    """Login events with the learner's school, grade and tenant."""
    return login_records(tables).join(login_profiles(tables), "learner_id", "left").select(
        "id", "level", "learner_id", "created_on", "school", "grade", "tenant_name"
    )


def question_positions(tables: Tables) -> DataFrame:
    return tables["question_set_question_mapping"].select(
        "question_id", "question_set_id", "sequence"
    )


def _with_repository(sets: DataFrame, tables: Tables) -> DataFrame:
    repo = repositories(tables).withColumnRenamed("identifier", "repo_identifier")
    return sets.join(
        repo, json_text(F.col("repository"), "identifier") == F.col("repo_identifier"), "left"
    )


def question_set_ids(tables: Tables, repository: str | None = None) -> DataFrame:
    """Sorted distinct public ids of question sets, of one repository if given."""
    sets = _with_repository(tables["question_set"], tables)
    if repository:
        sets = sets.where(F.col("repo_name") == repository)
    return sets.select(F.col("x_id").alias("qset_id")).distinct().orderBy(
        F.col("qset_id").asc_nulls_last()
    )


def question_level(tables: Tables, qset_uid: str | None = None) -> DataFrame:
    """Attempts with question and question-set positions; of one question set if given."""
    sets = set_labels(tables)
    facts = tables["question_attempts"].select(
        "question_set_id", "question_id", "learner_id", "score", "updated_at"
    )
    if qset_uid:
        sets = sets.where(F.col("question_set_uid") == qset_uid)
    positions = tables["question_set_question_mapping"].withColumnRenamed("sequence", "q_seq")
    questions = question_labels(tables)
    # With a question set chosen the filter would make this left join an inner one anyway.
    return (
        facts.join(sets, "question_set_id", "inner" if qset_uid else "left")
        .join(positions, ["question_set_id", "question_id"], "left")
        .join(questions, "question_id", "left")
        .select(
            "question_set_id",
            "question_set_uid",
            "qs_seq",
            "question_id",
            "question_uid",
            "q_seq",
            "learner_id",
            "score",
            "updated_at",
            F.to_date("updated_at").alias("updated_date"),
        )
    )


def question_answers(tables: Tables, qset_uid: str | None = None) -> DataFrame:
    """The attempts of :func:`question_level` by identifiers only, with the position that orders them."""
    facts = tables["question_attempts"].select(
        "question_set_id", "question_id", "learner_id", "score", "updated_at"
    )
    if qset_uid:
        chosen = tables["question_set"].where(F.col("x_id") == qset_uid)
        facts = facts.join(chosen.select(F.col("identifier").alias("question_set_id")), "question_set_id")
    positions = tables["question_set_question_mapping"].withColumnRenamed("sequence", "q_seq")
    return facts.join(positions, ["question_set_id", "question_id"], "left").withColumn(
        "updated_date", F.to_date("updated_at")
    )


def set_labels(tables: Tables) -> DataFrame:
    """Public id and position of each question set."""
    return tables["question_set"].select(
        F.col("identifier").alias("question_set_id"),
        F.col("x_id").alias("question_set_uid"),
        F.col("sequence").alias("qs_seq"),
    )


def question_labels(tables: Tables) -> DataFrame:
    """Public id of each question."""
    return tables["question"].select(
        F.col("identifier").alias("question_id"), F.col("x_id").alias("question_uid")
    )


def set_results(
    tables: Tables, purpose: str | None = None, repository: str | None = None
) -> DataFrame:
    """Scores of completed question-set journeys, optionally of one purpose or repository."""
    journeys = tables["learner_journey"].where(F.col("status") == COMPLETED).drop("status")
    named = tables["question_set_results"].withColumn("taxonomy", json_fields("taxonomy", NAMED_TAXONOMY))
    results = named.select(
        "question_set_id",
        "learner_id",
        "score",
        F.col("taxonomy.l1_skill.name.en").alias("operation"),
        F.col("taxonomy.class.name.en").alias("qset_grade"),
        F.col("question_set_id").alias("result_set_id"),
    )
    sets = tables["question_set"]
    if purpose:
        sets = sets.where(F.col("purpose") == purpose)
    sets = _with_repository(sets, tables) if repository else sets
    if repository:
        sets = sets.where(F.col("repo_name") == repository)
    sets = sets.select(
        F.col("identifier").alias("question_set_id"), json_text("title", "en").alias("qset_name")
    )
    return (
        journeys.join(sets, "question_set_id", "inner" if purpose or repository else "left")
        .join(results, ["question_set_id", "learner_id"], "left")
        .select(
            "operation",
            "qset_grade",
            F.col("result_set_id").alias("question_set_id"),
            "qset_name",
            "score",
        )
    )


def enrich(flat: DataFrame, tables: Tables) -> DataFrame:
    """Decode the identifiers of :func:`attempts_flat` into names.

    Grades become canonical labels, a missing school becomes ``No School``. Skills and repository belong to the
    question set, so they are decoded on the sets, and the fact takes all four names in one join by its set.
    """
    names = _decoded_sets(tables).select("question_set_id", *SET_NAMES)
    identifiers = [f"{c}_identifier" for c in SET_NAMES]
    decoded = _decoded_codes(flat.drop(*identifiers), tables)
    return _named_school(_canonical_grade(decoded.join(names, "question_set_id", "left")))


def attempts(tables: Tables, since: dt.datetime | None = None) -> DataFrame:
    """The attempt fact all metrics read: the rows of ``enrich(attempts_flat(tables))``.

    The fact meets sets that are decoded already, so it is joined five times; journeys and profiles, by which it may be
    shuffled, come first, while its rows are narrow, and grades are labelled on the lookups. The decoded sets and the
    learner profiles are stored first: Spark then knows their true size and broadcasts one that is small,
    instead of shuffling the fact because the size of a chain of joins is unknown.
    """
    facts = tables["question_attempts"]
    if since is not None:
        facts = facts.where(F.col("updated_at") >= instant(since))
    stored = written_together(question_sets=_decoded_sets(tables), learner_profiles=_canonical_grade(learner_profiles(tables)))
    narrow = (
        _with_codes(facts)
        .join(tables["learner_journey"], ["question_set_id", "learner_id"], "left")
        .join(stored["learner_profiles"], "learner_id", "left")
    )
    return _named_school(
        _decoded_codes(narrow, tables).join(stored["question_sets"], "question_set_id", "left")
    ).select(*ATTEMPTS.names)
