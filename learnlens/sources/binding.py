"""The driver's star-schema tables read as the learning model.

``events`` plays the question attempts and logins, ``customer`` the learners, ``nation`` and ``region`` schools
and tenants; ``part`` plays question sets and ``lineitem``/``orders`` their results and journeys. Every row of
the tables used is kept. Customers in debt have no school and no tenant, which supplies missing values.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from learnlens.functions.values import lookup
from learnlens.schema import COMPLETED, DIAGNOSTIC, GRADE_BY_ID, LOGIN_EVENT, NO_SCHOOL
from learnlens.sources.readers import Tables
from learnlens.sources.scratch import written

# ---------------------------------------------------------------------------
# How names in the driver tables map to the model.
# ---------------------------------------------------------------------------
SEGMENT_GRADE = {
    "MACHINERY": 1,
    "AUTOMOBILE": 2,
    "BUILDING": 3,
    "FURNITURE": 4,
    "HOUSEHOLD": 5,
}
EVENT_OPERATION = {
    "click": "Addition",
    "view": "Subtraction",
    "purchase": "Multiplication",
    "signup": "Division",
}
PART_OPERATION = {
    "SMALL": "Addition",
    "MEDIUM": "Subtraction",
    "LARGE": "Multiplication",
    "STANDARD": "Division",
}
LEARNERS_PER_DEVICE = 8
DRIVER_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string,"
    " l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
    " props string",
}
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its layout is declared, so no job runs to infer it."""
    return spark.read.schema(DRIVER_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, shared_devices: bool) -> DataFrame:
    """Events with the item number ``k``, its set number ``b`` and the learner.

    On shared devices eight neighbouring users count as one learner, which makes busy learner-days; the number
    of learners still grows with the number of users. Every attempt has a question, so a missing item number or
    type becomes one of its own.
    """
    user = F.col("user_id")
    if shared_devices:
        user = F.floor(user / LEARNERS_PER_DEVICE).cast("bigint")
    item = F.expr("coalesce(try_cast(get_json_object(props, '$.k') as int), -1)")
    return (
        table(spark, sf_dir, "events")
        .select(
            "event_id",
            "ts",
            F.expr("coalesce(event_type, 'unknown') as event_type"),
            "value",
            user.alias("learner"),
            item.alias("k"),
        )
        .withColumn("b", F.expr("shiftright(k, 2)"))
    )


def _set_id() -> Column:
    return F.concat(F.lit("qs-"), F.col("event_type"), F.lit("-"), F.col("b").cast("string"))


def _question_id() -> Column:
    return F.concat(F.lit("q-"), F.col("event_type"), F.lit("-"), F.col("k").cast("string"))


def _purpose() -> Column:
    return (
        F.when(F.col("b") == 24, F.lit(None).cast("string"))
        .when(F.col("b") % 5 == 0, F.lit(DIAGNOSTIC))
        .otherwise(F.lit("Practice"))
    )


def _status() -> Column:
    return F.when((F.col("learner") + F.col("b")) % 3 != 0, F.lit(COMPLETED)).otherwise(
        F.lit("in-progress")
    )


def _grade_number() -> Column:
    return (F.floor(F.col("b") / 5) + 1).cast("int")


def _score() -> Column:
    return F.when(F.col("value") <= 450, (F.col("value") < 50).cast("int"))


def _attempts_count() -> Column:
    return F.when(F.col("value") <= 300, F.lit(1) + F.col("k") % 3)


def learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    enrolled = F.col("c_acctbal") >= 0
    return (
        customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left")
        .join(region, nation["n_regionkey"] == region["r_regionkey"], "left")
        .select(
            F.col("c_custkey").alias("learner"),
            F.col("c_name").alias("learner_name"),
            F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("learner_username"),
            lookup(SEGMENT_GRADE, F.col("c_mktsegment")).alias("grade_number"),
            F.when(enrolled, F.col("n_name")).alias("school"),
            F.when(enrolled, F.col("r_name")).alias("tenant_name"),
        )
    )


def attempts(
    spark: SparkSession, sf_dir: str, shared_devices: bool = False, profiles: bool = True
) -> DataFrame:
    """The attempt fact, as the flatten-and-enrich pipeline makes it from :func:`source_tables`.

    ``profiles=False`` leaves out the learner's attributes and with them the join.
    """
    events = _events(spark, sf_dir, shared_devices)
    b = F.col("b")
    operation = lookup(EVENT_OPERATION, F.col("event_type"))
    core = [
        F.col("learner").cast("string").alias("learner_id"),
        _question_id().alias("question_id"),
        _set_id().alias("question_set_id"),
        F.col("ts").alias("updated_at"),
        _attempts_count().alias("attempts_count"),
        _score().alias("score"),
        F.concat(F.lit("Set "), "event_type", F.lit(" "), b.cast("string")).alias("qset_name"),
        F.concat(F.lit("U-"), "event_type", F.lit("-"), b.cast("string")).alias("qset_uid"),
        _purpose().alias("purpose"),
        (b % 5 + 1).alias("sequence"),
        _status().alias("status"),
        lookup(GRADE_BY_ID, _grade_number()).alias("qset_grade"),
        operation.alias("operation"),
        operation.alias("l1_skill"),
        F.concat(F.lit("L2-"), F.floor(b / 5).cast("string")).alias("l2_skill"),
        F.when(b < 24, F.concat(F.lit("L3-"), b.cast("string"))).alias("l3_skill"),
        F.concat(F.lit("Repo-"), (b % 3).cast("string")).alias("repo_name"),
    ]
    if not profiles:
        return events.select(*core)
    return events.join(learners(spark, sf_dir), "learner", "left").select(
        "tenant_name",
        F.coalesce("school", F.lit(NO_SCHOOL)).alias("school"),
        lookup(GRADE_BY_ID, F.col("grade_number")).alias("grade"),
        "learner_name",
        "learner_username",
        *core,
    )


def _named(text: Column | str) -> Column:
    return F.to_json(F.struct(F.col(text).alias("en") if isinstance(text, str) else text.alias("en")))


def source_tables(
    spark: SparkSession, sf_dir: str, shared_devices: bool = False, stored: bool = False
) -> Tables:
    """The normalised source tables, JSON documents included, for attempts, logins and journeys.

    The catalogue of questions is taken from the events once and stored; sets, skills and so on derive from it. With
    ``stored`` so are the events, for jobs that read them many times: their documents are parsed once.
    """
    events = _events(spark, sf_dir, shared_devices)
    if stored:
        events = written(events, "events")

    @cache
    def questions() -> DataFrame:
        return written(events.select("event_type", "k", "b").distinct(), "catalogue")

    def sets() -> DataFrame:
        return questions().select("event_type", "b").distinct()

    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")

    class_doc = F.struct(
        F.concat(F.lit("class-"), _grade_number().cast("string")).alias("identifier"),
        F.struct(_grade_number().cast("string").alias("en")).alias("name"),
    ).alias("class")
    operation = lookup(EVENT_OPERATION, F.col("event_type"))
    l1_doc = F.when(
        operation.isNotNull(),
        F.struct(
            F.concat(F.lit("l1-"), "event_type").alias("identifier"),
            F.struct(operation.alias("en")).alias("name"),
        ),
    ).alias("l1_skill")
    l2_doc = F.array(
        F.struct(F.concat(F.lit("l2-"), F.floor(F.col("b") / 5).cast("string")).alias("identifier"))
    ).alias("l2_skill")
    l3_doc = F.when(
        F.col("b") < 24,
        F.array(F.struct(F.concat(F.lit("l3-"), F.col("b").cast("string")).alias("identifier"))),
    ).alias("l3_skill")

    segments = customer.select(
        lookup(SEGMENT_GRADE, F.col("c_mktsegment")).alias("grade_number")
    ).distinct()
    enrolled = F.col("c_acctbal") >= 0

    def skills() -> DataFrame:
        n, m = F.floor(F.col("b") / 5).cast("string"), F.col("b").cast("string")
        levels = [
            sets().select(
                F.concat(F.lit("l1-"), "event_type").alias("identifier"),
                operation.alias("skill"),
                F.lit("l1_skill").alias("type"),
            ).where("skill is not null"),
            sets().select(
                F.concat(F.lit("l2-"), n).alias("identifier"),
                F.concat(F.lit("L2-"), n).alias("skill"),
                F.lit("l2_skill").alias("type"),
            ),
            sets().where("b < 24").select(
                F.concat(F.lit("l3-"), m).alias("identifier"),
                F.concat(F.lit("L3-"), m).alias("skill"),
                F.lit("l3_skill").alias("type"),
            ),
        ]
        return reduce(DataFrame.union, levels).distinct()

    made = {
        "question_attempts": lambda: events.select(
            F.col("learner").alias("learner_id"),
            _question_id().alias("question_id"),
            _set_id().alias("question_set_id"),
            F.col("ts").alias("updated_at"),
            _attempts_count().alias("attempts_count"),
            _score().alias("score"),
            F.to_json(F.struct(class_doc, l1_doc)).alias("taxonomy"),
        ),
        "question_set": lambda: sets().select(
            _set_id().alias("identifier"),
            _named(F.concat(F.lit("Set "), "event_type", F.lit(" "), F.col("b").cast("string"))).alias(
                "title"
            ),
            F.concat(F.lit("U-"), "event_type", F.lit("-"), F.col("b").cast("string")).alias("x_id"),
            _purpose().alias("purpose"),
            F.to_json(
                F.struct(
                    F.concat(F.lit("repo-"), (F.col("b") % 3).cast("string")).alias("identifier")
                )
            ).alias("repository"),
            F.to_json(F.struct(class_doc, l1_doc, l2_doc, l3_doc)).alias("taxonomy"),
            (F.col("b") % 5 + 1).alias("sequence"),
        ),
        "question_set_question_mapping": lambda: questions().select(
            _question_id().alias("question_id"),
            _set_id().alias("question_set_id"),
            (F.col("k") % 4 + 1).alias("sequence"),
        ),
        "question": lambda: questions().select(
            _question_id().alias("identifier"),
            F.concat(F.lit("QU-"), "event_type", F.lit("-"), F.col("k").cast("string")).alias("x_id"),
        ),
        "learner": lambda: customer.join(
            nation, customer["c_nationkey"] == nation["n_nationkey"], "left"
        ).select(
            F.col("c_custkey").alias("identifier"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("username"),
            F.concat(
                F.lit("class-"), lookup(SEGMENT_GRADE, F.col("c_mktsegment")).cast("string")
            ).alias("class_id"),
            F.when(enrolled, F.concat(F.lit("school-"), F.col("c_nationkey").cast("string"))).alias(
                "school_id"
            ),
            F.when(enrolled, F.concat(F.lit("tenant-"), F.col("n_regionkey").cast("string"))).alias(
                "tenant_id"
            ),
        ),
        "learner_journey": lambda: events.select(
            _set_id().alias("question_set_id"),
            F.col("learner").alias("learner_id"),
            _status().alias("status"),
        ).distinct(),
        "class_master": lambda: segments.select(
            F.concat(F.lit("class-"), F.col("grade_number").cast("string")).alias("identifier"),
            F.col("grade_number").alias("id"),
            _named(F.col("grade_number").cast("string")).alias("name"),
        ),
        "school": lambda: nation.select(
            F.concat(F.lit("school-"), F.col("n_nationkey").cast("string")).alias("identifier"),
            F.col("n_name").alias("name"),
        ),
        "tenant": lambda: region.select(
            F.concat(F.lit("tenant-"), F.col("r_regionkey").cast("string")).alias("identifier"),
            F.col("r_regionkey").alias("id"),
            _named("r_name").alias("name"),
        ),
        "repository": lambda: sets().select((F.col("b") % 3).cast("string").alias("n")).distinct().select(
            F.concat(F.lit("repo-"), "n").alias("identifier"),
            _named(F.concat(F.lit("Repo-"), "n")).alias("name"),
        ),
        "skill_master": lambda: skills().select(
            "identifier", _named("skill").alias("name"), "type"
        ),
        "telemetry_data": lambda: events.select(
            F.col("event_id").alias("id"),
            (F.col("k") % 3).cast("string").alias("level"),
            F.col("learner").alias("learner_id"),
            F.col("ts").alias("created_on"),
            F.when(F.col("event_type") == "signup", F.lit(LOGIN_EVENT))
            .otherwise(F.col("event_type"))
            .alias("event_type"),
        ),
    }
    return Tables(made)


def _part_grade() -> Column:
    brand = F.substring_index("p_brand", "#", -1).cast("int")
    return (F.floor((brand - 1) / 5) + 1).cast("int")


def result_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Source tables of question-set results: parts are sets, an order is a learner's journey through them.

    Finished orders are completed journeys; each order line is one result, scored by its discount. Two kinds
    of part belong to no operation.
    """
    part = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    grade = lookup(GRADE_BY_ID, _part_grade())
    operation = lookup(PART_OPERATION, F.col("p_type"))
    part_doc = F.to_json(
        F.struct(
            F.struct(F.struct(grade.alias("en")).alias("name")).alias("class"),
            F.when(operation.isNotNull(), F.struct(F.struct(operation.alias("en")).alias("name"))).alias(
                "l1_skill"
            ),
        )
    )
    repo_number = (F.col("p_size") % 3).cast("string")
    sets = part.select(
        F.col("p_partkey").alias("identifier"),
        _named("p_name").alias("title"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("x_id"),
        F.when(F.col("p_size") <= 10, F.lit(DIAGNOSTIC)).otherwise(F.lit("Practice")).alias("purpose"),
        F.to_json(F.struct(F.concat(F.lit("repo-"), repo_number).alias("identifier"))).alias("repository"),
        part_doc.alias("taxonomy"),
        F.col("p_size").alias("sequence"),
    )
    made = {
        "question_set": lambda: sets,
        "question_set_results": lambda: lines.join(
            part.select("p_partkey", part_doc.alias("taxonomy")),
            F.col("l_partkey") == F.col("p_partkey"),
            "left",
        ).select(
            F.col("l_partkey").alias("question_set_id"),
            F.col("l_orderkey").alias("learner_id"),
            (F.col("l_discount") * 10).alias("score"),
            "taxonomy",
        ),
        "learner_journey": lambda: lines.select("l_partkey", "l_orderkey")
        .distinct()
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            F.col("l_partkey").alias("question_set_id"),
            F.col("l_orderkey").alias("learner_id"),
            F.when(F.col("o_orderstatus") == "F", F.lit(COMPLETED))
            .otherwise(F.lit("in-progress"))
            .alias("status"),
        ),
        "repository": lambda: part.select(repo_number.alias("n")).distinct().select(
            F.concat(F.lit("repo-"), "n").alias("identifier"),
            _named(F.concat(F.lit("Repo-"), "n")).alias("name"),
        ),
    }
    return Tables(made)


def set_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of completed journeys, as the extract makes them from :func:`result_tables`."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    sets = table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_name",
        lookup(PART_OPERATION, F.col("p_type")).alias("operation"),
        lookup(GRADE_BY_ID, _part_grade()).alias("qset_grade"),
    )
    return (
        lines.join(finished, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(sets, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select(
            "operation",
            "qset_grade",
            F.col("l_partkey").cast("string").alias("question_set_id"),
            F.col("p_name").alias("qset_name"),
            (F.col("l_discount") * 10).alias("score"),
        )
    )
