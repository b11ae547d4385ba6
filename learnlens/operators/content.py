"""Difficulty of question sets and questions, by grade, question set and question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from learnlens.functions.calendar import seconds_between
from learnlens.functions.spread import spread
from learnlens.functions.values import percent_text, round_even
from learnlens.operators.filters import without_null_keys
from learnlens.operators.reshape import domain_order
from learnlens.schema import HIGH_SCORE, LOW_SCORE

QSET = [
    "question_set_id",
    "qset_uid",
    "operation",
    "qset_grade",
    "sequence",
    "purpose",
    "qset_name",
    "l2_skill",
    "l3_skill",
]
QUESTION = [
    "question_set_id",
    "question_set_uid",
    "qs_seq",
    "question_id",
    "question_uid",
    "q_seq",
]

#: Identifiers of a question set's row; the other attributes follow from them but for renamed sets, see `by_ids`.
QSET_IDS = ["question_set_id", "operation", "qset_grade"]
QUESTION_IDS = ["question_set_id", "question_id", "q_seq"]
MARK = "_attributes"

HARD, EASY = "hard", "easy"
NAME_BREAK = ", \n"


# --- by operation and grade ------------------------------------------------------------------------


def result_counts(results: DataFrame) -> DataFrame:
    """How often each score occurs on each question set: all that both summaries below need to know."""
    return results.groupBy("operation", "qset_grade", "question_set_id", "qset_name", "score").agg(
        F.count(F.lit(1)).alias("journeys")
    )


def qset_scores(results: DataFrame) -> DataFrame:
    """Average score of each question set; unknown operations and grades form groups of their own.

    ``results`` has one row per result, or those of :func:`result_counts`.
    """
    score = F.col("score").cast("double").cast("decimal(38,10)")
    if "journeys" in results.columns:
        weight = F.when(F.col("score").isNotNull(), F.col("journeys"))
        score = (F.col("score").cast("double") * F.col("journeys")).cast("decimal(38,10)")
        number = F.sum(weight)
    else:
        number = F.count("score")
    mean = F.try_divide(F.sum(score).cast("double"), number.cast("double"))
    return results.groupBy("operation", "qset_grade", "question_set_id", "qset_name").agg(
        mean.alias("avg_score")
    )


def grade_summary(results: DataFrame) -> DataFrame:
    """Number of journeys, median and average score per operation and grade, null groups included.

    ``results`` has one row per result, or those of :func:`result_counts`.
    """
    weight = "journeys" if "journeys" in results.columns else None
    return spread(
        results, ["operation", "qset_grade"], {"score": 0.01}, weight=weight
    ).select(
        "operation",
        "qset_grade",
        F.col("rows").alias("attempts_count"),
        F.col("score_median").alias("median"),
        F.col("score_mean").alias("avg"),
    )


def easy_and_hard_names(
    scores: DataFrame, low: float = LOW_SCORE, high: float = HIGH_SCORE
) -> DataFrame:
    """One row per operation, grade, list and question-set name with a low or a high average score; each name once a list."""
    known = without_null_keys(scores, ["operation", "qset_grade", "qset_name"])
    lists = F.array(
        F.when(F.col("avg_score") < low, F.lit(HARD)), F.when(F.col("avg_score") > high, F.lit(EASY))
    )
    listed = known.select("operation", "qset_grade", F.explode(F.array_compact(lists)).alias("list"), "qset_name")
    return listed.distinct()


def easy_and_hard(
    scores: DataFrame, low: float = LOW_SCORE, high: float = HIGH_SCORE
) -> DataFrame:
    """Names of the question sets with a low and with a high average score, sorted, in one text each.

    Names are ordered over all groups by ranges, so a group of very many is spread over tasks; each task joins the
    names it holds of a group into one piece, and only pieces, which are in the order of the ranges, are put together.
    A group without such names has two empty texts.
    """
    group = ["operation", "qset_grade"]
    spark = scores.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = easy_and_hard_names(scores, low, high).repartitionByRange(ranges, *group, "list", "qset_name")
    pieces = (
        ranged.withColumn("range", F.spark_partition_id())
        .groupBy(*group, "list", "range")
        .agg(F.array_join(F.array_sort(F.collect_list("qset_name")), NAME_BREAK).alias("piece"))
    )

    def text(name: str):
        held = F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("range", "piece"))))
        return F.array_join(F.transform(held, lambda p: p["piece"]), NAME_BREAK)

    found = without_null_keys(scores, group).select(*group).distinct().withColumn("list", F.lit(None).cast("string"))
    found = found.withColumns({"range": F.lit(None).cast("int"), "piece": F.lit(None).cast("string")})
    return pieces.unionByName(found).groupBy(*group).agg(
        text(HARD).alias("qsets_score_less_than_20"),
        text(EASY).alias("qsets_score_more_than_90"),
    )


def grade_performance(
    results: DataFrame, low: float = LOW_SCORE, high: float = HIGH_SCORE
) -> DataFrame:
    """Score summary per operation and grade with the names of its hard and easy question sets.

    Reads ``results`` twice, so a caller passes stored counts.
    """
    lists = easy_and_hard(qset_scores(results), low, high)
    return (
        grade_summary(results)
        .join(lists, ["operation", "qset_grade"], "left")
        .withColumns({"median": percent_text(F.col("median")), "avg": percent_text(F.col("avg"))})
        .orderBy(*domain_order("operation", "qset_grade"))
    )


# --- by question set -------------------------------------------------------------------------------


def by_ids(rows: DataFrame, names: Sequence[str], ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with only the columns ``ids`` of ``names`` and a mark of the others, and the names for ids and mark.

    Shuffles of the first then carry a number instead of texts. The mark is a 64-bit hash, which only has to tell apart the
    few states of one thing's attributes, such as its old and its new name.
    """
    others = [c for c in names if c not in ids]
    marked = rows.withColumn(MARK, F.xxhash64(*others))
    return marked.drop(*others), marked.select(*names, MARK).distinct()


def _learners(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Time, score and accuracy per ``keys``, which include the learner."""
    days = rows.groupBy(*keys, F.to_date("updated_at").alias("updated_date")).agg(
        F.min("updated_at").alias("first_at"),
        F.max("updated_at").alias("last_at"),
        F.sum("score").alias("score"),
        F.count("score").alias("scored"),
    )
    span = seconds_between(F.col("first_at"), F.col("last_at")).cast("decimal(18,6)")
    return days.groupBy(*keys).agg(
        F.sum(span).cast("double").alias("total_time"),
        F.coalesce(F.sum("score"), F.lit(0)).cast("bigint").alias("total_score"),
        F.sum("scored").alias("total_count"),
        F.try_divide(F.sum("score").cast("double"), F.sum("scored").cast("double")).alias("accuracy"),
    )


def _of_qsets(completed_attempts: DataFrame) -> DataFrame:
    return without_null_keys(completed_attempts, [*QSET, "learner_id", "updated_at"])


def qset_learners(completed_attempts: DataFrame) -> DataFrame:
    """Time, score and accuracy of each learner on each question set.

    Time is the uncapped span of each day, summed over days. Attempts that lack an attribute of the question
    set, such as a skill, belong to no group and are left out, and so are those without a time.
    """
    keys = [*QSET_IDS, MARK]
    rows, names = by_ids(_of_qsets(completed_attempts), QSET, QSET_IDS)
    measures = ["total_time", "total_score", "total_count", "accuracy"]
    return _learners(rows, [*keys, "learner_id"]).join(names, keys).select(*QSET, "learner_id", *measures)


def _difficulty(learners: DataFrame, keys: Sequence[str]) -> DataFrame:
    measured = spread(learners, keys, {"accuracy": 0.01, "total_time": 60.0})
    return measured.select(
        *keys,
        F.col("rows").alias("count_of_learners"),
        F.col("accuracy_median").alias("median_accuracy"),
        F.col("accuracy_mean").alias("average_accuracy"),
        round_even(F.col("total_time_median") / 60.0, 2).alias("median_time"),
        round_even(F.col("total_time_mean") / 60.0, 2).alias("mean_time"),
    )


def qset_performance(learners: DataFrame) -> DataFrame:
    """Learners, median and mean accuracy (fractions) and time (minutes) of each question set."""
    return _difficulty(learners, QSET)


def qset_performance_of(completed_attempts: DataFrame) -> DataFrame:
    """``qset_performance(qset_learners(completed_attempts))``, reduced by identifiers; names are joined to the result."""
    keys = [*QSET_IDS, MARK]
    rows, names = by_ids(_of_qsets(completed_attempts), QSET, QSET_IDS)
    found = _difficulty(_learners(rows, [*keys, "learner_id"]), keys).join(names, keys)
    return found.select(*QSET, *[c for c in found.columns if c not in {*QSET, MARK}])


def qset_report(performance: DataFrame) -> DataFrame:
    return performance.withColumns(
        {c: percent_text(F.col(c)) for c in ("median_accuracy", "average_accuracy")}
    ).orderBy(*domain_order("operation", "qset_grade", "sequence"))


# --- by question -----------------------------------------------------------------------------------


def question_times(question_level: DataFrame) -> DataFrame:
    """Attempts with ``question_time_taken``: seconds since the learner's answer to the question before.

    "Before" is by position in the question set within one day, so the time is negative where a learner
    answered out of order; the first answer of a day takes 0 seconds. Attempts without a known question set,
    learner or day have no answer before them and take 0 seconds as well.
    """
    key = ["question_set_id", "learner_id", "updated_date"]
    known = F.lit(True)
    for column in key:
        known = known & F.col(column).isNotNull()
    # Rows outside any group need no neighbour; hashing them apart keeps them from piling up in one task.
    apart = F.when(~known, F.xxhash64("question_id", "updated_at", "learner_id"))
    order = [F.col("q_seq").asc_nulls_last(), "updated_at", "question_id"]
    before = Window.partitionBy(*key, "_apart").orderBy(*order)
    since = seconds_between(F.lag("updated_at").over(before), F.col("updated_at"))
    return (
        question_level.withColumn("_apart", apart)
        .withColumn("question_time_taken", F.coalesce(F.when(known, since), F.lit(0.0)))
        .drop("_apart")
    )


def _answered(timed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Learners, median and mean score and mean time per ``keys``.

    Attempts are reduced to counts per learner and score, then per score. A score is a small whole number, so
    the median of a question looks at a handful of distinct values however many learners answered it.
    """
    per_learner = (
        without_null_keys(timed, keys)
        .groupBy(*keys, "learner_id", "score")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("question_time_taken").cast("decimal(18,6)")).alias("seconds"),
        )
    )
    once = Window.partitionBy(*keys, "learner_id").orderBy("score")
    counted = (F.row_number().over(once) == 1) & F.col("learner_id").isNotNull()
    per_score = (
        per_learner.withColumn("learners", counted.cast("bigint"))
        .groupBy(*keys, "score")
        .agg(*[F.sum(c).alias(c) for c in ("n", "seconds", "learners")])
    )
    scored = F.when(F.col("score").isNotNull(), F.col("n"))
    return per_score.groupBy(*keys).agg(
        F.sum("learners").alias("learners_count"),
        F.percentile("score", 0.5, F.col("n")).alias("median_accuracy"),
        F.try_divide(
            F.sum(F.col("score") * F.col("n")).cast("double"), F.sum(scored).cast("double")
        ).alias("average_accuracy"),
        round_even(F.sum("seconds").cast("double") / F.sum("n").cast("double"), 3).alias(
            "average_time_taken"
        ),
    )


def question_performance(timed: DataFrame) -> DataFrame:
    """Learners, median and mean score and mean time of each question."""
    return _answered(timed, QUESTION)


def question_performance_of(answers: DataFrame, sets: DataFrame, questions: DataFrame) -> DataFrame:
    """``question_performance(question_times(...))`` of attempts that carry identifiers only.

    ``sets`` and ``questions`` have one row per identifier; they are joined to the result, of one row per question.
    Questions and sets they do not name are left out.
    """
    found = _answered(question_times(answers), QUESTION_IDS)
    named = without_null_keys(found.join(sets, "question_set_id").join(questions, "question_id"), QUESTION)
    return named.select(*QUESTION, *[c for c in found.columns if c not in QUESTION])


def question_report(performance: DataFrame) -> DataFrame:
    return performance.withColumns(
        {c: percent_text(F.col(c)) for c in ("median_accuracy", "average_accuracy")}
    ).orderBy(
        F.col("qs_seq").asc_nulls_last(), F.col("q_seq").asc_nulls_last(), "question_id"
    )
