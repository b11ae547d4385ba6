"""Every operator applied to the whole driver tables.

Dates and timestamps are returned as ISO text, so that engines with different date types compare equal.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from learnlens.functions import calendar as cal
from learnlens.functions import values as val
from learnlens.operators import activity as act
from learnlens.operators import content, drilldown, jumps, progression, reshape
from learnlens.operators import filters as flt
from learnlens.operators import learner_bitmaps as bitmaps
from learnlens.operators.filters import Period, Selection
from learnlens.operators.joins import decode_lookup
from learnlens.plans import master_report, reports
from learnlens.schema import OPERATIONS
from learnlens.sources import binding, extracts, snapshots
from learnlens.sources.scratch import new_path, written
from learnlens.streaming.refresh import refresh_on_arrival

AS_OF = dt.date(2024, 1, 30)
NOW = dt.datetime(2024, 1, 30, 12, 0, 0)
FIRST_LOAD_UNTIL = dt.datetime(2024, 1, 20)
SOME_DAYS = Period(dt.date(2024, 1, 10), dt.date(2024, 1, 23))
LATER_WEEKS = Period(dt.date(2024, 1, 8))
LOW, HIGH = 0.4, 0.6
SCHOOL_CLASS = Selection(school="NATION_7", grade="class-two", tenant="ASIA")

Query = Callable[[SparkSession, str], DataFrame]


def as_text(df: DataFrame) -> DataFrame:
    def shown(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            return column.cast("string").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        return column

    return df.select(*[shown(f) for f in df.schema.fields])


def weeks(spark: SparkSession, sf: str) -> list[str]:
    """All weeks from the first to the last event, newest first."""
    days = F.to_date("updated_at")
    first, last = core(spark, sf).agg(F.min(days), F.max(days)).first()
    return cal.week_ids(first, last) if first else []


# --- inputs ----------------------------------------------------------------------------------------


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    return binding.attempts(spark, sf)


def core(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts for figures that use no learner attribute: no join is needed."""
    return binding.attempts(spark, sf, profiles=False)


def shared(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts on shared devices, which have busy learner-days."""
    return binding.attempts(spark, sf, shared_devices=True)


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return act.activity_rows(attempts(spark, sf))


def core_rows(spark: SparkSession, sf: str) -> DataFrame:
    return act.activity_rows(core(spark, sf))


def shared_rows(spark: SparkSession, sf: str) -> DataFrame:
    return act.activity_rows(shared(spark, sf))


def shared_core_rows(spark: SparkSession, sf: str) -> DataFrame:
    return act.activity_rows(binding.attempts(spark, sf, shared_devices=True, profiles=False))


def login_days(spark: SparkSession, sf: str) -> DataFrame:
    return act.login_days(extracts.logins(tables(spark, sf)))


def tables(spark: SparkSession, sf: str):
    return binding.source_tables(spark, sf)


def results(spark: SparkSession, sf: str) -> DataFrame:
    return binding.set_results(spark, sf)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return content.qset_scores(results(spark, sf))


# --- query builders --------------------------------------------------------------------------------


def of_tables(extract: Callable[..., DataFrame], **kw) -> Query:
    return lambda spark, sf: extract(tables(spark, sf), **kw)


def overall(metric: Callable[[DataFrame], DataFrame], source: Query = core_rows, default=0) -> Query:
    return lambda spark, sf: act.at_least_overall(metric(act.overall(source(spark, sf))), default)


def weekly(metric: Callable[[DataFrame], DataFrame], source: Query = core_rows) -> Query:
    return lambda spark, sf: metric(act.weekly(source(spark, sf)))


def keys_of(df: DataFrame) -> DataFrame:
    return df.select("learner_id", "question_id", "updated_at")


def jump_query(steps, by_step: bool, by_week: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        placed = steps(
            shared_rows(spark, sf),
            Selection(),
            Period(),
            as_of=AS_OF,
            overall=not by_week,
            weekly=by_week,
        )
        is_all = F.col("step") == jumps.ALL_STEPS
        return jumps.jump_medians(placed.where(~is_all if by_step else is_all))

    return run


def new_learners(distinct: bool, narrowed: bool) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        everything = core_rows(spark, sf)
        period = LATER_WEEKS if narrowed else Period()
        chosen = Selection(operation="Division") if narrowed else Selection()
        return act.new_learners(chosen.apply(everything), everything, period, distinct)

    return run


def unadjusted_and_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    keys = jumps.OPERATION_DAY
    days = (
        flt.without_null_keys(shared_rows(spark, sf), keys)
        .groupBy(*keys)
        .agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
        .withColumn("seconds", cal.seconds_between(F.col("first_at"), F.col("last_at")))
    )
    return jumps.adjust_daily(days, ["tenant_name", "school", "grade", "operation"]).select(
        "learner_id", "activity_date", "operation", "seconds", "time_spent"
    )


def last_questions(spark: SparkSession, sf: str) -> DataFrame:
    return written(extracts.last_questions(tables(spark, sf)), "last-questions")


def ladder(spark: SparkSession, sf: str) -> DataFrame:
    return progression.grade_ladder(attempts(spark, sf), last_questions(spark, sf))


def current(spark: SparkSession, sf: str) -> DataFrame:
    return progression.current_grades(ladder(spark, sf))


def qset_learners(spark: SparkSession, sf: str) -> DataFrame:
    return content.qset_learners(flt.completed(core(spark, sf)))


def question_times(spark: SparkSession, sf: str) -> DataFrame:
    shared_tables = binding.source_tables(spark, sf, shared_devices=True)
    return content.question_times(extracts.question_level(shared_tables))


def question_performance(spark: SparkSession, sf: str) -> DataFrame:
    source = binding.source_tables(spark, sf, shared_devices=True)
    return content.question_performance_of(
        extracts.question_answers(source), extracts.set_labels(source), extracts.question_labels(source)
    )


def refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """A first load of the older attempts, a sync of the rest, and one that finds nothing new."""
    source = binding.source_tables(spark, sf, stored=True)
    older = source["question_attempts"].where(F.col("updated_at") <= cal.instant(FIRST_LOAD_UNTIL))
    store = snapshots.SnapshotStore(spark, new_path(spark, "snapshots"))
    store.refresh(source.replacing(question_attempts=older), NOW)
    store.refresh(source, NOW)
    store.refresh(source, NOW)
    return store.attempts()


def two_syncs(spark: SparkSession, sf: str) -> snapshots.SnapshotStore:
    """A store that got the newer attempts and logins first and then all, the older ones late; it keeps first weeks."""
    source = binding.source_tables(spark, sf, stored=True)
    facts, events = source["question_attempts"], source["telemetry_data"]
    late = cal.instant(FIRST_LOAD_UNTIL)
    newer = source.replacing(
        question_attempts=facts.where(F.col("updated_at") > late), telemetry_data=events.where(F.col("created_on") > late)
    )
    store = snapshots.SnapshotStore(spark, new_path(spark, "snapshots"), learner_weeks=True)
    store.absorb(newer, NOW)
    store.absorb(source, NOW)
    return store


def streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same end state reached by streaming the attempt records from files, several batches, one late and one sent twice."""
    source = binding.source_tables(spark, sf, stored=True)
    facts = source["question_attempts"]
    late = F.col("updated_at") <= cal.instant(FIRST_LOAD_UNTIL)
    landing = new_path(spark, "landing")
    for part in (facts.where(~late | F.col("updated_at").isNull()), facts.where(late), facts.where(late)):
        part.repartition(2).write.mode("append").parquet(landing)
    arriving = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    store = snapshots.SnapshotStore(spark, new_path(spark, "snapshots"))
    query = refresh_on_arrival(
        arriving, source, store, new_path(spark, "stream-state"), lambda: NOW
    )
    query.awaitTermination()
    return store.attempts()


def report_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, dt.date]:
    shared_tables = binding.source_tables(spark, sf, shared_devices=True)
    return shared(spark, sf), extracts.logins(shared_tables), AS_OF


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The stored bitmaps of learners by day and attributes."""
    active = rows(spark, sf)
    numbers = written(bitmaps.numbered_learners(active), "learner-numbers")
    return written(bitmaps.learner_rollup(active, numbers), "learner-rollup")


def positions(spark: SparkSession, sf: str) -> DataFrame:
    return extracts.question_positions(binding.source_tables(spark, sf, shared_devices=True))


def count_format(spark: SparkSession, sf: str) -> DataFrame:
    placed = act.weekly(core_rows(spark, sf))
    learners = act.unique_learners(placed)
    median = act.median_work(placed)
    return median.join(learners, "bucket").select(
        "bucket", val.median_count_text(F.col("median_work"), F.col("learners")).alias("shown")
    )


def numbered_sets(spark: SparkSession, sf: str) -> DataFrame:
    sets = core(spark, sf).select("question_set_id", "operation", "qset_grade", "sequence").distinct()
    return sets.withColumns(
        {
            "operation_order": val.operation_rank(F.col("operation")),
            "qset_grade_order": val.grade_rank(F.col("qset_grade")),
        }
    ).orderBy(*reshape.domain_order("operation", "qset_grade", "sequence"))


def dim_values(extract, column: str, kind: str | None = None) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        where = F.col("type") == kind if kind else None
        return reshape.dim_values(extract(tables(spark, sf)), column, where)

    return run


QUERIES: dict[str, Query] = {
    # sources
    "attempts_flat": of_tables(extracts.attempts_flat),
    "attempts_enriched": lambda spark, sf: extracts.enrich(
        extracts.attempts_flat(tables(spark, sf)), tables(spark, sf)
    ),
    "attempt_fact": of_tables(extracts.attempts),
    "last_question": of_tables(extracts.last_questions),
    "dim_learners": of_tables(extracts.all_learners),
    "dim_grades": of_tables(extracts.grades),
    "dim_grades_list": of_tables(extracts.grades_list),
    "dim_schools": of_tables(extracts.schools),
    "dim_qset_types": of_tables(extracts.qset_types),
    "dim_repositories": of_tables(extracts.repositories),
    "dim_skills": of_tables(extracts.skills),
    "dim_tenants": of_tables(extracts.tenants),
    "login_events": of_tables(extracts.logins),
    "question_sequence": of_tables(extracts.question_positions),
    "question_set_ids": of_tables(extracts.question_set_ids),
    "question_set_ids_of_repository": of_tables(extracts.question_set_ids, repository="Repo-1"),
    "question_level": of_tables(extracts.question_level),
    "set_results": lambda spark, sf: extracts.set_results(binding.result_tables(spark, sf)),
    "incremental_refresh": refreshed,
    "streaming_refresh": streamed,
    "refreshed_logins": lambda spark, sf: two_syncs(spark, sf).logins(),
    "refreshed_new_learners": lambda spark, sf: two_syncs(spark, sf).new_learners(),
    "data_bounds": lambda spark, sf: snapshots.data_bounds(core(spark, sf)),
    "non_diagnostic": lambda spark, sf: flt.non_diagnostic(core(spark, sf)).select(
        "learner_id", "question_id", "updated_at", "purpose"
    ),
    "dim_values_l1": dim_values(extracts.skills, "skill", "l1_skill"),
    "dim_values_l2": dim_values(extracts.skills, "skill", "l2_skill"),
    "dim_values_l3": dim_values(extracts.skills, "skill", "l3_skill"),
    "dim_values_schools": dim_values(extracts.schools, "school_name"),
    "dim_values_qset_types": dim_values(extracts.qset_types, "purpose"),
    "dim_values_tenants": dim_values(extracts.tenants, "tenant_name"),
    "dim_values_repositories": dim_values(extracts.repositories, "repo_name"),
    # filters and projections
    "filtered_attempts": lambda spark, sf: keys_of(
        Selection("NATION_7", "class-two", "Addition", "ASIA").apply(attempts(spark, sf))
    ),
    "date_range_overall": lambda spark, sf: keys_of(
        core(spark, sf).where(SOME_DAYS.closed(F.to_date("updated_at")))
    ),
    "date_range_weekly": lambda spark, sf: keys_of(
        core(spark, sf).where(LATER_WEEKS.open_ended(F.to_date("updated_at")))
    ),
    "default_lookback": lambda spark, sf: keys_of(
        core(spark, sf).where(
            Period().or_lookback(dt.date(2024, 2, 20)).open_ended(F.to_date("updated_at"))
        )
    ),
    "filter_in_list": lambda spark, sf: flt.in_list(
        core(spark, sf), "purpose", ["Practice", "Pre Test"]
    ).select("learner_id", "question_id", "updated_at", "purpose"),
    "completed_attempts": lambda spark, sf: flt.completed(
        core(spark, sf), repository="Repo-1", operation="Addition", purpose="Practice"
    ).select("learner_id", "question_id", "updated_at", "qset_uid"),
    "completed_attempts_of_skill": lambda spark, sf: flt.completed(
        core(spark, sf), l2_skill="L2-1", l3_skill="L3-7"
    ).select("learner_id", "question_id", "updated_at", "qset_uid"),
    "completed_attempts_of_sets": lambda spark, sf: flt.completed(
        core(spark, sf), qsets=["U-click-3", "U-view-8", "U-none-1"]
    ).select("learner_id", "question_id", "updated_at", "qset_uid"),
    "learner_labels": lambda spark, sf: reshape.learner_labels(
        extracts.all_learners(tables(spark, sf))
    ),
    "learner_labels_no_school": lambda spark, sf: reshape.learner_labels(
        flt.of_school(extracts.all_learners(tables(spark, sf)), "No School")
    ),
    # joins and reshaping
    "skill_decode": lambda spark, sf: decode_lookup(
        extracts.attempts_flat(tables(spark, sf)).select(
            "learner_id", "question_id", "updated_at", "l3_skill_identifier"
        ),
        extracts.skills(tables(spark, sf)).where("type = 'l3_skill'"),
        "l3_skill_identifier",
        "identifier",
        "skill",
        "l3_skill",
    ),
    "last_question_reached": lambda spark, sf: progression.mark_last_question(
        core(spark, sf), last_questions(spark, sf)
    ).select("learner_id", "question_id", "question_set_id", "updated_at", "is_found"),
    "pivot_weekly": lambda spark, sf: reshape.pivot_buckets(
        act.unique_learners(act.weekly(core_rows(spark, sf))), weeks(spark, sf), "learners"
    ),
    "pivot_operation_week": lambda spark, sf: reshape.pivot_buckets(
        act.unique_learners_by_operation(act.weekly(core_rows(spark, sf))),
        weeks(spark, sf),
        "learners",
        ["operation"],
    ),
    "operation_domain_fill": lambda spark, sf: act.on_operation_domain(
        act.unique_learners_by_operation(
            act.weekly(Selection(school="NATION_7").apply(rows(spark, sf)))
        )
    ),
    "week_calendar": lambda spark, sf: cal.week_calendar(
        core(spark, sf).agg(
            F.to_date(F.min("updated_at")).alias("start"), F.to_date(F.max("updated_at")).alias("end")
        ),
        "start",
        "end",
    ),
    # activity
    "unique_learners_overall": lambda spark, sf: act.unique_learners_with_operations(
        act.overall(core_rows(spark, sf))
    ),
    "unique_learners_in_period": lambda spark, sf: act.unique_learners_with_operations(
        act.overall(core_rows(spark, sf), SOME_DAYS)
    ),
    "unique_learners_weekly": weekly(act.unique_learners),
    "unique_learners_weekly_selected": lambda spark, sf: act.unique_learners(
        act.weekly(SCHOOL_CLASS.apply(rows(spark, sf)), SOME_DAYS)
    ),
    "sessions_weekly_selected": lambda spark, sf: act.sessions(
        act.weekly(Selection(school=SCHOOL_CLASS.school).apply(rows(spark, sf)), SOME_DAYS), 2
    ),
    "time_per_learner_overall_selected": lambda spark, sf: act.at_least_overall(
        act.time_per_learner(act.overall(SCHOOL_CLASS.apply(rows(spark, sf)), SOME_DAYS))
    ),
    "learner_bitmaps_weekly": lambda spark, sf: bitmaps.unique_learners(act.weekly(rollup(spark, sf))),
    "learner_bitmaps_weekly_by_operation": lambda spark, sf: bitmaps.unique_learners_by_operation(
        act.weekly(rollup(spark, sf))
    ),
    "learner_bitmaps_selected": lambda spark, sf: bitmaps.unique_learners(
        act.weekly(SCHOOL_CLASS.apply(rollup(spark, sf)), SOME_DAYS)
    ),
    "unique_learners_weekly_by_operation": weekly(act.unique_learners_by_operation),
    "new_learners_weekly": new_learners(distinct=False, narrowed=False),
    "new_learners_weekly_distinct": new_learners(distinct=True, narrowed=False),
    "new_learners_weekly_selected": new_learners(distinct=False, narrowed=True),
    "logins_overall": overall(act.logged_in, login_days),
    "logins_weekly": weekly(act.logged_in, login_days),
    "sessions_overall": overall(act.sessions, rows),
    "sessions_weekly": weekly(act.sessions, rows),
    "work_done_overall": overall(act.work_done),
    "work_done_weekly": weekly(act.work_done),
    "work_per_learner_overall": overall(act.work_per_learner),
    "work_per_learner_weekly": weekly(act.work_per_learner),
    "median_work_overall": overall(act.median_work, default=None),
    "median_work_weekly": weekly(act.median_work),
    "time_spent_overall": overall(act.time_spent),
    "time_spent_weekly": weekly(act.time_spent),
    "time_per_learner_overall": overall(act.time_per_learner),
    "time_per_learner_weekly": weekly(act.time_per_learner),
    "low_time_weeks": lambda spark, sf: act.low_time(
        act.time_spent(act.weekly(shared_core_rows(spark, sf))), 2000
    ),
    "median_accuracy_overall": overall(act.median_accuracy, default=None),
    "median_accuracy_weekly": weekly(act.median_accuracy),
    # time on task and jumps
    "grade_time_daily": lambda spark, sf: jumps.grade_time_daily(shared_rows(spark, sf)),
    "operation_time_daily": lambda spark, sf: jumps.operation_time_daily(shared_rows(spark, sf)),
    "daily_time_adjusted": unadjusted_and_adjusted,
    "grade_jump_overall": jump_query(jumps.grade_steps, by_step=False, by_week=False),
    "grade_jump_by_grade": jump_query(jumps.grade_steps, by_step=True, by_week=False),
    "grade_jump_weekly": jump_query(jumps.grade_steps, by_step=False, by_week=True),
    "grade_jump_by_grade_week": jump_query(jumps.grade_steps, by_step=True, by_week=True),
    "operation_jump_overall": jump_query(jumps.operation_steps, by_step=False, by_week=False),
    "operation_jump_by_operation": jump_query(jumps.operation_steps, by_step=True, by_week=False),
    "operation_jump_weekly": jump_query(jumps.operation_steps, by_step=False, by_week=True),
    "operation_jump_by_operation_week": jump_query(
        jumps.operation_steps, by_step=True, by_week=True
    ),
    # content
    "qset_avg_score": scores,
    "qset_grade_summary": lambda spark, sf: content.grade_summary(results(spark, sf)),
    "easy_hard_qsets": lambda spark, sf: content.easy_and_hard(scores(spark, sf), LOW, HIGH),
    "grade_performance": lambda spark, sf: reports.grade_performance_report(
        binding.result_tables(spark, sf), low=LOW, high=HIGH
    ),
    "grade_performance_of_repository": lambda spark, sf: reports.grade_performance_report(
        binding.result_tables(spark, sf), "Practice", "Repo-1", LOW, HIGH
    ),
    "qset_learner_accuracy": qset_learners,
    "qset_performance": lambda spark, sf: content.qset_performance_of(flt.completed(core(spark, sf))),
    "qset_performance_report": lambda spark, sf: reports.qset_performance_report(
        core(spark, sf), purpose="Practice"
    ),
    "qset_performance_report_selected": lambda spark, sf: reports.qset_performance_report(
        core(spark, sf), qsets=["U-click-3", "U-click-6", "U-view-8"], repository="Repo-0", l2_skill="L2-0"
    ),
    "question_time_taken": question_times,
    "question_performance": question_performance,
    "question_performance_report": lambda spark, sf: reports.question_performance_report(
        binding.source_tables(spark, sf, shared_devices=True), "U-click-3"
    ),
    # progression
    "learner_grade_ladder": ladder,
    "learner_current_grade": current,
    "learner_progress_matrix": lambda spark, sf: progression.progress_matrix(current(spark, sf)),
    "learner_progress_report": lambda spark, sf: reports.learner_progress_report(
        attempts(spark, sf), extracts.last_questions(tables(spark, sf))
    ),
    "learner_progress_report_of_school": lambda spark, sf: reports.learner_progress_report(
        attempts(spark, sf), extracts.last_questions(tables(spark, sf)), SCHOOL_CLASS.school
    ),
    # drill-downs and reports
    "learner_list_selected": lambda spark, sf: drilldown.learner_list(
        attempts(spark, sf),
        "Subtraction",
        LATER_WEEKS,
        parent=Selection(school="NATION_2", tenant="ASIA"),
        child=Selection(school=SCHOOL_CLASS.school, operation="Division"),
        purposes=["Practice", "Pre Test"],
    ),
    "learner_detail_of_learner": lambda spark, sf: drilldown.learner_detail(
        shared(spark, sf), positions(spark, sf), learner_id="5", purposes=["Practice"]
    ),
    "learner_detail_of_username": lambda spark, sf: drilldown.learner_detail(
        shared(spark, sf), positions(spark, sf), username="user7", qset_grade="class-two", operation="Addition"
    ),
    "master_report_long_selected": lambda spark, sf: master_report.master_report_long(
        *report_inputs(spark, sf), selection=Selection(grade="class-two", tenant="ASIA")
    ),
    "learner_list": lambda spark, sf: drilldown.learner_list(attempts(spark, sf), OPERATIONS[0]),
    "learner_detail": lambda spark, sf: drilldown.learner_detail(
        shared(spark, sf),
        extracts.question_positions(binding.source_tables(spark, sf, shared_devices=True)),
    ),
    "master_report_long": lambda spark, sf: master_report.master_report_long(
        *report_inputs(spark, sf)
    ),
    "master_report_wide": lambda spark, sf: master_report.master_report_wide(
        *report_inputs(spark, sf)
    ),
    # scalar functions and formats
    "ordered_by_domain": numbered_sets,
    "week_range_label": lambda spark, sf: binding.table(spark, sf, "events").select(
        "event_id", cal.week_label(F.to_date("ts")).alias("week_range")
    ),
    "json_extract": lambda spark, sf: binding.table(spark, sf, "events").select(
        "event_id", val.json_text("props", "k").alias("k"), val.json_text("props", "none").alias("none")
    ),
    "percent_format": lambda spark, sf: binding.table(spark, sf, "events").select(
        "event_id", val.percent_text(F.col("value") / 500.0).alias("shown")
    ),
    "share_format": lambda spark, sf: binding.table(spark, sf, "events").select(
        "event_id", val.share_text(F.round(F.col("value"), 2)).alias("shown")
    ),
    "median_count_format": count_format,
}


def registered() -> dict[str, Query]:
    def shown(query: Query) -> Query:
        return lambda spark, sf: as_text(query(spark, sf))

    return {name: shown(query) for name, query in QUERIES.items()}
