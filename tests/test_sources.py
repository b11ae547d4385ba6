import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from learnlens.functions import calendar as cal
from learnlens.operators import filters
from learnlens.operators.filters import Period
from learnlens.schema import ATTEMPTS, SOURCE_SCHEMAS
from learnlens.sources import binding, extracts, readers, scratch, snapshots
from learnlens.streaming.refresh import attempt_stream, refresh_on_arrival
from helpers import at, rows_of

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 2, 1, 9, 30)

RAW = {
    "question_attempts": [
        ("l1", "q1", "s1", at(8), 1, 1, '{"class": {"identifier": "c2"}, "l1_skill": {"identifier": "k1"}}'),
        ("l1", "q2", "s1", at(9), 2, 0, '{"class": {"identifier": "c2"}, "l1_skill": {"identifier": "k1"}}'),
        ("l2", "q1", "s9", at(10), None, None, "{}"),
    ],
    "question_set": [
        (
            "s1",
            '{"en": "First"}',
            "U1",
            "Practice",
            '{"identifier": "r1"}',
            '{"class": {"identifier": "c2", "name": {"en": "2"}}, "l1_skill": {"identifier": "k1", "name":'
            ' {"en": "Addition"}}, "l2_skill": [{"identifier": "k2"}, {"identifier": "k3"}],'
            ' "l3_skill": []}',
            4,
        )
    ],
    "question_set_question_mapping": [("q1", "s1", 1), ("q2", "s1", 2)],
    "question": [("q1", "QU1"), ("q2", "QU2")],
    "learner": [("l1", "Ann", "ann", "c3", "sc1", "t1"), ("l2", "Bo", "bo", None, None, None)],
    "learner_journey": [("s1", "l1", "completed")],
    "class_master": [("c2", 2, '{"en": "2"}'), ("c3", 3, '{"en": "3"}')],
    "school": [("sc1", "School A")],
    "tenant": [("t1", 1, '{"en": "Tenant A"}')],
    "repository": [("r1", '{"en": "Repo A"}')],
    "skill_master": [("k1", '{"en": "Addition"}', "l1_skill"), ("k2", '{"en": "Carrying"}', "l2_skill")],
    "telemetry_data": [
        ("e1", "info", "l1", at(8), "learner_logged_in"),
        ("e2", "info", "l1", at(8), "page_view"),
    ],
    "question_set_results": [("s1", "l1", 0.5, '{"class": {"name": {"en": "class-two"}}}')],
}


@pytest.fixture
def tables(spark):
    return readers.Tables(
        {n: (lambda n=n: spark.createDataFrame(RAW[n], SOURCE_SCHEMAS[n])) for n in RAW}
    )


def test_attempts_are_flattened_and_decoded(tables):
    first, second, third = extracts.attempts(tables).orderBy("updated_at").collect()
    assert first.asDict() == {
        "tenant_name": "Tenant A",
        "school": "School A",
        "grade": "class-three",
        "learner_name": "Ann",
        "learner_username": "ann",
        "learner_id": "l1",
        "question_id": "q1",
        "question_set_id": "s1",
        "updated_at": at(8),
        "attempts_count": 1,
        "score": 1,
        "qset_name": "First",
        "qset_uid": "U1",
        "purpose": "Practice",
        "sequence": 4,
        "status": "completed",
        "qset_grade": "class-two",
        "operation": "Addition",
        "l1_skill": "Addition",
        "l2_skill": "Carrying",
        "l3_skill": None,
        "repo_name": "Repo A",
    }
    assert second["score"] == 0
    # An unknown question set, class and school: the record stays, the school gets its label.
    assert third["school"] == "No School" and third["qset_name"] is None and third["grade"] is None
    assert third["score"] is None and third["attempts_count"] is None


def test_decoding_before_or_after_flattening_is_the_same(tables):
    early = extracts.attempts(tables)
    late = extracts.enrich(extracts.attempts_flat(tables), tables).select(*early.columns)
    assert early.columns == ATTEMPTS.names
    assert early.exceptAll(late).count() == 0 and late.exceptAll(early).count() == 0


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_read_once_and_the_fact_is_joined_five_times(spark, tables):
    plan = optimized(extracts.attempts(tables))
    assert plan.count("from_json") == 1 and plan.count("Join LeftOuter") == 5  # the sets are stored by then
    assert optimized(extracts.last_questions(tables)).count("from_json") == 1
    assert optimized(extracts.set_results(tables)).count("from_json") == 1
    # Flattened attempts meet the decoded sets in one join, beside those by grade and operation.
    schema = extracts.attempts_flat(tables).schema
    path = scratch.new_path(spark, "flat")
    extracts.attempts_flat(tables).write.parquet(path)
    late = extracts.enrich(spark.read.schema(schema).parquet(path), tables)
    chain, joins = late._jdf.queryExecution().analyzed(), 0
    while chain.children().size() > 0:  # the fact is always the left side
        joins += chain.nodeName() == "Join"
        chain = chain.children().apply(0)
    assert joins == 3


@pytest.mark.parametrize(
    "document, found",
    [
        ('{"l1_skill": {"identifier": "a"}, "l2_skill": [{"identifier": "b"}, {"identifier": "c"}]}', ("a", "b", None)),
        ('{"l1_skill": {"identifier": 7}, "l2_skill": [], "l3_skill": [{}]}', ("7", None, None)),
        ('{"l1_skill": null, "l3_skill": [{"identifier": "d"}], "more": [1, 2]}', (None, None, "d")),
        ('{"l1_skill": {"identifier": "a"}, "l2_skill": {"identifier": "b"}}', ("a", None, None)),
        ("no document", (None, None, None)),
        ("", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_identifiers_in_a_taxonomy(spark, document, found):
    row = ("s", None, None, None, None, document, 1)
    sets = spark.createDataFrame([row], SOURCE_SCHEMAS["question_set"])
    (made,) = extracts._question_sets({"question_set": sets}).collect()
    assert tuple(made[f"l{n}_skill_identifier"] for n in (1, 2, 3)) == found


def test_driver_binding_equals_the_pipeline(spark):
    direct = binding.attempts(spark, SF)
    made = extracts.attempts(binding.source_tables(spark, SF)).select(*direct.columns)
    assert direct.exceptAll(made).count() == 0 and made.exceptAll(direct).count() == 0
    results = binding.set_results(spark, SF)
    extracted = extracts.set_results(binding.result_tables(spark, SF))
    assert results.exceptAll(extracted).count() == 0 and extracted.exceptAll(results).count() == 0


def test_records_since_a_moment(tables):
    assert extracts.attempts_flat(tables, at(9)).count() == 2


def test_journeys_fan_out(spark, tables):
    journeys = spark.createDataFrame(
        [("s1", "l1", "completed"), ("s1", "l1", "in-progress")], SOURCE_SCHEMAS["learner_journey"]
    )
    assert extracts.attempts(tables.replacing(learner_journey=journeys)).count() == 5


def test_last_question_has_the_canonical_grade(tables):
    assert rows_of(extracts.last_questions(tables)) == [("Addition", "class-two", "s1", "q2")]


def test_logins(tables):
    assert rows_of(extracts.logins(tables), "id", "school", "grade", "tenant_name") == [
        ("e1", "School A", "class-three", "Tenant A")
    ]


def test_question_level_of_one_set(tables):
    rows = extracts.question_level(tables, "U1")
    assert rows_of(rows, "question_uid", "q_seq", "qs_seq") == [("QU1", 1, 4), ("QU2", 2, 4)]
    assert extracts.question_level(tables).count() == 3


def test_question_set_ids_by_repository(tables):
    assert rows_of(extracts.question_set_ids(tables, "Repo A")) == [("U1",)]
    assert rows_of(extracts.question_set_ids(tables, "Other")) == []


def test_set_results_by_purpose(tables):
    assert rows_of(extracts.set_results(tables, "Practice", "Repo A"), "qset_name", "score") == [("First", 0.5)]
    assert extracts.set_results(tables, "Main Diagnostic").count() == 0


def test_values_are_literals_not_sql(tables):
    assert extracts.question_level(tables, "x' OR '1'='1").count() == 0


def test_files_are_read_back(spark, tables, tmp_path):
    for name in tables:
        tables[name].write.parquet(f"{tmp_path}/{name}")
    again = readers.read_files(spark, str(tmp_path))
    assert set(again) == set(SOURCE_SCHEMAS)
    assert rows_of(again["question"]) == rows_of(tables["question"])


def test_jdbc_options():
    options = readers.jdbc_options(
        "jdbc:x", "facts", {"user": "u"}, ("updated_at", "2024-01-01", "2024-02-01", 16)
    )
    assert options["fetchsize"] == "10000" and options["numPartitions"] == "16"
    assert options["partitionColumn"] == "updated_at" and options["user"] == "u"
    assert "numPartitions" not in readers.jdbc_options("jdbc:x", "small")


# --- calendar --------------------------------------------------------------------------------------


def test_default_lookback():
    assert cal.default_start(dt.date(2024, 1, 30)) == dt.date(2023, 12, 25)
    assert cal.default_start(dt.date(2024, 1, 29)) == dt.date(2023, 12, 25)
    assert cal.default_start(dt.date(2024, 1, 28)) == dt.date(2023, 12, 18)
    both = Period(dt.date(2024, 1, 1), dt.date(2024, 1, 2))
    assert both.or_lookback(dt.date(2024, 1, 30)) == both
    assert Period(end=dt.date(2024, 1, 2)).or_lookback(dt.date(2024, 1, 30)).end is None


def test_week_calendar_newest_first(spark):
    bounds = spark.createDataFrame([(dt.date(2023, 12, 31), dt.date(2024, 1, 8))], "a date, b date")
    found = [(r["week_id"], r["week_name"]) for r in cal.week_calendar(bounds, "a", "b").collect()]
    assert found == [
        ("2024-01-08,2024-01-14", "08 Jan to 14 Jan 2024"),
        ("2024-01-01,2024-01-07", "01 Jan to 07 Jan 2024"),
        ("2023-12-25,2023-12-31", "25 Dec to 31 Dec 2023"),
    ]
    assert [w for w, _ in found] == cal.week_ids(dt.date(2023, 12, 31), dt.date(2024, 1, 8))


def test_date_filters_reach_the_scan(spark):
    day = F.to_date("updated_at")
    period = Period(dt.date(2024, 1, 8), dt.date(2024, 1, 9))
    frame = binding.attempts(spark, SF, profiles=False).where(period.closed(day)).select("learner_id")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-08" in plan and "LessThan(ts,2024-01-10" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint" in plan and "value" not in plan.split("ReadSchema")[1]


def test_null_key_filters_reach_the_scan(spark):
    customers = binding.table(spark, SF, "customer")
    frame = filters.without_null_keys(customers, ["c_nationkey", "c_mktsegment"])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(c_nationkey)" in plan and "IsNotNull(c_mktsegment)" in plan


# --- snapshots -------------------------------------------------------------------------------------


def fact(learner, day, score=1):
    return (learner, "q1", "s1", at(day), 1, score, RAW["question_attempts"][0][6])


@pytest.fixture
def store(spark, tmp_path):
    return snapshots.SnapshotStore(spark, str(tmp_path / "store"))


def having(spark, tables, *facts):
    frame = spark.createDataFrame(list(facts), SOURCE_SCHEMAS["question_attempts"])
    return tables.replacing(question_attempts=frame)


def days(store):
    return sorted((r["learner_id"], r["updated_at"].day, r["score"]) for r in store.attempts().collect())


def test_refresh_adds_new_records_once(spark, tables, store):
    assert store.last_sync() is None
    with pytest.raises(FileNotFoundError):
        store.attempts()
    store.refresh(having(spark, tables, fact("l1", 1), fact("l1", 2)), NOW)
    state = store.refresh(having(spark, tables, fact("l1", 1), fact("l1", 2), fact("l1", 3)), NOW)
    assert days(store) == [("l1", 1, 1), ("l1", 2, 1), ("l1", 3, 1)]
    assert (state["min_updated_at"], state["max_updated_at"]) == (at(1), at(3))
    again = store.refresh(having(spark, tables, fact("l1", 2), fact("l1", 3)), NOW)
    assert again["added"] == 0 and days(store) == [("l1", 1, 1), ("l1", 2, 1), ("l1", 3, 1)]
    assert (again["min_updated_at"], again["max_updated_at"]) == (at(1), at(3))


def test_changed_record_is_kept_besides_its_old_version(spark, tables, store):
    store.refresh(having(spark, tables, fact("l1", 1, 0)), NOW)
    store.refresh(having(spark, tables, fact("l1", 2, 1)), NOW)
    assert days(store) == [("l1", 1, 0), ("l1", 2, 1)]


def test_first_load_keeps_duplicates_until_the_next_sync(spark, tables, store):
    store.refresh(having(spark, tables, fact("l1", 1), fact("l1", 1), fact("l1", 2)), NOW)
    assert len(days(store)) == 3
    store.refresh(having(spark, tables, fact("l1", 2), fact("l2", 2), fact("l2", 2)), NOW)
    assert days(store) == [("l1", 1, 1), ("l1", 2, 1), ("l2", 2, 1)]
    store.refresh(having(spark, tables, fact("l2", 2), fact("l2", 4), fact("l2", 4)), NOW)
    assert days(store) == [("l1", 1, 1), ("l1", 2, 1), ("l2", 2, 1), ("l2", 4, 1)]


def test_empty_first_load(spark, tables, store):
    empty = having(spark, tables, fact("l1", 1))["question_attempts"].limit(0)
    store.refresh(tables.replacing(question_attempts=empty), NOW)
    assert days(store) == []
    store.refresh(having(spark, tables, fact("l1", 1)), NOW)
    assert days(store) == [("l1", 1, 1)]


def test_unfinished_sync_is_invisible_and_repeated(spark, tables, store):
    store.refresh(having(spark, tables, fact("l1", 1)), NOW)
    # A job that died before its log row: rows under the next number.
    ghost = store.attempts().withColumn("learner_id", F.lit("ghost")).withColumn("day", F.to_date("updated_at"))
    ghost.write.partitionBy("day").parquet(f"{store.root}/attempts/sync=1")
    assert days(store) == [("l1", 1, 1)]
    store.refresh(having(spark, tables, fact("l1", 1), fact("l1", 3)), NOW)
    assert days(store) == [("l1", 1, 1), ("l1", 3, 1)]


def test_dimensions_and_bounds(spark, tables, store):
    store.refresh(tables, NOW)
    assert set(snapshots.DIMENSIONS) == {
        "last_question_per_qset_grade",
        "all_learners",
        "all_grades",
        "all_schools",
        "all_qset_types",
        "all_repository_names",
        "all_skills",
        "all_tenants",
        "all_logged_in_users",
        "all_question_sequence_data",
    }
    for name, extract in snapshots.DIMENSIONS.items():
        assert rows_of(store.dimension(name)) == rows_of(extract(tables))
    store.refresh(tables.replacing(school=tables["school"].limit(0)), NOW)
    assert rows_of(store.dimension("all_schools")) == [("No School",)]
    assert rows_of(store.bounds()) == [(at(8), at(10), NOW)]


def test_last_record_is_shown_in_indian_time(spark, tables):
    (row,) = snapshots.data_bounds(extracts.attempts(tables)).collect()
    assert row["last_record_shown"] == "10 Jan 2024 15:30"


def test_stream_of_files_ends_in_the_same_state(spark, tables, store, tmp_path):
    landing, state = str(tmp_path / "landing"), str(tmp_path / "state")

    def arrive(*facts):
        having(spark, tables, *facts)["question_attempts"].write.mode("append").parquet(landing)
        query = refresh_on_arrival(attempt_stream(spark, landing), tables, store, state, lambda: NOW)
        query.awaitTermination()

    arrive(fact("l1", 5), fact("l1", 6))
    arrive(fact("l1", 6), fact("l1", 7))
    arrive(fact("l1", 2))  # a late file
    arrive(fact("l1", 2), fact("l1", 5))  # one sent twice
    assert days(store) == [("l1", 2, 1), ("l1", 5, 1), ("l1", 6, 1), ("l1", 7, 1)]


def test_records_without_a_time_are_stored_once(spark, tables, store):
    timeless = ("l1", "q1", "s1", None, 1, 1, RAW["question_attempts"][0][6])
    for facts in ([fact("l1", 1), timeless], [timeless, fact("l1", 1)], [timeless, timeless, fact("l1", 3)], [timeless]):
        store.absorb(having(spark, tables, *facts), NOW)
    assert sorted(str(r["updated_at"]) for r in store.attempts().collect()) == [str(at(1)), str(at(3)), "None"]


def test_only_the_days_of_a_batch_are_compared(spark, tables, store):
    store.absorb(having(spark, tables, *[fact("l1", d) for d in range(1, 9)]), NOW)
    store.absorb(having(spark, tables, fact("l1", 2), fact("l2", 2)), NOW)
    assert store.last_sync()["added"] == 1 and len(days(store)) == 9
    assert sorted(p for p in os.listdir(f"{store.root}/attempts/sync=1") if p.startswith("day=")) == [f"day={at(2).date()}"]


def test_superseded_tables_are_removed(spark, tables, store):
    for day in range(1, 5):
        store.refresh(having(spark, tables, fact("l1", 1), *[fact("l1", d) for d in range(1, day + 1)]), NOW)
    assert sorted(os.listdir(f"{store.root}/dims")) == ["sync=2", "sync=3"]
    assert "sync=0" not in os.listdir(f"{store.root}/attempts")
    assert days(store) == [("l1", d, 1) for d in range(1, 5)]


def test_scratch_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch.shared_folder(spark) == folder
    assert scratch.new_path(spark, "x").startswith(folder)
    assert rows_of(scratch.written(spark.range(3).toDF("n"), "three")) == [(0,), (1,), (2,)]


def test_a_scope_leaves_nothing_behind(spark):
    with scratch.scope(spark) as folder:
        assert scratch.written(spark.range(3), "three").count() == 3
        assert os.listdir(folder)
    assert not os.path.exists(folder)


class _Session:
    """A session that names no shared folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: "/warehouse" if key.endswith("warehouse.dir") else default)

    class sparkContext:  # noqa: N801
        applicationId, master = "some-application", "local[2]"


def test_intermediates_need_a_named_folder_whatever_the_master():
    with pytest.raises(ValueError):
        scratch.shared_folder(_Session)
    scratch.use_warehouse_where_unset(_Session)
    assert scratch.shared_folder(_Session) == "/warehouse/_intermediate"
    scratch._instead.clear()


def test_weeks_of_the_data_are_all_pivoted(spark, tmp_path):
    from driver_queries import spark_queries
    from learnlens.sources.binding import DRIVER_TABLES

    rows = [(1, dt.datetime(2023, 12, 20, 9), 8, "view", '{"k" : 5}'), (2, dt.datetime(2024, 2, 8, 9), 16, "view", '{"k": "5"}')]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string")
    plain = events.withColumn("value", F.lit(1.0))
    declared = spark.createDataFrame([], DRIVER_TABLES["events"]).schema
    plain.select(*[plain[f.name].cast(f.dataType).alias(f.name) for f in declared]).write.parquet(str(tmp_path / "events.parquet"))
    pivot = spark_queries.registered()["pivot_weekly"](spark, str(tmp_path))
    weeks = pivot.columns
    assert len(weeks) == 8 and weeks[-1] == "2023-12-18,2023-12-24" and weeks[0] == "2024-02-05,2024-02-11"
    (row,) = pivot.collect()
    assert (row[weeks[0]], row[weeks[-1]]) == (1, 1)


# --- folders of the store ---------------------------------------------------------------------------


def parts(store, name):
    """The live folders of a store's table, by day."""
    found = {}
    for folder in store.folders():
        if folder.store == name:
            found.setdefault(folder.day, []).append(folder)
    return found


def test_many_small_syncs_leave_few_folders(spark, tables, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"), most_folders=2)
    for k in range(7):
        store.absorb(having(spark, tables, fact(f"l{k}", 1), fact("l1", 1 + k)), NOW)
        assert len(days(store)) == len({(f"l{j}", 1) for j in range(k + 1)} | {("l1", 1 + j) for j in range(k + 1)})
    held = parts(store, "attempts")
    assert max(map(len, held.values())) <= 3
    assert {d: sum(f.rows for f in fs) for d, fs in held.items()}[at(1).date()] == 7
    # two states are kept on disk, and no file of an older one
    labels = {f.label for f in store.folders()} | {f.label for f in snapshots.read_manifest(spark, store.root, 5)}
    assert {p.removeprefix("sync=") for p in os.listdir(f"{store.root}/attempts")} <= labels


def test_a_reader_sees_one_state_while_files_are_swapped(spark, tables, store):
    for k in range(3):
        store.absorb(having(spark, tables, *[fact(f"l{k}", d) for d in (1, 2)]), NOW)
    reader = store.attempts()
    before = rows_of(reader)
    state = store.compact(NOW)
    assert rows_of(reader) == before == rows_of(store.attempts())
    assert [len(fs) for fs in parts(store, "attempts").values()] == [1, 1] and state["added"] == 0
    assert (state["min_updated_at"], state["max_updated_at"]) == (at(1), at(2))
    for name, extract in snapshots.DIMENSIONS.items():
        assert rows_of(store.dimension(name)) == rows_of(extract(tables))
    store.absorb(having(spark, tables, fact("l0", 1), fact("l9", 3)), NOW)
    assert store.last_sync()["added"] == 1


def test_folders_are_merged_when_small_beside_each_other():
    from learnlens.sources.folders import Folder, _alike

    def of(*sizes):
        return [Folder("attempts", None, str(k), n) for k, n in enumerate(sizes)]

    assert [f.rows for f in _alike(of(1000, 3, 2, 1))] == [1, 2, 3]
    assert _alike(of(1, 10, 100)) == []
    assert [f.rows for f in _alike(of(5, 5, 5, 5))] == [5, 5, 5, 5]


def test_a_period_opens_its_days_only(spark, tables, store):
    store.absorb(having(spark, tables, *[fact("l1", d) for d in range(1, 9)]), NOW)
    some = store.attempts(Period(dt.date(2024, 1, 3), dt.date(2024, 1, 4)))
    assert sorted(r["updated_at"].day for r in some.collect()) == [3, 4]
    assert len(some.inputFiles()) == 2


def test_repeats_are_found_without_shuffling_rows(spark, tables, store):
    store.refresh(having(spark, tables, *[fact("l1", d) for d in (1, 1, 2, 3, 3)]), NOW)
    held = store._store("attempts").open([f for f in store.folders() if f.store == "attempts"])
    found = snapshots.days_with_repeats(held)
    assert sorted(r[0].day for r in found.collect()) == [1, 3]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    shuffled = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate [day" in plan and "Exchange" in shuffled
    for line in shuffled.splitlines():
        if "Exchange" in line:
            assert "learner" not in line and "question" not in line
    # a sync rewrites the days with repeats, each by itself, and leaves the others alone
    store.refresh(having(spark, tables, fact("l1", 3)), NOW)
    assert {d.day: [f.label for f in fs] for d, fs in parts(store, "attempts").items()} == {
        1: [f"1-distinct-{at(1).date()}"],
        2: ["0"],
        3: [f"1-distinct-{at(3).date()}"],
    }
    assert days(store) == [("l1", 1, 1), ("l1", 2, 1), ("l1", 3, 1)]


def login(k, learner, day):
    return (f"e{k}", "info", learner, None if day is None else at(day), "learner_logged_in")


def with_logins(spark, tables, *events, **more):
    frame = spark.createDataFrame(list(events), SOURCE_SCHEMAS["telemetry_data"])
    return tables.replacing(telemetry_data=frame, **more)


def test_a_sync_writes_only_new_logins(spark, tables, store):
    first = [login(1, "l1", 8), login(2, "l2", 8), login(3, None, 9), login(4, "l1", None)]
    store.refresh(with_logins(spark, tables, *first), NOW)
    labels = {d: [(f.label, f.rows) for f in fs] for d, fs in parts(store, "logins").items()}
    more = [*first, login(5, "l2", 9), login(6, "l1", 10), login(6, "l1", 10)]
    source = with_logins(spark, tables, *more)
    store.refresh(source, NOW)
    after = {d: [(f.label, f.rows) for f in fs] for d, fs in parts(store, "logins").items()}
    assert after[at(8).date()] == labels[at(8).date()] and after[None] == labels[None]
    assert sorted(after[at(9).date()]) == [("0", 1), ("1-more", 1)] and after[at(10).date()] == [("1", 2)]
    assert rows_of(store.logins()) == rows_of(extracts.logins(source))
    # nothing new: nothing is written
    store.refresh(source, NOW)
    assert {d: [(f.label, f.rows) for f in fs] for d, fs in parts(store, "logins").items()} == after


def test_logins_that_go_or_change_in_the_source(spark, tables, store):
    store.refresh(with_logins(spark, tables, login(1, "l1", 8), login(2, "l2", 8), login(3, "l2", 9)), NOW)
    source = with_logins(spark, tables, login(1, "l1", 8), login(4, "l2", 8))
    store.refresh(source, NOW)
    assert rows_of(store.logins()) == rows_of(extracts.logins(source))
    assert [f.label for f in parts(store, "logins")[at(8).date()]] == ["1-again"]


def test_changed_names_appear_without_new_logins(spark, tables, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"), most_folders=2)
    events = [login(1, "l1", 8), login(2, "l2", 8), login(3, "l3", 9)]
    learners = [list(r) for r in RAW["learner"]]
    for k, change in enumerate([lambda: None, lambda: learners[1].__setitem__(4, "sc1"), lambda: learners.append(["l3", "Cy", "cy", "c2", None, "t1"]), learners.pop, lambda: learners[0].__setitem__(3, "c2")]):
        change()
        frame = spark.createDataFrame([tuple(r) for r in learners], SOURCE_SCHEMAS["learner"])
        source = with_logins(spark, tables, *events, learner=frame)
        store.refresh(source, NOW)
        assert rows_of(store.logins()) == rows_of(extracts.logins(source)), k
    assert {f.label for f in store.folders() if f.store == "logins"} == {"0"}
    assert len([f for f in store.folders() if f.store == "profiles"]) <= 3


def test_first_weeks_follow_late_and_repeated_batches(spark, tables, tmp_path):
    from learnlens.operators import activity

    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"), learner_weeks=True, most_folders=2)
    unknown = ("l4", "q1", "s1", at(3), 1, 1, "{}")
    batches = [
        [fact("l1", 9), fact("l2", 16), fact("l1", 16)],
        [fact("l2", 2), fact("l3", 23)],  # late: an earlier week than the known one
        [("l1", "q2", "s1", at(10), 1, 1, "{}"), unknown, (None, "q1", "s1", at(30), 1, 1, "{}")],
        [fact("l4", 4), fact("l4", 4), fact("l2", 2)],  # one more operation in the same week, and rows sent twice
        [("l2", "q9", "s1", None, 1, 1, "{}")],
    ]
    for k, batch in enumerate(batches):
        store.absorb(having(spark, tables, *batch), NOW)
        everything = activity.activity_rows(store.attempts())
        for distinct in (False, True):
            want = activity.new_learners(everything, everything, distinct_learners=distinct)
            assert rows_of(store.new_learners(distinct)) == rows_of(want), (k, distinct)
    kept = sum(f.rows for f in store.folders() if f.store == "first_weeks")
    store.absorb(having(spark, tables, *[fact("l1", d) for d in range(11, 31)]), NOW)
    grown = sum(f.rows for f in store.folders() if f.store == "first_weeks")
    assert grown == kept + 1  # twenty more attempts, and one week that nobody had worked in


def test_a_store_without_learner_weeks_says_so(spark, tables, store):
    store.refresh(tables, NOW)
    with pytest.raises(ValueError):
        store.new_learners()


def test_rows_not_stored_are_joined_by_their_hash_alone(spark):
    layout = "a string, b int"
    new = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), (None, 2), ("y", None), ("", None)], layout)
    stored = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), ("z", 3)], layout)
    missing = snapshots.not_stored(new, stored)
    assert missing.columns == ["a", "b"]
    assert sorted(map(tuple, missing.collect()), key=str) == [("", None), (None, 2)]
    plan = snapshots.not_stored(new, stored)._jdf.queryExecution().executedPlan().toString()  # as planned, before it runs
    assert re.search(r"Join \[_row#\d+L\], \[_row#\d+L\], LeftAnti", plan)


def test_stored_events_are_parsed_once(spark):
    read, kept = binding.source_tables(spark, SF), binding.source_tables(spark, SF, stored=True)
    for name in ("question_attempts", "learner_journey", "telemetry_data"):
        assert "get_json_object" in optimized(read[name]) and "get_json_object" not in optimized(kept[name])
        assert kept[name].dtypes == read[name].dtypes
        assert kept[name].exceptAll(read[name]).isEmpty() and read[name].exceptAll(kept[name]).isEmpty()


def test_grades_are_labelled_on_lookups_and_the_fact_meets_journeys_first(spark, tables):
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(extracts.attempts(tables)._jdf.queryExecution(), "simple")
    lines = [line for line in plan.splitlines() if "LeftOuter" in line]
    assert "question_set_id" in lines[-1] and "learner_id" in lines[-1]  # the innermost join is printed last


def test_only_logins_are_digested(spark, tables, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    store.refresh(tables, NOW)
    digests = {(f.store, f.digest is None) for f in store.folders() if f.day}
    assert digests <= {("attempts", True), ("logins", False)} and ("attempts", True) in digests
