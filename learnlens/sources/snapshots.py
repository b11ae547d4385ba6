"""Snapshot tables and the incremental refresh of the attempt fact.

Layout under a root folder: ``dims/sync=<n>/<name>`` for the small tables, each replaced whole by a sync;
``attempts``, ``logins`` and ``profiles`` in folders of one sync and day (:mod:`learnlens.sources.folders`); ``manifest/sync=<n>``, which
names the folders of a state; ``layout`` for the columns of the fact; and ``log`` with one row per finished sync. A
sync is visible once its log row is written, which happens last, so a job that dies half-way leaves the
previous state in place and is simply run again under the next number. What the last two states do not need is
then removed; the one before the last stays for readers that are at work.

Logins are stored without names, by day. A sync compares the number and the summed hashes of each day's events with those
of the source and adds what is missing. Names are versions of learner profiles, each valid from the sync that found
it changed, and are joined when logins are read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from learnlens.functions.calendar import display_time, instant
from learnlens.operators import first_weeks
from learnlens.operators.filters import Period
from learnlens.sources import extracts, scratch
from learnlens.sources.folders import (
    MOST_FOLDERS,
    Folder,
    Folders,
    digest,
    of_days,
    read_manifest,
    remove_unused,
    row_hash,
    write_manifest,
)

LOG_SCHEMA = (
    "sync bigint, deduplicated boolean, min_updated_at timestamp_ntz,"
    " max_updated_at timestamp_ntz, added bigint, synced_at timestamp"
)

Load = Callable[[extracts.Tables, dt.datetime | None], DataFrame]

DIMENSIONS: Mapping[str, Callable[[extracts.Tables], DataFrame]] = {
    "last_question_per_qset_grade": extracts.last_questions,
    "all_learners": extracts.all_learners,
    "all_grades": extracts.grades,
    "all_schools": extracts.schools,
    "all_qset_types": extracts.qset_types,
    "all_repository_names": extracts.repositories,
    "all_skills": extracts.skills,
    "all_tenants": extracts.tenants,
    "all_logged_in_users": extracts.logins,
    "all_question_sequence_data": extracts.question_positions,
}
LOGINS = "all_logged_in_users"
#: the tables that a sync replaces whole
REPLACED = [name for name in DIMENSIONS if name != LOGINS]
LOGIN_LAYOUT = "id string, level string, learner_id string, created_on timestamp_ntz"
#: what a version of a learner's profile shows; a learner who is gone has none
PROFILE_LAYOUT = "learner_id string, valid_from bigint, shown array<struct<school string, grade string, tenant_name string>>"
SIDE_BY_SIDE = 8


def not_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of ``new``, each once, that ``stored`` does not have; a missing value equals a missing value.

    Rows are placed and sorted by one hash; their columns are compared only where hashes meet. They are compared in one sum, since
    the planner would make two join keys of each comparison that stands alone.
    """
    columns = new.columns
    mine = new.distinct().withColumn("_row", row_hash(columns)).alias("n")
    held = stored.select(*[f"`{c}`" for c in columns]).withColumn("_row", row_hash(columns)).alias("s")
    equal = reduce(add, [F.col(f"n.`{c}`").eqNullSafe(F.col(f"s.`{c}`")).cast("int") for c in columns])
    return mine.join(held, (F.col("n._row") == F.col("s._row")) & (equal == len(columns)), "left_anti").drop("_row")


def days_with_repeats(stored: DataFrame) -> DataFrame:
    """The days on which two rows have one hash. Only hashes and days are shuffled, counted before."""
    columns = [c for c in stored.columns if c != "day"]
    hashes = stored.select("day", row_hash(columns).alias("_row")).groupBy("day", "_row").agg(F.count(F.lit(1)).alias("_n"))
    return hashes.where("_n > 1").select("day").distinct()


def newest_profiles(versions: DataFrame) -> DataFrame:
    """learner_id and what is shown of each learner, by the newest version."""
    return versions.groupBy("learner_id").agg(F.max_by("shown", "valid_from").alias("shown"))


def data_bounds(attempts: DataFrame) -> DataFrame:
    """Earliest and latest record, and the latest as it is shown to readers."""
    return attempts.agg(
        F.min("updated_at").alias("min_updated_at"), F.max("updated_at").alias("max_updated_at")
    ).withColumn(
        "last_record_shown", F.date_format(display_time(F.col("max_updated_at")), "dd MMM yyyy HH:mm")
    )


@dataclass(frozen=True)
class SnapshotStore:
    """Readers and the refresh job over one root folder in shared storage.

    ``learner_weeks`` keeps the first week of each learner as a state of its own, which new learners per week are read from.
    """

    spark: SparkSession
    root: str
    learner_weeks: bool = False
    most_folders: int = MOST_FOLDERS

    # -- reading ------------------------------------------------------------------------------------

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/log")

    def last_sync(self) -> Row | None:
        """The log row of the newest finished sync, if there is one."""
        try:
            return self.log().orderBy(F.col("sync").desc()).first()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _state(self) -> Row:
        state = self.last_sync()
        if state is None:
            raise FileNotFoundError(f"no finished sync under {self.root}")
        return state

    def folders(self, state: Row | None = None) -> list[Folder]:
        """The live folders of a state, of the newest one if none is given."""
        return read_manifest(self.spark, self.root, (state or self._state())["sync"])

    def _store(self, name: str) -> Folders:
        if name == "attempts":
            layout, time = self.spark.read.parquet(f"{self.root}/layout").schema, "updated_at"
        else:
            text, time = {
                "logins": (LOGIN_LAYOUT, "created_on"),
                "profiles": (PROFILE_LAYOUT, None),
                "first_weeks": (first_weeks.LAYOUT, None),
            }[name]
            layout = T.StructType.fromDDL(text)
        return Folders(self.spark, self.root, name, layout, time, digested=name == "logins")

    def attempts(self, period: Period = Period()) -> DataFrame:
        """The fact; with both ends of a period, only the folders of its days are opened."""
        live = [f for f in self.folders() if f.store == "attempts"]
        if period.start and period.end:
            live = [f for f in live if f.day and period.start <= f.day <= period.end]
        return self._store("attempts").open(live).drop("day")

    def logins(self) -> DataFrame:
        """Login events with the school, grade and tenant their learner has in the newest state."""
        live = self.folders()
        events = self._store("logins").open([f for f in live if f.store == "logins"]).drop("day")
        versions = self._store("profiles").open([f for f in live if f.store == "profiles"])
        shown = events.join(newest_profiles(versions), "learner_id", "left").withColumn("shown", F.explode_outer("shown"))
        return shown.select("id", "level", "learner_id", "created_on", "shown.school", "shown.grade", "shown.tenant_name")

    def dimension(self, name: str) -> DataFrame:
        if name == LOGINS:
            return self.logins()
        return self.spark.read.parquet(f"{self.root}/dims/sync={self._state()['sync']}/{name}")

    def new_learners(self, distinct_learners: bool = False) -> DataFrame:
        """New learners per week, from the kept first weeks; no attempt is read."""
        if not self.learner_weeks:
            raise ValueError("this store does not keep learner weeks")
        live = [f for f in self.folders() if f.store == "first_weeks"]
        return first_weeks.new_learners(self._store("first_weeks").open(live), distinct_learners)

    def bounds(self) -> DataFrame:
        """Data range and time of the last sync."""
        return (
            self.log()
            .orderBy(F.col("sync").desc())
            .limit(1)
            .select("min_updated_at", "max_updated_at", F.col("synced_at").alias("last_synced_at"))
        )

    # -- writing ------------------------------------------------------------------------------------

    def refresh(self, tables: extracts.Tables, now: dt.datetime, load: Load = extracts.attempts) -> Row:
        """One sync: replace the small tables, add the attempts updated since the last sync and the logins not stored.

        Attempts are read from the newest stored ``updated_at`` on, so the rows at that instant arrive again;
        exact duplicates are dropped. A changed record has a new ``updated_at`` and is kept besides its old
        version. The first load is stored as it is; the first sync after it drops its duplicates once, day by day, and
        every later one compares new rows only with the stored rows of the same days.
        """
        state = self.last_sync()
        latest = state["max_updated_at"] if state else None
        return self._sync(tables, now, state, lambda: load(tables, latest), exact=False)

    def absorb(self, tables: extracts.Tables, now: dt.datetime, load: Load = extracts.attempts) -> Row:
        """One sync with all the attempts of ``tables``, in any order of time, each record once."""
        return self._sync(tables, now, self.last_sync(), lambda: load(tables, None), exact=True)

    def compact(self, now: dt.datetime) -> Row:
        """A state of the same rows with one folder a day. The small tables are copied as they are."""
        state = self._state()
        sync, live = state["sync"] + 1, self.folders(state)
        merged: list[Folder] = []
        for name in sorted({f.store for f in live}):
            merged += self._store(name).merged([f for f in live if f.store == name], f"{sync}-merged", most=1, all_of_them=True)
        for name in REPLACED:
            self.dimension(name).write.mode("overwrite").parquet(f"{self.root}/dims/sync={sync}/{name}")
        return self._finish(sync, state, merged, now, added=[], bounds=(None, None), deduplicated=state["deduplicated"])

    def _sync(
        self, tables: extracts.Tables, now: dt.datetime, state: Row | None, load: Callable[[], DataFrame], exact: bool
    ) -> Row:
        sync = state["sync"] + 1 if state else 0
        live = self.folders(state) if state else []
        for name in tables:  # tables are made once and not by two threads
            tables[name]
        with scratch.scope(self.spark), ThreadPoolExecutor(SIDE_BY_SIDE) as pool:

            def start(job, *args):
                return pool.submit(copy_context().run, job, *args)

            fact = start(self._sync_attempts, sync, state, live, load, exact)
            other = [start(self._sync_logins, tables, sync, live), start(self._sync_profiles, tables, sync, live)]
            small = [start(self._write_dimension, tables, sync, name) for name in REPLACED]
            folders, added, bounds = fact.result()
            for job in other:
                folders += job.result()
            for job in small:
                job.result()
        return self._finish(sync, state, folders, now, added, bounds, state is not None or exact)

    def _write_dimension(self, tables: extracts.Tables, sync: int, name: str) -> None:
        DIMENSIONS[name](tables).write.mode("overwrite").parquet(f"{self.root}/dims/sync={sync}/{name}")

    def _sync_attempts(self, sync: int, state: Row | None, live: list[Folder], load: Callable[[], DataFrame], exact: bool):
        """The live folders of the fact after the sync, those it added, and the range of the rows it added."""
        held = [f for f in live if f.store == "attempts"]
        new = load()
        if not state:  # an empty file that holds the columns, also when there are no rows yet
            new.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/layout")
        store = self._store("attempts")
        if state:
            if not state["deduplicated"]:
                held = self._without_repeats(store, held, sync)
            new = new.select(*store.layout.names)
            days = {r[0] for r in new.select(F.to_date("updated_at")).distinct().collect()}
            new = not_stored(new, store.open([f for f in held if f.day in days]).drop("day"))
        elif exact:
            new = new.distinct()
        added, *bounds = store.add(new, str(sync))
        kept = [f for f in live if f.store == "first_weeks"]
        if self.learner_weeks:
            weeks = self._store("first_weeks")
            better = first_weeks.improvements(store.open(added), weeks.open(kept))
            kept = weeks.merged(kept + weeks.write(better, str(sync)), f"{sync}-merged", self.most_folders)
        return store.merged(held + added, f"{sync}-merged", self.most_folders) + kept, added, bounds

    def _without_repeats(self, store: Folders, held: list[Folder], sync: int) -> list[Folder]:
        """The folders with each row once. Days with repeated rows are rewritten one by one, so no more than a day is shuffled whole."""
        days = {r[0] for r in days_with_repeats(store.open(held)).collect()}
        rewritten: list[Folder] = []

        def rewrite(day: dt.date | None) -> list[Folder]:
            rows = store.open([f for f in held if f.day == day]).drop("day").distinct()
            return store.write(rows, f"{sync}-distinct-{day}")

        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            for folders in pool.map(lambda day: copy_context().run(rewrite, day), sorted(days, key=str)):
                rewritten += folders
        return [f for f in held if f.day not in days] + rewritten

    def _sync_logins(self, tables: extracts.Tables, sync: int, live: list[Folder]) -> list[Folder]:
        """The live folders of logins: days whose events are the stored ones stay, missing events are added to theirs.

        A day on which stored events are gone from the source is written anew.
        """
        held = [f for f in live if f.store == "logins"]
        store = self._store("logins")
        names = store.layout.names
        events = extracts.login_records(tables).withColumn("day", F.to_date("created_on"))
        rows = events.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), digest(names).alias("digest")).collect()
        wanted = {r["day"]: (r["rows"], r["digest"]) for r in rows}
        stored: dict[dt.date | None, tuple] = {}
        for f in held:
            n, total = stored.get(f.day, (0, 0))
            stored[f.day] = (n + f.rows, total + f.digest)
        changed = {day for day in wanted.keys() | stored.keys() if wanted.get(day) != stored.get(day)}
        fresh, known = changed - stored.keys(), changed & stored.keys()
        if fresh:
            held += store.write(of_days(events, fresh) if stored else events, str(sync))
        if known:
            old = store.open([f for f in held if f.day in known])
            counted = of_days(events, known).withColumn("n", F.lit(1)).unionByName(old.withColumn("n", F.lit(-1)))
            different = counted.groupBy(*names, "day").agg(F.sum("n").alias("n")).where("n <> 0")
            different = scratch.written(different, "login-changes")
            shrunk = {r[0] for r in different.where("n < 0").select("day").distinct().collect()}
            if shrunk:
                held = [f for f in held if f.day not in shrunk]
                held += store.write(of_days(events, shrunk), f"{sync}-again")
            if grown := known - shrunk:
                more = of_days(different, grown).withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
                held += store.write(more, f"{sync}-more")
        return store.merged(held, f"{sync}-merged", self.most_folders)

    def _sync_profiles(self, tables: extracts.Tables, sync: int, live: list[Folder]) -> list[Folder]:
        """The live folders of learner profiles, with a version for each learner whose profile changed."""
        held = [f for f in live if f.store == "profiles"]
        store = self._store("profiles")
        one = F.sort_array(F.collect_list(F.struct("school", "grade", "tenant_name")))  # an identifier has one profile, as a rule
        current = extracts.login_profiles(tables).where("learner_id IS NOT NULL").groupBy("learner_id").agg(one.alias("shown"))
        if held:
            before = newest_profiles(store.open(held)).where("shown IS NOT NULL").withColumnRenamed("shown", "before")
            both = current.join(before, "learner_id", "full_outer")
            current = both.where(~F.col("shown").eqNullSafe(F.col("before"))).drop("before")
        held = held + store.write(current.withColumn("valid_from", F.lit(sync).cast("bigint")), str(sync))
        return store.merged(held, f"{sync}-merged", self.most_folders)

    def _finish(
        self, sync: int, state: Row | None, folders: list[Folder], now: dt.datetime, added: list[Folder], bounds: tuple, deduplicated: bool
    ) -> Row:
        """Writes the manifest and then the log row, which makes the sync the newest state."""
        write_manifest(self.spark, self.root, sync, folders)
        low, high = (
            pick([v for v in (found, state[column] if state else None) if v is not None], default=None)
            for pick, found, column in ((min, bounds[0], "min_updated_at"), (max, bounds[1], "max_updated_at"))
        )
        moments = [(instant(v) if v else F.lit(None).cast("timestamp_ntz")) for v in (low, high)]
        entry = self.spark.range(1).select(
            F.lit(sync).cast("bigint").alias("sync"),
            F.lit(deduplicated).alias("deduplicated"),
            moments[0].alias("min_updated_at"),
            moments[1].alias("max_updated_at"),
            F.lit(sum(f.rows for f in added)).cast("bigint").alias("added"),
            F.lit(now).cast("timestamp").alias("synced_at"),
        )
        entry.write.mode("append").parquet(f"{self.root}/log")
        if state:
            self._remove_superseded(state, folders)
        return self._state()

    def _remove_superseded(self, before: Row, folders: list[Folder]) -> None:
        """Removes what neither the newest state, of ``folders``, nor the state ``before`` it needs."""
        old = before["sync"] - 1
        if old < 0:
            return
        remove_unused(self.spark, self.root, read_manifest(self.spark, self.root, old), self.folders(before) + folders)
        scratch.delete(self.spark, f"{self.root}/dims/sync={old}")
        scratch.delete(self.spark, f"{self.root}/manifest/sync={old}")
