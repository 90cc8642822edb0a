"""The job state machine as a keyed stateful stream, and the same rules over a finished table.

Events (job_id, ts, kind, stage, percent, error): submit, start, progress, cancel, finish, fail. Queued -> Running -> Done, Failed or
Cancelled; a finished job changes no more. Progress never falls and stays at 99 until Done."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

QUEUED, RUNNING, DONE, FAILED, CANCELLED = "Queued", "Running", "Done", "Failed", "Cancelled"
FINISHED = (DONE, FAILED, CANCELLED)
STATE = "status string, progress int, stage string, error string, cancel boolean, created timestamp"
OUT = "job_id string, status string, progress int, stage string, error string, created_at timestamp"


def advance(state: tuple | None, kind: str, ts, stage, percent, error) -> tuple | None:
    """The next state (status, progress, stage, error, cancel, created); events before a submit are ignored, a second submit too."""
    if state is None:
        return (QUEUED, 0, "Queued", None, False, ts) if kind == "submit" else None
    status, progress, at, failed, cancel, created = state
    if status in FINISHED or kind == "submit":
        return state
    if kind == "cancel":
        return (CANCELLED, progress, at, failed, True, created) if status == QUEUED else (status, progress, "Cancelling", failed, True, created)
    if kind == "start" and status == QUEUED:
        return (RUNNING, progress, "Starting", failed, cancel, created)
    if status != RUNNING:
        return state
    if kind == "progress":
        # A running job that is to stop does so at its next report.
        return (CANCELLED, progress, at, failed, True, created) if cancel else (status, max(progress, min(int(percent), 99)), stage, failed, cancel, created)
    if kind == "finish":
        return (DONE, 100, "Done", failed, cancel, created)
    if kind == "fail":
        return (CANCELLED, progress, at, failed, True, created) if cancel else (FAILED, progress, at, (error or "error")[:500], cancel, created)
    return state


def run_stream(events: DataFrame) -> DataFrame:
    """The state of each job that a micro-batch touches; a batch's events are applied in order of time, so that one batch or many end alike."""

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["ts", "ord"], kind="stable")
        now = state.get if state.exists else None
        for r in rows.itertuples():
            now = advance(now, r.kind, r.ts, r.stage, 0 if pd.isna(r.percent) else r.percent, r.error)
        if now is not None:
            state.update(now)
            yield pd.DataFrame([(key[0], *now[:4], now[5])], columns=["job_id", "status", "progress", "stage", "error", "created_at"])

    return events.groupBy("job_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def final_state(events: DataFrame) -> DataFrame:
    """The same over a finished table: each job's events folded in order, in the JVM. One job's events are bounded by its reports."""
    items = F.array_sort(F.collect_list(F.struct("ts", "ord", "kind", F.coalesce("stage", F.lit("")).alias("stage"), F.coalesce("percent", F.lit(0)).cast("int").alias("percent"), F.coalesce("error", F.lit("")).alias("error"))))
    pick = lambda cond, a, b: F.when(cond, a).otherwise(b)

    def step(s, e):
        k = e["kind"]
        fresh = s["status"].isNull() & (k == "submit")
        live = s["status"].isin(QUEUED, RUNNING)
        running = s["status"] == RUNNING
        halted = (live & (k == "cancel") & (s["status"] == QUEUED)) | (running & s["cancel"] & k.isin("progress", "fail"))
        report = running & ~s["cancel"] & (k == "progress")
        status = F.when(fresh, QUEUED).when(halted, CANCELLED).when((s["status"] == QUEUED) & (k == "start"), RUNNING).when(running & (k == "finish"), DONE).when(running & (k == "fail"), FAILED).otherwise(s["status"])
        progress = F.when(report, F.greatest(s["progress"], F.least(e["percent"], F.lit(99)))).when(running & (k == "finish"), F.lit(100)).otherwise(s["progress"])
        stage = F.when(fresh, "Queued").when(report, e["stage"]).when((s["status"] == QUEUED) & (k == "start"), "Starting").when(running & (k == "cancel"), "Cancelling").when(running & (k == "finish"), "Done").otherwise(s["stage"])
        error = pick(running & ~s["cancel"] & (k == "fail"), pick(e["error"] == "", F.lit("error"), F.left(e["error"], F.lit(500))), s["error"])
        return F.struct(status.alias("status"), progress.alias("progress"), stage.alias("stage"), error.alias("error"), (s["cancel"] | (live & (k == "cancel"))).alias("cancel"), pick(fresh, e["ts"], s["created"]).alias("created"))

    none = lambda t: F.lit(None).cast(t)
    start = F.struct(none("string").alias("status"), F.lit(0).alias("progress"), F.lit("").alias("stage"), none("string").alias("error"), F.lit(False).alias("cancel"), none("timestamp").alias("created"))
    out = events.groupBy("job_id").agg(F.aggregate(items, start, step).alias("s")).where(F.col("s.status").isNotNull())
    return out.select("job_id", "s.status", "s.progress", "s.stage", "s.error", F.col("s.created").alias("created_at"))


def progress(events: DataFrame) -> DataFrame:
    """The reports that count, each with the job's progress by then: the largest so far, at most 99. A report counts while its job is running and nobody has asked it to stop."""
    before = Window.partitionBy("job_id").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, -1)
    had = lambda c, kind: F.coalesce(F.max(F.when(c, F.col("kind") == kind)).over(before), F.lit(False))
    # A start counts once the job is there; nothing counts before that, nor after what ends or cancels it.
    e = events.withColumn("_in", had(F.lit(True), "submit")).withColumn("_up", F.col("_in") & (F.col("kind") == "start")).withColumn("_off", F.col("_in") & F.col("kind").isin("finish", "fail", "cancel"))
    stop = F.col("kind") == "cancel"
    e = e.withColumn("_run", F.coalesce(F.max("_up").over(before), F.lit(False))).withColumn("_end", F.coalesce(F.max(F.when(F.col("_run") | stop, F.col("_off"))).over(before), F.lit(False)))
    live = e.where((F.col("kind") == "progress") & F.col("_run") & ~F.col("_end"))
    w = Window.partitionBy("job_id").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return live.withColumn("progress", F.least(F.lit(99), F.max("percent").over(w))).drop("_in", "_up", "_off", "_run", "_end")


def admit(jobs: DataFrame, limit: int = 2) -> DataFrame:
    """Queued jobs that may start now, oldest first: as many as are missing to `limit` running ones."""
    running = jobs.agg(F.count_if(F.col("status") == RUNNING).alias("running"))
    queued = jobs.where(F.col("status") == QUEUED).orderBy("created_at", "job_id").limit(max(1, limit))
    place = F.row_number().over(Window.orderBy("created_at", "job_id"))
    # At most `limit` rows are ranked.
    return queued.withColumn("place", place).crossJoin(running).where(F.col("place") + F.col("running") <= max(1, limit)).drop("place", "running")


# The share of a job's progress that each stage covers.
BANDS = {"Extracting": (0, 5), "Translating": (6, 60), "Assembling": (60, 65), "Verifying": (65, 82), "Writing": (83, 97)}


def stage_percent(stage: Column, done: Column, total: Column) -> Column:
    """The progress of a job of whose stage `done` of `total` steps are made."""
    share = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(F.lit(1.0))
    out = F.lit(None).cast("int")
    for name, (lo, hi) in BANDS.items():
        out = F.when(stage == name, F.floor(F.lit(lo) + (hi - lo) * share).cast("int")).otherwise(out)
    return out


def lookup(jobs: DataFrame, job_id: str) -> DataFrame:
    """One job by its id: a point filter; no rows where there is none."""
    return jobs.where(F.col("job_id") == job_id)


def known_fields(raw: Column, names: tuple[str, ...]) -> Column:
    """A map without the keys that a job does not have and without empty values."""
    return F.map_filter(raw, lambda k, v: k.isin(*names) & v.isNotNull() & (v != ""))


def save_state(root: str):
    """A foreachBatch function that keeps a job table under `root`: each micro-batch's states replace those of the same jobs, as a new version that readers meet whole."""
    from quillon.operators.memory import merge_cache
    from quillon.sources import readers

    def keep(batch: DataFrame, batch_id: int) -> None:
        old = readers.current_table(batch.sparkSession, root)
        readers.swap_table(batch if old is None else merge_cache(old, batch, ["job_id"]), root, f"{batch_id}-{uuid.uuid4().hex}")

    return keep


def recover(jobs: DataFrame) -> DataFrame:
    """After a restart, jobs that had not ended have failed."""
    open_ = ~F.col("status").isin(*FINISHED)
    return jobs.withColumn("error", F.when(open_, "interrupted by a restart").otherwise(F.col("error"))).withColumn("status", F.when(open_, FAILED).otherwise(F.col("status")))


def counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == RUNNING).alias("running"), F.count_if(F.col("status") == QUEUED).alias("queued"))


def recent(jobs: DataFrame, status: str | None = None) -> DataFrame:
    return (jobs.where(F.col("status") == status) if status else jobs).orderBy(F.desc("created_at"), "job_id")


def dedup(submissions: DataFrame) -> DataFrame:
    """The first submission of each id."""
    return submissions.groupBy("job_id").agg(F.min_by(F.struct(*[c for c in submissions.columns if c != "job_id"]), F.struct("ts", "ord")).alias("_s")).select("job_id", "_s.*")


def clashes(submissions: DataFrame) -> DataFrame:
    """Ids submitted again with another file."""
    return submissions.groupBy("job_id").agg(F.count_distinct("input_path").alias("files")).where("files > 1")


def status_view(jobs: DataFrame) -> DataFrame:
    """Jobs under the names of the service's answers."""
    camel = lambda c: c.split("_")[0] + "".join(x.title() for x in c.split("_")[1:])
    return jobs.select(*[F.col(c).alias(camel(c)) for c in jobs.columns])
