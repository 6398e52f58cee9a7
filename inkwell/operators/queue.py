"""Work queues and leases as pure functions of snapshots: the next state comes out as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worker_status(now: Column, seen: str = "last_seen_at", job: str = "current_job_id", error: str = "last_error", minutes: int = 3) -> Column:
    """offline after ``minutes`` without a heartbeat, else error, busy or online."""
    late = F.col(seen) <= now - F.make_dt_interval(mins=F.lit(minutes))
    return F.when(late, "offline").when(F.col(error).isNotNull(), "error").when(F.col(job).isNotNull(), "busy").otherwise("online")


def disposition(retryable: Column, attempts: Column, most: Column) -> Column:
    return F.when(~retryable, "permanent").when(attempts >= most, "exhausted").otherwise("retry")


def normalized(jobs: DataFrame) -> DataFrame:
    """A waiting job without attempts left has failed; only a running job holds a claim and a lease."""
    spent = (F.col("status") == "waiting") & (F.col("attempts") >= F.col("max_attempts"))
    status = F.when(spent, "failed").otherwise(F.col("status"))
    running = status == "running"
    return jobs.withColumns({"status": status, "claimed_by": F.when(running, F.col("claimed_by")), "lease_expires_at": F.when(running, F.col("lease_expires_at"))})


def reset_stale(jobs: DataFrame, now: Column, minutes: int = 8) -> DataFrame:
    """Running jobs whose lease ended ``minutes`` ago wait again, or have failed where no attempt is left."""
    stale = (F.col("status") == "running") & (F.col("lease_expires_at") <= now - F.make_dt_interval(mins=F.lit(minutes)))
    again = F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("waiting")
    return normalized(jobs.withColumn("status", F.when(stale, again).otherwise(F.col("status"))))


def assign(jobs: DataFrame, workers: DataFrame, order: list[Column]) -> DataFrame:
    """``jobs`` with ``worker_id``: the n-th job of the queue goes to the n-th idle worker, so none goes out twice.

    The queue is cut to the number of workers first: that many jobs at most are ranked in one place.
    """
    n = workers.count()
    head = jobs.orderBy(*order).limit(n)
    ranked = head.withColumn("_r", F.row_number().over(Window.orderBy(*order)))
    idle = workers.select(F.col("id").alias("worker_id"), F.row_number().over(Window.orderBy("id")).alias("_r"))
    return ranked.join(idle, "_r").drop("_r")


def claims(jobs: DataFrame, workers: DataFrame, now: Column, lease_seconds: int = 900) -> DataFrame:
    """(action, job_id, worker_id, attempts, previous, lease_expires_at): what one claim of each of ``workers`` (id) does, in order of their ids.

    First jobs without an attempt left, that wait or whose lease has ended, are ``exhausted``. A worker that holds a lease gets its oldest job back
    (``resumed``), with a new lease and no new attempt. The others get the oldest jobs that wait (``taken``) or whose lease has ended (``stolen``,
    where ``previous`` had it before), with one attempt more. ``lease_seconds`` is held to 60..86400.
    """
    until = now + F.make_dt_interval(secs=F.lit(max(60, min(86_400, lease_seconds))).cast("decimal(18,6)"))
    waits, runs = F.col("status") == "waiting", (F.col("status") == "running") & F.col("lease_expires_at").isNotNull()
    ended, spent = runs & (F.col("lease_expires_at") <= now), F.col("attempts") >= F.col("max_attempts")
    shape = lambda df, action, worker, attempts, previous, lease: df.select(action.alias("action"), F.col("id").alias("job_id"), worker.alias("worker_id"), attempts.alias("attempts"), previous.alias("previous"), lease.alias("lease_expires_at"))
    nobody, attempts = F.lit(None).cast("string"), F.col("attempts").cast("long")
    exhausted = shape(jobs.where(spent & (waits | ended)), F.lit("exhausted"), nobody, attempts, F.col("claimed_by"), F.lit(None).cast("timestamp_ntz"))

    first = Window.partitionBy("claimed_by").orderBy(F.col("claimed_at").asc_nulls_first(), "id")
    held = jobs.where(runs & (F.col("lease_expires_at") > now)).join(workers.select(F.col("id").alias("claimed_by")).distinct(), "claimed_by", "left_semi")
    own = held.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    resumed = shape(own, F.lit("resumed"), F.col("claimed_by"), attempts, F.col("claimed_by"), until)

    idle = workers.join(own.select(F.col("claimed_by").alias("id")), "id", "left_anti")
    given = assign(jobs.where(~spent & (waits | ended)), idle, [F.col("created_at"), F.col("id")])
    stolen = F.col("claimed_by").isNotNull() & (F.col("claimed_by") != F.col("worker_id"))
    taken = shape(given, F.when(stolen, "stolen").otherwise("taken"), F.col("worker_id"), attempts + 1, F.col("claimed_by"), until)
    return exhausted.unionByName(resumed).unionByName(taken)


def claim_runs(attempts: DataFrame, lease_seconds: int = 600) -> DataFrame:
    """attempts (key, at, outcome) in order of ``at``: which of them get the run of their key.

    The first does; after it one does if the one before failed or was skipped, or if its lease ended. A
    completed run isn't claimed again. ``lease_seconds`` is held to 60..3600.
    """
    lease = F.make_dt_interval(secs=F.lit(max(60, min(3600, lease_seconds))).cast("decimal(18,6)"))
    order = Window.partitionBy("key").orderBy("at", "id")
    before, when = F.lag("outcome").over(order), F.lag("at").over(order)
    done = F.max(F.when(F.col("outcome") == "completed", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    free = before.isNull() | before.isin("failed", "skipped") | (when + lease <= F.col("at"))
    return attempts.withColumn("claimed", F.when(done == 1, False).otherwise(free))


def compare_and_set(rows: DataFrame, changes: DataFrame, key: str, version: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new rows, conflicts): changes (key, version, columns) apply where the version is still the same."""
    new = changes.select(key, F.col(version).alias("_v"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    met = rows.join(new, key, "left").withColumn("_ok", F.coalesce(F.col("_hit") & (F.col(version) == F.col("_v")), F.lit(False)))
    done = met.select(*[F.when(F.col("_ok"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.when(F.col("_ok"), F.col(c) + 1).otherwise(F.col(c)).alias(c) if c == version else F.col(c) for c in rows.columns])
    return done, met.where(F.col("_hit") & ~F.col("_ok")).select(key)


def consume_approvals(approvals: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request, operation, at, payload) with ``outcome``: the first request of an operation, in order of (at, request), that comes while its approval
    (operation, created, expires, payload; the newest of an operation counts) holds and has exactly the values approved is ``consumed``; a later one that would have been is
    ``used``; one with other values is a ``mismatch``, one too late ``expired``, one without an approval ``unknown``. A payload is a map; the approval's may have more in it."""
    newest = approvals.withColumn("_r", F.row_number().over(Window.partitionBy("operation").orderBy(F.desc("created")))).where("_r = 1")
    met = requests.join(newest.select("operation", "created", "expires", F.col("payload").alias("_approved")), "operation", "left")
    same = F.forall(F.map_entries("payload"), lambda e: F.element_at("_approved", e["key"]).eqNullSafe(e["value"]) & F.map_contains_key("_approved", e["key"]))
    why = F.when(F.col("created").isNull() | (F.col("at") < F.col("created")), "unknown").when(F.col("at") >= F.col("expires"), "expired").when(~same, "mismatch")
    marked = met.withColumn("_why", why)
    first = F.row_number().over(Window.partitionBy("operation", "_why").orderBy("at", "request"))
    return marked.withColumn("outcome", F.coalesce("_why", F.when(first == 1, "consumed").otherwise("used"))).select("request", "operation", "outcome")


def next_steps(candidates: DataFrame, existing: DataFrame, key: str, steps: tuple[str, ...]) -> DataFrame:
    """(key, step, place, status, waits_for): the steps of each candidate that it has no job for (``existing``: key, step), in order. Only the first is queued; the
    n-th waits for the step before the n-th of all."""
    has = existing.groupBy(key).agg(F.collect_set("step").alias("_has"))  # so many as there are steps
    left = F.filter(F.array(*map(F.lit, steps)), lambda s: ~F.array_contains(F.coalesce("_has", F.array().cast("array<string>")), s))
    rows = candidates.select(key).join(has, key, "left").select(key, F.posexplode(left).alias("_i", "step"))
    waits = F.when(F.col("_i") > 0, F.element_at(F.array(*map(F.lit, steps)), F.col("_i")))
    return rows.select(key, "step", (F.col("_i") + 1).alias("place"), F.when(F.col("_i") == 0, "queued").otherwise("on_hold").alias("status"), waits.alias("waits_for"))
