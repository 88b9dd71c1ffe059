"""Structured Streaming forms: ingestion, correlation, rate guard and feedback.

Each takes a streaming DataFrame and returns a started query or a streaming
DataFrame; the batch operators hold the semantics.

What depends on the order of events waits in the RocksDB state store until the
watermark has passed it, so results are the same however files are cut into batches, in whatever
order they come, as long as no row is later than ``delay``; only rows below the watermark are
dropped.  What is newer than the watermark at a stream's end stays open; a last row with a
later time and null keys (``end_marker``) closes it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import action, ingest, reason

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
MONITORING = "MONITORING_IN_PROGRESS"
FEEDBACK_PARTS = 512


def with_state(rows: DataFrame, keys: list[str], step, schema: str, state: str, timeout: str = GroupStateTimeout.EventTimeTimeout) -> DataFrame:
    """``rows`` grouped by ``keys`` through a function whose state is kept in RocksDB."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(*keys).applyInPandasWithState(step, schema, state, "append", timeout)


def wake(state: GroupState, at_ms: int) -> None:
    """Call again once the watermark is past ``at_ms``."""
    state.setTimeoutTimestamp(max(int(at_ms) + 1, state.getCurrentWatermarkMs() + 1))


def end_marker(rows: DataFrame, time: str, after: str) -> DataFrame:
    """One row with null keys and a time ``after`` the last of ``rows``; as a stream's last file it moves the watermark past everything."""
    last = rows.agg((F.max(time) + F.expr(f"INTERVAL {after}")).alias(time))
    return last.select(*[F.col(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])


def file_stream(spark: SparkSession, schema, path: str, max_files: int = 100) -> DataFrame:
    """Files of a folder as they come; the checkpoint keeps what was read, in place of a hand-kept cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def first_of_hash(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Remembers each hash of a job; the row with the least index of the first batch that has it is the first."""
    rows = pd.concat(list(parts), ignore_index=True)
    again = pd.Series(True, index=rows.index)
    if not state.exists:
        again[rows["row_index"].idxmin()] = False  # of rows with one index the first that comes
        state.update((int(rows["row_index"].min()),))
    yield pd.DataFrame({"tenant_id": key[0], "job_id": key[1], "row_hash": key[2], "data_source_id": rows["data_source_id"], "row_index": rows["row_index"], "raw_json": rows["raw_json"], "again": again})


def stream_ingest(rows: DataFrame, out: str, checkpoint: str):
    """Write normalized rows, dead letters and counts of each batch below ``out``; each row is tagged once.

    A row is a duplicate if an earlier batch of its job holds its hash, or an earlier row of its batch.  The hashes
    seen are keyed state, so a batch costs what its own rows cost,
    however many came before.  A batch that runs again replaces its own folders.
    """
    tagged = ingest.tag_outcomes(rows, deduplicate=False)
    columns = ["tenant_id", "job_id", "row_hash", "data_source_id", "row_index", "raw_json"]
    judged = tagged.filter("outcome <> 'EMPTY_OR_INVALID_ROW'").select(*columns)
    again = with_state(judged, columns[:3], first_of_hash, "tenant_id string, job_id string, row_hash string, data_source_id string, row_index long, raw_json string, again boolean", "first long", GroupStateTimeout.NoTimeout)
    empty = tagged.filter("outcome = 'EMPTY_OR_INVALID_ROW'").select(*columns, F.lit(False).alias("again"))

    def write(batch: DataFrame, epoch: int) -> None:
        known = ingest.tag_outcomes(batch.drop("row_hash"), deduplicate=False)
        known = known.withColumn("outcome", F.when(F.col("again"), "DUPLICATE").otherwise(F.col("outcome"))).drop("again").persist()
        for name, part in (("normalized", ingest.normalized(known)), ("dead_letters", ingest.dead_letters(known)), ("counts", ingest.job_summary(known).drop("status"))):
            part.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
        known.unpersist()

    return again.unionByName(empty).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_job_summary(spark: SparkSession, out: str) -> DataFrame:
    """One row per job over all batches that ``stream_ingest`` wrote."""
    counts = ("total_rows", "valid_rows", "duplicate_rows", "error_rows")
    per_job = spark.read.parquet(f"{out}/counts").groupBy("tenant_id", "job_id").agg(*[F.sum(c).alias(c) for c in counts])
    return per_job.withColumn("status", ingest.job_status())


def stream_correlate(telemetry: DataFrame, window: int = reason.WINDOW_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Pairs of breaches of one incident at most ``window`` seconds apart, with their pattern: pressure or vibration beside temperature.

    A stream-stream join by interval, so pairs across any border are found and the state ends with the watermark.
    """
    def side(kind: str, name: str) -> DataFrame:
        found = telemetry.filter(reason.breaches(kind))
        return found.select(*[F.col(c).alias(f"{name}_{c}") for c in ("tenant_id", "incident_id", "entity_id", "seq", "ts")]).withWatermark(f"{name}_ts", delay)

    out = None
    for kind, pattern in (("pressure", reason.CASCADE), ("vib", reason.SPIKE)):
        near = F.expr(f"a_tenant_id = b_tenant_id AND a_incident_id = b_incident_id AND a_ts BETWEEN b_ts - INTERVAL {window} SECONDS AND b_ts + INTERVAL {window} SECONDS")
        pairs = side(kind, "a").join(side("temp", "b"), near)
        pairs = pairs.select(F.col("a_tenant_id").alias("tenant_id"), F.col("a_incident_id").alias("incident_id"), F.lit(pattern[0]).alias("pattern_type"),
                             F.col("a_seq").alias("seq"), F.col("b_seq").alias("temp_seq"), F.col("b_entity_id").alias("entity_id"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def stream_rate_guard(actions: DataFrame, limit: int = 5, delay: str = "10 minutes") -> DataFrame:
    """``tenant_id, entity_id, ts, n`` of each action that is the ``limit``-th or a later one of its asset's trailing hour, both ends included.

    The state of an asset is the times of the last hour and of what the watermark has not passed.
    """
    hour = HOUR_MS * 1000

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[1] is None:
            return
        times, counted = state.get if state.exists else ([], 0)
        new = [] if state.hasTimedOut else [int(t) for p in parts for t in p["micros"]]
        passed = max(state.getCurrentWatermarkMs() * 1000, counted)
        times = sorted([*times, *new])
        hit = [(key[0], key[1], t, n) for t in times if counted < t <= passed and (n := bisect_right(times, t) - bisect_left(times, t - hour)) >= limit]
        times = [t for t in times if t > passed - hour]
        if times:
            waiting = [t for t in times if t > passed]
            state.update((times, passed))
            wake(state, (waiting[0] if waiting else times[-1] + hour) // 1000)
        elif state.exists:
            state.remove()
        if hit:
            yield pd.DataFrame(hit, columns=["tenant_id", "entity_id", "micros", "n"])

    timed = actions.withWatermark("ts", delay).select("tenant_id", "entity_id", "ts", F.unix_micros("ts").alias("micros"))
    found = with_state(timed, ["tenant_id", "entity_id"], step, "tenant_id string, entity_id string, micros long, n long", "times array<long>, counted long")
    return found.select("tenant_id", "entity_id", F.timestamp_micros("micros").alias("ts"), "n")


def pack(rows: pd.DataFrame) -> bytes:
    """``rows`` as one Arrow stream, the form in which a table is kept as state."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(state: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(state).read_pandas()


def decisive(readings: pd.DataFrame) -> pd.DataFrame:
    """Of each execution the one reading that counts: the one that was told, else the first that settles, else the last that has a value."""
    waits = readings["status"] == MONITORING
    order = {"waits": waits, "blank": waits & readings["value"].isna(), "at": readings["micros"].where(~waits, -readings["micros"]), "tie": readings["value"].where(~waits, -readings["value"])}
    found = readings.assign(**order).sort_values(["told", *order], ascending=[False, *[True] * len(order)])
    return found.drop_duplicates("execution_id").drop(columns=list(order))


def stream_feedback(readings: DataFrame, delay: str = "10 minutes", patience_ms: int = 24 * HOUR_MS, parts: int = FEEDBACK_PARTS) -> DataFrame:
    """Closed-loop feedback per execution over a stream of its readings.

    Input: ``execution_id, ts, started_at, value, baseline, target, op, max_minutes``.  An execution is settled once, by
    the first reading (by its time) that resolves, deteriorates or comes after its window, or, where none does within
    ``patience_ms`` after the window, by that time (then with its last value).  Readings after that are ignored, and so
    are those without a start or a window.

    Executions are dealt by hash to ``parts`` keys.  A key's state is a table with one reading of each of its open
    executions, and a call into Python serves them all, so calls do not grow with the executions.  A checkpoint holds for the ``parts`` it was begun with.
    """
    elapsed = (F.unix_micros("ts") - F.unix_micros("started_at")) / F.lit(60e6)
    status = action.feedback_status(F.col("value"), F.col("baseline"), F.col("target"), F.col("op"), elapsed, F.col("max_minutes"))
    close = (F.unix_micros("started_at") / 1000 + F.col("max_minutes") * 60_000).cast("long") + patience_ms
    # one condition on ts, so that it stays above the watermark, which the end marker has to move
    counts = F.coalesce(F.col("execution_id").isNotNull() & (F.unix_micros("ts") <= close * 1000), F.lit(False))
    judged = readings.withWatermark("ts", delay).filter(counts).select(
        F.pmod(F.xxhash64("execution_id"), F.lit(parts)).alias("part"), "ts", "execution_id", F.unix_micros("ts").alias("micros"), F.col("value").cast("double").alias("value"), elapsed.alias("elapsed_minutes"),
        status.alias("status"), close.alias("close_ms"), F.col("max_minutes").cast("double").alias("max_minutes"), F.lit(False).alias("told"))

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        held = [unpack(state.get[0])] if state.exists else []
        held += [] if state.hasTimedOut else [decisive(c.drop(columns=["part", "ts"])) for c in chunks]
        rows = decisive(pd.concat(held, ignore_index=True))
        waits, over = rows["status"] == MONITORING, rows["close_ms"] <= passed
        settled = ~waits & (rows["micros"] <= passed * 1000)
        now = rows[~rows["told"] & (settled | over)]
        late = now["status"] == MONITORING
        rest = rows.assign(told=rows["told"] | settled)[~over]
        if len(rest):
            state.update((pack(rest),))
            due = rest["close_ms"].where(rest["told"] | waits[rest.index], np.minimum(rest["close_ms"], rest["micros"] // 1000))
            wake(state, due.min())
        elif state.exists:
            state.remove()
        if len(now):
            yield now.assign(status=now["status"].where(~late, "TIMEOUT_FAILED"), elapsed_minutes=now["elapsed_minutes"].where(~late, now["max_minutes"]))[["execution_id", "status", "value", "elapsed_minutes"]]

    return with_state(judged, ["part"], step, "execution_id string, status string, value double, elapsed_minutes double", "open binary")


def stream_patterns(telemetry: DataFrame, window: int = reason.WINDOW_SECONDS, delay: str = "10 minutes", quiet_ms: int = 24 * HOUR_MS) -> DataFrame:
    """All patterns of each incident, drift included, as ``reason.correlate`` gives them, once the incident has been quiet for ``quiet_ms`` of event time.

    An incident's readings are one session, whose state is the sums of ``first_and_last_breach``; after a longer silence its next reading begins another.
    """
    timed = telemetry.withWatermark("ts", delay)
    session = F.session_window("ts", F.lit(f"{quiet_ms} milliseconds"))
    timed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return reason.patterns(reason.first_and_last_breach(timed, session), window)
