"""Streams give the same rows however their files are cut and ordered."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from opsgraph.operators import reason
from opsgraph.streaming import streams
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1, 12)
numbers = itertools.count()


def at(minute):
    return T0 + timedelta(minutes=minute)


def land(spark, tmp_path, files, schema, after="9 HOURS"):
    """Each list of rows becomes one file; the end marker comes last."""
    path = f"{tmp_path}/in{next(numbers)}"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    every = spark.read.parquet(path)
    if after:
        streams.end_marker(every, "ts", after).write.mode("append").parquet(path)
    return path, every.schema


def drain(df, tmp_path):
    root = f"{tmp_path}/out{next(numbers)}"
    df.writeStream.format("parquet").option("path", root).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(root).collect()


ACTIONS = [[0, 10, 20], [200], [30, 40, 40]]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
@pytest.mark.parametrize("per_batch", [1, 100])
def test_rate_guard_by_event_time(spark, tmp_path, order, per_batch):
    schema = "tenant_id string, entity_id string, ts timestamp"
    path, shape = land(spark, tmp_path, [[("t", "a", at(m)) for m in ACTIONS[k]] for k in order], schema)
    got = drain(streams.stream_rate_guard(streams.file_stream(spark, shape, path, per_batch), 3, "6 hours"), tmp_path)
    times = sorted(m for f in ACTIONS for m in f)
    want = sorted((at(m), sum(m - 60 <= x <= m for x in times)) for m in times)
    assert sorted((r["ts"], r["n"]) for r in got) == [w for w in want if w[1] >= 3]


@pytest.mark.parametrize("per_batch, turn", [(1, 1), (100, 1), (1, -1)])
def test_feedback_by_event_time(spark, tmp_path, per_batch, turn):
    schema = "execution_id string, ts timestamp, started_at timestamp, value double, baseline double, target double, op string, max_minutes double"
    row = lambda e, m, v: (e, at(m), at(0), v, 45.0, 30.0, "<=", 60.0)
    files = [[row("late", 90, 40.0), row("ok", 20, 29.0)], [row("ok", 10, 50.0), row("open", 5, 41.0)], [row("open", 50, 39.0), row("never", 70, 29.0)]][::turn]
    path, shape = land(spark, tmp_path, files, schema, "40 HOURS")
    got = drain(streams.stream_feedback(streams.file_stream(spark, shape, path, per_batch), "6 hours"), tmp_path)
    assert sorted(tuple(r) for r in got) == [("late", "TIMEOUT_FAILED", 40.0, 90.0), ("never", "RESOLVED_HEALTHY", 29.0, 70.0), ("ok", "DETERIORATING", 50.0, 10.0), ("open", "TIMEOUT_FAILED", 39.0, 60.0)]


FEEDBACK = "execution_id string, ts timestamp, started_at timestamp, value double, baseline double, target double, op string, max_minutes double"


@pytest.mark.parametrize("per_batch, parts", [(1, 3), (100, 3), (1, 512)])
def test_feedback_equals_its_definition(spark, tmp_path, per_batch, parts):
    """Ties, nulls, readings after the end and executions without a start or window, in random files."""
    rng = random.Random(per_batch * parts)
    ends = {f"e{k}": (at(rng.randrange(600)), rng.choice(["<", ">=", "?"]), rng.choice([30.0, 90.0])) for k in range(60)}
    readings = [(e, t0 + timedelta(minutes=rng.randrange(-5, 1700, 5)), t0, rng.choice([None, 35.0, 40.0, 44.9, 45.1, 45.5, 60.0, 29.0]), 45.0, 30.0 if op == "<" else 50.0, op, most)
                for e, (t0, op, most) in ends.items() for _ in range(rng.randrange(1, 9))]
    odd = [("none", at(5), None, 29.0, 45.0, 30.0, "<=", 60.0), ("none", at(5), at(0), 29.0, 45.0, 30.0, "<=", None), (None, at(5), at(0), 29.0, 45.0, 30.0, "<=", 60.0)]

    def judged(r):
        _, ts, t0, v, base, target, op, most = r
        if v is not None and op == "<" and (v < target or v > base + 1):
            return "RESOLVED_HEALTHY" if v < target else "DETERIORATING"
        if v is not None and op == ">=" and (v >= target or v < base - 0.2):
            return "RESOLVED_HEALTHY" if v >= target else "DETERIORATING"
        return "TIMEOUT_FAILED" if ts > t0 + timedelta(minutes=most) else None

    want = []
    for e, (t0, _, most) in ends.items():
        mine = [r for r in readings if r[0] == e and r[1] <= t0 + timedelta(minutes=most, hours=24)]
        settle = sorted((r[1], r[3] is None, r[3] or 0.0, judged(r)) for r in mine if judged(r))
        if settle:
            ts, blank, v, status = settle[0]
            want.append((e, status, None if blank else v, (ts - t0) / timedelta(minutes=1)))
        elif mine:
            want.append((e, "TIMEOUT_FAILED", max([(r[1], r[3]) for r in mine if r[3] is not None], default=(0, None))[1], most))
    rows = [*readings, *odd]
    rng.shuffle(rows)
    path, shape = land(spark, tmp_path, [rows[k::5] for k in range(5)], FEEDBACK, "60 HOURS")
    got = drain(streams.stream_feedback(streams.file_stream(spark, shape, path, per_batch), "48 hours", parts=parts), tmp_path)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len({w[1] for w in want}) == 3


def test_feedback_is_told_early_and_once(spark, tmp_path):
    """A settled execution is told when the watermark passes its reading, long before its end; a reading after its end tells nothing again."""
    row = lambda e, m, v: (e, at(m), at(0), v, 45.0, 30.0, "<=", 60.0)
    path, shape = land(spark, tmp_path, [[row("a", 10, 29.0), row("b", 20, 40.0)], [row("b", 30, None)], [row("z", 200, 40.0)]], FEEDBACK, None)
    run = lambda: streams.stream_feedback(streams.file_stream(spark, shape, path, 1), "1 hour", parts=1).writeStream.format("parquet").option("path", f"{tmp_path}/told").option("checkpointLocation", f"{tmp_path}/told-state").trigger(availableNow=True).start().awaitTermination()
    told = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/told").collect())
    run()
    assert told() == [("a", "RESOLVED_HEALTHY", 29.0, 10.0)]
    for rows in ([row("a", 50 * 60, 60.0)], [row("a", 51 * 60, 60.0), row("b", 51 * 60, 29.0)], [row("z", 90 * 60, 29.0)]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
        run()
    assert told() == [("a", "RESOLVED_HEALTHY", 29.0, 10.0), ("b", "TIMEOUT_FAILED", 40.0, 60.0), ("z", "TIMEOUT_FAILED", 40.0, 200.0)]


@pytest.mark.parametrize("per_batch", [1, 100])
def test_patterns_equal_the_batch(spark, tmp_path, per_batch):
    rng = random.Random(3)
    metrics = ["Spindle Temp", "coolant_pressure", "vibration_rms", "rpm"]
    rows = [("t", f"i{k % 25}", f"A{rng.randrange(4)}", rng.choice(metrics), rng.choice([None, 10.0, 50.0, 60.5, 39.0]), rng.choice([None, 0.0, 40.0, 40.0]), at(rng.randrange(300)), k) for k in range(400)]
    schema = "tenant_id string, incident_id string, entity_id string, metric string, value double, threshold double, ts timestamp, seq long"
    path, shape = land(spark, tmp_path, [rows[k::4] for k in range(4)], schema, "40 HOURS")
    got = drain(streams.stream_patterns(streams.file_stream(spark, shape, path, per_batch), 900, "12 hours"), tmp_path)
    want = reason.correlate(spark.createDataFrame(rows, schema), 900).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r["pattern_type"] for r in want} >= {"PROGRESSIVE_DRIFT", "CROSS_SYSTEM_CASCADE"}


def test_ingest_remembers_over_restarts(spark, tmp_path):
    """Hashes are kept as state: a second run over new files knows those of the first."""
    schema = "tenant_id string, data_source_id string, job_id string, row_index long, raw_json string"
    row = lambda i, x, job="j": ("t", "s", job, i, x)
    path, out = f"{tmp_path}/rows", f"{tmp_path}/ingested"
    first = [row(1, '{"a":1}'), row(2, '{"a":1}'), row(3, "{}"), row(4, '{"__proto__x":1}'), row(5, '{"a":1}', "k")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(path)
    run = lambda: streams.stream_ingest(streams.file_stream(spark, schema, path, 1), out, f"{tmp_path}/state").awaitTermination()
    run()
    for more in ([row(6, '{"a":1}'), row(7, '{"b":2}'), row(8, '{"b":2}')], [row(9, '{"b":2}'), row(10, None), row(7, '{"c":3}'), row(7, '{"c":3}')]):
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(path)
    run()
    got = {r["job_id"]: (r["total_rows"], r["valid_rows"], r["duplicate_rows"], r["error_rows"]) for r in streams.stream_job_summary(spark, out).collect()}
    assert got == {"j": (11, 3, 5, 3), "k": (1, 1, 0, 0)}
    kept = spark.read.parquet(f"{out}/normalized").select(F.col("row_index")).collect()
    assert sorted(r[0] for r in kept) == [1, 5, 7, 7]
