"""Event-time state of a stream against the batch form: shuffled arrival, late rows, state that goes."""

import datetime as dt
import random

from corvex.streaming import event_state, limits

EPOCH = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, name, batches, schema, build):
    """The rows of a stream that gets the batches one after the other, then two far later rows that push the watermark."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n:03d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.table(name), q.recentProgress


def shuffled(rows, delay_s, rng, size):
    """rows (by their last column, a time) in an order of arrival where none comes more than delay_s behind a later one."""
    arrive = sorted(rows, key=lambda r: r[-1].timestamp() + rng.random() * delay_s * 0.9)
    return [arrive[i : i + size] for i in range(0, len(arrive), size)]


def test_rate_limits_do_not_depend_on_arrival(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, f"k{rng.randrange(4)}", rng.choice(["reasoning", "fast", "x"]), EPOCH + dt.timedelta(seconds=rng.randrange(900))) for i in range(500)]
    schema = "request_id long, key string, profile string, ts timestamp"
    want = {(r.request_id, r.key, r.allowed, r.remaining, r.retry_after) for r in limits.rate_limit(spark.createDataFrame(rows, schema), 5).collect()}
    ends = [[(9000 + n, "end", "x", EPOCH + dt.timedelta(days=9 + n))] for n in range(2)]
    got, _ = run(spark, tmp_path, "limited_in_order", shuffled(rows, 300, rng, 100) + ends, schema, lambda s: event_state.rate_limit_stream(s, 5, "5 minutes"))
    assert {tuple(r) for r in got.collect() if r.key != "end"} == want and len({r[2] for r in want}) == 2


def test_claims_do_not_depend_on_arrival_and_late_rows_get_none(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"k{rng.randrange(5)}", rng.choice("ab"), rng.choice(["failed", "in_progress", "completed"]), EPOCH + dt.timedelta(minutes=rng.randrange(4000))) for i in range(200)]
    schema = "request_id long, key string, request_hash string, outcome string, ts timestamp"
    want = {(r.request_id, r.result) for r in limits.idempotency(spark.createDataFrame(rows, schema)).collect()}
    late = [(7000, "k0", "a", "completed", EPOCH)]
    ends = [[(9000, "end", "a", "failed", EPOCH + dt.timedelta(days=30))], [*late, (9001, "end", "a", "failed", EPOCH + dt.timedelta(days=60))], [(9002, "end", "a", "failed", EPOCH + dt.timedelta(days=90))]]
    got, progress = run(spark, tmp_path, "claimed_in_order", shuffled(rows, 7200, rng, 50) + ends, schema, lambda s: event_state.idempotency_stream(s, "2 hours"))
    assert {(r.request_id, r.result) for r in got.collect() if r.key != "end"} == want and len({r[1] for r in want}) == 4
