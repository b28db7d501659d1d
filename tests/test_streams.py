"""Streams with state against the batch functions, with rows that arrive out of order."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from caseloom.operators import ledger, temporal
from caseloom.streaming import state

START = datetime(2024, 1, 1)


def run(spark, tmp_path, parts, schema, job):
    """All rows that job puts out for parts that arrive one after another."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = job(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        out.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()


def test_locks_equal_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randint(1, 4), i, START + timedelta(minutes=i // 2), rng.random() < 0.15) for i in range(600)]
    rows += [(None, 1000, START, False), (1, 1001, None, False), (1, 1002, START, None)]
    last = START + timedelta(hours=8)
    # Rows come up to half an hour too late, and equal times in any order.
    keyed = sorted(rows, key=lambda r: (r[2] or START) + timedelta(minutes=rng.randint(0, 29)))
    parts = [keyed[:200], keyed[200:400], [*keyed[400:], (9, 2000, last, True)]]
    schema = "user_id long, login_id long, ts timestamp_ntz, success boolean"
    got = run(spark, tmp_path, parts, schema, state.locks)
    want = temporal.lockouts(spark.createDataFrame([r for r in rows if None not in r], schema)).collect()
    ends = [(r["user_id"], r["locked_until"], "released") for r in want]
    assert len(want) > 20
    assert sorted(map(tuple, got)) == sorted([(r["user_id"], r["ts"], "locked") for r in want] + ends)


def test_ledgers_equal_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randint(1, 5), START + timedelta(hours=i // 3), i, f"d{i}", rng.choice(["add", None])) for i in range(300)]
    keyed = sorted(rows, key=lambda r: r[1] + timedelta(hours=rng.randint(0, 20)))
    parts = [keyed[:90], keyed[90:200], [*keyed[200:], (77, START + timedelta(days=30), 999, "end", None)]]
    schema = "case_id long, ts timestamp_ntz, block_id long, data_hash string, action string"
    got = sorted(map(tuple, run(spark, tmp_path, parts, schema, state.ledgers)), key=lambda r: r[:2])
    blocks, turn = [], {}
    for case, ts, _, data, action in sorted(rows, key=lambda r: (r[1], r[2])):
        turn[case] = turn.get(case, -1) + 1
        blocks.append((case, turn[case], ts.strftime("%Y-%m-%d %H:%M:%S"), data, action))
    want = ledger.chained(spark.createDataFrame(blocks, "case_id long, idx int, ts string, data_hash string, action string"), "case_id").collect()
    assert got == sorted(map(tuple, want), key=lambda r: r[:2])
    frame = spark.createDataFrame(got, "case_id long, idx int, ts string, data_hash string, action string, previous_hash string, hash string")
    assert ledger.verified(frame, "case_id").where(~F.col("intact")).count() == 0


def test_stream_without_rows(spark):
    from caseloom.plans.stream_queries import streamed

    empty = spark.createDataFrame([], "user_id long, login_id long, ts timestamp_ntz, success boolean")
    assert streamed(empty, "ts", state.locks).count() == 0


def test_keys_share_groups(spark, tmp_path):
    """Very many keys are dealt into a fixed number of groups, each with the state of all its keys."""
    schema = "user_id long, login_id long, ts timestamp_ntz, success boolean"
    spark.range(3 * state.BUCKETS).selectExpr("id user_id", "id login_id", "timestamp_ntz'2024-01-01 00:00:00' ts", "false success").coalesce(1).write.parquet(f"{tmp_path}/in")
    query = state.locks(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= state.BUCKETS
