"""Streams with state over the driver's tables, with SQL that gives what they must have put out when the last rows have come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.graph import shared_path
from caseloom.plans.record_queries import _CHAIN
from caseloom.registry import load, query
from caseloom.streaming import state as S


def streamed(rows: DataFrame, ts: str, job: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """What job puts out for a stream of all the rows with a time, which arrive in parts by time; each part is a trigger, and state goes from one to the next."""
    spark = rows.sparkSession
    source, sink, log = (shared_path(spark, f"stream_{n}") for n in ("in", "out", "log"))
    at = F.col(ts).cast("timestamp").cast("double")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    if low is None:
        rows.limit(0).write.parquet(source)
    done = None
    for k in range(parts if low is not None else 1):
        if low is not None:
            part = F.least(F.floor((at - low) / ((high - low) / parts or 1)), F.lit(parts - 1))
            rows.where(part == k).write.mode("append").parquet(source)
        done = job(spark.readStream.schema(rows.schema).parquet(source))
        done.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).parquet(sink)


@query("""WITH l AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS ok FROM events), r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
  s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM r WHERE NOT ok), k AS (SELECT user_id, ts FROM s WHERE streak = 5),
  a AS (SELECT user_id, ts, 'locked' AS kind FROM k UNION ALL SELECT user_id, ts + INTERVAL 15 MINUTES, 'released' FROM k) SELECT a.* FROM a, (SELECT epoch_ms(max(ts)) - 3600000 AS mark FROM events) WHERE epoch_ms(ts) < mark""")
def login_lock_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 as a stream with state and timers: locks and their ends, up to the watermark an hour behind the last event."""
    logins = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("login_id"), "ts", (F.col("event_type") == "purchase").alias("success"))
    return streamed(logins, "ts", S.locks)


@query(f"WITH RECURSIVE {_CHAIN} SELECT case_id, CAST(idx AS INT) AS idx, data_hash, previous_hash, hash FROM lc, (SELECT epoch_ms(CAST(max(o_orderdate) AS TIMESTAMP)) - 86400000 AS mark FROM orders) WHERE epoch_ms(CAST(ts AS TIMESTAMP)) < mark")
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10, M11's ledgers as a stream: orders go to the ends of their customers' ledgers, up to the watermark a day behind the last one."""
    digest = F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus")), 256)
    blocks = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("block_id"), digest.alias("data_hash"), F.col("o_orderstatus").alias("action"))
    return streamed(blocks, "ts", S.ledgers).select("case_id", "idx", "data_hash", "previous_hash", "hash")
