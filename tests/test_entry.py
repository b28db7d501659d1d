"""The driver contract and the streams."""

import pytest

import __spark_entry__ as entry
from caseloom import queries as own
from caseloom.plans import views
from caseloom.registry import load
from caseloom.streaming import counters

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(own.SQL) <= set(own.QUERIES) and len(own.QUERIES) > 90


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and {"person_id", "location_id", "visit_count", "location_entropy"} <= set(out.columns)


def test_rare_filters_reach_the_scan(spark):
    plan = load(spark, SMALL, "orders").where("o_totalprice > 200000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,200000.0)" in plan and "o_orderpriority" not in plan


def test_colocation_is_an_equi_join(spark):
    from caseloom.operators.behaviour import colocation_features

    plan = colocation_features(views.events(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_windowed_stream_equals_batch(spark, tmp_path):
    rows = views.events(spark, SMALL).select("person_id", "location_id", "ts", "event_type")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = counters.windowed(stream, "ts", ["event_type"]).writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("windowed")) == key(counters.windowed(rows, "ts", ["event_type"]))
    assert counters.visits(rows, "ts").count() > 0 and counters.off_hours(rows, "ts").count() > 0


def test_scopes_are_read_by_name(spark):
    assert set(views.scoped(spark, SMALL)) == set(views.SCOPES) and list(views.scoped(spark, SMALL, "events")) == ["events"]
    with pytest.raises(ValueError):
        views.scoped(spark, SMALL, "nothing")
