"""Lines of unknown format, paged sources and graphs of evidence on small tables."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from caseloom.operators import evidence
from caseloom.sources import lines, paged


def test_mixed_lines(spark):
    rows = [(1, '{"a": 1, "b": {"c": "x"}}'), (2, 'x,"y, z",3'), (3, "x\ty\tz"), (4, '{"a": '), (5, "a,b"), (6, "free text"), (7, ""), (8, None), (9, "[1, 2]"), (10, "a,b,c,d"), (11, "  \t "), (12, ",,")]
    got = {r["id"]: r for r in lines.dynamic_records(spark.createDataFrame(rows, "id int, line string"), "line", ("a", "b", "c")).select("id", "format", F.to_json("record").alias("record"), "raw").collect()}
    assert [got[i]["format"] for i, _ in rows] == ["json", "csv", "tsv", "json", "csv", "text", None, None, "json", "csv", None, "csv"]
    assert json.loads(got[1]["record"]) == {"a": 1, "b": {"c": "x"}} and json.loads(got[2]["record"]) == {"a": "x", "b": "y, z", "c": "3"}
    assert json.loads(got[3]["record"]) == {"a": "x", "b": "y", "c": "z"} and json.loads(got[9]["record"]) == [1, 2] and json.loads(got[12]["record"]) == {"a": None, "b": None, "c": None}
    assert {i for i in got if got[i]["record"] is None} == {4, 5, 6, 7, 8, 10, 11} and all((got[i]["raw"] is None) == (got[i]["record"] is not None or i == 8) for i in got)


def test_pages_answer_filters(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "cast(id % 7 as string) as kind", "id * 0.5D as amount")
    path = f"file://{tmp_path}/pages"
    paged.export(rows.repartition(3), path, 100)
    found = paged.scan(spark, path, "id long, kind string, amount double").where("kind = '3' and amount > 100 and id % 2 = 0")
    assert sorted(r["id"] for r in found.collect()) == [i for i in range(1000) if i % 7 == 3 and i * 0.5 > 100 and i % 2 == 0]
    reader = paged.PagedReader(rows.schema, path)
    left = list(reader.pushFilters([EqualTo(("kind",), "3"), In(("kind",), ("1", "2")), GreaterThan(("amount",), 100.0)]))
    assert [type(f) for f in left] == [In] and len(reader.tests) == 2 and len(reader.partitions()) >= 10
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == sum(i % 7 == 3 and i * 0.5 > 100 for i in range(1000))
    with pytest.raises(Exception, match="page|No such|not exist|FileNotFound"):
        paged.scan(spark, f"file://{tmp_path}/nothing", "id long").collect()


def test_evidence_of_odd_rows(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    entities = spark.createDataFrame([("r1", "p1", "Ann", "Main Road", "AB1", None, 10), ("r2", "p2", None, None, None, None, None)], "record_id string, person_id string, name string, place string, vehicle string, ts timestamp_ntz, risk int")
    calls = spark.createDataFrame([("c1", "p1", "p2", None, None, None, None), ("c2", "p1", None, "Video", 5, "X", None), ("c3", "p2", "p2", None, 1, None, None)], "call_id string, caller_id string, callee_id string, call_type string, seconds int, city string, ts timestamp_ntz")
    transfers = spark.createDataFrame([("t1", "p2", "p1", 1234567.5, None, "B", None, None)], "txn_id string, sender_id string, receiver_id string, amount double, kind string, sender_bank string, receiver_bank string, ts timestamp_ntz")
    rest = none("fir_id string, accused_id string, crime string, sections string, ts timestamp_ntz, risk int"), none("event_id string, person_id string, place string, event_type string, city string, system string, ts timestamp_ntz")
    edges = evidence.evidence_edges(entities, calls, transfers, *rest)
    got = {r["edge_id"]: r for r in edges.collect()}
    assert set(got) == {"e-loc-p1-LOC-Main_Road", "e-veh-p1-VEH-AB1", "call-c1", "call-c3", "txn-t1"}
    assert got["call-c1"]["detail"] == "Voice Call (0s) via Tower Site" and got["txn-t1"]["detail"] == "INR 1,234,567.50 transfer (Transfer) from B to Bank" and got["txn-t1"]["date"] == "2024-01-01"
    pair = {(r["a"], r["b"]): r for r in evidence.relationship_analysis(edges).collect()}["p1", "p2"]
    assert (pair["calls"], pair["transfers"], pair["kinds"], pair["strength"], pair["record"], pair["band"]) == (1, 1, 2, 7, "Txn ID: t1", "MODERATE")
    nodes = {r["id"]: (r["name"], r["type"], r["risk"]) for r in evidence.evidence_nodes(entities, calls, transfers, *rest).collect()}
    assert nodes == {"p1": ("Ann", "PERSON", 10), "p2": ("Identified Person", "PERSON", 50), "LOC-Main_Road": ("Main Road", "LOCATION", 20), "VEH-AB1": ("AB1", "VEHICLE", 30)}
    with pytest.raises(ValueError, match="scope"):
        evidence.scoped_network(entities, edges, entities, "SOME")
