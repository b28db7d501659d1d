"""The graph of evidence and what is read from it, activity of all sources, listings, timelines and whole dossiers, with SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import evidence as X
from caseloom.operators import graph as G
from caseloom.operators import places as P
from caseloom.operators import records as R
from caseloom.operators import reports as O
from caseloom.plans import graph_queries as Q
from caseloom.plans import views as V
from caseloom.plans.activity_queries import _ACTIVITY, _CLUSTER, _SCORED
from caseloom.plans.views import order_lines
from caseloom.registry import load, query


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities, calls, transfers, cases and visits, in the columns of evidence_edges()."""
    c, n, o, li, e = (load(spark, sf_dir, t) for t in ("customer", "nation", "orders", "lineitem", "events"))
    text = lambda x: F.col(x).cast("string")
    person, firm = F.concat(F.lit("C"), text("o_custkey")), F.concat(F.lit("S"), text("l_suppkey"))
    bank = lambda x: F.concat(F.lit("Bank "), (F.col(x) % 5).cast("string"))
    line = F.concat_ws("-", *(text(x) for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
    entities = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.concat(F.lit("R"), text("c_custkey")).alias("record_id"), F.concat(F.lit("C"), text("c_custkey")).alias("person_id"), F.col("c_name").alias("name"), F.col("n_name").alias("place"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("DL01AB"), text("c_custkey"))).alias("vehicle"), F.lit(None).cast("timestamp_ntz").alias("ts"), (F.abs(F.floor("c_acctbal")) % 100).cast("int").alias("risk"))
    lines = order_lines(o, li)
    calls = lines.select(line.alias("call_id"), person.alias("caller_id"), firm.alias("callee_id"), F.col("l_linestatus").alias("call_type"), F.floor("l_quantity").alias("seconds"), F.lit(None).cast("string").alias("city"), F.col("l_shipdate").alias("ts"))
    transfers = lines.where("l_returnflag = 'R'").select(line.alias("txn_id"), firm.alias("sender_id"), person.alias("receiver_id"), F.floor("l_extendedprice").alias("amount"), F.col("l_linestatus").alias("kind"), bank("l_suppkey").alias("sender_bank"), bank("o_custkey").alias("receiver_bank"), F.col("l_shipdate").alias("ts"))
    cases = o.select(F.concat(F.lit("F"), text("o_orderkey")).alias("fir_id"), person.alias("accused_id"), F.col("o_orderpriority").alias("crime"), F.col("o_orderstatus").alias("sections"), F.col("o_orderdate").alias("ts"), (F.floor("o_totalprice") % 11).cast("int").alias("risk"))
    visits = e.select("event_id", F.concat(F.lit("C"), text("user_id")).alias("person_id"), F.concat(F.col("event_type"), F.lit(" "), (F.floor("value") % 40).cast("string")).alias("place"), "event_type", F.col("event_type").alias("city"), F.lit(None).cast("string").alias("system"), "ts")
    return entities, calls, transfers, cases, visits


_LINE = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
_EVIDENCE = f"""en AS (SELECT 'C' || c_custkey AS pid, c_name AS name, n_name AS place, CASE WHEN c_custkey % 3 = 0 THEN 'DL01AB' || c_custkey END AS vehicle, 'R' || c_custkey AS rid, CAST(abs(CAST(floor(c_acctbal) AS BIGINT)) % 100 AS INT) AS risk FROM customer JOIN nation ON c_nationkey = n_nationkey),
  ln AS (SELECT {_LINE} AS id, 'C' || o_custkey AS p, 'S' || l_suppkey AS s, l_linestatus AS kind, CAST(floor(l_quantity) AS BIGINT) AS seconds, CAST(floor(l_extendedprice) AS BIGINT) AS amount, l_returnflag, 'Bank ' || l_suppkey % 5 AS sb, 'Bank ' || o_custkey % 5 AS rb, strftime(l_shipdate, '%Y-%m-%d') AS date FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  vi AS (SELECT event_id, 'C' || user_id AS pid, event_type || ' ' || CAST(floor(value) AS BIGINT) % 40 AS place, event_type, strftime(ts, '%Y-%m-%d') AS date FROM events),
  ed AS (SELECT 'e-loc-' || pid || '-LOC-' || replace(place, ' ', '_') AS edge_id, pid AS src, 'LOC-' || replace(place, ' ', '_') AS dst, 'LOCATED_AT' AS type, 1 AS strength, 'Entity Record: ' || rid AS record, 'Primary location recorded as ' || place AS detail, '2024-01-01' AS date FROM en
    UNION ALL SELECT 'e-veh-' || pid || '-VEH-' || vehicle, pid, 'VEH-' || vehicle, 'USES_VEHICLE', 2, 'Vehicle Registry: ' || vehicle, 'Vehicle associated with subject ' || name, '2024-01-01' FROM en WHERE vehicle IS NOT NULL
    UNION ALL SELECT 'call-' || id, p, s, 'COMMUNICATION', 3, 'CDR ID: ' || id, kind || ' Call (' || seconds || 's) via Tower Site', date FROM ln
    UNION ALL SELECT 'txn-' || id, s, p, 'FINANCIAL_TRANSACTION', 4, 'Txn ID: ' || id, 'INR ' || format('{{:,}}', amount) || '.00 transfer (' || kind || ') from ' || sb || ' to ' || rb, date FROM ln WHERE l_returnflag = 'R'
    UNION ALL SELECT 'fir-rel-F' || o_orderkey || '-C' || o_custkey, 'C' || o_custkey, 'F' || o_orderkey, 'SHARED_CASE', 5, 'FIR Docket: F' || o_orderkey, 'Accused in ' || o_orderpriority || ' docket under IPC ' || o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') FROM orders
    UNION ALL SELECT 'loc-event-' || event_id, pid, 'LOC-' || replace(place, ' ', '_'), 'LOCATION_EVENT', 2, 'Event ID: ' || event_id, event_type || ' logged in ' || event_type || ' via Sensor', date FROM vi WHERE pid IS NOT NULL AND place IS NOT NULL)"""


@query(f"WITH {_EVIDENCE} SELECT edge_id, src, dst, type, CAST(strength AS INT) AS strength, record, detail, date FROM ed")
def evidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of five sources with strengths 1 to 5 and their evidence."""
    return X.evidence_edges(*sources(spark, sf_dir))


@query(f"""WITH {_EVIDENCE}, nd AS (SELECT 0 AS part, pid AS id, name, 'PERSON' AS type, risk FROM en UNION ALL SELECT 1, 'LOC-' || replace(place, ' ', '_'), place, 'LOCATION', 20 FROM en UNION ALL SELECT 2, 'VEH-' || vehicle, vehicle, 'VEHICLE', 30 FROM en WHERE vehicle IS NOT NULL UNION ALL SELECT 3, p, p, 'PERSON', 60 FROM ln UNION ALL SELECT 4, s, s, 'PERSON', 55 FROM ln UNION ALL SELECT 5, s, s, 'PERSON', 65 FROM ln WHERE l_returnflag = 'R' UNION ALL SELECT 6, p, p, 'PERSON', 60 FROM ln WHERE l_returnflag = 'R'
    UNION ALL SELECT 7, 'F' || o_orderkey, 'FIR F' || o_orderkey, 'FIR', CAST(CAST(floor(o_totalprice) AS BIGINT) % 11 * 10 AS INT) FROM orders UNION ALL SELECT 8, 'C' || o_custkey, 'C' || o_custkey, 'PERSON', 75 FROM orders UNION ALL SELECT 9, 'LOC-' || replace(place, ' ', '_'), place, 'LOCATION', 25 FROM vi WHERE place IS NOT NULL UNION ALL SELECT 10, pid, pid, 'PERSON', 50 FROM vi WHERE pid IS NOT NULL)
  SELECT id, arg_min(name, (part, name)) AS name, arg_min(type, (part, name)) AS type, CAST(arg_min(risk, (part, name)) AS INT) AS risk FROM nd GROUP BY 1""")
def evidence_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of five sources, each as its first source has it."""
    return X.evidence_nodes(*sources(spark, sf_dir))


@query(f"""WITH {_EVIDENCE}, pr AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS evidence, count(*) FILTER (type = 'COMMUNICATION') AS calls, count(*) FILTER (type = 'FINANCIAL_TRANSACTION') AS transfers, count(*) FILTER (type = 'SHARED_CASE') AS cases, count(*) FILTER (type IN ('LOCATED_AT', 'LOCATION_EVENT')) AS places, count(*) FILTER (type = 'USES_VEHICLE') AS vehicles,
    CAST(sum(strength) AS BIGINT) AS strength, CAST(max(strength) AS INT) AS strongest, min(date) AS first_date, max(date) AS last_date, arg_max(record, (strength, date, record)) AS record, CAST(count(DISTINCT CASE WHEN type = 'LOCATED_AT' THEN 'LOCATION_EVENT' ELSE type END) AS INT) AS kinds FROM ed WHERE src <> dst GROUP BY 1, 2)
  SELECT *, CAST(datediff('day', CAST(first_date AS DATE), CAST(last_date AS DATE)) AS INT) AS days, CASE WHEN kinds > 1 AND strength >= 20 THEN 'STRONG' WHEN kinds > 1 OR strength >= 10 THEN 'MODERATE' ELSE 'WEAK' END AS band FROM pr""")
def relationship_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all evidence says of each pair."""
    return X.relationship_analysis(X.evidence_edges(*sources(spark, sf_dir)))


@query(f"""WITH {Q.BASE}, mb AS (SELECT 'C' || c_custkey AS id FROM customer WHERE c_nationkey = 7) SELECT 'DATASET_ONLY' AS scope, id, CAST(0 AS BIGINT) AS edges FROM vs WHERE id IN (FROM mb)
  UNION ALL SELECT 'COMBINED', vs.id, coalesce(n, 0) FROM vs LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM es UNION ALL SELECT dst FROM es) GROUP BY 1) e USING (id)""")
def dataset_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: the entities of a dataset without edges, and the whole network."""
    members = load(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    out = []
    for scope in ("DATASET_ONLY", "COMBINED"):
        nodes, edges = X.scoped_network(Q.vertices(spark, sf_dir), Q.edges(spark, sf_dir), members, scope)
        out.append(G.degrees(nodes, edges).select(F.lit(scope).alias("scope"), "id", F.col("edge_count").alias("edges")))
    return out[0].union(out[1])


@query(f"WITH {Q.BASE}, d AS (SELECT vs.id, coalesce(n, 0) AS degree FROM vs LEFT JOIN (SELECT id, count(*) AS n FROM nb GROUP BY 1) USING (id)) SELECT id, degree, (SELECT round(2 * count(*) / (SELECT count(*) FROM vs), 2) FROM es) AS average_degree FROM d ORDER BY degree DESC, id LIMIT 8")
def most_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight vertices of most neighbours (the limit is the feature), with the mean degree."""
    v, e = Q.vertices(spark, sf_dir), Q.edges(spark, sf_dir)
    mean = e.agg(F.count("*").alias("m")).join(v.agg(F.count("*").alias("n"))).select(F.round(2 * F.col("m") / F.col("n"), 2).alias("average_degree"))
    return G.degrees(v, e).select("id", "degree").orderBy(F.desc("degree"), "id").limit(8).join(F.broadcast(mean))


def _activity_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c, n, r, o, li, e = (load(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders", "lineitem", "events"))
    home = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("c_custkey", F.col("c_name").alias("subject"), F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.col("c_mktsegment").alias("detail"), F.col("n_nationkey").cast("double").alias("lat"), (F.col("n_nationkey") * 2).cast("double").alias("lon"))
    o2 = o.join(home, o.o_custkey == home.c_custkey)
    lines = o2.join(li, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("line", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")))

    def of(rows: DataFrame, i, source: str, kind: str, confidence: float, ts: str, flagged, case) -> DataFrame:
        return rows.select(i.cast("string").alias("id"), F.lit(source).alias("source"), F.col(kind).cast("string").alias("event_type"), "subject", "state", "district", "detail", "lat", "lon", F.lit(confidence).alias("confidence"), F.col(ts).alias("ts"), flagged.alias("flagged"), case.cast("string").alias("case_id"))

    none = F.lit(None).cast("string")
    return {
        "LOCATION": of(e.join(home, e.user_id == home.c_custkey), F.col("event_id"), "Location Registry", "event_type", 0.7, "ts", F.col("event_type") == "error", F.get_json_object("props", "$.k")),
        "COMMUNICATION": of(lines, F.col("line"), "Call Records", "l_linestatus", 0.8, "l_shipdate", F.col("l_quantity") > 45, none),
        "FIR": of(o2, F.col("o_orderkey"), "Case Register", "o_orderpriority", 0.9, "o_orderdate", F.floor("o_totalprice") % 11 > 7, F.col("o_orderkey")),
        "VEHICLE": of(o2.where("o_custkey % 3 = 0"), F.col("o_orderkey"), "Vehicle Registry", "o_orderstatus", 0.85, "o_orderdate", F.lit(False), none),
        "FINANCIAL": of(lines.where("l_returnflag = 'R'"), F.col("line"), "Bank Feed", "l_returnflag", 0.75, "l_shipdate", F.col("l_extendedprice") > 80000, none),
    }


_HOME = "hm AS (SELECT c_custkey, c_name AS subject, r_name AS state, n_name AS district, c_mktsegment AS detail, CAST(n_nationkey AS DOUBLE) AS lat, CAST(n_nationkey * 2 AS DOUBLE) AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_WHERE = "subject, state, district, detail, lat, lon"
_FIVE = f"""{_HOME}, lw AS (SELECT *, {_LINE} AS line FROM orders JOIN hm ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey),
  ar AS (SELECT 'LOCATION' AS category, CAST(event_id AS VARCHAR) AS id, 'Location Registry' AS source, event_type, {_WHERE}, 0.7::DOUBLE AS confidence, ts, event_type = 'error' AS flagged, json_extract_string(props, '$.k') AS case_id FROM events JOIN hm ON user_id = c_custkey UNION ALL SELECT 'COMMUNICATION', line, 'Call Records', l_linestatus, {_WHERE}, 0.8::DOUBLE, l_shipdate, l_quantity > 45, NULL FROM lw
    UNION ALL SELECT 'FIR', CAST(o_orderkey AS VARCHAR), 'Case Register', o_orderpriority, {_WHERE}, 0.9::DOUBLE, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) % 11 > 7, CAST(o_orderkey AS VARCHAR) FROM orders JOIN hm ON o_custkey = c_custkey UNION ALL SELECT 'VEHICLE', CAST(o_orderkey AS VARCHAR), 'Vehicle Registry', o_orderstatus, {_WHERE}, 0.85::DOUBLE, o_orderdate, false, NULL FROM orders JOIN hm ON o_custkey = c_custkey WHERE o_custkey % 3 = 0
    UNION ALL SELECT 'FINANCIAL', line, 'Bank Feed', l_returnflag, {_WHERE}, 0.75::DOUBLE, l_shipdate, l_extendedprice > 80000, NULL FROM lw WHERE l_returnflag = 'R')"""
#: What a view shows of each source.
_LIMITS = {"LOCATION": 600, "COMMUNICATION": 500, "FIR": 300, "VEHICLE": 300, "FINANCIAL": 300}


@query(f"WITH {_FIVE} SELECT * FROM ar")
def activity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All activity of five sources as one record."""
    return P.activity_records(_activity_sources(spark, sf_dir))


@query(f"WITH {_FIVE}, k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ts DESC NULLS LAST, id) AS k FROM ar) SELECT * EXCLUDE (k) FROM k WHERE k <= CASE category {' '.join(f'WHEN {c!r} THEN {n}' for c, n in _LIMITS.items())} END")
def activity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3 as a view shows it: the newest of each source up to its limit, which is the feature."""
    return P.activity_records(_activity_sources(spark, sf_dir), _LIMITS)


@query(f"WITH {V.ACTIVITY_SQL}, d AS (SELECT DISTINCT state, district, place FROM ac) SELECT state, district, count(*) AS areas, list_sort(list(place))[1:3] AS first_areas FROM d GROUP BY 1, 2")
def area_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts with their first areas (three, as the data have five at most; the limit is the feature)."""
    return P.hierarchy_listing(V.activity(spark, sf_dir), 3)


@query(" UNION ALL ".join(f"SELECT '{level}' AS level, * FROM (WITH {_ACTIVITY}, c AS (SELECT {title} AS title, {_CLUSTER} FROM lo WHERE {test} GROUP BY 1) {_SCORED})" for level, title, test in (("india", "state", "true"), ("district", "place", "district = 'NATION_7'"))))
def requested_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level follows from what is asked for; a district goes before a state."""
    a = V.activity(spark, sf_dir)
    return P.requested_hotspots(a).unionByName(P.requested_hotspots(a, state="Asia", district="NATION_7"))


_TIMELINE = "tl AS (SELECT 'case' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS key, o_orderdate AS ts FROM orders UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), ts FROM events UNION ALL SELECT 'line', concat_ws('-', l_orderkey, l_linenumber), CAST(o_custkey AS VARCHAR), l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'call', concat_ws('-', l_orderkey, l_linenumber), CAST(l_suppkey AS VARCHAR), l_shipdate FROM lineitem WHERE l_returnflag = 'R')"


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, e, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "events"), load(spark, sf_dir, "lineitem")
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    own = li.join(o, li.l_orderkey == o.o_orderkey).withColumn("line", line).withColumn("who", F.col("o_custkey"))
    moves = li.where("l_returnflag = 'R'").withColumn("line", line).withColumn("who", F.col("l_suppkey"))
    return R.timeline((o.withColumn("who", F.col("o_custkey")), "case", "o_orderkey", "o_orderdate"), (e.withColumn("who", F.col("user_id")), "event", "event_id", "ts"), (own, "line", "line", "l_shipdate"), (moves, "call", "line", "l_shipdate"), key="who")


@query(f"WITH {_TIMELINE} SELECT kind, id, key, ts FROM tl")
def dossier_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sources of a dossier's timeline, of all people."""
    return _timeline(spark, sf_dir)


@query(f"WITH {_TIMELINE} SELECT kind, id, key, ts FROM tl WHERE kind IN ('case', 'line') AND key = '77' AND CAST(ts AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1997-06-30'")
def timeline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline by kinds, entity and inclusive days."""
    return R.filtered_timeline(_timeline(spark, sf_dir), ("case", "line"), "77", "1995-01-01", "1997-06-30")


@query("SELECT event_id, event_type, 'AUD-' || lpad(CAST(event_id AS VARCHAR), CAST(greatest(6, length(CAST(event_id AS VARCHAR))) AS INT), '0') AS reference FROM events WHERE event_id = 77 OR event_id BETWEEN 1200 AND 1299")
def audit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: by id, and by the beginning of a number."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type")
    return R.audit_event(e, "77").union(R.audit_event(e, "AUD-0012"))


@query("""WITH p AS (SELECT c_custkey AS k, c_name AS name, CAST(abs(CAST(floor(c_acctbal) AS BIGINT)) % 100 AS INT) AS risk FROM customer WHERE c_mktsegment = 'MACHINERY'), x AS (SELECT k, 'identity' AS section, name || ' ' || CAST(least(95, 50 + risk // 2) AS INT) AS value FROM p
    UNION ALL SELECT k, 'orders', CAST(o_orderkey AS VARCHAR) FROM p JOIN orders ON o_custkey = k UNION ALL SELECT k, 'events', CAST(event_id AS VARCHAR) FROM p JOIN events ON user_id = k
    UNION ALL SELECT k, 'timeline', kind || ' ' || id FROM (SELECT k, 'orders' AS kind, CAST(o_orderkey AS VARCHAR) AS id FROM p JOIN orders ON o_custkey = k UNION ALL SELECT k, 'events', CAST(event_id AS VARCHAR) FROM p JOIN events ON user_id = k)
    UNION ALL SELECT DISTINCT k, 'network', 'S' || l_suppkey FROM p JOIN orders ON o_custkey = k JOIN lineitem ON o_orderkey = l_orderkey) SELECT 'C' || k AS person, section, value FROM x""")
def dossier_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole dossier of each customer of one segment: identity, rows of two tables, timeline and direct contacts."""
    c, o, e = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders"), load(spark, sf_dir, "events")
    key = lambda x: F.concat(F.lit("C"), F.col(x).cast("string"))
    people = c.where("c_mktsegment = 'MACHINERY'").select(key("c_custkey").alias("person_id"), F.col("c_name").alias("name"), (F.abs(F.floor("c_acctbal")) % 100).cast("int").alias("risk"))
    tables = {"orders": (o.select(key("o_custkey").alias("person_id"), F.lit(None).cast("string").alias("name"), F.col("o_orderkey").cast("string").alias("row"), F.col("o_orderdate").alias("ts")), "row", "ts"), "events": (e.select(key("user_id").alias("person_id"), F.lit(None).cast("string").alias("name"), F.col("event_id").cast("string").alias("row"), "ts"), "row", "ts")}
    d = O.dossier(people, tables, Q.edges(spark, sf_dir))
    parts = [d["identity"].select(F.col("person_id").alias("person"), F.lit("identity").alias("section"), F.concat_ws(" ", "name", F.col("identity_confidence").cast("string")).alias("value")), *(d[n].select("person", F.lit(n), "row") for n in ("orders", "events")), d["timeline"].select("key", F.lit("timeline"), F.concat_ws(" ", "kind", "id")), d["network"].select("id", F.lit("network"), "other")]
    return reduce(DataFrame.union, parts)


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS m FROM lineitem GROUP BY 1) SELECT o_orderkey AS case_id, unnest(['status', 'lines', 'transfers']) AS metric, unnest([o_orderstatus, CAST(coalesce(n, 0) AS VARCHAR), CAST(coalesce(m, 0) AS VARCHAR)]) AS value FROM orders LEFT JOIN n ON o_orderkey = l_orderkey""")
def case_report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13's metrics of all cases at once, by one aggregate of each part."""
    o, li = load(spark, sf_dir, "orders").withColumn("case_id", F.col("o_orderkey")), load(spark, sf_dir, "lineitem").withColumn("case_id", F.col("l_orderkey"))
    counts = R.case_counts(o.select(F.col("case_id").cast("string").alias("case_id"), F.lit(None).cast("string").alias("other_id"), "o_orderstatus"), {"lines": (li, "case_id"), "transfers": (li.where("l_returnflag = 'R'"), "case_id")})
    pair = lambda n, c: F.struct(F.lit(n).alias("metric"), F.col(c).cast("string").alias("value"))
    return counts.select(F.col("case_id").cast("long").alias("case_id"), F.explode(F.array(pair("status", "o_orderstatus"), pair("lines", "lines"), pair("transfers", "transfers"))).alias("m")).select("case_id", "m.*")
