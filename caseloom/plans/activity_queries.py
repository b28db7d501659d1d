"""Behaviour, places and time over the driver's tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import behaviour as B
from caseloom.operators import places as P
from caseloom.operators import temporal as T
from caseloom.plans import views as V
from caseloom.registry import load, query

_FEATURES = """pl AS (SELECT person_id, location_id, count(*) AS visit_count, count(DISTINCT ts::DATE) AS unique_days, count(DISTINCT event_type) AS unique_event_types, count(DISTINCT case_id) AS unique_cases,
  round(CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(*) - 1) ELSE 0 END, 3) AS average_time_between_visits_sec,
  round(sum(CAST(hour(ts) >= 22 OR hour(ts) <= 5 AS INT)) / count(*), 6) AS night_visit_ratio, round(sum(CAST(isodow(ts) >= 6 AS INT)) / count(*), 6) AS weekend_visit_ratio,
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 86400) + 1 AS BIGINT) AS duration_days FROM ev GROUP BY ALL)"""


@query(f"""WITH {V.EVENTS_SQL}, {_FEATURES}, p AS (SELECT *, sum(visit_count) OVER (PARTITION BY person_id) AS total_visits FROM pl)
  SELECT * REPLACE (CAST(total_visits AS BIGINT) AS total_visits), round(visit_count / total_visits, 6) AS visit_prob, round(sum(-(visit_count / total_visits) * ln(visit_count / total_visits + 1e-9)) OVER (PARTITION BY person_id), 6) AS location_entropy FROM p""")
def person_location_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, A13, J9, X30, W7."""
    return B.person_location_features(V.events(spark, sf_dir))


_PAIRS = f"""{V.EVENTS_SQL}, co AS (SELECT least(a.person_id, b.person_id) AS p1, greatest(a.person_id, b.person_id) AS p2, a.location_id, (epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS delta,
  coalesce(CAST(a.case_id = b.case_id AS INT), 0) AS shared_case, coalesce(CAST(a.event_type = b.event_type AS INT), 0) AS shared_type
  FROM ev a JOIN ev b ON a.location_id = b.location_id AND a.person_id <> b.person_id AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)) AND epoch_us(b.ts) - epoch_us(a.ts) <= 1800000000)"""


@query(f"""WITH {_PAIRS} SELECT p1, p2, location_id, count(*) AS co_location_count, round(min(delta), 6) AS minimum_time_difference, round(avg(delta), 3) AS average_time_difference,
  CAST(sum(shared_case) AS BIGINT) AS shared_case_count, CAST(sum(shared_type) AS BIGINT) AS shared_event_type_count FROM co GROUP BY ALL""")
def colocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, A14."""
    return B.colocation_features(V.events(spark, sf_dir))


_STATS = f"""{_PAIRS}, {_FEATURES}, st AS (SELECT location_id, CAST(sum(visit_count) AS BIGINT) AS total_visits, count(DISTINCT person_id) AS unique_people, round(avg(night_visit_ratio), 6) AS average_night_ratio, round(avg(unique_days), 6) AS average_days FROM pl GROUP BY ALL),
  s AS (SELECT st.*, coalesce(n, 0) AS co_locations, round(CAST(0.3 * total_visits + 0.4 * unique_people + 0.3 * coalesce(n, 0) AS DOUBLE), 6) AS hotspot_score FROM st LEFT JOIN (SELECT location_id, count(*) AS n FROM co GROUP BY 1) USING (location_id))"""


@query(f"""WITH {_STATS} SELECT s.*, hotspot_score >= round((SELECT quantile_cont(hotspot_score, 0.85) FROM s), 9) AS is_hotspot FROM s""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, A26, J10, K3."""
    e = V.events(spark, sf_dir)
    return B.hotspots(B.location_stats(B.person_location_features(e), B.colocation_counts(e)))


_LEADS = f"""{V.CONTACTS_SQL}, ld AS (SELECT least(p1, p2) AS p1, greatest(p1, p2) AS p2, count(*) FILTER (kind = 'call') AS communication_frequency, count(*) FILTER (kind = 'transaction') AS transaction_count, round(coalesce(sum(amount), 0), 4) AS total_amount,
  count(DISTINCT case_id) AS shared_case_count, count(*) AS evidence_count, count(DISTINCT kind) AS multi_source_support,
  round(CASE WHEN count(*) FILTER (kind = 'call') > 0 THEN coalesce(sum(duration), 0) / count(*) FILTER (kind = 'call') ELSE 0 END, 6) AS average_call_duration,
  round(CASE WHEN count(*) FILTER (kind = 'transaction') > 0 THEN round(coalesce(sum(amount), 0), 4) / count(*) FILTER (kind = 'transaction') ELSE 0 END, 6) AS average_amount FROM ct GROUP BY 1, 2)"""


@query(f"""WITH {_LEADS} SELECT ld.*, CAST((CASE WHEN multi_source_support > 1 THEN 2 ELSE 0 END) + CAST(communication_frequency >= round(hf, 9) AS INT) + CAST(total_amount >= round(ha, 9) AS INT) + CAST(shared_case_count > 0 AS INT) >= 2 AS INT) AS is_lead
  FROM ld, (SELECT quantile_cont(communication_frequency, 0.9) AS hf, quantile_cont(total_amount, 0.9) AS ha FROM ld)""")
def lead_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, A26, U2, X36."""
    return B.labelled_leads(V.leads(spark, sf_dir))


@query(f"""WITH {_LEADS}, sc AS (SELECT p1, p2, round(least(0.5, communication_frequency / 600) + least(0.5, total_amount / 3000000), 6) AS lead_score FROM ld)
  SELECT *, CASE WHEN lead_score > 0.8 THEN 'HIGH' WHEN lead_score > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority, true AS requires_review FROM sc WHERE lead_score > 0.05""")
def ranked_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5, X37, X38."""
    return B.ranked_leads(V.leads(spark, sf_dir), least=0.05)


@query("""SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS person_id, event_type AS location_id, ts, json_extract_string(props, '$.k') AS case_id, event_type FROM events
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), o_orderpriority, o_orderdate, NULL, o_orderstatus FROM orders) WHERE ts IS NOT NULL""")
def unified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("u"), "event_type", "ts", F.get_json_object("props", "$.k").alias("k"))
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("u"), "o_orderpriority", "o_orderdate", "o_orderstatus")
    return B.unified_events((e, {"person_id": "u", "location_id": "event_type", "ts": "ts", "case_id": "k", "event_type": "event_type"}), (o, {"person_id": "u", "location_id": "o_orderpriority", "ts": "o_orderdate", "event_type": "o_orderstatus"}))


_ACTIVITY = V.ACTIVITY_SQL + ", lo AS (SELECT * FROM ac WHERE lat <> 0 AND lon <> 0)"
_CLUSTER = """count(*) AS activity_count, count(DISTINCT source) AS source_count, count(*) FILTER (flagged) AS flagged_count, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon"""
_SCORED = """SELECT title, activity_count, source_count, flagged_count, lat, lon, CAST(least(100, round(70 * activity_count / greatest(m, 1) + 20 * least(source_count, 5) / 5 + 10 * flagged_count / greatest(activity_count, 1))) AS INT) AS activity_score,
  CASE WHEN activity_count > 0 THEN round(activity_count / greatest(m, 1), 2) ELSE 0.1 END AS intensity FROM (SELECT *, max(activity_count) OVER () AS m FROM c)"""


@query(f"WITH {_ACTIVITY}, c AS (SELECT state AS title, {_CLUSTER} FROM lo GROUP BY 1) {_SCORED}")
def rollup_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 (india), A18, W7."""
    return P.rolled_up(V.activity(spark, sf_dir), "india")


@query(f"""WITH {_ACTIVITY}, k AS (SELECT n_nationkey AS ordinal, n_name AS district FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_nationkey < 20),
  g AS (SELECT coalesce(k.district, (SELECT arg_min(district, ordinal) FROM k)) AS title, {_CLUSTER} FROM lo LEFT JOIN k ON lo.district = k.district WHERE lower(state) = 'asia' GROUP BY 1),
  c AS (SELECT k.district AS title, coalesce(activity_count, 0) AS activity_count, coalesce(source_count, 1) AS source_count, coalesce(flagged_count, 0) AS flagged_count, lat, lon FROM k LEFT JOIN g ON k.district = g.title) {_SCORED}""")
def rollup_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 (state): unknown districts go to the first, empty ones appear."""
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    known = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).where("r_name = 'ASIA' and n_nationkey < 20").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("district"))
    return P.rolled_up(V.activity(spark, sf_dir), "state", "Asia", known=known)


@query(f"WITH {_ACTIVITY}, c AS (SELECT place AS title, {_CLUSTER} FROM lo WHERE district = 'NATION_7' GROUP BY 1) {_SCORED}")
def rollup_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 (district)."""
    return P.rolled_up(V.activity(spark, sf_dir), "district", district="NATION_7")


@query(f"WITH {_ACTIVITY} SELECT CAST(CASE grouping(state, district, place) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS INT) AS level, state, district, place, count(*) AS n FROM lo GROUP BY ROLLUP (state, district, place)")
def hierarchy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 in one pass."""
    return P.hierarchy(V.activity(spark, sf_dir))


@query(f"WITH {V.ACTIVITY_SQL} SELECT place, list(id ORDER BY n) AS events FROM (SELECT place, id, row_number() OVER (PARTITION BY place ORDER BY ts DESC, id) AS n FROM ac) WHERE n <= 4 GROUP BY 1")
def recent_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return P.recent_events(V.activity(spark, sf_dir), "place")


@query(f"""WITH {V.ACTIVITY_SQL} SELECT count(*) AS records, count(*) FILTER (h) AS with_location, count(*) FILTER (NOT h) AS missing_location, round(100 * count(*) FILTER (NOT h) / count(*), 1) AS missing_pct, round(100 * count(*) FILTER (h) / count(*), 1) AS coverage_pct,
  round(100 * count(*) FILTER (ts IS NOT NULL) / count(*), 1) AS completeness_pct, count(DISTINCT source) AS source_count FROM (SELECT *, lat <> 0 AND lon <> 0 AS h FROM ac)""")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    return P.data_quality(V.activity(spark, sf_dir))


@query("""WITH k AS (SELECT n_nationkey AS ordinal, n_name AS district, r_name AS state FROM nation JOIN region ON n_regionkey = r_regionkey),
  ct AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'NATION_' || c_nationkey WHEN 1 THEN 'old nation_' || c_nationkey || ' town' ELSE c_mktsegment END AS city FROM customer),
  d AS (SELECT city, (SELECT arg_min(state, ordinal) FROM k WHERE k.district = u.city) AS exact, (SELECT arg_min(state, ordinal) FROM k WHERE contains(lower(u.city), lower(k.district)) OR contains(lower(k.district), lower(u.city))) AS near FROM (SELECT DISTINCT city FROM ct) u)
  SELECT id, city, coalesce(exact, near, 'UNKNOWN') AS state FROM ct JOIN d USING (city)""")
def city_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    known = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("district"), F.col("r_name").alias("state"))
    k = F.col("c_custkey") % 3
    city = F.when(k == 0, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).when(k == 1, F.concat(F.lit("old nation_"), F.col("c_nationkey").cast("string"), F.lit(" town"))).otherwise(F.col("c_mktsegment"))
    return P.inferred_state(c.select(F.col("c_custkey").alias("id"), city.alias("city")), "city", known, "UNKNOWN")


_AT = "2024-01-28 12:00:00"
_BIN = """(SELECT entity_id, sum(n) AS s, sum(n * n) AS q FROM (SELECT entity_id, least({last}, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-28 12:00:00' - INTERVAL 20 DAYS)) / 1e6 / (60.0 * {m}))) AS b, count(*) AS n FROM w WHERE old GROUP BY 1, 2) GROUP BY 1)"""
_TSCORE = """CASE WHEN {o} = 0 AND {m} = 0 THEN 0 WHEN {s} > 0 THEN greatest(0, round(({o} - {m}) / {s}, 2)) WHEN history > 0 THEN CASE WHEN {o} > {m} THEN least(5, round(1 + 0.5 * ({o} - {m}), 2)) ELSE 0 END WHEN {o} > 0 THEN least(3, round(0.5 + 0.4 * {o}, 2)) ELSE 0 END"""


@query(f"""WITH w AS (SELECT user_id AS entity_id, ts, ts < TIMESTAMP '{_AT}' - INTERVAL 360 MINUTES AS old, epoch_us(ts) - epoch_us(TIMESTAMP '{_AT}') <= -60000000 AS early FROM events WHERE ts >= TIMESTAMP '{_AT}' - INTERVAL 20 DAYS AND ts <= TIMESTAMP '{_AT}' + INTERVAL 720 MINUTES),
  o AS (SELECT entity_id, count(*) FILTER (NOT old AND early) AS before_count, count(*) FILTER (NOT old AND NOT early) AS after_count, count(*) FILTER (old) AS history FROM w GROUP BY 1),
  m AS (SELECT o.*, coalesce(b.s, 0) / 79 AS bm, coalesce(b.q, 0) / 79 AS bq, coalesce(a.s, 0) / 39 AS am, coalesce(a.q, 0) / 39 AS aq FROM o LEFT JOIN {_BIN.format(last=78, m=360)} b USING (entity_id) LEFT JOIN {_BIN.format(last=38, m=720)} a USING (entity_id)),
  d AS (SELECT *, sqrt(CASE WHEN bq - bm * bm < 1e-12 THEN 0 ELSE bq - bm * bm END) AS bs, sqrt(CASE WHEN aq - am * am < 1e-12 THEN 0 ELSE aq - am * am END) AS as_ FROM m),
  e AS (SELECT *, {_TSCORE.format(o="before_count", m="bm", s="bs")} AS sb, {_TSCORE.format(o="after_count", m="am", s="as_")} AS sa FROM d),
  f AS (SELECT *, round(greatest(sb, sa), 2) AS score, CASE WHEN history = 0 THEN 'NO_HISTORICAL_ACTIVITY' WHEN bs = 0 AND as_ = 0 THEN 'LOW_VARIANCE' ELSE 'STATISTICALLY_SUPPORTED' END AS status FROM e)
  SELECT entity_id, before_count, after_count, history, round(bm, 2) AS before_mean, round(bs, 2) AS before_std, round(sb, 2) AS before_score, round(am, 2) AS after_mean, round(as_, 2) AS after_std, round(sa, 2) AS after_score, score,
  CASE WHEN score >= 3.5 THEN 'CRITICAL' WHEN score >= 2.5 THEN 'HIGH' WHEN score >= 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS level, status, CASE status WHEN 'NO_HISTORICAL_ACTIVITY' THEN 'LOW' WHEN 'LOW_VARIANCE' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence, true AS requires_review FROM f""")
def temporal_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M4, X37."""
    return T.temporal_anomalies(load(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), "ts"), _AT, 360, 720, 20)


@query(f"""SELECT timing, count(*) AS n, CAST(min(minutes) AS BIGINT) AS first_minute, CAST(max(minutes) AS BIGINT) AS last_minute FROM (SELECT minutes, CASE WHEN minutes < 0 THEN 'BEFORE' WHEN minutes > 0 THEN 'AFTER' ELSE 'AT_CRIME' END AS timing FROM (SELECT trunc((epoch_us(ts) - epoch_us(TIMESTAMP '{_AT}')) / 60e6) AS minutes FROM events)) GROUP BY 1""")
def timeline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, A21."""
    return T.split_timeline(load(spark, sf_dir, "events"), _AT).groupBy("timing").agg(F.count("*").alias("n"), F.min("minutes").alias("first_minute"), F.max("minutes").alias("last_minute"))


@query("SELECT event_id, user_id, 'UNUSUAL_COMMUNICATION_HOURS' AS anomaly FROM events WHERE hour(ts) IN (1, 2, 3, 4)")
def off_hours_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    return T.unusual_hours(load(spark, sf_dir, "events")).select("event_id", "user_id", "anomaly")


@query("SELECT event_id, user_id, value AS speed_kmh, 'EXCESSIVE_SPEED' AS anomaly, 'HIGH' AS severity FROM events WHERE value > 120")
def excessive_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the values of events taken as speeds."""
    return T.above(load(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("speed_kmh")), "speed_kmh", 120, "EXCESSIVE_SPEED")


@query("SELECT o_orderkey, o_totalprice, 'UNUSUAL_AMOUNT' AS anomaly, 'HIGH' AS severity FROM orders WHERE o_totalprice > 200000")
def large_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20."""
    return T.above(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 200000, "UNUSUAL_AMOUNT")


@query(f"WITH {V.EVENTS_SQL} SELECT location_id, count(DISTINCT person_id) AS people, count(*) AS events FROM ev GROUP BY 1 HAVING count(DISTINCT person_id) >= 2")
def repeated_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7."""
    return T.repeated_locations(V.events(spark, sf_dir))


@query(f"WITH {V.CONTACTS_SQL} SELECT least(p1, p2) AS p1, greatest(p1, p2) AS p2, count(*) AS contacts FROM ct GROUP BY 1, 2 HAVING count(*) >= 5")
def repeated_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8."""
    return T.repeated_contacts(V.contacts(spark, sf_dir))


@query(f"""WITH {V.CONTACTS_SQL}, b AS (SELECT p1, p2, count(*) AS n FROM (SELECT p1, p2, amount FROM ct WHERE kind = 'transaction' UNION ALL SELECT 'C' || o_custkey, 'S' || l_suppkey, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE amount >= 95000 GROUP BY 1, 2)
  SELECT x.p1 AS a, x.p2 AS b, y.p2 AS c, x.n * y.n AS n FROM b x JOIN b y ON x.p2 = y.p1 WHERE x.p1 <> y.p2""")
def transaction_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: money passed on."""
    back = V.contacts(spark, sf_dir).where("kind = 'transaction'").select(F.col("p1").alias("sender"), F.col("p2").alias("receiver"), "amount")
    o, li = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    there = o.join(li, o.o_orderkey == li.l_orderkey).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), "l_extendedprice")
    return T.transaction_chains(back.union(there), 95000)


@query("""WITH l AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS ok FROM events), r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
  s AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM r WHERE NOT ok) SELECT user_id, ts, CAST(streak AS INT) AS streak, ts + INTERVAL 15 MINUTES AS locked_until FROM s WHERE streak = 5""")
def login_lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15."""
    return T.lockouts(load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("login_id"), "ts", (F.col("event_type") == "purchase").alias("success")))


@query("SELECT time_bucket(INTERVAL 4 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY 1")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6."""
    return T.windowed_counts(load(spark, sf_dir, "events"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate BETWEEN TIMESTAMP '2001-08-01' - INTERVAL 180 DAYS AND TIMESTAMP '2001-08-01'""")
def recent_half_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, F14."""
    return load(spark, sf_dir, "orders").where(P.within(F.col("o_orderdate"), *P.time_bounds("6m", "2001-08-01"))).select("o_orderkey")


@query("""SELECT o_orderkey, o_orderdate - INTERVAL 3 DAYS AS low, o_orderdate + INTERVAL 3 DAYS + INTERVAL 23 HOURS + INTERVAL 59 MINUTES AS high, true AS has_incident_date FROM orders WHERE o_orderdate IS NOT NULL""")
def incident_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15, F17."""
    low, high = P.incident_window(F.col("o_orderdate"), 3)
    return load(spark, sf_dir, "orders").where("o_orderdate is not null").select("o_orderkey", low.alias("low"), high.alias("high"), F.lit(True).alias("has_incident_date"))
