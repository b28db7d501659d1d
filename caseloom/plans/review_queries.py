"""What an investigator looks at: events around a time, ranked anomalies, linked places, reviews, leads and ingested rows, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import behaviour as B
from caseloom.operators import graph as G
from caseloom.operators import ml as K
from caseloom.operators import places as P
from caseloom.operators import records as R
from caseloom.operators import resolution as E
from caseloom.operators import temporal as T
from caseloom.plans import activity_queries as A
from caseloom.plans import views as V
from caseloom.plans.graph_queries import BASE, edges, vertices
from caseloom.registry import SQL, load, query
from caseloom.sources import files as S

_AT = A._AT


@query(f"""SELECT event_id, user_id AS entity_id, c_name AS entity_name, CASE WHEN c_custkey IS NOT NULL THEN 'PERSON' END AS entity_type, minutes, CASE WHEN minutes < 0 THEN 'BEFORE' WHEN minutes > 0 THEN 'AFTER' ELSE 'AT_CRIME' END AS timing, user_id IS NULL AS unassigned
  FROM (SELECT *, CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '{_AT}')) / 60e6) AS BIGINT) AS minutes FROM events WHERE ts BETWEEN TIMESTAMP '{_AT}' - INTERVAL 360 MINUTES AND TIMESTAMP '{_AT}' + INTERVAL 720 MINUTES) LEFT JOIN customer ON user_id = c_custkey""")
def window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their entity, if there is one."""
    e = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("entity_id"), "ts")
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.lit("PERSON").alias("type"))
    return T.window_events(e, people, _AT, 360, 720)


_SEEDED = f"""ta AS ({SQL["temporal_anomalies"]}), sd AS (SELECT c_custkey AS entity_id FROM customer WHERE c_mktsegment = 'MACHINERY'),
  al AS (SELECT entity_id, coalesce(before_count, 0) AS before_count, coalesce(after_count, 0) AS after_count, coalesce(history, 0) AS history, coalesce(score, 0) AS score, coalesce(level, 'LOW') AS level, coalesce(status, 'NO_HISTORICAL_ACTIVITY') AS status, coalesce(confidence, 'LOW') AS confidence FROM ta FULL JOIN sd USING (entity_id))"""


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = load(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("entity_id"))
    return T.seeded(A.temporal_anomalies(spark, sf_dir), seed)


@query(f"WITH {_SEEDED} SELECT * FROM al")
def seeded_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of a case appear without events, too."""
    return _seeded(spark, sf_dir).select("entity_id", "before_count", "after_count", "history", "score", "level", "status", "confidence")


@query(f"WITH {_SEEDED} SELECT row_number() OVER (ORDER BY score DESC, before_count + after_count DESC, entity_id) AS rank, entity_id, score, before_count + after_count AS activity FROM al")
def anomaly_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities."""
    return T.ranked_anomalies(_seeded(spark, sf_dir))


_PLACES = """nd AS (SELECT 'C' || c_custkey AS id, c_mktsegment || ' ' || (c_custkey // 2) AS name, 'PERSON' AS type FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, 'ORGANIZATION' FROM supplier UNION ALL SELECT 'N' || n_nationkey, n_name, 'LOCATION' FROM nation),
  lk AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 1 AS n FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 2 FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'C' || n_nationkey, 5 FROM nation),
  mb AS (SELECT p.id AS place_id, p.name AS place, s.name, min(s.type) AS type, CAST(sum(n) AS BIGINT) AS activity FROM lk JOIN nd p ON dst = p.id JOIN nd s ON src = s.id WHERE p.type = 'LOCATION' GROUP BY 1, 2, 3)"""


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s, n, o = (load(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "orders"))
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    nodes = c.select(key("C", "c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", F.floor(F.col("c_custkey") / 2).cast("string")).alias("name"), F.lit("PERSON").alias("type")).union(s.select(key("S", "s_suppkey"), "s_name", F.lit("ORGANIZATION"))).union(n.select(key("N", "n_nationkey"), "n_name", F.lit("LOCATION")))
    homes = c.join(o, c.c_custkey == o.o_custkey).select(key("C", "c_custkey").alias("src"), key("N", "c_nationkey").alias("dst"), F.lit(1).alias("n"))
    links = homes.union(s.select(key("S", "s_suppkey"), key("N", "s_nationkey"), F.lit(2))).union(n.select(key("N", "n_nationkey"), key("C", "n_nationkey"), F.lit(5)))
    return links, nodes


@query(f"WITH {_PLACES} SELECT place_id, name, type, activity FROM mb")
def place_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15."""
    return P.place_members(*_places(spark, sf_dir))


@query(f"WITH {_PLACES} SELECT place_id, place AS name, count(*) AS entities, CAST(sum(activity) AS BIGINT) AS activity, round(100 * sum(activity) / greatest(max(sum(activity)) OVER (), 1), 2) AS share FROM mb GROUP BY 1, 2")
def linked_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8."""
    return P.linked_places(*_places(spark, sf_dir))


@query(f"WITH {BASE} SELECT * FROM (SELECT 'node' AS kind, id FROM vs ORDER BY id LIMIT 40) UNION ALL SELECT * FROM (SELECT 'edge', edge_id FROM es ORDER BY edge_id LIMIT 80)")
def capped_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of bounded size, in a stated order."""
    v, e = G.capped(vertices(spark, sf_dir), edges(spark, sf_dir), 40)
    return v.select(F.lit("node").alias("kind"), "id").union(e.select(F.lit("edge"), "edge_id"))


@query(f"WITH {BASE} SELECT 'Review connection between ' || src || ' and ' || dst AS title, 'Corroborate communication and co-location frequency. Strength: ' || strength * 12 || '.' AS detail, CASE WHEN strength * 12 > 70 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM es ORDER BY edge_id LIMIT 3")
def contact_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9."""
    return R.contact_leads(edges(spark, sf_dir).withColumn("strength", F.col("strength") * 12))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name || ' (' || c_custkey || ')' AS caller, 'None (' || o_orderpriority || ')' AS receiver, CAST(floor(o_totalprice) AS BIGINT) || 's' AS duration, o_orderdate AS ts, 'Voice Call' AS type, c_mktsegment AS location, o_orderstatus = 'F' AS flagged
  FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def case_communications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the latest calls as they are shown."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    calls = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("caller_name"), F.col("c_custkey").cast("string").alias("caller_number"), F.lit(None).cast("string").alias("callee_name"), F.col("o_orderpriority").alias("callee_number"), F.floor("o_totalprice").alias("seconds"), F.col("o_orderdate").alias("ts"), F.lit("").alias("kind"), F.col("c_mktsegment").alias("place"), (F.col("o_orderstatus") == "F").alias("flagged"))
    return R.contact_rows(calls)


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of a customer and the same one's order, some decided already, and the decisions made on them."""
    o = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    pairs = o.select(F.col("o_custkey").alias("id_a"), key.alias("id_b"), F.concat(F.lit("person "), F.col("o_custkey").cast("string")).alias("name_a"), F.concat(F.lit("record "), key.cast("string")).alias("name_b"), (key % 100).alias("confidence"), F.when(key % 5 == 0, "REJECTED").otherwise("PENDING_REVIEW").alias("review_status"))
    decision = F.when(key % 4 == 0, "CONFIRMED_ALIAS").when(key % 4 == 1, "REJECTED").otherwise("CONFIRMED_SAME_ENTITY")
    made = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id_a"), key.alias("id_b"), decision.alias("decision"), F.col("o_orderpriority").alias("reviewer"), F.lit("seen").alias("note"))
    return pairs, made


_REVIEWS = """pr AS (SELECT o_custkey AS id_a, o_orderkey AS id_b, 'person ' || o_custkey AS name_a, 'record ' || o_orderkey AS name_b, o_orderkey % 100 AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN 'REJECTED' ELSE 'PENDING_REVIEW' END AS review_status FROM orders),
  dc AS (SELECT o_custkey AS id_a, o_orderkey AS id_b, CASE o_orderkey % 4 WHEN 0 THEN 'CONFIRMED_ALIAS' WHEN 1 THEN 'REJECTED' ELSE 'CONFIRMED_SAME_ENTITY' END AS decision, o_orderpriority AS reviewer FROM orders WHERE o_orderstatus = 'F')"""


@query(f"WITH {_REVIEWS} SELECT id_a, id_b, CASE WHEN review_status = 'PENDING_REVIEW' THEN coalesce(decision, review_status) ELSE review_status END AS review_status, reviewer FROM pr LEFT JOIN dc USING (id_a, id_b)")
def reviewed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions."""
    return E.reviewed(*_reviews(spark, sf_dir)).select("id_a", "id_b", "review_status", "reviewer")


@query(f"""WITH {_REVIEWS} SELECT id_a, id_b, reviewer AS user_id, 'ENTITY_RESOLUTION_' || decision AS action, '[Decision: ' || decision || '] ' || name_a || ' and ' || name_b || ' (confidence ' || confidence || '%)' AS detail,
  sha256(concat_ws('|', id_a, id_b, name_a, name_b, confidence, decision, reviewer)) AS decision_hash FROM pr JOIN dc USING (id_a, id_b) WHERE review_status = 'PENDING_REVIEW'""")
def review_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows."""
    return E.review_audit(*_reviews(spark, sf_dir))


@query(f"""WITH {_REVIEWS}, nw AS (SELECT id_a AS id, list_sort(list_distinct(list(CAST(id_b % 7 AS VARCHAR)))) AS names FROM dc WHERE decision LIKE 'CONFIRMED%' GROUP BY 1)
  SELECT c_custkey AS id, c_name AS name, ['3'] || coalesce(list_filter(names, lambda x: x <> '3'), []) AS aliases FROM customer LEFT JOIN nw ON id = c_custkey""")
def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of confirmed pairs."""
    people = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.lit("3")).alias("aliases"))
    matches = E.confirmed(_reviews(spark, sf_dir)[1]).select(F.col("id_a").alias("id"), (F.col("id_b") % 7).cast("string").alias("name"))
    return E.merged_aliases(people, matches).select("id", "name", "aliases")


def _with_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit features and a hundred made pairs with many visits at night on few days."""
    i = F.col("id")
    made = spark.range(100).select(F.concat(F.lit("SYNTH_ANOMALY_"), i.cast("string")).alias("person_id"), F.concat(F.lit("LOC_"), i.cast("string")).alias("location_id"), (50 + i * 37 % 150).alias("visit_count"), (1 + i % 4).alias("unique_days"), F.lit(60.0).alias("average_time_between_visits_sec"), F.lit(0.95).alias("night_visit_ratio"), F.lit(0.9).alias("weekend_visit_ratio"), F.lit(1).cast("long").alias("unique_event_types"), F.lit(1).cast("long").alias("unique_cases"), F.lit(5).cast("long").alias("duration_days"), F.lit(0.0).alias("location_entropy"))
    own = B.person_location_features(V.events(spark, sf_dir)).withColumn("person_id", F.col("person_id").cast("string"))
    return K.with_injected(own, made)


@query(f"""WITH ow AS ({SQL["person_location_features"]}) SELECT CAST(person_id AS VARCHAR) AS person_id, location_id, visit_count, unique_days, night_visit_ratio, visit_prob, location_entropy, CAST(0 AS INT) AS is_injected FROM ow
  UNION ALL SELECT 'SYNTH_ANOMALY_' || i, 'LOC_' || i, 50 + i * 37 % 150, 1 + i % 4, 0.95, 0, 0, 1 FROM range(100) t(i)""")
def injected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made anomalies among the features."""
    return _with_injected(spark, sf_dir).select("person_id", "location_id", "visit_count", "unique_days", "night_visit_ratio", "visit_prob", "location_entropy", "is_injected")


@query()
def injected_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U7, A27 of the forest: how many made anomalies it flags."""
    names = ("visit_count", "unique_days", "unique_event_types", "unique_cases", "night_visit_ratio", "weekend_visit_ratio", "duration_days", "visit_prob", "location_entropy")
    return K.injected_metrics(K.anomalies(_with_injected(spark, sf_dir), names, key=("person_id", "location_id")), ("person_id", "location_id"))


@query()
def injected_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U7, A27 of the forest: how many rows are flagged that were moved away from the mean by 1 to 8 standard deviations, and of the others."""
    names = ("visit_count", "unique_days", "unique_event_types", "unique_cases", "night_visit_ratio", "weekend_visit_ratio", "duration_days", "visit_prob", "location_entropy")
    rows = K.shifted(B.person_location_features(V.events(spark, sf_dir)), names, ("person_id", "location_id"), (1, 2, 3, 4, 6, 8))
    return K.flagged_by_distance(K.anomalies(rows, names, key=("distance", "person_id", "location_id")))


@query("""SELECT row_number() OVER (ORDER BY c_custkey) AS row_index, CAST(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_nationkey': c_nationkey}) AS VARCHAR) AS raw,
  CAST(to_json({'c_custkey': CAST(c_custkey AS VARCHAR), 'c_mktsegment': trim(c_mktsegment), 'c_nationkey': CAST(c_nationkey AS VARCHAR)}) AS VARCHAR) AS normalized FROM customer""")
def ingested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON, numbered in their order."""
    return S.ingested(load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_custkey"])


@query(f"WITH {V.CASES_SQL}, {V.CONTACTS_SQL} SELECT 'cases' AS name, count(*) AS n FROM cs UNION ALL SELECT 'communications', count(*) FROM ct WHERE kind = 'call' UNION ALL SELECT 'transactions', count(*) FROM ct WHERE kind = 'transaction' UNION ALL SELECT 'evidence', count(*) FROM documents")
def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes by name."""
    return R.counted(V.scoped(spark, sf_dir, "cases", "communications", "transactions", "evidence"))
