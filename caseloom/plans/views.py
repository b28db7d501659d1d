"""Role views: the driver's tables as events, contacts, nodes, edges, cases and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.behaviour import lead_features
from caseloom.operators.graph import DEALT, dealt
from caseloom.registry import load


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, person_id, location_id, ts, event_type, case_id, value)."""
    e = load(spark, sf_dir, "events")
    place = F.concat_ws("-", "event_type", (F.floor("value") % 40).cast("string"))
    return e.select("event_id", F.col("user_id").alias("person_id"), place.alias("location_id"), "ts", "event_type", F.get_json_object("props", "$.k").alias("case_id"), "value")


EVENTS_SQL = "ev AS (SELECT event_id, user_id AS person_id, event_type || '-' || CAST(CAST(floor(value) AS BIGINT) % 40 AS VARCHAR) AS location_id, ts, event_type, json_extract_string(props, '$.k') AS case_id, value FROM events)"


def order_lines(orders: DataFrame, lines: DataFrame, n: int | None = None) -> DataFrame:
    """Orders with their lines, n or counted here. Where lines are many, they are dealt out in tasks of bounded size; few are left to Spark."""
    if (n := lines.count() if n is None else n) > 8 * DEALT:
        orders, lines = dealt(orders, n, "o_orderkey"), dealt(lines, n, "l_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p1, p2, kind, duration, amount, case_id): a call for each line of an order, and a transaction for each that came back; one pass over the lines."""
    rows = order_lines(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"))
    p1, p2 = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    null = lambda kind: F.lit(None).cast(kind)
    of = lambda a, b, kind, duration, amount: F.struct(a.alias("p1"), b.alias("p2"), F.lit(kind).alias("kind"), duration.alias("duration"), amount.alias("amount"))
    call = of(p1, p2, "call", F.col("l_quantity"), null("double"))
    money = of(p2, p1, "transaction", null(dict(rows.dtypes)["l_quantity"]), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4))
    both = F.when(F.col("l_returnflag") == "R", F.array(call, money)).otherwise(F.array(call))
    return rows.select(F.explode(both).alias("c"), F.col("o_orderpriority").alias("case_id")).select("c.*", "case_id")


CONTACTS_SQL = """ct AS (SELECT 'C' || o_custkey AS p1, 'S' || l_suppkey AS p2, 'call' AS kind, l_quantity AS duration, NULL::DOUBLE AS amount, o_orderpriority AS case_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT 'S' || l_suppkey, 'C' || o_custkey, 'transaction', NULL, round(l_extendedprice * (1 - l_discount), 4), o_orderpriority FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')"""


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lead_features() of the contacts, of which each line makes two at most."""
    return lead_features(contacts(spark, sf_dir), 2 * load(spark, sf_dir, "lineitem").count())


def contact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p1, p2, source, record_id): the records that contacts() has of each unordered pair."""
    rows = order_lines(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"))
    p1, p2 = F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    record = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
    sources = F.explode(F.when(F.col("l_returnflag") == "R", F.array(F.lit("calls"), F.lit("transactions"))).otherwise(F.array(F.lit("calls"))))
    return rows.select(F.least(p1, p2).alias("p1"), F.greatest(p1, p2).alias("p2"), sources.alias("source"), record.alias("record_id"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, opened, status, category, risk, place): orders with their customers' places."""
    o, c, n, r = (load(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    place = F.concat_ws(", ", "n_name", "r_name")
    status = F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("ACTIVE")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("opened"), status.alias("status"), F.col("o_orderpriority").alias("category"), (F.floor("o_totalprice") % 11).cast("int").alias("risk"), place.alias("place"), F.col("o_custkey").alias("owner_id"))


CASES_SQL = """cs AS (SELECT o_orderkey AS case_id, o_orderdate AS opened, CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'ACTIVE' END AS status, o_orderpriority AS category,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 11 AS INT) AS risk, n_name || ', ' || r_name AS place, o_custkey AS owner_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, event_type, subject, state, district, place, lat, lon, flagged, ts): orders and customers as located activity."""
    c, n, r, o = (load(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    home = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = o.join(home, F.col("o_custkey") == F.col("c_custkey"))
    lat, lon = (F.col("n_nationkey") % 20 - 2).cast("double"), (F.col("n_nationkey") * 3 % 50 + 1).cast("double")
    return rows.select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 3, 20).alias("source"), F.col("o_orderstatus").alias("event_type"), F.col("c_name").alias("subject"), F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.col("c_mktsegment").alias("place"), lat.alias("lat"), lon.alias("lon"), (F.col("o_totalprice") > 400000).alias("flagged"), F.col("o_orderdate").alias("ts"))


ACTIVITY_SQL = """ac AS (SELECT o_orderkey AS id, substr(o_orderpriority, 3, 20) AS source, o_orderstatus AS event_type, c_name AS subject, r_name AS state, n_name AS district, c_mktsegment AS place,
  CAST(n_nationkey % 20 - 2 AS DOUBLE) AS lat, CAST(n_nationkey * 3 % 50 + 1 AS DOUBLE) AS lon, o_totalprice > 400000 AS flagged, o_orderdate AS ts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


#: What a client may ask for by name; a scope is read only if it is asked for.
SCOPES = {
    "cases": cases,
    "events": events,
    "communications": lambda spark, sf_dir: contacts(spark, sf_dir).where("kind = 'call'"),
    "transactions": lambda spark, sf_dir: contacts(spark, sf_dir).where("kind = 'transaction'"),
    "locations": activity,
    "entities": lambda spark, sf_dir: load(spark, sf_dir, "customer"),
    "evidence": lambda spark, sf_dir: load(spark, sf_dir, "documents"),
    "blocks": lambda spark, sf_dir: load(spark, sf_dir, "pages"),
}


def scoped(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named scopes, all without a name; ValueError for one that does not exist."""
    if unknown := set(names) - set(SCOPES):
        raise ValueError(f"no scope {', '.join(sorted(unknown))}")
    return {n: SCOPES[n](spark, sf_dir) for n in names or SCOPES}
