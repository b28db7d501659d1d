"""Graph operators over the network of all customers, suppliers and lines, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import graph as G
from caseloom.plans.views import order_lines
from caseloom.registry import load, query


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    risk = lambda v: (F.abs(F.floor(v)) % 100).cast("int")
    people = c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("PERSON").alias("type"), risk("c_acctbal").alias("risk"))
    firms = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("ORGANIZATION").alias("type"), risk("s_acctbal").alias("risk"))
    return people.union(firms)


def edge_key() -> Column:
    return F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_lines(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem"))
    return rows.select(edge_key().alias("edge_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"), F.when(F.col("l_returnflag") == "R", "TRANSACTION").otherwise("COMMUNICATION").alias("type"), F.col("l_linenumber").alias("strength"))


BASE = f"""vs AS (SELECT 'C' || c_custkey AS id, c_name AS name, 'PERSON' AS type, CAST(abs(CAST(floor(c_acctbal) AS BIGINT)) % 100 AS INT) AS risk FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, 'ORGANIZATION', CAST(abs(CAST(floor(s_acctbal) AS BIGINT)) % 100 AS INT) FROM supplier),
  es AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS edge_id, 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'TRANSACTION' ELSE 'COMMUNICATION' END AS type, l_linenumber AS strength FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
  nb AS (SELECT src AS id, dst AS other FROM es WHERE src <> dst UNION SELECT dst, src FROM es WHERE src <> dst)"""
#: Distances by recursion, at most so deep.
_CC = "cc AS (SELECT id, id AS component FROM vs UNION SELECT nb.other, cc.component FROM cc JOIN nb ON cc.id = nb.id WHERE nb.other > cc.component), lb AS (SELECT id, min(component) AS component FROM cc GROUP BY 1)"


@query(f"""WITH {BASE} SELECT vs.id, coalesce(d.n, 0) AS degree, coalesce(e.n, 0) AS edge_count, round(coalesce(d.n, 0) / ((SELECT count(*) FROM vs) - 1), 4) AS degree_centrality FROM vs LEFT JOIN (SELECT id, count(*) AS n FROM nb GROUP BY 1) d USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM es UNION ALL SELECT dst FROM es) GROUP BY 1) e USING (id)""")
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, A8."""
    return G.degrees(vertices(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {BASE} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, CAST(sum(strength) AS BIGINT) AS strength FROM es GROUP BY 1, 2")
def graph_pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15."""
    return G.pair_weights(edges(spark, sf_dir))


@query(f"WITH RECURSIVE {BASE}, {_CC} SELECT id, component FROM lb")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G7."""
    return G.components(vertices(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {BASE}, {_CC}, t AS (SELECT component, type, count(*) AS n FROM vs JOIN lb USING (id) GROUP BY 1, 2), dg AS (SELECT vs.id, component, coalesce(n, 0) AS degree FROM vs JOIN lb USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM nb GROUP BY 1) USING (id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY degree DESC, id) AS n FROM dg), b AS (SELECT component, count(*) AS node_count, round(avg(risk), 0) AS average_risk FROM vs JOIN lb USING (id) GROUP BY 1), i AS (SELECT component, count(*) AS edge_count FROM es JOIN lb ON src = id GROUP BY 1)
  SELECT b.component, node_count, average_risk, coalesce(edge_count, 0) AS edge_count, (SELECT type FROM t WHERE t.component = b.component ORDER BY n DESC, type LIMIT 1) AS dominant_type, (SELECT list(id ORDER BY n) FROM r WHERE r.component = b.component AND n <= 4) AS key_members,
  CASE WHEN node_count > 1 THEN round(coalesce(edge_count, 0) * 2 / (node_count * (node_count - 1)), 3) ELSE 1.0 END AS density FROM b LEFT JOIN i USING (component)""")
def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, W3, C2."""
    v, e = vertices(spark, sf_dir), edges(spark, sf_dir)
    return G.communities(v, e, G.components(v, e))


@query(f"""WITH RECURSIVE {BASE}, {_CC} SELECT n AS nodes, m AS edges, (SELECT count(*) FROM vs WHERE id NOT IN (SELECT id FROM nb)) AS isolates, (SELECT count(DISTINCT component) FROM lb) AS components, round(m * 2 / (n * (n - 1)), 4) AS density, round(2 * m / n, 2) AS average_degree FROM (SELECT count(*) AS n FROM vs), (SELECT count(*) AS m FROM es)""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24."""
    v, e = vertices(spark, sf_dir), edges(spark, sf_dir)
    return G.graph_stats(v, e, G.components(v, e))


_NEAR3 = "d0 AS (SELECT 'S1' AS id, 0 AS hop), d1 AS (SELECT id, min(hop) AS hop FROM (SELECT * FROM d0 UNION ALL SELECT other, 1 FROM d0 JOIN nb USING (id)) GROUP BY 1), d2 AS (SELECT id, min(hop) AS hop FROM (SELECT * FROM d1 UNION ALL SELECT other, hop + 1 FROM d1 JOIN nb USING (id)) GROUP BY 1)"


@query(f"WITH {BASE}, {_NEAR3} SELECT id, CAST(hop AS INT) AS hop FROM d2")
def ego_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10."""
    return G.ego_network(edges(spark, sf_dir), vertices(spark, sf_dir).where("id = 'S1'"), 2)[0]


@query(f"WITH {BASE}, {_NEAR3} SELECT edge_id, src, dst FROM es WHERE src IN (SELECT id FROM d2) AND dst IN (SELECT id FROM d2)")
def ego_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10, J1."""
    return G.ego_network(edges(spark, sf_dir), vertices(spark, sf_dir).where("id = 'S1'"), 2)[1].select("edge_id", "src", "dst")


_ALL = """dt AS (SELECT id AS source, id, 0 AS dist FROM vs UNION ALL SELECT * FROM (SELECT DISTINCT dt.source, nb.other AS id, dt.dist + 1 AS dist FROM dt JOIN nb ON dt.id = nb.id WHERE dt.dist < 14 AND NOT EXISTS (SELECT 1 FROM recurring.dt r WHERE r.source = dt.source AND r.id = nb.other)))"""
_KEYED = """dt(source, id, dist) USING KEY (source, id) AS (SELECT id AS source, id, 0 AS dist FROM vs UNION SELECT DISTINCT dt.source, nb.other, dt.dist + 1 FROM dt JOIN nb ON dt.id = nb.id LEFT JOIN recurring.dt r ON r.source = dt.source AND r.id = nb.other WHERE r.id IS NULL)"""


@query(f"""WITH RECURSIVE {BASE}, {_KEYED} SELECT vs.id, coalesce(round(r / ((SELECT count(*) FROM vs) - 1) * (r / d), 4), 0) AS closeness FROM vs LEFT JOIN (SELECT source AS id, count(*) AS r, sum(dist) AS d FROM dt WHERE dist > 0 GROUP BY 1) USING (id)""")
def graph_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    return G.closeness(vertices(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH RECURSIVE {BASE}, {_KEYED} SELECT max(dist) AS diameter_estimate FROM dt WHERE source IN (SELECT id FROM vs ORDER BY id LIMIT 15)")
def graph_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G14."""
    return G.diameter_estimate(vertices(spark, sf_dir), edges(spark, sf_dir))


_STEP = "r{k} AS MATERIALIZED (SELECT vs.id, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{j} WHERE id NOT IN (SELECT id FROM kk))) / (SELECT count(*) FROM vs) + 0.85 * coalesce(g, 0) AS rank FROM vs LEFT JOIN (SELECT nb.other AS id, sum(rank / k) AS g FROM nb JOIN kk ON nb.id = kk.id JOIN r{j} ON nb.id = r{j}.id GROUP BY 1) USING (id))"


@query(f"WITH {BASE}, kk AS (SELECT id, count(*) AS k FROM nb GROUP BY 1), r0 AS (SELECT id, CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM vs) AS rank FROM vs), {', '.join(_STEP.format(k=i, j=i - 1) for i in range(1, 41))} SELECT id, round(rank, 8) AS pagerank FROM r40")
def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6."""
    return G.pagerank(vertices(spark, sf_dir), edges(spark, sf_dir), digits=8)


#: Shortest paths forward and shares back, by level; no vertex of the network is further than LEVELS from another (the SQL returns nothing if one is).
LEVELS = 6
_FORWARD = "f{l} AS MATERIALIZED (SELECT f.source, nb.other AS id, sum(f.n) AS n FROM f{k} f JOIN nb ON f.id = nb.id JOIN dt ON dt.source = f.source AND dt.id = nb.other AND dt.dist = {l} GROUP BY 1, 2)"
_BACK = "g{l} AS MATERIALIZED (SELECT f.source, f.id, f.n, f.n * coalesce(h.part, 0) AS share FROM f{l} f LEFT JOIN (SELECT g.source, nb.other AS id, sum((1 + g.share) / g.n) AS part FROM g{k} g JOIN nb ON g.id = nb.id GROUP BY 1, 2) h ON f.source = h.source AND f.id = h.id)"
_BETWEEN = f"""{_KEYED.replace('dt(source, id, dist)', 'dq(source, id, dist)').replace('dt.', 'dq.').replace('FROM dt', 'FROM dq').replace('recurring.dt', 'recurring.dq')}, dt AS MATERIALIZED (SELECT * FROM dq), f0 AS (SELECT id AS source, id, CAST(1 AS DOUBLE) AS n FROM vs), {", ".join(_FORWARD.format(l=i, k=i - 1) for i in range(1, LEVELS + 1))},
  g{LEVELS} AS (SELECT source, id, n, CAST(0 AS DOUBLE) AS share FROM f{LEVELS}), {", ".join(_BACK.format(l=i, k=i + 1) for i in range(LEVELS - 1, 0, -1))}, bw AS MATERIALIZED (SELECT vs.id, round(coalesce(s, 0) / ((SELECT count(*) FROM vs) - 1) / ((SELECT count(*) FROM vs) - 2), 6) AS betweenness FROM vs LEFT JOIN (SELECT id, sum(share) AS s FROM ({" UNION ALL ".join(f"SELECT id, share FROM g{i}" for i in range(1, LEVELS + 1))}) GROUP BY 1) USING (id) WHERE (SELECT max(dist) FROM dt) <= {LEVELS})"""
_RANKS = f"kk AS (SELECT id, count(*) AS k FROM nb GROUP BY 1), r0 AS (SELECT id, CAST(1.0 AS DOUBLE) / (SELECT count(*) FROM vs) AS rank FROM vs), {', '.join(_STEP.format(k=i, j=i - 1) for i in range(1, 41))}"
_METRICS = f"""{BASE}, {_CC}, {_BETWEEN}, {_RANKS}, cn AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) AS community_id FROM lb GROUP BY 1),
  mt AS (SELECT vs.id, coalesce(d.n, 0) AS degree, coalesce(e.n, 0) AS edge_count, round(coalesce(d.n, 0) / ((SELECT count(*) FROM vs) - 1), 4) AS degree_centrality, betweenness, coalesce(round(r / ((SELECT count(*) FROM vs) - 1) * (r / s), 4), 0) AS closeness, round(rank, 4) AS pagerank, lb.component, community_id
    FROM vs JOIN bw USING (id) JOIN r40 USING (id) JOIN lb USING (id) JOIN cn USING (component) LEFT JOIN (SELECT id, count(*) AS n FROM nb GROUP BY 1) d USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM es UNION ALL SELECT dst FROM es) GROUP BY 1) e USING (id) LEFT JOIN (SELECT source AS id, count(*) AS r, sum(dist) AS s FROM dt WHERE dist > 0 GROUP BY 1) c USING (id)),
  im AS (SELECT *, round(3.5::DOUBLE * degree_centrality + 3.5::DOUBLE * betweenness + 1.5::DOUBLE * closeness + 1.5::DOUBLE * pagerank * (SELECT count(*) FROM vs), 2) AS importance FROM mt), ik AS (SELECT *, row_number() OVER (ORDER BY importance DESC, id) AS rank FROM im)"""


@query(f"WITH RECURSIVE {BASE}, {_BETWEEN} SELECT id, betweenness FROM bw")
def graph_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    return G.betweenness(vertices(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_METRICS} SELECT id, degree, edge_count, degree_centrality, betweenness, closeness, pagerank, importance, rank, community_id, component, concat_ws(' ', CASE WHEN degree >= 4 THEN 'High direct connectivity with ' || degree || ' direct links (Hub Entity).' WHEN degree > 1 THEN 'Moderate connectivity with ' || degree || ' links in Cluster #' || community_id || '.'
  WHEN degree = 1 THEN 'Single peripheral relationship in Cluster #' || community_id || '.' ELSE 'Isolated node with no active recorded relationships.' END, CASE WHEN betweenness >= 0.15 THEN 'Critical network bridge routing high-frequency multi-hop interactions.' WHEN betweenness > 0.05 THEN 'Intermediary broker connecting multiple sub-graphs.' END, CASE WHEN pagerank > 0.1 THEN 'High PageRank influence propagated from neighboring central nodes.' END) AS reason FROM ik""")
def graph_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4, G6, G11, G13, W1."""
    v, e = vertices(spark, sf_dir), edges(spark, sf_dir)
    out = G.importance(G.degrees(v, e), G.betweenness(v, e), G.closeness(v, e), G.pagerank(v, e))
    return G.importance_reason(out.join(G.community_ids(G.components(v, e)), "id"))


@query(f"""WITH RECURSIVE {_METRICS}, b AS (SELECT component, count(*) AS n FROM lb GROUP BY 1), i AS (SELECT component, count(*) AS m FROM es JOIN lb ON src = id WHERE src <> dst GROUP BY 1)
  SELECT type, id, severity FROM (SELECT 'HUB_ENTITY' AS type, id, CASE WHEN degree >= 5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM ik WHERE degree >= 3 ORDER BY rank LIMIT 3) UNION ALL SELECT * FROM (SELECT 'BRIDGE_NODE', id, 'HIGH' FROM ik WHERE betweenness > 0.1 AND degree >= 2 ORDER BY rank LIMIT 3)
  UNION ALL SELECT 'DENSE_CELL', component, 'MEDIUM' FROM b LEFT JOIN i USING (component) WHERE n >= 3 AND round(coalesce(m, 0) * 2 / (n * (n - 1)), 3) >= 0.5""")
def graph_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12, W2, on betweenness."""
    v, e = vertices(spark, sf_dir), edges(spark, sf_dir)
    m = G.importance(G.degrees(v, e), G.betweenness(v, e), G.closeness(v, e), G.pagerank(v, e))
    return G.patterns(m, G.communities(v, e, G.components(v, e)))


_PATHS = """p1 AS (SELECT [nd, next] AS path, [edge_id] AS edge_ids, next AS nd FROM b WHERE nd = 'S1'), p2 AS (SELECT list_append(path, next) AS path, list_append(edge_ids, edge_id) AS edge_ids, next AS nd FROM p1 JOIN b USING (nd) WHERE p1.nd <> 'S2' AND NOT list_contains(path, next)),
  p3 AS (SELECT list_append(path, next) AS path, list_append(edge_ids, edge_id) AS edge_ids, next AS nd FROM p2 JOIN b USING (nd) WHERE p2.nd <> 'S2' AND NOT list_contains(path, next)), p4 AS (SELECT list_append(path, next) AS path, list_append(edge_ids, edge_id) AS edge_ids, next AS nd FROM p3 JOIN b USING (nd) WHERE p3.nd <> 'S2' AND NOT list_contains(path, next))"""


@query(f"""WITH {BASE}, b AS (SELECT edge_id, src AS nd, dst AS next FROM es UNION ALL SELECT edge_id, dst, src FROM es), {_PATHS} SELECT CAST(len(edge_ids) AS INT) AS hops, count(*) AS paths, min(path) AS first_path FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) WHERE nd = 'S2' GROUP BY 1""")
def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths, summed up by length."""
    return G.simple_paths(edges(spark, sf_dir), "S1", "S2").groupBy("hops").agg(F.count("*").alias("paths"), F.min("path").alias("first_path"))


@query(f"""WITH {BASE}, b AS (SELECT NULL AS edge_id, id AS nd, other AS next FROM nb), {_PATHS} SELECT path, CAST(len(path) - 1 AS INT) AS hops FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) WHERE nd = 'S2' ORDER BY len(path), path LIMIT 1""")
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9, C1."""
    return G.shortest_path(edges(spark, sf_dir), "S1", "S2")


@query(f"""WITH {BASE}, n AS (SELECT other, count(*) AS n FROM nb WHERE id IN ('S1', 'S2') GROUP BY 1) SELECT count(*) FILTER (n = 2) AS common, round(coalesce(count(*) FILTER (n = 2) / nullif(count(*), 0), 0), 4) AS jaccard FROM n""")
def graph_common_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, U8."""
    return G.common_neighbours(edges(spark, sf_dir), "S1", "S2")


@query(f"""WITH {BASE}, h AS (SELECT id FROM vs WHERE contains(lower(concat_ws(' ', id, name, type, risk)), '00001')), a AS (SELECT id FROM h UNION SELECT other FROM nb WHERE id IN (SELECT id FROM h)) SELECT id, type, risk FROM vs WHERE id IN (SELECT id FROM a) AND risk >= 20 AND type = 'PERSON'""")
def network_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F10, C3."""
    return G.search_network(vertices(spark, sf_dir), edges(spark, sf_dir), "00001", ["person"], 20)[0].select("id", "type", "risk")


@query(f"WITH {BASE} SELECT type, n, round(100 * n / sum(n) OVER (), 1) AS share FROM (SELECT type, count(*) AS n FROM es GROUP BY 1)")
def link_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    from caseloom.operators.records import shares

    return shares(edges(spark, sf_dir), "type", 10).withColumnRenamed("value", "type")


@query(f"WITH {BASE} SELECT type, count(*) AS n FROM vs GROUP BY 1")
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    return vertices(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {BASE}, u AS (SELECT id, name, type, 0 AS part FROM vs UNION ALL SELECT 'C' || o_custkey, o_orderpriority, 'CASE', 1 FROM orders UNION ALL SELECT 'O' || o_orderkey, o_orderpriority, 'CASE', 1 FROM orders) SELECT id, arg_min(name, (part, name)) AS name, arg_min(type, (part, name)) AS type FROM u GROUP BY 1")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first definition of an id stays."""
    o = load(spark, sf_dir, "orders")
    again = o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("name"), F.lit("CASE").alias("type"))
    docket = o.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("name"), F.lit("CASE").alias("type"))
    return G.merged_vertices(vertices(spark, sf_dir).drop("risk"), again.union(docket))


@query(f"WITH {BASE} SELECT e.edge_id, a.name AS source_name, b.name AS target_name, e.type, e.strength FROM es e JOIN vs a ON e.src = a.id JOIN vs b ON e.dst = b.id WHERE e.type = 'COMMUNICATION'")
def named_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, J2, J16."""
    c, f, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier"), load(spark, sf_dir, "orders")
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag is null or l_returnflag != 'R'")
    # Names are joined by the tables' own keys, to orders before these meet their lines; ids are made at the end.
    rows = order_lines(
        o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("source_name")), "o_custkey").select("o_orderkey", "source_name"),
        lines.join(f.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("target_name")), "l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "target_name"),
        lines.count(),
    )
    return rows.select(edge_key().alias("edge_id"), "source_name", "target_name", F.lit("COMMUNICATION").alias("type"), F.col("l_linenumber").alias("strength"))


@query(f"WITH {BASE} SELECT edge_id, CASE WHEN src = 'S1' THEN dst ELSE src END AS other_id, type FROM es WHERE src = 'S1' OR dst = 'S1'")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12."""
    return edges(spark, sf_dir).where("src = 'S1' or dst = 'S1'").select("edge_id", F.when(F.col("src") == "S1", F.col("dst")).otherwise(F.col("src")).alias("other_id"), "type")
