"""Operators on small tables with known answers."""

import datetime
import difflib
import inspect
import itertools
import math
import random
from collections import Counter
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import behaviour, explain, graph, ledger, ml, places, ranking, records, resolution, temporal, text
from caseloom.sources import files


def network(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p} | set(extra))
    v = spark.createDataFrame([(i, f"n{i}", "PERSON", 10) for i in ids], "id string, name string, type string, risk int")
    return v, spark.createDataFrame([(f"e{k}", a, b, 1) for k, (a, b) in enumerate(pairs)], "edge_id string, src string, dst string, strength int")


def as_dict(df, value):
    return {r["id"]: r[value] for r in df.collect()}


def test_path_and_isolate(spark):
    v, e = network(spark, [("a", "b"), ("b", "c"), ("b", "c")], extra=["z"])
    assert as_dict(graph.betweenness(v, e), "betweenness") == {"a": 0, "b": pytest.approx(2 / 6, abs=1e-6), "c": 0, "z": 0}
    assert as_dict(graph.closeness(v, e), "closeness") == {"a": round(2 / 3 * 2 / 3, 4), "b": round(2 / 3, 4), "c": round(2 / 3 * 2 / 3, 4), "z": 0}
    assert as_dict(graph.components(v, e), "component") == {"a": "a", "b": "a", "c": "a", "z": "z"}
    assert as_dict(graph.degrees(v, e), "edge_count") == {"a": 1, "b": 3, "c": 2, "z": 0}
    assert sum(as_dict(graph.pagerank(v, e, digits=12), "pagerank").values()) == pytest.approx(1)
    paths = graph.simple_paths(e, "a", "c").collect()
    assert len(paths) == 2 and all(r["path"] == ["a", "b", "c"] for r in paths)
    assert graph.shortest_path(e, "a", "c").first()["path"] == ["a", "b", "c"] and graph.shortest_path(e, "a", "z").count() == 0


def betweenness_brute(ids, pairs):
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} - {i} for i in ids}
    total = dict.fromkeys(ids, 0.0)

    def reach(s):
        dist, ways, front = {s: 0}, {s: 1}, [s]
        while front:
            after = {}
            for v in front:
                for w in near[v]:
                    if w not in dist or w in after:
                        after[w] = after.get(w, 0) + ways[v]
            dist |= {w: dist[front[0]] + 1 for w in after}
            ways |= after
            front = list(after)
        return dist, ways

    found = {s: reach(s) for s in ids}
    for s in ids:
        for t in found[s][0]:
            for v in ids:
                if v not in (s, t) and v in found[s][0] and t in found[v][0] and found[s][0][v] + found[v][0][t] == found[s][0][t]:
                    total[v] += found[s][1][v] * found[v][1][t] / found[s][1][t]
    return {v: round(x / ((len(ids) - 1) * (len(ids) - 2)), 6) for v, x in total.items()}


def test_betweenness_against_pairs_of_ends(spark):
    rng = random.Random(6)
    ids = [f"v{i}" for i in range(30)]
    pairs = [tuple(rng.sample(ids[:22], 2)) for _ in range(34)] + [("v24", "v25"), ("v25", "v26"), ("v26", "v26"), ("v27", "v28")]
    v, e = network(spark, pairs, extra=ids)
    want = pytest.approx(betweenness_brute(ids, pairs), abs=2e-6)
    assert as_dict(graph.betweenness(v, e), "betweenness") == want
    assert as_dict(graph.betweenness(v, e, sources=4, rows=3), "betweenness") == want  # several rows a vertex, several passes
    assert set(as_dict(graph.betweenness(v, e.limit(0)), "betweenness").values()) == {0.0}


def test_closeness_and_betweenness_over_several_blocks_and_components(spark):
    rng = random.Random(11)
    pairs = {(f"v{a:02}", f"v{b:02}") for a, b in (rng.sample(range(11), 2) for _ in range(22))} | {(f"w{i}", f"w{i + 1}") for i in range(3)}
    v, e = network(spark, sorted(pairs), extra=["z"])
    ids = [r["id"] for r in v.collect()]
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in ids}
    want = {}
    for i in ids:
        dist, front = {i: 0}, [i]
        while front:
            front = sorted({o for f in front for o in near[f]} - dist.keys())
            dist |= dict.fromkeys(front, max(dist.values()) + 1)
        r, d = len(dist) - 1, sum(dist.values())
        want[i] = round(r / (len(ids) - 1) * (r / d), 4) if d else 0
    assert as_dict(graph.closeness(v, e, size=8), "closeness") == pytest.approx(want, abs=1.1e-4)
    assert as_dict(graph.betweenness(v, e, sources=12, size=8), "betweenness") == pytest.approx(betweenness_brute(ids, pairs), abs=2e-6)


def test_pagerank_with_vertices_without_neighbours(spark):
    ids, pairs = [f"v{i}" for i in range(12)], [("v0", "v1"), ("v1", "v2"), ("v2", "v0"), ("v3", "v0"), ("v4", "v5"), ("v4", "v5")]
    v, e = network(spark, pairs, extra=ids)
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in ids}
    rank = dict.fromkeys(ids, 1 / 12)
    for _ in range(7):
        lost = sum(rank[i] for i in ids if not near[i])
        rank = {i: 0.15 / 12 + 0.85 * lost / 12 + 0.85 * sum(rank[j] / len(near[j]) for j in near[i]) for i in ids}
    assert as_dict(graph.pagerank(v, e, iterations=7, digits=10), "pagerank") == pytest.approx(rank, abs=1e-9)


def test_pagerank_deals_out_its_links_once(spark):
    from caseloom.operators import tiles as T

    ids = [f"v{i}" for i in range(40)]
    links = sorted({(ids[i], ids[i * i * 3 % 37]) for i in range(38) if i != i * i * 3 % 37})
    v, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(links + links[:5], "src string, dst string")
    near = {i: {b if a == i else a for a, b in links if i in (a, b)} for i in ids}
    rank = dict.fromkeys(ids, 1 / 40)
    for _ in range(7):
        alone = sum(rank[i] for i in ids if not near[i])
        rank = {i: (0.15 + 0.85 * alone) / 40 + 0.85 * sum(rank[o] / len(near[o]) for o in near[i]) for i in ids}
    found = {r["id"]: r["pagerank"] for r in graph.pagerank(v, e, 7, digits=8, links=4).collect()}
    assert found == pytest.approx(rank, abs=2e-8)
    tiles = T.pair_tiles(spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long"), spark.range(10).select("id", F.col("id").alias("number")), 4, 3)
    ones = spark.range(3).select(F.col("id").alias("v"), F.lit(T.packed(np.ones(4))).alias("x"))
    sums = T.both_ways(ones, tiles, 4, 3)
    assert sum(T.unpacked(r["sums"], np.float64, 4).sum() for r in sums.collect()) == 18
    # A round has one exchange, that of the ranks, above the kept tiles.
    assert sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("InMemoryRelation")[0].count("Exchange") == 1
    tiles.unpersist()


def test_ranks_and_exact_quantiles(spark):
    rng = random.Random(2)
    for values in ([3.0], [1.0, 1.0, 2.0], [rng.gauss(0, 1e6) for _ in range(500)], [7.0] * 300 + [rng.random() for _ in range(60)], [10.0 ** rng.randrange(-30, 30) for _ in range(80)]):
        rows = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").cache()
        for q in (0.0, 0.1, 0.5, 0.85, 1.0):
            want = rows.where("x is not null and not isnan(x)").agg(F.percentile("x", F.lit(q))).first()[0]
            assert ranking.exact_quantile(rows, "x", q) == pytest.approx(want, rel=1e-12, abs=0)
    assert ranking.exact_quantile(rows.limit(0), "x", 0.5) is None
    rows = spark.createDataFrame([(i, rng.randrange(5)) for i in range(300)], "id int, score int").repartition(7)
    got = {r["id"]: r["rank"] for r in ranking.ranked(rows, F.desc("score"), "id").collect()}
    assert got == {r["id"]: k + 1 for k, r in enumerate(sorted(rows.collect(), key=lambda r: (-r["score"], r["id"])))}
    assert ranking.ranked(rows.limit(0), "id").count() == 0


def test_contributions_are_shapley_values(spark):
    rng = random.Random(5)
    columns = ("a", "b", "c")
    rows = spark.createDataFrame([(i, rng.random(), rng.randrange(4) / 4, rng.choice([None, 1.0, 2.0])) for i in range(300)], "id int, a double, b double, c double")
    rows = rows.withColumn("is_lead", (F.col("a") + F.col("b") * F.coalesce("c", F.lit(0.0)) > 0.9).cast("int"))
    model = ml.lead_model(rows, columns, iterations=4, depth=3)
    trees = explain.fitted_trees(model, 3)
    out = explain.explained(trees, rows, columns)
    from pyspark.ml.functions import vector_to_array

    margin = {r["id"]: r["m"] for r in model.transform(rows.fillna(0, list(columns))).select("id", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    for r in out.collect():
        assert r["base_margin"] + sum(r["contributions"]) == pytest.approx(margin[r["id"]], abs=1e-9)
    # The same by all subsets of known features over the trees themselves.
    fitted = model.stages[-1]

    def nodes(tree):
        def grow(n):
            if n.subtreeDepth() == 0:
                return n.prediction(), n.impurityStats().count()
            return n.split().featureIndex(), n.split().threshold(), grow(n.leftChild()), grow(n.rightChild()), n.impurityStats().count()

        return grow(tree._call_java("rootNode"))

    grown = [nodes(t) for t in fitted.trees]

    def value(n, x, known):
        if len(n) == 2:
            return n[0]
        f, cut, left, right, cover = n
        if f in known:
            return value(left if x[f] <= cut else right, x, known)
        return (value(left, x, known) * left[-1] + value(right, x, known) * right[-1]) / cover

    def whole(x, known):
        return sum(w * value(t, x, known) for w, t in zip(fitted.treeWeights, grown, strict=True))

    for r in out.orderBy("id").limit(25).collect():
        x = [r["a"], r["b"], r["c"] or 0.0]
        for j in range(3):
            others = [k for k in range(3) if k != j]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (whole(x, {*s, j}) - whole(x, set(s))) for n in range(3) for s in itertools.combinations(others, n))
            assert r["contributions"][j] == pytest.approx(want, abs=1e-9)
    top = explain.top_factors(out, ("id",), columns, 2).where("id = 0").orderBy("place").collect()
    first = out.where("id = 0").first()
    assert [t["feature"] for t in top] == sorted(columns, key=lambda c: (-round(abs(first["contributions"][columns.index(c)]), 9), columns.index(c)))[:2]
    assert all(t["direction"] == ("positive" if t["contribution"] > 0 else "negative") for t in top)


def test_colocations_are_counted_without_their_pairs(spark):
    rng = random.Random(3)
    base = datetime.datetime(2024, 1, 1)
    times = [base + datetime.timedelta(seconds=rng.choice([0, 1, 900, 1800, 1801, 3600, rng.randrange(9000)]), microseconds=rng.choice([0, 0, 1])) for _ in range(300)]
    rows = [(rng.choice([None, *range(200)]), rng.choice(["p", "q", "r", None]), rng.choice(["x", "y", None]), t, None, "e") for t in times] + [(1, "p", "lone", base, None, "e"), (2, None, "x", None, None, "e")]
    schema = "event_id int, person_id string, location_id string, ts timestamp_ntz, case_id string, event_type string"
    events = spark.createDataFrame(rows, schema)
    want = {r[0]: r[1] for r in behaviour.colocation_pairs(events).groupBy("location_id").count().collect()}
    assert {r[0]: r[1] for r in behaviour.colocation_counts(events).collect() if r[1]} == want and set(want) == {"x", "y"}
    crowd = spark.range(60_000).selectExpr("id as event_id", "cast(id as string) as person_id", "'x' as location_id", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 600) as ts")
    assert behaviour.colocation_counts(crowd).first()["co_location_count"] == 60_000 * 59_999 // 2


def test_colocations_are_summed_up_where_they_are_made(spark, monkeypatch):
    rng = random.Random(3)
    at = datetime.datetime(2024, 1, 1)
    rows = [(k if k % 9 else None, rng.choice([1, 2, 3, 4, 5, 6, 7, 8, None]), rng.choice(["a", "b", None]), at + datetime.timedelta(seconds=rng.randrange(9) * 600), rng.choice(["k", "l", None]), rng.choice("xy")) for k in range(160)]
    events = spark.createDataFrame(rows, "event_id long, person_id long, location_id string, ts timestamp, case_id string, event_type string")
    pairs = behaviour.colocation_pairs(events).groupBy("p1", "p2", "location_id")
    want = pairs.agg(F.count("*"), F.round(F.min("delta"), 6), F.round(F.avg("delta"), 3), F.sum("shared_case"), F.sum("shared_type"))
    for most in (1 << 19, 40):
        monkeypatch.setattr(behaviour, "PAIRS", most)
        found = behaviour.colocation_features(events)
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, want.collect()))
        # Nothing is exchanged between the making of pairs and their sums.
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.index("Exchange") > plan.index("Window")


def test_colocation_window_is_inclusive_and_symmetric(spark):
    t = datetime.datetime(2024, 1, 1)
    m = lambda k: t + datetime.timedelta(minutes=k)
    rows = [(1, "p", "x", m(0), "c", "t"), (2, "q", "x", m(30), "c", "u"), (3, "q", "x", m(61), None, "t"), (4, "p", "x", m(0), None, "t"), (5, "r", "y", m(0), "c", "t")]
    out = behaviour.colocation_features(spark.createDataFrame(rows, "event_id int, person_id string, location_id string, ts timestamp_ntz, case_id string, event_type string")).collect()
    assert [(r["p1"], r["p2"], r["co_location_count"], r["shared_case_count"], r["shared_event_type_count"]) for r in out] == [("p", "q", 2, 1, 0)]


def test_temporal_score_ladder(spark):
    t = datetime.datetime(2024, 1, 31)
    rows = [("new", t - datetime.timedelta(minutes=10)), ("new", t), ("old", t - datetime.timedelta(days=3)), (None, t)]
    out = {r["entity_id"]: r for r in temporal.temporal_anomalies(spark.createDataFrame(rows, "entity_id string, ts timestamp_ntz"), "2024-01-31 00:00:00").collect()}
    assert (out["new"]["before_count"], out["new"]["after_count"], out["new"]["score"], out["new"]["status"]) == (1, 1, 0.9, "NO_HISTORICAL_ACTIVITY") and out["old"]["score"] == 0
    assert set(out) == {"new", "old"}


def test_lockout_needs_a_run(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("u", i, t + datetime.timedelta(minutes=i), i == 4) for i in range(11)]
    out = temporal.lockouts(spark.createDataFrame(rows, "user_id string, login_id int, ts timestamp_ntz, success boolean")).collect()
    assert [r["ts"] for r in out] == [t + datetime.timedelta(minutes=9)]


def test_ledger_detects_tampering(spark):
    blocks = spark.createDataFrame([(i, "2024-01-01 00:00:00", f"h{i}", "ADD") for i in range(20)], "idx int, ts string, data_hash string, action string")
    chain = ledger.chained(blocks).cache()
    assert tuple(ledger.verified(chain).first()) == (20, True, None)
    assert tuple(ledger.verified(chain.withColumn("action", F.when(F.col("idx") == 7, "X").otherwise(F.col("action")))).first())[1:] == (False, 7)
    more = chain.unionByName(ledger.appended(chain, spark.createDataFrame([("2024-01-02 00:00:00", "h", "ADD")], "ts string, data_hash string, action string")))
    assert tuple(ledger.verified(more).first()) == (21, True, None)


def test_resolution_scenarios(spark):
    raw = [("a", "Rahul Kumar", "9876512345", "1990", "12 Main Road", "C1"), ("b", "Rahul Kumar", "9876512345", "1990", "12 Main Road", "C1"), ("c", "Rahul Kumar", None, "1970", "9 Hill Street", "C1"), ("d", "Someone Else", "9876512345", "1950", None, None)]
    r = resolution.validated(spark.createDataFrame(raw, "id string, name string, phone string, dob string, address string, case_id string"), 2024)
    pairs = resolution.blocked_pairs(r)
    assert {tuple(x) for x in pairs.collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d")}
    full = {(x["id_a"], x["id_b"]): x for x in resolution.pair_scores(r, pairs).collect()}
    assert full["a", "b"]["classification"] == "POSSIBLE DUPLICATE" and full["a", "c"]["classification"] == "IDENTITY CONFLICT" and full["a", "d"]["classification"] == "POSSIBLE ASSOCIATION"
    assert all(0 <= x["confidence"] <= 99 for x in full.values())
    simple = {(x["id_a"], x["id_b"]): x["classification"] for x in resolution.simple_scores(r, pairs).collect()}
    assert simple["a", "b"] == "PROBABLE SAME ENTITY" and simple["a", "c"] == "IDENTITY CONFLICT"


def test_registry_match(spark):
    e = spark.createDataFrame([("1", "Rahul Kumar", "", "PERSON", "+91 9876512345", "DL01AB1234", "Sector 18"), ("2", "R. Kumar", "", "PERSON", "", "", "Sector 18"), ("3", "Nobody", "", "VEHICLE", "", "", "")], "entity_id string, name string, alias string, type string, phone string, vehicle string, location string")
    r = spark.createDataFrame([("x", "rahul kumar", ["rk"], "person", "9876512345", "dl 01 ab 1234", "sector 18")], "candidate_id string, name string, aliases array<string>, type string, phone string, vehicle string, location string")
    out = {x["entity_id"]: x for x in resolution.best_matches(e, r).collect()}
    assert out["3"]["matched_id"] is None and out["3"]["decision"] == "DISTINCT_ENTITY"
    r = r.withColumn("aliases", F.array().cast("array<string>"))
    out = {x["entity_id"]: x for x in resolution.best_matches(e, r, least=0.6).collect()}
    assert out["1"]["confidence"] >= 0.85 and out["1"]["decision"] == "HIGH_CONFIDENCE_MATCH" and not out["1"]["requires_review"]


def test_city_pairs_that_say_nothing_are_not_made(spark):
    rng = random.Random(12)
    made = ["".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(500)]

    def row(i):
        name = " ".join(rng.sample(made, 2))
        return i, name, rng.choice([None, None, rng.choice(made) + " " + rng.choice(made)]), rng.choice([None, f"98{rng.randrange(200):08d}"]), rng.choice([None, f"97{rng.randrange(60):08d}"]), rng.choice([None, str(1960 + rng.randrange(5))]), rng.choice([None, " ".join(rng.sample(made, 3))]), "Somewhere", f"ps{rng.randrange(3)}"

    rows = [row(i) for i in range(300)]
    for i in range(40):
        old = list(rng.choice(rows[:300]))
        at = rng.randrange(len(old[1]))
        old[0], old[1] = 1000 + i, rng.choice([old[1][:at] + old[1][at + 1 :], " ".join(old[1].split()[::-1]), "7" + old[1][1:], old[1]])
        old[3] = None
        rows.append(tuple(old))
    rows += [(2000, "12 34", None, None, None, None, None, "Somewhere", None), (2001, "12 35", None, None, None, "1961", None, "Somewhere", None), (2002, "", None, None, None, None, None, "Somewhere", None), (2003, None, None, None, None, None, None, "Somewhere", None)]
    raw = spark.createDataFrame(rows, "id int, name string, aliases string, phone string, alternate_phones string, dob string, address string, city string, police_station string")
    r = resolution.validated(raw, 2024).cache()
    every = r.select(F.col("id").alias("id_a")).join(r.select(F.col("id").alias("id_b")), F.col("id_a") < F.col("id_b"))
    pairs = resolution.blocked_pairs(r).cache()
    kinds = lambda p: {(x["id_a"], x["id_b"]): (x["classification"], x["confidence"]) for x in resolution.pair_scores(r, p).where("classification != 'DIFFERENT ENTITY'").collect()}
    assert kinds(pairs) == kinds(every) and pairs.count() < every.count() / 4
    assert resolution.blocked_pairs(r.limit(0)).count() == 0


def registry_brute(entities, entries, least):
    def ratio(x, y):
        return difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0

    def score(e, r):
        _, name, alias, _, phone, vehicle, place = e
        _, r_name, r_aliases, _, r_phone, r_vehicle, r_place = r
        held = name and r_name and (name in r_name or r_name in name)
        partial = min(len(name), len(r_name)) / max(len(name), len(r_name)) * 0.8 + 0.2 if held else 0.0
        x, y = set(name.split()), set(r_name.split())
        words = len(x & y) / math.sqrt(len(x) * len(y)) if x and y else 0.0
        parts = [(0.35, max(ratio(name, r_name), partial), name and r_name), (0.2, max([ratio(alias or name, a) for a in r_aliases], default=0), (alias or name) and r_aliases), (0.2, phone == r_phone, phone and r_phone), (0.1, vehicle == r_vehicle, vehicle and r_vehicle), (0.05, ratio(place, r_place), place and r_place), (0.1, words, name and r_name)]
        whole = sum(w for w, _, there in parts if there)
        return round(sum(w * v for w, v, there in parts if there) / whole, 4) if whole else 0.0

    out = {}
    for e in entities:
        found = [(-score(e, r), r[0]) for r in entries if not e[3] or not r[3] or e[3] == r[3]]
        found = min((f for f in found if -f[0] >= least), default=(0.0, None))
        out[e[0]] = (found[1], pytest.approx(-found[0], abs=1e-4))
    return out


@pytest.mark.parametrize("least", [0.65, 0.5])
def test_registry_index_loses_no_match(spark, least):
    rng = random.Random(int(least * 100))
    first, last = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(12)], ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(12)]

    def changed(t):
        at = rng.randrange(len(t) + 1)
        return rng.choice([t, t, t[:at] + t[at + 1 :], t[:at] + rng.choice("xaeq") + t[at:], t.split()[0], " ".join(t.split()[::-1]), t.replace(" ", "")]) if t else t

    def row(i):
        name = rng.choice([f"{rng.choice(first)} {rng.choice(last)}"] * 6 + ["", rng.choice(first)])
        return i, name, rng.choice(["PERSON", "PERSON", "FIRM", ""]), rng.choice(["", f"98765{rng.randrange(5):05d}"]), rng.choice(["", "", f"AB{rng.randrange(6)}"]), rng.choice(["", f"place {rng.choice(last)}"])

    entries = [(i, name, [changed(name) for _ in range(rng.choice([0, 1, 2])) if name], kind, *rest) for i, name, kind, *rest in map(row, range(120))]
    entities = []
    for i in range(150):
        _, name, _, kind, phone, vehicle, place = rng.choice(entries)
        entities.append((1000 + i, changed(name), rng.choice(["", "", changed(name)]), rng.choice([kind, kind, ""]), rng.choice([phone, ""]), rng.choice([vehicle, ""]), rng.choice([place, changed(place), ""])))
    entities += [(2000 + i, *entities[i][1:]) for i in range(20)]
    e = spark.createDataFrame(entities, "entity_id int, name string, alias string, type string, phone string, vehicle string, location string")
    r = spark.createDataFrame(entries + [(500 + i, *entries[i][1:]) for i in range(20)], "candidate_id int, name string, aliases array<string>, type string, phone string, vehicle string, location string")
    got = {x["entity_id"]: (x["matched_id"], x["confidence"]) for x in resolution.best_matches(e, r, least).collect()}
    assert got == registry_brute(entities, entries, least)
    if least == 0.65:
        _, own, known = resolution._signatures(e, r)
        pairs = resolution.registry_candidates(own, known, least).count()
        assert pairs < own.count() * known.count() / 8
    with pytest.raises(ValueError, match="least score"):
        resolution.best_matches(e, r, 0.2).count()


def test_entities_in_text(spark):
    body = "Rahul Kumar called 9876512345 from DL-01-AB-1234 near Sector 18, paid Rs. 2,00,000 to ABC Logistics; 9811223344."
    rows = text.extracted(spark.createDataFrame([(1, body), (2, None)], "id int, text string"), "text", "id").collect()
    assert {"PERSON", "PHONE", "VEHICLE", "LOCATION", "AMOUNT", "ORGANIZATION"} == {r["label"] for r in rows}
    assert all(body[r["start"] : r["end"]].upper() == r["text"].upper() for r in rows) and sum(r["label"] == "PHONE" for r in rows) == 2


def test_names_of_a_table_in_text(spark):
    names = spark.createDataFrame([("P", "Rahul Kumar", 0.9), ("P", "rahul  kumar", 0.95), ("P", "Kumar", 0.9), ("F", "ABC Logistics Pvt Ltd", 0.8), ("L", "Zürich", 0.7), ("L", "", 0.5), ("L", None, 0.5), ("L", "--", 0.5)], "label string, name string, confidence double")
    body = "kumar, RAHUL-Kumar met Rahul Kumar of abc logistics (Pvt) Ltd in ZÜRICH; Kumars of Zürich1"
    rows = spark.createDataFrame([(1, body, "x"), (2, None, "x"), (3, "", "x"), (4, "kumar " * 200_000, "x"), (4, "Kumar", "x")], "id int, body string, label string")
    got = sorted((r["id"], r["label"], r["text"], r["start"], r["end"], r["confidence"]) for r in text.dictionary_entities(rows, "body", "id", names).collect())
    want = [(1, "F", "abc logistics (Pvt) Ltd", 38, 61, 0.8), (1, "L", "ZÜRICH", 65, 71, 0.7), (1, "P", "RAHUL-Kumar", 7, 18, 0.95), (1, "P", "kumar", 0, 5, 0.9), (4, "P", "Kumar", 0, 5, 0.9), (4, "P", "kumar", 0, 5, 0.9)]
    assert got == want and all(body[a:b] == t for i, _, t, a, b, _ in got if i == 1)
    assert text.dictionary_entities(rows, "body", "id", names.limit(0)).count() == 0


def test_paths_from_both_ends_against_a_walk(spark):
    rng = random.Random(4)
    ids = [f"v{i}" for i in range(9)]
    pairs = [tuple(rng.choice(ids) for _ in range(2)) for _ in range(22)]
    _, e = network(spark, pairs)

    def walk(path, used, longest):
        if path[-1] == "v1":
            yield path, used
            return
        for k, (a, b) in enumerate(pairs):
            if len(used) < longest and a != b and path[-1] in (a, b):
                to = b if path[-1] == a else a
                if to not in path:
                    yield from walk([*path, to], [*used, f"e{k}"], longest)

    for longest in (1, 2, 3, 4, 5):
        got = sorted((r["path"], r["edge_ids"], r["hops"]) for r in graph.simple_paths(e, "v0", "v1", longest).collect())
        assert got == sorted((p, u, len(u)) for p, u in walk(["v0"], [], longest))
    assert graph.simple_paths(e, "v0", "v0").count() == 0


def test_models(spark):
    rows = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(200)] + [(999, 80.0, 90.0)], "id int, a double, b double")
    out = {r["id"]: r["anomaly_score"] for r in ml.anomalies(rows, ("a", "b"), trees=40).collect()}
    assert max(out, key=out.get) == 999
    groups = spark.createDataFrame([(i, 0.0 + i * 1e-3, 0.0) for i in range(5)] + [(10 + i, 9.0 + i * 1e-3, 9.0) for i in range(4)] + [(50, 30.0, -30.0)], "id int, a double, b double")
    label = {r["id"]: r["cluster"] for r in ml.density_clusters(groups, "id", ("a", "b"), eps=0.3).collect()}
    assert [label[i] for i in (0, 4, 10, 13, 50)] == [0, 0, 1, 1, -1]
    scored = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.3, 0), (4, 0.3, 1)], "id int, s double, y int")
    assert tuple(ml.evaluated(scored, F.col("s"), F.col("y")).first()) == (0.5, 0.5, 0.5, 0.625) and ml.precision_at(scored, "s", "y", "id", 1).first()[0] == 1


def test_anomalies_are_drawn_and_cut_over_all_rows(spark):
    def vector(i):
        return (7.0, 7.0) if i % 3 == 0 else (float(i * 7919 % 1009), float(i * 104729 % 997))

    rows = spark.createDataFrame([(i, *vector(i)) for i in range(3000)], "id int, a double, b double")
    out = ml.anomalies(rows, ("a", "b"), trees=8, sample=16).collect()
    flagged = sum(r["is_anomaly"] for r in out)
    assert len(out) == 3000 and 0.045 * 3000 <= flagged <= 0.05 * 3000
    # A vector that holds a third of the rows holds about a third of what the forest is grown on; each tree has rows of its own.
    for n, trees, size in ((3000, 8, 64), (3000, 30, 256), (100, 4, 256)):
        drawn = ml.tree_samples(rows.where(F.col("id") < n), n, ("a", "b"), ("id",), trees, size).collect()
        assert Counter(r["tree"] for r in drawn) == dict.fromkeys(range(trees), min(n, size))
        assert 0.2 < sum(r["a"] == 7.0 for r in drawn) / len(drawn) < 0.45
    hot = rows.withColumn("id", F.lit(5))  # rows of one key go together, and no tree gets more than its sample
    assert all(c <= 64 for c in Counter(r["tree"] for r in ml.tree_samples(hot, 3000, ("a", "b"), ("id",), 8, 64).collect()).values())
    assert ml.anomalies(hot, ("a", "b"), trees=8, sample=64, key=("id",)).count() == 3000


def test_forest_scores_rows_as_its_nodes_say(spark):
    rng = random.Random(1)
    x = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)]
    rows = spark.createDataFrame(x, "id int, a double, b double")
    forest = ml.grown_forest(ml.tree_samples(rows, 400, ("a", "b"), ("id",), 20, 64), ("a", "b"), 64, 3)
    assert len(forest.trees) == 20

    def depth(tree, row):
        at = 0
        while tree[0][at] >= 0:
            at = tree[2][at] if row[tree[0][at]] < tree[1][at] else tree[3][at]
        return tree[1][at]

    usual = 2 * (math.log(63) + 0.5772156649) - 2 * 63 / 64
    for _, *row in x[:40]:
        want = 2 ** (-sum(depth(t, row) for t in forest.trees) / 20 / usual)
        assert forest.score(np.array([row]))[0] == pytest.approx(want, rel=1e-12)
    made = spark.createDataFrame([(1000 * k + i, k * math.cos(i), k * math.sin(i), k) for k in (2, 4, 6, 8) for i in range(25)], "id int, a double, b double, far int")
    found = ml.anomalies(rows.withColumn("far", F.lit(0)).unionByName(made), ("a", "b"), contamination=0.2, trees=60, key=("id",))
    rate = {r["far"]: r["flagged"] for r in found.groupBy("far").agg(F.avg(F.col("is_anomaly").cast("int")).alias("flagged")).collect()}
    assert rate[0] < 0.1 and rate[8] > 0.9 and rate[2] <= rate[4] + 0.1 <= rate[6] + 0.2


def clusters_brute(rows, eps, least):
    cols = list(zip(*(r[1:] for r in rows), strict=True))
    mean = [sum(c) / len(c) for c in cols]
    dev = [math.sqrt(sum((v - m) ** 2 for v in c) / len(c)) or 1.0 for c, m in zip(cols, mean, strict=True)]
    x = {r[0]: [(v - m) / s for v, m, s in zip(r[1:], mean, dev, strict=True)] for r in rows}
    near = {i: [j for j in x if sum((a - b) ** 2 for a, b in zip(x[i], x[j], strict=True)) <= eps * eps + 1e-12] for i in x}
    core = {i for i in x if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        todo = [] if i in label else [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = i
                todo += [k for k in near[j] if k in core]
    number = {c: n for n, c in enumerate(sorted(set(label.values())))}
    return {i: (number[label[i]], True) if i in core else (number[label[min(k for k in near[i] if k in core)]], False) if any(k in core for k in near[i]) else (-1, False) for i in x}


@pytest.mark.parametrize(("d", "eps", "least"), [(1, 0.1, 3), (2, 0.25, 3), (2, 0.25, 6), (3, 0.5, 4), (5, 0.9, 3)])
def test_density_clusters_against_all_pairs(spark, d, eps, least):
    rng = random.Random(d * 10 + least)
    names = [f"f{i}" for i in range(d)]
    centres = [[rng.uniform(-3, 3) for _ in names] for _ in range(5)]
    rows = [(i, *(v + rng.gauss(0, rng.choice([0.05, 0.4])) for v in centres[i % 5])) for i in range(140)] + [(500 + i, *(rng.uniform(-4, 4) for _ in names)) for i in range(30)]
    rows += [(900 + i, *rows[3][1:]) for i in range(12)]
    got = ml.density_clusters(spark.createDataFrame(rows, ", ".join(["id int", *(f"{n} double" for n in names)])), "id", names, eps, least)
    assert {r["id"]: (r["cluster"], r["is_core"]) for r in got.collect()} == clusters_brute(rows, eps, least)


def test_density_clusters_of_a_crowded_cell(spark):
    rows = spark.range(100_000).selectExpr("id", "id % 1000 * 1e-7 as a", "id % 7 * 1e-7 as b").union(spark.createDataFrame([(200_000, 9.0, 9.0), (200_001, 9.0, 9.0), (200_002, -9.0, 9.0)], "id long, a double, b double"))
    got = {(r["cluster"], r["is_core"]): r["n"] for r in ml.density_clusters(rows, "id", ("a", "b"), eps=0.5).groupBy("cluster", "is_core").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, True): 100_000, (-1, False): 3}


def test_models_are_registered_with_the_production_settings(monkeypatch):
    from caseloom.plans import record_queries

    asked = {}

    def signed(name, f):
        def run(*a, **b):
            own = inspect.signature(f).bind(*a, **b)
            own.apply_defaults()
            asked[name] = own.arguments
            return MagicMock()

        return run

    for name in ("anomalies", "lead_model"):
        monkeypatch.setattr(ml, name, signed(name, getattr(ml, name)))
    monkeypatch.setattr(ml, "predicted_leads", MagicMock())
    for name in ("person_location_features", "lead_features", "labelled_leads"):
        monkeypatch.setattr(behaviour, name, MagicMock())
    for name in ("events", "contacts"):
        monkeypatch.setattr(record_queries.V, name, MagicMock())
    record_queries.behaviour_anomalies(None, "")
    record_queries.learned_leads(None, "")
    a, m = asked["anomalies"], asked["lead_model"]
    assert (a["trees"], a["contamination"], a["seed"]) == (300, 0.05, 42) and tuple(a["key"]) == ("person_id", "location_id")
    assert (m["iterations"], m["depth"], m["step"], m["share"]) == (400, 6, 0.05, 0.8)


def test_records_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "mr. a  b", "+919876512345"), (2, "c", None)], "id int, person_name string, phone string")
    out = files.ingested(rows, ["id"]).collect()
    assert [r["row_index"] for r in out] == [1, 2] and '"A B"' in out[0]["normalized"] and "9876512345" in out[0]["normalized"]
    files.write_result(rows, f"{tmp_path}/t", "csv")
    assert files.read_csv(spark, f"{tmp_path}/t").count() == 2 and files.read_csv(spark, f"{tmp_path}/none", "a int").count() == 0
    with pytest.raises(ValueError):
        files.checked_ingest("pdf")
    with pytest.raises(ValueError):
        files.checked_ingest("CSV", "DATASET_ONLY")
    assert records.searched(rows, "100%_", ("person_name",)).count() == 0 and records.searched(rows, "A ", ("person_name",)).count() == 1
    assert places.time_bounds("all", "2024-01-01") == (None, None)


def test_ingest_numbers_rows_over_partitions(spark):
    rows = spark.range(1000, 0, -1).select("id", F.lit(" x ").alias("word")).repartition(7)
    out = files.ingested(rows, ["id"]).collect()
    assert [(r["row_index"], r["raw"]) for r in sorted(out)] == [(i, f'{{"id":{i},"word":" x "}}') for i in range(1, 1001)]
    assert files.ingested(rows.where("id < 0"), ["id"]).count() == 0


def test_seeded_and_ranked_anomalies(spark):
    at = "2024-01-10 12:00:00"
    events = spark.sql("SELECT 1L AS event_id, 'a' AS entity_id, timestamp_ntz'2024-01-10 11:30:00' AS ts UNION ALL SELECT 2L, NULL, timestamp_ntz'2024-01-10 12:10:00' UNION ALL SELECT 3L, 'q', timestamp_ntz'2024-01-10 12:00:00'")
    people = spark.createDataFrame([("a", "A", "PERSON")], "entity_id string, name string, type string")
    near = {r["event_id"]: (r["entity_name"], r["timing"], r["minutes"], r["unassigned"]) for r in temporal.window_events(events, people, at, 60, 60).collect()}
    assert near == {1: ("A", "BEFORE", -30, False), 2: (None, "AFTER", 10, True), 3: (None, "AT_CRIME", 0, False)}
    found = temporal.seeded(temporal.temporal_anomalies(events, at, 60, 60, 5), people.select("entity_id").union(spark.createDataFrame([("z",)], "entity_id string")))
    rows = {r["entity_id"]: r for r in found.collect()}
    assert set(rows) == {"a", "q", "z"} and rows["z"]["score"] == 0 and rows["z"]["status"] == "NO_HISTORICAL_ACTIVITY" and rows["z"]["requires_review"]
    assert [(r["rank"], r["entity_id"]) for r in temporal.ranked_anomalies(found).orderBy("rank").limit(2).collect()] == [(1, "a"), (2, "q")] and temporal.ranked_anomalies(found).count() == found.count()


def test_places_by_linked_names(spark):
    nodes = spark.createDataFrame([("p", "Ann", "PERSON"), ("q", "Ann", "ORGANIZATION"), ("x", "Here", "LOCATION"), ("y", "There", "LOCATION")], "id string, name string, type string")
    links = spark.createDataFrame([("p", "x", 2), ("q", "x", 3), ("x", "p", 9), ("p", "y", 1)], "src string, dst string, n int")
    assert {tuple(r) for r in places.linked_places(links, nodes).collect()} == {("x", "Here", 1, 5, 100.0), ("y", "There", 1, 1, 20.0)}
    assert {tuple(r) for r in places.place_members(links, nodes).collect()} == {("x", "Ann", "ORGANIZATION", 5), ("y", "Ann", "PERSON", 1)}


def test_injected_anomalies_are_measured(spark):
    own = spark.createDataFrame([(f"r{i}", i % 3) for i in range(20)], "id string, a int")
    both = ml.with_injected(own, spark.createDataFrame([("m0",), ("m1",)], "id string"))
    assert both.where("is_injected = 1").agg(F.sum("a")).first()[0] == 0 and both.count() == 22
    scored = both.withColumn("anomaly_score", F.when(F.col("id").isin("m0", "r5"), 0.9).otherwise(0.1)).withColumn("is_anomaly", F.col("anomaly_score") > 0.5)
    assert tuple(ml.injected_metrics(scored, ["id"], (1, 2)).first()) == (0.5, 0.05, 1.0, 0.5)


def test_review_decisions_leave_an_audit_row(spark):
    pairs = spark.createDataFrame([(1, 2, "A", "B", 90, "PENDING_REVIEW"), (1, 3, "A", "C", 70, "REJECTED")], "id_a int, id_b int, name_a string, name_b string, confidence int, review_status string")
    made = spark.createDataFrame([(1, 2, "CONFIRMED_ALIAS", "u", "n"), (1, 3, "CONFIRMED_ALIAS", "u", "n")], "id_a int, id_b int, decision string, reviewer string, note string")
    audit = resolution.review_audit(pairs, made).collect()
    assert [(r["id_b"], r["action"], r["detail"]) for r in audit] == [(2, "ENTITY_RESOLUTION_CONFIRMED_ALIAS", "[Decision: CONFIRMED_ALIAS] A and B (confidence 90%)")]
    assert {r["id_b"]: r["review_status"] for r in resolution.reviewed(pairs, made).collect()} == {2: "CONFIRMED_ALIAS", 3: "REJECTED"}


def test_case_counts_by_the_id_that_a_part_names(spark):
    """Case and other ids overlap: lines of case 7 are not those of the case whose other id is 7."""
    cases = spark.createDataFrame([("1", "7"), ("7", "9"), ("5", "5"), ("6", None), ("8", "7")], "case_id string, other_id string")
    lines, people = spark.createDataFrame([(1,), (7,), (7,), (5,)], "k long"), spark.createDataFrame([(7,), (5,), (1,), (None,)], "k long")
    both = {r["case_id"]: (r["lines"], r["people"]) for r in records.case_counts(cases, {"lines": (lines, "k", "case_id"), "people": (people, "k", "other_id")}).collect()}
    assert both == {"1": (1, 1), "7": (2, 0), "5": (1, 1), "6": (0, 0), "8": (0, 1)}
    either = {r["case_id"]: r["lines"] for r in records.case_counts(cases, {"lines": (lines, "k")}).collect()}
    assert either == {"1": 3, "7": 2, "5": 1, "6": 0, "8": 2}


def test_search_reads_what_edges_say_but_not_their_ids(spark):
    v, e = network(spark, [("a", "b"), ("c", "d"), ("x", "y")])
    e = e.withColumn("edge_id", F.concat(F.lit("0001-"), "edge_id"))
    assert graph.search_network(v, e, "0001")[0].count() == 0
    told = e.withColumn("detail", F.when(F.col("src") == "c", "Seen at Dock 0001"))
    nodes, inside = graph.search_network(v, told, "dock 0001")
    assert {r["id"] for r in nodes.collect()} == {"c", "d"} and inside.count() == 1


def test_leads_of_one_class_are_certain(spark):
    rows = spark.createDataFrame([("a", "b", 1), ("a", "c", 1)], "p1 string, p2 string, is_lead int").withColumns({c: F.lit(1.0) for c in ml.LEAD_FEATURES})
    for label in (1, 0):
        own = rows.withColumn("is_lead", F.lit(label))
        model = ml.lead_model(own)
        assert model is None and {r["lead_score"] for r in ml.predicted_leads(model, own).collect()} == {float(label)}


def test_blocked_pairs_are_made_once_in_shares(spark, monkeypatch):
    """Pairs of blocks of several shares, with two keys in common, come once and all."""
    monkeypatch.setattr(resolution, "BLOCK_SHARE", 7)
    raw = spark.createDataFrame([(i, f"Rahul Kumar {i // 3}", f"9{i % 4:09d}") for i in range(60)], "id long, name string, phone string")
    got = sorted(map(tuple, resolution.blocked_pairs(resolution.validated(raw, 2024)).collect()))
    assert got == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def test_components_read_each_pair_once(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(f"c{i}", f"s{j}") for i in range(20) for j in range(20)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [(f"r{rng.randrange(60):02}", f"r{rng.randrange(60):02}") for _ in range(45)]
    v, e = network(spark, pairs, extra=["z"])
    held, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: held.append(cut(df)) or held[-1])
    got = as_dict(graph.components(v, e), "component")
    want = {i: i for p in pairs for i in p} | {"z": "z"}
    while any(want[a] != want[b] for a, b in pairs):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
    # No table holds a pair in both directions, and after the first round only pairs between groups are left.
    ends = [df.count() for df in held if df.columns == ["u", "v"]]
    assert max(df.count() for df in held) <= len(pairs) and ends[1] < 60


def executed(df):
    """The plan as it is before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_diameter_holds_a_row_a_vertex(spark, monkeypatch):
    v, e = network(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(8)] + [("n03", "m1"), ("n03", "m2"), ("m1", "m2")], ["alone"])
    rows, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rows.append(cut(df)) or rows[-1])
    found = graph.diameter_estimate(v, e, 4).collect()
    assert [r["diameter_estimate"] for r in found] == [8]
    assert max(df.count() for df in rows[1:]) <= v.count()
    assert graph.diameter_estimate(v.where("id = 'alone'"), e).collect()[0][0] == 0
    assert graph.diameter_estimate(v.limit(0), e).collect()[0][0] is None


def test_leads_are_dealt_out_once(spark):
    from caseloom.plans import lead_queries, views

    leads = executed(views.leads(spark, "/root/testdata/sf0.001"))
    assert leads.count("Exchange hashpartitioning(p1") == 1 and leads.count("Scan parquet") == 2
    # Sentences and sources are chosen in the plan, not by the name of a feature in each row.
    texts = executed(lead_queries.lead_feature_texts(spark, "/root/testdata/sf0.001"))
    assert "RLIKE" not in texts and "format_string" not in texts


def test_link_names_meet_the_tables_own_keys(spark):
    from caseloom.plans import graph_queries

    plan = executed(graph_queries.named_links(spark, "/root/testdata/sf0.001"))
    # The plan is printed from the top: ids are made above all joins.
    assert plan.count("concat_ws") == 1 and plan.index("concat_ws") < plan.index("Join")


def test_names_in_text_go_out_in_batches(spark, monkeypatch):
    monkeypatch.setattr(text, "RUNS", 3)
    rows = spark.createDataFrame([(1, "Ann Lee met ann  lee, and Bo."), (2, None), (3, ""), (4, "bo bo ann-lee")], "k int, t string")
    names = spark.createDataFrame([("PERSON", "Ann Lee", 0.9), ("PERSON", "bo", 0.8)], "label string, name string, confidence double")
    found = {(r["k"], r["text"], r["start"], r["end"]) for r in text.dictionary_entities(rows, "t", "k", names).collect()}
    assert found == {(1, "Ann Lee", 0, 7), (1, "Bo", 26, 28), (4, "bo", 0, 2), (4, "ann-lee", 6, 13)}


def test_texts_are_lowered_once(spark):
    rows = spark.createDataFrame([(1, "RAHUL kumar of abc logistics, 9876543210"), (2, None)], "k int, t string")
    found = text.extracted(rows, "t", "k")
    assert {(r["label"], r["start"]) for r in found.collect()} == {("PERSON", 0), ("ORGANIZATION", 15), ("PHONE", 30)}
    assert executed(found).count("lower(") == 1


def test_evidence_ids_are_told_apart_before_the_choice(spark):
    from caseloom.plans import case_queries

    plan = executed(case_queries.evidence_nodes(spark, "/root/testdata/sf0.001"))
    assert plan.count("functions=[]") >= 8


def test_components_that_fit_a_task_are_searched_there(spark, monkeypatch):
    from caseloom.operators import parts, tiles

    rng = random.Random(5)
    pairs = sorted({(f"v{a:02}", f"v{b:02}") for a, b in (rng.sample(range(20), 2) for _ in range(40))} | {(f"w{i}", f"w{i + 1}") for i in range(5)} | {("y0", "y1"), ("z0", "z1"), ("z1", "z2")})
    v, e = network(spark, pairs, extra=["alone"])
    ids = [r["id"] for r in v.collect()]
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in ids}
    want = {}
    for i in ids:
        dist, front = {i: 0}, [i]
        while front:
            front = sorted({o for f in front for o in near[f]} - dist.keys())
            dist |= dict.fromkeys(front, max(dist.values()) + 1)
        r, d = len(dist) - 1, sum(dist.values())
        want[i] = pytest.approx(r / (len(ids) - 1) * (r / d) if d else 0, abs=1e-4)
    monkeypatch.setattr(tiles, "spread", None)
    monkeypatch.setattr(parts, "SHARED", 12)  # one part of a component, others of several
    monkeypatch.setattr(parts, "SOURCES", 6)  # several tasks for a part
    monkeypatch.setattr(parts, "CELLS", 40)  # several turns in a task
    assert as_dict(graph.betweenness(v, e), "betweenness") == pytest.approx(betweenness_brute(ids, pairs), abs=2e-6)
    assert as_dict(graph.closeness(v, e), "closeness") == want
    monkeypatch.setattr(parts, "LINKS", 12)  # what does not fit goes over tiles
    numbers = graph._numbered(graph.neighbours(e))
    fit, rest = parts.divided(graph.neighbours(e), numbers)
    assert {r["id"][0] for r in rest.collect()} == {"v"} and fit.agg(F.sum("n")).first()[0] == 11


def test_pairs_are_scored_from_lists_of_records(spark, monkeypatch):
    """What units of lists give is what a row for each pair gives, evidence too; a pair comes once, in the order of its ids."""
    from caseloom.functions import pairs as own

    monkeypatch.setattr(resolution, "LISTED", 9)
    rng = random.Random(3)
    names = ["Rahul Kumar", "Rahul Kmar", "Rahul Gupta", "rahul é kumar", "Kumar Rahul", None]
    row = lambda i: (f"{i:x}", rng.choice(names), rng.choice([None, "Rahul Kmar"]), f"9{rng.randrange(9):09d}", rng.choice([None, f"9{rng.randrange(9):09d}"]), rng.choice([None, "1980", "1981", "1985"]), rng.choice([None, "12 Main Road East", "12 Main Road West", "9 Hill Side"]), rng.choice(["M", "F", None]), rng.choice([None, "Delhi", "Goa"]), rng.choice([None, "110001"]), rng.choice([None, "C1", "C2"]), rng.choice([None, "PS1"]))
    raw = spark.createDataFrame([row(i) for i in range(60)], "id string, name string, aliases string, phone string, alternate_phones string, dob string, address string, gender string, city string, pincode string, case_id string, police_station string")
    r = resolution.validated(raw, 2024).cache()
    got, want = (sorted(map(str, df.collect())) for df in (resolution.scored_pairs(r), resolution.pair_scores(r, resolution.blocked_pairs(r))))
    assert got == want and len(got) > 500
    assert {x["id_a"] < x["id_b"] for x in resolution.scored_pairs(r).select("id_a", "id_b").collect()} == {True}
    twice = r.union(r.limit(3))
    got, want = (sorted(map(str, df.collect())) for df in (resolution.scored_pairs(twice), resolution.pair_scores(twice, resolution.blocked_pairs(twice))))
    assert got == want
    # No pair is a row before it is scored: units are of lists, and few.
    assert "MapInArrow" in executed(resolution.scored_pairs(r)) and own.AT_ONCE < 1 << 20
