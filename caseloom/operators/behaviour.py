"""Behaviour of people at places: visit features, co-location, hotspots and leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.normalize import temporal_parts
from caseloom.functions.scores import fallback_lead_score, priority_band, weak_lead_label
from caseloom.operators.graph import cut, dealt
from caseloom.operators.ranking import exact_quantile


def unified_events(*sources: tuple[DataFrame, dict[str, str]]) -> DataFrame:
    """Sources with their column names, as one table of (person_id, location_id, ts, case_id, event_type) without null persons, places or times; unreadable times are null."""
    out = None
    for df, names in sources:
        kinds = dict(df.dtypes)
        own = [(F.try_to_timestamp(names[c]) if c == "ts" and kinds[names[c]] == "string" else F.col(names[c]) if c in names else F.lit(None).cast("string")).alias(c) for c in ("person_id", "location_id", "ts", "case_id", "event_type")]
        part = df.select(*own)
        out = part if out is None else out.unionByName(part)
    return out.dropna(subset=["person_id", "location_id", "ts"])


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1_000_000


def person_location_features(events: DataFrame) -> DataFrame:
    """Per person and place: visits, days, event types, cases, mean gap, night and weekend shares, span in days, and the person's total, share and place entropy.

    One aggregate and one window over the person; no join back.
    """
    parts = temporal_parts(F.col("ts"))
    own = events.groupBy("person_id", "location_id").agg(
        F.count("*").alias("visit_count"),
        F.count_distinct(F.to_date("ts")).alias("unique_days"),
        F.count_distinct("event_type").alias("unique_event_types"),
        F.count_distinct("case_id").alias("unique_cases"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.sum(parts["night_activity_flag"]).alias("night"),
        F.sum(parts["weekend_flag"]).alias("weekend"),
    )
    person = Window.partitionBy("person_id")
    total = F.sum("visit_count").over(person)
    share = F.col("visit_count") / total
    out = own.withColumns({
        "average_time_between_visits_sec": F.round(F.when(F.col("visit_count") > 1, seconds_between(F.col("first"), F.col("last")) / (F.col("visit_count") - 1)).otherwise(0.0), 3),
        "night_visit_ratio": F.round(F.col("night") / F.col("visit_count"), 6),
        "weekend_visit_ratio": F.round(F.col("weekend") / F.col("visit_count"), 6),
        "duration_days": F.floor(seconds_between(F.col("first"), F.col("last")) / 86400) + 1,
        "total_visits": total,
        "visit_prob": share,
    })
    entropy = F.round(F.sum(-F.col("visit_prob") * F.ln(F.col("visit_prob") + 1e-9)).over(person), 6)
    return out.withColumn("location_entropy", entropy).withColumn("visit_prob", F.round("visit_prob", 6)).drop("first", "last", "night", "weekend")


def colocation_pairs(events: DataFrame, minutes: int = 30) -> DataFrame:
    """(p1, p2, location_id, delta, shared_case, shared_type) for each two events of different people at a place within the window.

    Time is cut into buckets as long as the window; an event meets those of its own and of the next bucket, so the
    band join is an equi-join on (place, bucket) and a busy place spreads over its buckets.
    """
    width = 60 * minutes
    bucket = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / width)
    own = events.select("event_id", "person_id", "location_id", "ts", "case_id", "event_type").withColumn("bucket", bucket)
    a = own.select(*(F.col(c).alias(f"a_{c}") if c not in ("location_id", "bucket") else F.col(c) for c in own.columns))
    b = own.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)))
    later = (F.col("ts") > F.col("a_ts")) | ((F.col("ts") == F.col("a_ts")) & (F.col("event_id") > F.col("a_event_id")))
    delta = seconds_between(F.col("a_ts"), F.col("ts"))
    rows = a.join(b, ["location_id", "bucket"]).where((F.col("a_person_id") != F.col("person_id")) & later & (delta <= width))
    same = lambda c: F.coalesce((F.col(f"a_{c}") == F.col(c)).cast("int"), F.lit(0))
    return rows.select(F.least("a_person_id", "person_id").alias("p1"), F.greatest("a_person_id", "person_id").alias("p2"), "location_id", delta.alias("delta"), same("case_id").alias("shared_case"), same("event_type").alias("shared_type"))


#: Pairs of a block of colocation_features(), about; a task makes twice as many.
PAIRS = 1 << 19


def colocation_features(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Per pair of people and place: what colocation_pairs() has of them, counted and summed up.

    The result has a row for each pair that meets, so pairs are made, but never exchanged: people fall into groups by a hash,
    as many as a place's crowd needs, each event goes to the blocks of its group with every group, and a block makes and sums up the
    pairs between its two groups, so all of a pair's. What is exchanged is events times the groups of their place.
    """
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(dict(events.dtypes)["ts"]), F.col("ts"))
    own = events.where("person_id is not null and location_id is not null and ts is not null").select("event_id", "person_id", "location_id", us.alias("us"), "case_id", "event_type")
    width = 60_000_000 * minutes
    # An event meets about as many as its bucket of time holds.
    crowd = own.groupBy("location_id", F.floor(F.col("us") / width)).agg(F.count("*").alias("n")).groupBy("location_id").agg(F.sum(F.col("n") * F.col("n")).alias("about"))
    crowd = cut(crowd.withColumn("groups", F.ceil(F.sqrt(2 * F.col("about") / PAIRS)).cast("int")))
    many = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(crowd.agg(F.sum("about")).first()[0] or 0) // (2 * PAIRS)))
    dealt = own.join(crowd.drop("about"), "location_id").withColumn("g", F.pmod(F.xxhash64("person_id"), F.col("groups")).cast("int"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumns({"low": F.least("g", "x"), "high": F.greatest("g", "x")}).drop("groups", "x")
    block = ("location_id", "low", "high")
    soon = Window.partitionBy(*block).orderBy("us").rangeBetween(0, width)
    met = dealt.repartition(many, *block).withColumn("b", F.collect_list(F.struct("event_id", "person_id", "us", "case_id", "event_type", "g")).over(soon))
    rows = met.withColumn("b", F.explode("b"))
    other = lambda c: F.col(f"b.{c}")
    later = (other("us") > F.col("us")) | (other("event_id") > F.col("event_id"))
    rows = rows.where((other("person_id") != F.col("person_id")) & later & ((F.col("low") == F.col("high")) | (other("g") != F.col("g"))))
    same = lambda c: F.coalesce((F.col(c) == other(c)).cast("int"), F.lit(0))
    pairs = rows.select(*block, F.least("person_id", other("person_id")).alias("p1"), F.greatest("person_id", other("person_id")).alias("p2"), ((other("us") - F.col("us")) / 1_000_000).alias("delta"), same("case_id").alias("shared_case"), same("event_type").alias("shared_type"))
    out = pairs.groupBy("p1", "p2", *block).agg(F.count("*").alias("co_location_count"), F.round(F.min("delta"), 6).alias("minimum_time_difference"), F.round(F.avg("delta"), 3).alias("average_time_difference"), F.sum("shared_case").alias("shared_case_count"), F.sum("shared_type").alias("shared_event_type_count"))
    return out.drop("low", "high")


def _close_pairs(events: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(location_id, n): by place, the pairs of events(us, ...) of one group at most `width` apart that colocation_pairs() would make of different people.

    An event at t meets those before t less those before t - width: so sums of counts up to both points suffice, inside buckets
    and over buckets, and no pair is made. Of events at one time those of different, known ids are pairs.
    """
    at = events.groupBy(*keys, "us").agg(F.count("*").alias("n"))
    points = at.select(*keys, "us", F.col("n").alias("add"), F.col("n").alias("weight")).union(at.select(*keys, F.col("us") - width, F.lit(0).cast("long"), -F.col("n")))
    points = points.groupBy(*keys, "us").agg(F.sum("add").alias("add"), F.sum("weight").alias("weight")).withColumn("bucket", F.floor(F.col("us") / width))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("add").over(before([*keys, "bucket"], "us")), F.lit(0))
    buckets = points.withColumn("inside", inside).groupBy(*keys, "bucket").agg(F.sum("add").alias("add"), F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("inside")).alias("own"))
    earlier = F.coalesce(F.sum("add").over(before(keys, "bucket")), F.lit(0))
    apart = buckets.select("location_id", (F.col("own") + F.col("weight") * earlier).alias("n"))
    ids = events.where("event_id is not null").groupBy(*keys, "us", "event_id").agg(F.count("*").alias("m"))
    ties = ids.groupBy(*keys, "us").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same")).select("location_id", F.expr("(m * m - same) div 2").alias("n"))
    return apart.union(ties).groupBy("location_id").agg(F.sum("n").alias("n"))


def colocation_counts(events: DataFrame, minutes: int = 30) -> DataFrame:
    """(location_id, co_location_count): how many colocation_pairs() a place has, without making them: pairs of all its events less those of one person. It grows with the events, not with the pairs."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast(dict(events.dtypes)["ts"]), F.col("ts"))
    own = events.where("person_id is not null and location_id is not null and ts is not null").select("event_id", "person_id", "location_id", us.alias("us"))
    width = 60_000_000 * minutes
    every, same = _close_pairs(own, ["location_id"], width), _close_pairs(own, ["location_id", "person_id"], width)
    return every.union(same.select("location_id", -F.col("n"))).groupBy("location_id").agg(F.sum("n").alias("co_location_count"))


def location_stats(features: DataFrame, colocations: DataFrame) -> DataFrame:
    """Per place: visits, people, mean night share and mean days, and its co-locations (0 without any)."""
    own = features.groupBy("location_id").agg(F.sum("visit_count").alias("total_visits"), F.count_distinct("person_id").alias("unique_people"), F.round(F.avg("night_visit_ratio"), 6).alias("average_night_ratio"), F.round(F.avg("unique_days"), 6).alias("average_days"))
    met = colocations.groupBy("location_id").agg(F.sum("co_location_count").alias("co_locations"))
    return own.join(met, "location_id", "left").fillna(0, ["co_locations"])


def hotspots(stats: DataFrame, quantile: float = 0.85) -> DataFrame:
    """stats with hotspot_score .3 visits + .4 people + .3 co-locations and whether it reaches its exact quantile."""
    scored = cut(stats.withColumn("hotspot_score", F.round(0.3 * F.col("total_visits") + 0.4 * F.col("unique_people") + 0.3 * F.col("co_locations"), 6)))
    least = F.lit(exact_quantile(scored, "hotspot_score", quantile)).cast("double")
    return scored.withColumn("is_hotspot", F.col("hotspot_score") >= F.round(least, 9))


def lead_features(contacts: DataFrame, rows: int = 0) -> DataFrame:
    """Per unordered pair of contacts(p1, p2, kind (call or transaction), duration, amount, case_id): counts, sums, sources and guarded means.

    Contacts, about `rows`, are dealt out by pair once, in tasks of bounded size, and both sums are made there.
    """
    call, money = F.col("kind") == "call", F.col("kind") == "transaction"
    pairs = contacts.where("p1 is not null and p2 is not null and p1 != p2").select(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2"), "kind", "duration", "amount", "case_id")
    # Distinct cases are counted in two steps, of sums by case and then of those; kinds by one sum each. So no row is copied for a distinct count.
    by_case = dealt(pairs, rows, "p1", "p2").groupBy("p1", "p2", "case_id").agg(F.count_if(call).alias("calls"), F.count_if(money).alias("moves"), F.sum("amount").alias("amount"), F.sum("duration").alias("duration"), F.count("*").alias("n"))
    own = by_case.groupBy("p1", "p2").agg(
        F.sum("calls").alias("communication_frequency"),
        F.sum("moves").alias("transaction_count"),
        F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 4).alias("total_amount"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration"),
        F.count("case_id").alias("shared_case_count"),
        F.sum("n").alias("evidence_count"),
        ((F.sum("calls") > 0).cast("long") + (F.sum("moves") > 0).cast("long")).alias("multi_source_support"),
    )
    mean = lambda s, n: F.round(F.when(F.col(n) > 0, F.col(s) / F.col(n)).otherwise(0.0), 6)
    return own.withColumns({"average_call_duration": mean("total_duration", "communication_frequency"), "average_amount": mean("total_amount", "transaction_count")}).drop("total_duration")


def labelled_leads(features: DataFrame, quantile: float = 0.9) -> DataFrame:
    """features with the weak label is_lead, from exact quantiles of frequency and amount."""
    features = cut(features)
    often, much = (F.round(F.lit(exact_quantile(features, c, quantile)).cast("double"), 9) for c in ("communication_frequency", "total_amount"))
    label = weak_lead_label(*(F.col(c) for c in ("multi_source_support", "communication_frequency", "total_amount", "shared_case_count")), often, much)
    return features.withColumn("is_lead", label)


def ranked_leads(features: DataFrame, least: float = 0.4, person: str | None = None) -> DataFrame:
    """(p1, p2, lead_score, priority, requires_review) by the formula score, best first; for one person if given, filtered before anything else."""
    own = features.where((F.col("p1") == person) | (F.col("p2") == person)) if person else features
    score = F.round(fallback_lead_score(F.col("communication_frequency"), F.col("total_amount")), 6)
    return own.select("p1", "p2", score.alias("lead_score")).where(F.col("lead_score") > least).withColumn("priority", priority_band(F.col("lead_score"))).withColumn("requires_review", F.lit(True)).orderBy(F.desc("lead_score"), "p1", "p2")
