"""Located activity: time filters, hierarchical roll-up, activity scores and data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.scores import activity_score, area_label

#: Days of the named time ranges.
RANGES = {"7d": 7, "30d": 30, "6m": 180}


def time_bounds(name: str, as_of: str, start: str | None = None, end: str | None = None) -> tuple[Column | None, Column | None]:
    """(from, to) of a named range before as_of, of custom bounds, or (None, None) for all."""
    if name in RANGES:
        now = F.lit(as_of).cast("timestamp_ntz")
        return now - F.expr(f"INTERVAL {RANGES[name]} DAYS"), now
    if name == "custom":
        return tuple(F.lit(x).cast("timestamp_ntz") if x else None for x in (start, end))
    return None, None


def within(ts: Column, low: Column | None, high: Column | None) -> Column:
    """Inclusive bounds; a null time passes."""
    test = F.lit(True)
    if low is not None:
        test &= ts >= low
    if high is not None:
        test &= ts <= high
    return ts.isNull() | test


def incident_window(incident: Column, days: int) -> tuple[Column, Column]:
    """From so many days before an incident's day to 23:59 on the day as many after it."""
    day = F.date_trunc("day", incident).cast("timestamp_ntz")
    return day - F.expr(f"INTERVAL {days} DAYS"), day + F.expr(f"INTERVAL {days} DAYS 23 HOURS 59 MINUTES")


def located(records: DataFrame) -> DataFrame:
    return records.where("lat != 0 and lon != 0")


def rolled_up(records: DataFrame, level: str, state: str | None = None, district: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Clusters of records(state, district, place, lat, lon, source, flagged) at a level.

    india: per state, of known(state) if given. state: per district of the state in known(ordinal, district), where
    records of other districts count for the first and districts without records appear with intensity 0.1. district:
    per area, with mean coordinates. Each has activity_count, source_count, flagged_count, activity_score and intensity.
    """
    rows = located(records)
    if level == "india":
        rows = rows.join(F.broadcast(known), "state", "left_semi") if known is not None else rows
        key = F.col("state")
    elif level == "state":
        rows = rows.where(F.lower("state") == (state or "").lower())
        first = known.agg(F.min_by("district", "ordinal").alias("first"))
        rows = rows.join(F.broadcast(known.select(F.col("district").alias("own"))), F.col("district") == F.col("own"), "left").join(F.broadcast(first)).withColumn("district", F.coalesce("own", "first"))
        key = F.col("district")
    else:
        rows = rows.where(F.col("district") == district) if district else rows
        key = area_label(F.col("place"))
    out = rows.groupBy(key.alias("title")).agg(F.count("*").alias("activity_count"), F.count_distinct("source").alias("source_count"), F.count_if("flagged").alias("flagged_count"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))
    if level == "state":
        out = known.select(F.col("district").alias("title")).join(out, "title", "left").fillna(0, ["activity_count", "flagged_count"]).fillna(1, ["source_count"])
    most = F.greatest(F.max("activity_count").over(Window.partitionBy()), F.lit(1))
    n = F.col("activity_count")
    out = out.withColumn("activity_score", activity_score(n, most, F.col("source_count"), F.col("flagged_count"))).withColumn("intensity", F.when(n > 0, F.round(n / most, 2)).otherwise(0.1))
    return out.select("title", "activity_count", "source_count", "flagged_count", "lat", "lon", "activity_score", "intensity")


def hierarchy(records: DataFrame) -> DataFrame:
    """Counts of all levels at once: (level, state, district, place, n), level 0 for the total."""
    rolled = located(records).rollup("state", "district", "place").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    level = F.when(F.col("g") == 7, 0).when(F.col("g") == 3, 1).when(F.col("g") == 1, 2).otherwise(3)
    return rolled.select(level.alias("level"), "state", "district", "place", "n")


def recent_events(records: DataFrame, key: str, k: int = 4) -> DataFrame:
    """(key, events): the k latest records of each group, latest first."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("ts"), "id")
    top = records.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("events"))


def data_quality(records: DataFrame) -> DataFrame:
    """One row: records, with and without coordinates, coverage and completeness in per cent, distinct sources."""
    has = F.coalesce((F.col("lat") != 0) & (F.col("lon") != 0), F.lit(False))
    whole = F.col("ts").isNotNull() & (F.coalesce(F.col("place"), F.lit("")) != F.lit("")) | F.col("ts").isNotNull() & F.col("district").isNotNull()
    n = F.count("*")
    share = lambda c: F.round(100 * F.count_if(c) / F.greatest(n, F.lit(1)), 1)
    return records.agg(n.alias("records"), F.count_if(has).alias("with_location"), F.count_if(~has).alias("missing_location"), share(~has).alias("missing_pct"), share(has).alias("coverage_pct"), share(whole).alias("completeness_pct"), F.count_distinct("source").alias("source_count"))


def inferred_state(places: DataFrame, city: str, known: DataFrame, default: str) -> DataFrame:
    """places with `state`: of the known(ordinal, district, state) equal to the city, else the first that holds it or is held by it, else the default.

    Equal names are an equi-join; only distinct cities without one meet the dimension, so the second join stays small.
    """
    exact = known.groupBy(F.col("district").alias(city)).agg(F.min_by("state", "ordinal").alias("exact"))
    joined = places.join(F.broadcast(exact), city, "left")
    rest = joined.where(F.col("exact").isNull() & F.col(city).isNotNull() & (F.trim(city) != "")).select(city).distinct()
    a, b = F.lower(F.trim(city)), F.lower("district")
    near = rest.join(F.broadcast(known), a.contains(b) | b.contains(a)).groupBy(city).agg(F.min_by("state", "ordinal").alias("near"))
    return joined.join(near, city, "left").withColumn("state", F.coalesce("exact", "near", F.lit(default))).drop("exact", "near")


def place_members(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(place_id, name, type, activity): for links(src, dst, n) to nodes(id, name, type) of type LOCATION, each linked name once, with the sum of its links' counts; of several types of a name the smallest."""
    places = nodes.where("type = 'LOCATION'").select(F.col("id").alias("dst"))
    sources = nodes.select(F.col("id").alias("src"), "name", "type")
    sums = links.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return sums.join(places, "dst").join(sources, "src").groupBy(F.col("dst").alias("place_id"), "name").agg(F.min("type").alias("type"), F.sum("n").alias("activity"))


def linked_places(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(place_id, name, entities, activity, share): linked names and activity of each place, and its share in per cent of the busiest one's."""
    own = place_members(links, nodes).groupBy("place_id").agg(F.count("*").alias("entities"), F.sum("activity").alias("activity"))
    most = F.broadcast(own.agg(F.greatest(F.max("activity"), F.lit(1)).alias("most")))
    named = own.join(nodes.select(F.col("id").alias("place_id"), "name"), "place_id").join(most)
    return named.select("place_id", "name", "entities", "activity", F.round(100 * F.col("activity") / F.col("most"), 2).alias("share"))


def hierarchy_listing(records: DataFrame, areas: int = 15) -> DataFrame:
    """(state, district, areas, first_areas): each district with how many areas it has and the first of them by name."""
    own = records.select("state", "district", "place").where("state is not null and district is not null and place is not null").distinct()
    order = Window.partitionBy("state", "district").orderBy("place")
    first = own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= areas).groupBy("state", "district").agg(F.array_sort(F.collect_list("place")).alias("first_areas"))
    return own.groupBy("state", "district").agg(F.count("*").alias("areas")).join(first, ["state", "district"])


def requested_hotspots(records: DataFrame, state: str | None = None, district: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Clusters at the level that a request asks for, with the level: areas of a district if one is given, else districts of a state, else states."""
    level = "district" if district else "state" if state else "india"
    return rolled_up(records, level, state, district, known).withColumn("level", F.lit(level))


def activity_records(sources: dict[str, DataFrame], limits: dict[str, int] | None = None) -> DataFrame:
    """(category, id, source, event_type, subject, state, district, detail, lat, lon, confidence, ts, flagged, case_id) of all sources by category; with limits, of each the newest so many (ties by id), else all."""
    names = ("id", "source", "event_type", "subject", "state", "district", "detail", "lat", "lon", "confidence", "ts", "flagged", "case_id")
    parts = []
    for category, rows in sources.items():
        own = rows.select(F.lit(category).alias("category"), *(F.col(n) for n in names))
        parts.append(own.orderBy(F.desc_nulls_last("ts"), "id").limit(limits[category]) if limits and category in limits else own)
    return reduce(DataFrame.unionByName, parts)
