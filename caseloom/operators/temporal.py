"""Temporal anomalies around a reference time, against a binned baseline; rule detectors and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.scores import temporal_band
from caseloom.operators.ranking import ranked


def _score(observed: Column, mean: Column, std: Column, history: Column) -> Column:
    z = F.greatest(F.lit(0.0), F.round((observed - mean) / std, 2))
    return (
        F.when((observed == 0) & (mean == 0), 0.0)
        .when(std > 0, z)
        .when(history > 0, F.when(observed > mean, F.least(F.lit(5.0), F.round(1 + 0.5 * (observed - mean), 2))).otherwise(0.0))
        .when(observed > 0, F.least(F.lit(3.0), F.round(0.5 + 0.4 * observed, 2)))
        .otherwise(0.0)
    )


def temporal_anomalies(events: DataFrame, at: str, before_minutes: int = 120, after_minutes: int = 120, baseline_days: int = 30) -> DataFrame:
    """Per entity of events(entity_id, ts): observed counts before and after `at`, their binned baselines, scores, level and status.

    The baseline runs from baseline_days before `at` to the window's start, in bins as long as each window; a remainder
    goes with the last bin, and empty bins count as zero: mean and deviation come from sums of counts and of their
    squares over all bins, without making the empty ones. Windows are clamped to 5..10080 minutes, days to 1..365.
    Minutes from the reference are cut towards zero, so events less than a minute early count as after it.
    """
    before_minutes, after_minutes = (max(5, min(10080, m)) for m in (before_minutes, after_minutes))
    baseline_days = max(1, min(365, baseline_days))
    at_c = F.lit(at).cast("timestamp_ntz")
    ts = F.col("ts").cast("timestamp_ntz")
    start, low = at_c - F.expr(f"INTERVAL {baseline_days} DAYS"), at_c - F.expr(f"INTERVAL {before_minutes} MINUTES")
    high = at_c + F.expr(f"INTERVAL {after_minutes} MINUTES")
    span = max(1, baseline_days * 1440 - before_minutes)
    bins = {"before": max(1, span // before_minutes), "after": max(1, span // after_minutes)}
    minutes = {"before": before_minutes, "after": after_minutes}
    rows = events.where("entity_id is not null").withColumn("ts", ts).where((ts >= start) & (ts <= high))
    offset = F.timestamp_diff("MICROSECOND", start, F.col("ts")) / 1e6
    rows = rows.withColumn("old", F.col("ts") < low).withColumn("early", F.timestamp_diff("MICROSECOND", at_c, F.col("ts")) <= -60_000_000)
    observed = rows.groupBy("entity_id").agg(F.count_if(~F.col("old") & F.col("early")).alias("before_count"), F.count_if(~F.col("old") & ~F.col("early")).alias("after_count"), F.count_if("old").alias("history"))
    out = observed
    for side in ("before", "after"):
        bin_of = F.least(F.lit(bins[side] - 1), F.floor(offset / (60.0 * minutes[side])))
        counts = rows.where("old").groupBy("entity_id", bin_of.alias("bin")).agg(F.count("*").alias("n"))
        sums = counts.groupBy("entity_id").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
        mean = F.coalesce("s", F.lit(0)) / bins[side]
        var = F.greatest(F.lit(0.0), F.coalesce("q", F.lit(0)) / bins[side] - mean * mean)
        # A deviation below 1e-6 is what cancellation leaves of equal counts.
        std = F.sqrt(F.when(var < 1e-12, 0.0).otherwise(var))
        out = out.join(sums, "entity_id", "left").withColumns({f"{side}_mean": mean, f"{side}_std": std}).drop("s", "q")
        out = out.withColumn(f"{side}_score", _score(F.col(f"{side}_count"), F.col(f"{side}_mean"), F.col(f"{side}_std"), F.col("history")))
    score = F.round(F.greatest("before_score", "after_score"), 2)
    few = min(bins.values()) < 5
    status = F.when(F.col("history") == 0, "NO_HISTORICAL_ACTIVITY").when(F.lit(few), "INSUFFICIENT_DATA").when((F.col("before_std") == 0) & (F.col("after_std") == 0), "LOW_VARIANCE").otherwise("STATISTICALLY_SUPPORTED")
    confidence = F.when(F.col("status").isin("NO_HISTORICAL_ACTIVITY", "INSUFFICIENT_DATA"), "LOW").when(F.col("status") == "LOW_VARIANCE", "MEDIUM").otherwise("HIGH")
    out = out.withColumn("score", score).withColumn("level", temporal_band(score)).withColumn("status", status).withColumn("confidence", confidence)
    return out.select("entity_id", "before_count", "after_count", "history", *(F.round(c, 2).alias(c) for c in ("before_mean", "before_std", "before_score", "after_mean", "after_std", "after_score")), "score", "level", "status", "confidence", F.lit(True).alias("requires_review"))


def reason(name: Column, score: Column, level: Column) -> Column:
    """What a temporal score says of an entity, as a lead for review."""
    text = F.when(level.isin("CRITICAL", "HIGH"), "Entity '%s' recorded a marked temporal activity anomaly (Score: %.2f).").when(level == "MEDIUM", "Entity '%s' exhibited moderate activity elevation (Score: %.2f).").otherwise("Entity '%s' activity is consistent with normal baseline levels (Score: %.2f).")
    own = [F.when(text == t, F.format_string(t, name, score)) for t in ("Entity '%s' recorded a marked temporal activity anomaly (Score: %.2f).", "Entity '%s' exhibited moderate activity elevation (Score: %.2f).", "Entity '%s' activity is consistent with normal baseline levels (Score: %.2f).")]
    return F.concat(F.coalesce(*own), F.lit(" Investigative signal only; investigator review required."))


def split_timeline(events: DataFrame, at: str, half_up: bool = False) -> DataFrame:
    """events with minutes from `at`, cut towards zero or (half_up) rounded, and the timing BEFORE, AT_CRIME or AFTER."""
    exact = F.timestamp_diff("MICROSECOND", F.lit(at).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 60e6
    minutes = (F.floor(exact + 0.5) if half_up else exact).cast("long")
    return events.withColumn("minutes", minutes).withColumn("timing", F.when(minutes < 0, "BEFORE").when(minutes > 0, "AFTER").otherwise("AT_CRIME"))


def unusual_hours(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events from 1 to 4 o'clock; a null time counts as noon."""
    return events.where(F.coalesce(F.hour(ts), F.lit(12)).isin(1, 2, 3, 4)).withColumn("anomaly", F.lit("UNUSUAL_COMMUNICATION_HOURS"))


def above(rows: DataFrame, column: str, limit: float, kind: str, severity: str = "HIGH") -> DataFrame:
    """Rows whose value exceeds the limit, such as amounts over 200,000 or speeds over 120, with kind and severity."""
    return rows.where(F.col(column) > limit).withColumns({"anomaly": F.lit(kind), "severity": F.lit(severity)})


def repeated_locations(events: DataFrame, least: int = 2) -> DataFrame:
    """Places where at least so many different people were."""
    return events.groupBy("location_id").agg(F.count_distinct("person_id").alias("people"), F.count("*").alias("events")).where(F.col("people") >= least)


def repeated_contacts(contacts: DataFrame, least: int = 5) -> DataFrame:
    """Unordered pairs with at least so many contacts."""
    return contacts.groupBy(F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2")).agg(F.count("*").alias("contacts")).where(F.col("contacts") >= least)


def transaction_chains(moves: DataFrame, least: float) -> DataFrame:
    """(a, b, c, n): money that went on from a receiver to a third party, for moves(sender, receiver, amount) of at least so much."""
    big = moves.where(F.col("amount") >= least).groupBy("sender", "receiver").agg(F.count("*").alias("n"))
    first = big.select(F.col("sender").alias("a"), F.col("receiver").alias("b"), F.col("n").alias("m"))
    second = big.select(F.col("sender").alias("b"), F.col("receiver").alias("c"), "n")
    return first.join(second, "b").where("a != c").select("a", "b", "c", (F.col("m") * F.col("n")).alias("n"))


def lockouts(logins: DataFrame, failures: int = 5, minutes: int = 15) -> DataFrame:
    """(user_id, ts, streak, locked_until) of logins(user_id, ts, success) at which a run of failures reaches the limit."""
    order = Window.partitionBy("user_id").orderBy("ts", "login_id")
    run = F.sum(F.col("success").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = logins.withColumn("run", run).where(~F.col("success"))
    streak = F.row_number().over(Window.partitionBy("user_id", "run").orderBy("ts", "login_id"))
    return rows.withColumn("streak", streak).where(F.col("streak") == failures).select("user_id", "ts", "streak", (F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("locked_until"))


def windowed_counts(events: DataFrame, hours: int = 4) -> DataFrame:
    """(window_start, n): events in fixed windows."""
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), f"{hours} hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def window_events(events: DataFrame, entities: DataFrame, at: str, before_minutes: int, after_minutes: int) -> DataFrame:
    """(event_id, entity_id, entity_name, entity_type, minutes, timing, unassigned): events around `at` with their entity(entity_id, name, type), if there is one; without an id an event is unassigned."""
    ts, when = F.col("ts").cast("timestamp_ntz"), F.lit(at).cast("timestamp_ntz")
    near = events.where((ts >= when - F.expr(f"INTERVAL {before_minutes} MINUTES")) & (ts <= when + F.expr(f"INTERVAL {after_minutes} MINUTES")))
    known = entities.select("entity_id", F.col("name").alias("entity_name"), F.col("type").alias("entity_type"))
    return split_timeline(near, at).join(known, "entity_id", "left").select("event_id", "entity_id", "entity_name", "entity_type", "minutes", "timing", F.col("entity_id").isNull().alias("unassigned"))


def seeded(anomalies: DataFrame, seed: DataFrame) -> DataFrame:
    """Temporal anomalies with a row for each entity of a case, seed(entity_id), also where it has no event at all."""
    zeros = {c: 0 for c, t in anomalies.dtypes if t in ("int", "bigint", "double")}
    texts = {"level": "LOW", "status": "NO_HISTORICAL_ACTIVITY", "confidence": "LOW"}
    own = seed.select("entity_id").distinct()
    return anomalies.join(own, "entity_id", "full").fillna({k: v for k, v in zeros.items() if k != "entity_id"}).fillna(texts).fillna(True, ["requires_review"])


def ranked_anomalies(anomalies: DataFrame) -> DataFrame:
    """(rank, entity_id, score, activity) of every entity: by score, then by most events in the window, then by smallest id."""
    rows = anomalies.select("entity_id", "score", (F.col("before_count") + F.col("after_count")).alias("activity"))
    return ranked(rows, F.desc("score"), F.desc("activity"), "entity_id")
