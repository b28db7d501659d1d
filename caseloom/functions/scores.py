"""Scores, bands and explanations as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colours of node types.
TYPE_COLOURS = {"PERSON": "#E07A5F", "PHONE": "#3D5A80", "VEHICLE": "#81B29A", "LOCATION": "#F4A261", "ORGANIZATION": "#9B5DE5", "BANK_ACCOUNT": "#F15BB5", "TRANSACTION": "#00BBF9"}
#: Weights of the resolution signals.
RESOLUTION_WEIGHTS = {"name": 0.35, "alias": 0.20, "phone": 0.20, "vehicle": 0.10, "location": 0.05, "semantic": 0.10}
#: What a lead's feature means, %s being its value.
FEATURE_TEXTS = {
    "communication_frequency": "The entities have communicated %s times, which is highly significant.",
    "average_call_duration": "The average call duration between them was %s seconds.",
    "transaction_count": "There are %s recorded financial transactions between these entities.",
    "total_amount": "A total of %s INR was transferred between them.",
    "shared_case_count": "These entities appear together in %s other case investigations.",
    "evidence_count": "The relationship is backed by %s direct evidence records.",
    "multi_source_support": "%s independent intelligence sources support this relationship.",
    "visit_count": "The entity was observed at this location %s times.",
    "night_visit_ratio": "An unusually high %s%% of visits occurred during late night hours.",
}
WARNING = " This pattern may warrant further investigation."


def banded(value: Column, steps: Sequence[tuple[float, str]], rest: str, over: bool = False) -> Column:
    """The name of the first step that value reaches (or exceeds, with over)."""
    out = None
    for low, name in steps:
        test = value > low if over else value >= low
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(rest)


def anomaly_band(score: Column) -> Column:
    return banded(score, ((0.6, "HIGH"), (0.4, "MEDIUM")), "LOW", over=True)


def priority_band(score: Column) -> Column:
    return banded(score, ((0.8, "HIGH"), (0.5, "MEDIUM")), "LOW", over=True)


def temporal_band(score: Column) -> Column:
    return banded(score, ((3.5, "CRITICAL"), (2.5, "HIGH"), (1.5, "MEDIUM")), "LOW")


def relationship_strength(calls: Column, amount: Column, shared: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(10), calls * 2 + F.floor(amount / 50000) + shared * 15)).cast("int")


def link_weight(strength: Column) -> Column:
    return F.least(F.lit(4), 1 + F.bround(strength / 30)).cast("int")


def link_weight_wide(strength: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(1), F.round(strength / 20))).cast("int")


def type_colour(kind: Column, default: str = "#6C757D") -> Column:
    colours = F.create_map(*(F.lit(x) for kv in TYPE_COLOURS.items() for x in kv))
    return F.coalesce(F.try_element_at(colours, F.upper(kind)), F.lit(default))


def area_label(place: Column, default: str = "Local Sector") -> Column:
    """Of the first line what stands after the last comma."""
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(F.element_at(F.split(F.coalesce(place, F.lit("")), "\n"), 1), ","), -1)), F.lit("")), F.lit(default))


def district(place: Column) -> Column:
    return F.trim(F.element_at(F.split(place, ","), 1))


def weak_lead_label(sources: Column, frequency: Column, amount: Column, shared: Column, high_frequency: Column, high_amount: Column) -> Column:
    points = F.when(sources > 1, 2).otherwise(0) + (frequency >= high_frequency).cast("int") + (amount >= high_amount).cast("int") + (shared > 0).cast("int")
    return (points >= 2).cast("int")


def fallback_lead_score(frequency: Column, amount: Column) -> Column:
    return F.least(F.lit(0.5), F.greatest(F.lit(0.0), frequency / 600)) + F.least(F.lit(0.5), F.greatest(F.lit(0.0), amount / 3_000_000))


def identity_confidence(risk: Column) -> Column:
    return F.least(F.lit(95), 50 + F.floor(risk / 2)).cast("int")


def activity_score(n: Column, most: Column, sources: Column, flagged: Column) -> Column:
    raw = 70 * n / F.greatest(most, F.lit(1)) + 20 * F.least(sources, F.lit(5)) / 5 + 10 * flagged / F.greatest(n, F.lit(1))
    return F.least(F.lit(100), F.round(raw)).cast("int")


def feature_text(feature: Column, value: Column, positive: Column) -> Column:
    """A sentence on a lead's feature. Shares are given in per cent."""
    whole = F.floor(F.coalesce(value, F.lit(0.0))).cast("long").cast("string")
    out = None
    for name, text in FEATURE_TEXTS.items():
        shown = F.floor(F.coalesce(value, F.lit(0.0)) * 100).cast("long").cast("string") if name.endswith("ratio") else F.coalesce(value, F.lit(0.0)).cast("decimal(20,2)").cast("string") if name == "total_amount" else whole
        before, after = text.replace("%%", "%").split("%s")
        own = F.concat(F.lit(before), shown, F.lit(after))
        out = F.when(feature == name, own) if out is None else out.when(feature == name, own)
    other = F.concat(F.lit("Feature "), feature, F.lit(" contributed "), F.when(positive, "positively").otherwise("negatively"), F.lit("."))
    return F.concat(out.otherwise(other), F.when(positive, WARNING).otherwise(""))


def feature_source(feature: Column) -> Column:
    """The source table of a feature's evidence."""
    has = lambda *words: F.lower(feature).rlike("|".join(words))
    return F.when(has("call", "communication"), "calls").when(has("amount", "transaction"), "transactions").when(has("visit", "location"), "location events").otherwise("master intelligence")


def sha256_of(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def block_hash(index: Column, ts: Column, data: Column, previous: Column, action: Column) -> Column:
    """SHA-256 of index, the first 19 characters of the time, data hash, previous hash and action."""
    return sha256_of(index.cast("string"), F.substring(ts.cast("string"), 1, 19), data, previous, action)


def provenance_hash(row: Column) -> Column:
    return F.concat(F.lit("SHA256:"), F.sha2(F.to_json(row), 256))


def weighted(signals: dict[str, tuple[Column, Column]], weights: dict[str, float]) -> Column:
    """Sum of signal x weight over the signals whose field is there, over the sum of their weights; 0 without any."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, (value, there) in signals.items():
        top += F.when(there, value * weights[name]).otherwise(0.0)
        bottom += F.when(there, weights[name]).otherwise(0.0)
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def resolution_decision(score: Column) -> Column:
    return banded(score, ((0.85, "HIGH_CONFIDENCE_MATCH"), (0.65, "POTENTIAL_LEAD_REVIEW_REQUIRED")), "DISTINCT_ENTITY")
