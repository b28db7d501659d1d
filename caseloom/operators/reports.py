"""Case reports and dossiers: one table per section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.scores import identity_confidence
from caseloom.operators.graph import neighbours
from caseloom.operators.ledger import verified
from caseloom.operators.records import by_id_or_name, timeline


def case_report(case: DataFrame, parts: dict[str, DataFrame], ledger: DataFrame) -> dict[str, DataFrame]:
    """Sections of a report on case(case_id): the case, the rows of each part(case_id, ...), their counts and the ledger's real state."""
    own = {n: df.join(case.select("case_id"), "case_id", "left_semi") for n, df in parts.items()}
    metrics = reduce(DataFrame.union, (df.agg(F.lit(n).alias("metric"), F.count("*").cast("string").alias("value")) for n, df in own.items()))
    state = verified(ledger).select(F.lit("ledger").alias("metric"), F.when(F.col("intact"), "INTACT").otherwise("COMPROMISED").alias("value"))
    return {"case": case, **own, "metrics": metrics.union(state)}


def dossier(person: DataFrame, tables: dict[str, tuple[DataFrame, str, str]], edges: DataFrame) -> dict[str, DataFrame]:
    """Sections on person(person_id, name, risk): identity with its confidence, each table's rows by id or name, the timeline, and direct contacts.

    tables: name to (table with person_id, name, an id and a time, id column, time column).
    """
    found = {n: by_id_or_name(person, df) for n, (df, _, _) in tables.items()}
    identity = person.withColumn("identity_confidence", identity_confidence(F.col("risk"))).withColumn("requires_review", F.lit(True))
    line = timeline(*((found[n], n, key, ts) for n, (_, key, ts) in tables.items()), key="person")
    near = neighbours(edges).join(person.select(F.col("person_id").alias("id")), "id", "left_semi")
    return {"identity": identity, **found, "timeline": line, "network": near}
