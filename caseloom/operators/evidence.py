"""A graph of evidence from several sources, each edge with its strength and the record behind it, and what it says of a pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.graph import merged_vertices

#: Kinds of edges and their strengths from 1 to 5.
STRENGTHS = {"LOCATED_AT": 1, "USES_VEHICLE": 2, "LOCATION_EVENT": 2, "COMMUNICATION": 3, "FINANCIAL_TRANSACTION": 4, "SHARED_CASE": 5}
#: Risk of nodes that a source without risk scores names first.
RISKS = {"place": 20, "vehicle": 30, "caller": 60, "callee": 55, "sender": 65, "receiver": 60, "accused": 75, "event place": 25, "visitor": 50}
#: Fixed value: the date of records without one.
NO_DATE = "2024-01-01"


def place_id(place: Column) -> Column:
    return F.concat(F.lit("LOC-"), F.replace(place, F.lit(" "), F.lit("_")))


def vehicle_id(plate: Column) -> Column:
    return F.concat(F.lit("VEH-"), plate)


def evidence_edges(entities: DataFrame, calls: DataFrame, transfers: DataFrame, cases: DataFrame, visits: DataFrame) -> DataFrame:
    """(edge_id, src, dst, type, strength, record, detail, date) from all rows of five sources; rows without an end give no edge.

    entities(record_id, person_id, name, place, vehicle, ts), calls(call_id, caller_id, callee_id, call_type, seconds, city, ts),
    transfers(txn_id, sender_id, receiver_id, amount, kind, sender_bank, receiver_bank, ts), cases(fir_id, accused_id, crime,
    sections, ts), visits(event_id, person_id, place, event_type, city, system, ts). One pass over each, without an exchange.
    """
    text, join = (lambda c: F.col(c).cast("string")), F.concat
    date = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit(NO_DATE))

    def of(rows: DataFrame, kind: str, edge_id: Column, src: Column, dst: Column, record: Column, detail: Column) -> DataFrame:
        out = rows.select(edge_id.alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(STRENGTHS[kind]).alias("strength"), record.alias("record"), detail.alias("detail"), date.alias("date"))
        return out.where("src is not null and dst is not null")

    person, l = text("person_id"), F.lit  # noqa: E741
    place, plate = place_id(F.col("place")), vehicle_id(F.col("vehicle"))
    amount = join(l("INR "), F.format_number("amount", 2), l(" transfer ("), F.coalesce("kind", l("Transfer")), l(") from "), F.coalesce("sender_bank", l("Bank")), l(" to "), F.coalesce("receiver_bank", l("Bank")))
    parts = [
        of(entities, "LOCATED_AT", join(l("e-loc-"), person, l("-"), place), person, place, join(l("Entity Record: "), text("record_id")), join(l("Primary location recorded as "), text("place"))),
        of(entities, "USES_VEHICLE", join(l("e-veh-"), person, l("-"), plate), person, plate, join(l("Vehicle Registry: "), text("vehicle")), join(l("Vehicle associated with subject "), F.coalesce("name", l("Identified Person")))),
        of(calls, "COMMUNICATION", join(l("call-"), text("call_id")), text("caller_id"), text("callee_id"), join(l("CDR ID: "), text("call_id")), join(F.coalesce("call_type", l("Voice")), l(" Call ("), F.coalesce(text("seconds"), l("0")), l("s) via "), F.coalesce("city", l("Tower Site")))),
        of(transfers, "FINANCIAL_TRANSACTION", join(l("txn-"), text("txn_id")), text("sender_id"), text("receiver_id"), join(l("Txn ID: "), text("txn_id")), amount),
        of(cases, "SHARED_CASE", join(l("fir-rel-"), text("fir_id"), l("-"), text("accused_id")), text("accused_id"), text("fir_id"), join(l("FIR Docket: "), text("fir_id")), join(l("Accused in "), text("crime"), l(" docket under IPC "), text("sections"))),
        of(visits, "LOCATION_EVENT", join(l("loc-event-"), text("event_id")), person, place, join(l("Event ID: "), text("event_id")), join(F.coalesce("event_type", l("Presence")), l(" logged in "), F.coalesce("city", l("")), l(" via "), F.coalesce("system", l("Sensor")))),
    ]
    return reduce(DataFrame.unionByName, parts)


def evidence_nodes(entities: DataFrame, calls: DataFrame, transfers: DataFrame, cases: DataFrame, visits: DataFrame) -> DataFrame:
    """(id, name, type, risk) of every end of evidence_edges(): the definition of the first source that names an id, entities first, as they alone have names and risks of their own (entities and cases: column risk)."""
    def of(rows: DataFrame, i: Column, name: Column, kind: str, risk: Column | int) -> DataFrame:
        return rows.select(i.cast("string").alias("id"), name.cast("string").alias("name"), F.lit(kind).alias("type"), (risk if isinstance(risk, Column) else F.lit(risk)).cast("int").alias("risk")).where("id is not null")

    c = F.col
    people = [(calls, "caller_id", "caller"), (calls, "callee_id", "callee"), (transfers, "sender_id", "sender"), (transfers, "receiver_id", "receiver")]
    parts = [of(entities, c("person_id"), F.coalesce("name", F.lit("Identified Person")), "PERSON", F.coalesce("risk", F.lit(50))), of(entities, place_id(c("place")), c("place"), "LOCATION", RISKS["place"]), of(entities, vehicle_id(c("vehicle")), c("vehicle"), "VEHICLE", RISKS["vehicle"])]
    parts += [of(df, c(i), c(i), "PERSON", RISKS[role]) for df, i, role in people]
    parts += [of(cases, c("fir_id"), F.concat(F.lit("FIR "), c("fir_id").cast("string")), "FIR", F.coalesce("risk", F.lit(7)) * 10), of(cases, c("accused_id"), c("accused_id"), "PERSON", RISKS["accused"])]
    parts += [of(visits, place_id(c("place")), c("place"), "LOCATION", RISKS["event place"]), of(visits, c("person_id"), c("person_id"), "PERSON", RISKS["visitor"])]
    # Ids come back in very many records: only different rows go on to the choice, which sorts what it is given.
    return merged_vertices(*(p.distinct() for p in parts))


def relationship_analysis(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair with edges of evidence: how many of each kind, kinds, summed and greatest strength, first and last date, days between, the record of the strongest evidence (ties: latest, then by its text), and a band.

    A single aggregate with partial sums; loops are left out.
    """
    own = edges.where("src != dst")
    count = lambda *kinds: F.count_if(F.col("type").isin(*kinds))
    out = own.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.count("*").alias("evidence"), count("COMMUNICATION").alias("calls"), count("FINANCIAL_TRANSACTION").alias("transfers"), count("SHARED_CASE").alias("cases"), count("LOCATED_AT", "LOCATION_EVENT").alias("places"), count("USES_VEHICLE").alias("vehicles"),
        F.sum("strength").alias("strength"), F.max("strength").alias("strongest"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max(F.struct("strength", "date", "record"))["record"].alias("record"),
    )
    kinds = sum(((F.col(k) > 0).cast("int") for k in ("transfers", "cases", "places", "vehicles")), (F.col("calls") > 0).cast("int"))
    out = out.withColumn("kinds", kinds).withColumn("days", F.datediff(F.to_date("last_date"), F.to_date("first_date")))
    band = F.when((F.col("kinds") > 1) & (F.col("strength") >= 20), "STRONG").when((F.col("kinds") > 1) | (F.col("strength") >= 10), "MODERATE").otherwise("WEAK")
    return out.withColumn("band", band)


def scoped_network(nodes: DataFrame, edges: DataFrame, members: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """The network that an analysis looks at: all of it for COMBINED; for DATASET_ONLY the nodes of members(id) without any edges, as a dataset alone says nothing of links."""
    if scope == "COMBINED":
        return nodes, edges
    if scope != "DATASET_ONLY":
        raise ValueError(f"scope {scope} is none of COMBINED, DATASET_ONLY")
    return nodes.join(members.select("id").distinct(), "id", "left_semi"), edges.limit(0)
