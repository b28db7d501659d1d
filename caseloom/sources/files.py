"""Sources and sinks: delimited, JSON, text and binary files, tables by JDBC, and results as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseloom.functions import normalize as N
from caseloom.operators.graph import cut


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, sep: str = ",") -> DataFrame:
    """A CSV or TSV file with a header; a missing file is an empty table if a schema says which."""
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None, lines: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole documents decoded as UTF-8; of binary formats only what decodes is of use."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A table by JDBC; with a numeric key and its bounds, read in parts side by side."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def mapped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns renamed by source name; those that are not mapped go."""
    return df.select(*(F.col(a).alias(b) for a, b in columns.items()))


def missing_columns(df: DataFrame, needed: Sequence[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def _normalizer(name: str) -> Column:
    """By what the column's name says."""
    low, c = name.lower(), F.col(f"`{name}`").cast("string")
    for words, f in ((("phone", "mobile", "caller", "receiver"), N.d_phone), (("vehicle", "plate", "registration"), N.d_vehicle), (("location", "address", "city", "place"), N.d_location), (("org", "company"), N.d_organization), (("name", "person"), N.d_name)):
        if any(w in low for w in words):
            return f(c)
    return F.trim(c)


def ingested(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """(row_index, raw, normalized): records as JSON, as they are and normalized by column names, numbered from 1 in the given order.

    Numbers come from counts of sorted ranges and not from one window: rows are range-partitioned by the order, and each
    partition starts after the rows of those before it.
    """
    raw = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    clean = F.to_json(F.struct(*(_normalizer(c).alias(c) for c in df.columns)))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select(raw.alias("raw"), clean.alias("normalized"), F.monotonically_increasing_id().alias("at"))
    kept = cut(ranged)
    # The id holds the partition above its 33 low bits and the row's place below; there is one count for each partition.
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    first = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return kept.withColumn("part", part).join(F.broadcast(first), "part").select((F.col("before") + place + 1).alias("row_index"), "raw", "normalized")


def detected_format(path: str) -> str:
    """json, csv, tsv or text, by the file's name."""
    end = path.lower().rsplit(".", 1)[-1]
    return {"json": "json", "csv": "csv", "tsv": "tsv", "tab": "tsv"}.get(end, "text")


def checked_ingest(kind: str, scope: str = "COMBINED", case_id: str | None = None) -> None:
    """ValueError for a source type other than CSV, JSON or TXT, or DATASET_ONLY without a case."""
    if kind.upper() not in ("CSV", "JSON", "TXT"):
        raise ValueError(f"source type {kind} is none of CSV, JSON, TXT")
    if scope not in ("COMBINED", "DATASET_ONLY"):
        raise ValueError(f"scope {scope} is none of COMBINED, DATASET_ONLY")
    if scope == "DATASET_ONLY" and not case_id:
        raise ValueError("DATASET_ONLY needs a case")


def parsed_json(c: Column, schema: str) -> Column:
    """(parsed, raw): the value by the schema, and the text where it cannot be read."""
    value = F.from_json(c, schema)
    return F.struct(value.alias("parsed"), F.when(value.isNull(), c).alias("raw"))


def write_result(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def samples(spark: SparkSession, kind: str) -> DataFrame:
    """A few made records of a kind, for trying the ingest."""
    made = {
        "CDR": ("caller string, receiver string, duration_sec int, timestamp string", [("+919876512345", "+919988776655", 120, "2026-01-15T14:30:00Z"), ("+919988776655", "+919811223344", 45, "2026-01-15T15:10:00Z")]),
        "TRANSACTION": ("sender string, receiver string, amount double, timestamp string", [("ACC-1", "ACC-2", 250000.0, "2026-01-16T10:00:00Z")]),
        "LOCATION": ("person string, location string, timestamp string", [("Rahul Kumar", "sector 18", "2026-01-15T20:00:00Z")]),
    }
    schema, rows = made.get(kind.upper(), ("record string", [("sample",)]))
    return spark.createDataFrame(rows, schema)
