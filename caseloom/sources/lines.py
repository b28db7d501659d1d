"""Lines of unknown format as dynamic records: detected by what they hold, read as far as they can be, kept as they are where not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_format(text: Column) -> Column:
    """json, tsv, csv or text, by content: an opening brace or bracket, a tab, a comma, or none of them; null for a null or blank line."""
    own = F.trim(text, F.lit(" \t\r\n"))
    return F.when(own != "", F.when(own.startswith("{") | own.startswith("["), "json").when(text.contains("\t"), "tsv").when(text.contains(","), "csv").otherwise("text"))


def _delimited(text: Column, columns: Sequence[str], sep: str) -> Column:
    """The line's fields as a struct, null if it has more or fewer than the columns."""
    schema = ", ".join(f"`{c}` string" for c in (*columns, "_unread"))
    row = F.from_csv(text, schema, {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread", "escape": '"'})
    return F.when(row["_unread"].isNull(), F.struct(*(row[c].alias(c) for c in columns)))


def dynamic_records(lines: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """lines with `format`, `record` (a VARIANT of the whole JSON value, or of the delimited fields by name) and `raw`, the line itself where no record could be read.

    Broken JSON, lines of another number of fields and free text are raw; nothing is dropped. All of it is expressions, so a
    scan stays one pass.
    """
    line = F.col(text)
    kind = line_format(line)
    named = lambda sep: F.to_json(_delimited(line, columns, sep), {"ignoreNullFields": "false"})
    value = F.when(kind == "json", F.try_parse_json(line)).when(kind == "csv", F.try_parse_json(named(","))).when(kind == "tsv", F.try_parse_json(named("\t")))
    return lines.withColumn("format", kind).withColumn("record", value).withColumn("raw", F.when(F.col("record").isNull(), line))


def field(record: str, path: str, kind: str = "string") -> Column:
    """A field of a record by JSON path, null where it is missing or of another kind."""
    return F.try_variant_get(F.col(record), path, kind)


def ingest_summary(records: DataFrame) -> DataFrame:
    """(format, lines, unreadable, schema): how many lines of each format there are, how many could not be read, and the schema that all records of the format fit."""
    return records.groupBy("format").agg(F.count("*").alias("lines"), F.count("raw").alias("unreadable"), F.schema_of_variant_agg("record").alias("schema"))
