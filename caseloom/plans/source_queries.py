"""Sources and sinks over the driver's tables: mixed lines, files of several kinds written and read back, appended rows, a paged source, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import records as R
from caseloom.operators.graph import shared_path
from caseloom.registry import load, query
from caseloom.sources import files as S
from caseloom.sources import lines as L

_COLUMNS = ("o_orderkey", "o_orderstatus", "o_orderpriority")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a line of JSON, CSV, TSV, broken JSON, too few fields, or free text."""
    k, (key, status, kind) = F.col("o_orderkey"), (F.col(c).cast("string") for c in _COLUMNS)
    of = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    line = F.when(k % 6 == 0, of('{"o_orderkey": ', key, ', "o_orderstatus": "', status, '", "more": {"priority": "', kind, '"}}')).when(k % 6 == 1, of(key, ",", status, ',"', kind, '"')).when(k % 6 == 2, of(key, "\t", status, "\t", kind)).when(k % 6 == 3, of('{"o_orderkey": ', key)).when(k % 6 == 4, of(key, ",", status)).otherwise(of("order ", key))
    return load(spark, sf_dir, "orders").select(k.alias("id"), line.alias("line"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'json' WHEN 3 THEN 'json' WHEN 2 THEN 'tsv' WHEN 5 THEN 'text' ELSE 'csv' END AS format, CASE WHEN o_orderkey % 6 < 3 THEN o_orderkey END AS key, CASE WHEN o_orderkey % 6 < 3 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 6 < 3 THEN o_orderpriority END AS priority,
  CASE o_orderkey % 6 WHEN 3 THEN '{"o_orderkey": ' || o_orderkey WHEN 4 THEN o_orderkey || ',' || o_orderstatus WHEN 5 THEN 'order ' || o_orderkey END AS raw FROM orders""")
def dynamic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed lines as VARIANT records, with what could not be read."""
    rows = L.dynamic_records(order_lines(spark, sf_dir), "line", _COLUMNS)
    priority = F.coalesce(L.field("record", "$.more.priority"), L.field("record", "$.o_orderpriority"))
    return rows.select("id", "format", L.field("record", "$.o_orderkey", "long").alias("key"), L.field("record", "$.o_orderstatus").alias("status"), priority.alias("priority"), "raw")


@query("""SELECT CASE o_orderkey % 6 WHEN 0 THEN 'json' WHEN 3 THEN 'json' WHEN 2 THEN 'tsv' WHEN 5 THEN 'text' ELSE 'csv' END AS format, count(*) AS lines, count(*) FILTER (o_orderkey % 6 >= 3) AS unreadable,
  CASE min(CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 5 THEN 2 ELSE 1 END) WHEN 0 THEN 'OBJECT<more: OBJECT<priority: STRING>, o_orderkey: BIGINT, o_orderstatus: STRING>' WHEN 1 THEN 'OBJECT<o_orderkey: STRING, o_orderpriority: STRING, o_orderstatus: STRING>' ELSE 'VOID' END AS schema FROM orders GROUP BY 1""")
def dynamic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats, unreadable lines and schemas found."""
    return L.ingest_summary(L.dynamic_records(order_lines(spark, sf_dir), "line", _COLUMNS))


@query("SELECT kind, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders, (VALUES ('csv'), ('tsv'), ('json'), ('parquet')) k(kind)")
def file_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders written as files of four kinds to the shared folder and read back by schema."""
    o = load(spark, sf_dir, "orders").select(*_COLUMNS, "o_totalprice")
    schema, out = "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double", None
    for kind in ("csv", "tsv", "json", "parquet"):
        path = shared_path(spark, f"orders-{kind}")
        if kind == "tsv":
            o.write.option("header", True).option("sep", "\t").csv(path)
        else:
            S.write_result(o, path, kind)
        back = S.read_csv(spark, path, schema, "\t" if kind == "tsv" else ",") if kind in ("csv", "tsv") else S.read_json(spark, path, schema, lines=True) if kind == "json" else spark.read.schema(schema).parquet(path)
        back = back.select(F.lit(kind).alias("kind"), *o.columns)
        out = back if out is None else out.union(back)
    return out


@query("SELECT doc_id, length(text) AS chars, sha256(text) AS sha256 FROM documents")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as text files of at most 500 each, read back as whole files by Hadoop paths only, and taken apart again."""
    d, path = load(spark, sf_dir, "documents"), shared_path(spark, "texts")
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.translate(F.base64(F.encode("text", "UTF-8")), "\r\n", ""))
    d.select(line.alias("line")).write.option("maxRecordsPerFile", 500).text(path)
    lines = S.read_text(spark, f"{path}/part-*").select(F.explode(F.split("text", "\n")).alias("line")).where("line != ''")
    body = F.decode(F.unbase64(F.substring_index("line", " ", -1)), "UTF-8")
    return lines.select(F.substring_index("line", " ", 1).cast("long").alias("doc_id"), body.alias("body")).select("doc_id", F.length("body").cast("long").alias("chars"), F.sha2("body", 256).alias("sha256"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: rows appended to a table, of which those with a key that is there already are left out."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept = o.where("o_orderkey % 3 != 0")
    return kept.unionByName(R.inserted(kept, o.withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"]))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def paged_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders laid out in pages and read by a source of one task a page, to which the filters go."""
    from caseloom.sources import paged

    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = shared_path(spark, "pages")
    paged.export(o, path, 2000)
    return paged.scan(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double").where("o_orderstatus = 'F' and o_totalprice > 100000")
