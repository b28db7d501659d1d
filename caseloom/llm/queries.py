"""The registered queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("matches")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fitted, held_out, scored

    docs = table(spark, sf_dir, "documents")
    lexicon = fitted(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = scored(docs, lexicon)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import BASE, found_secrets, span_text

    found = found_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    kinds = [r.kind for r in BASE]
    count = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in kinds]
    base = span_text(F.filter("spans", lambda s: s["kind"].isin(kinds)))
    return found.select("doc_id", *count, F.sha2(base, 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filtered

    return filtered(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups, word_counts

    return spelling_groups(word_counts(table(spark, sf_dir, "documents"), damage=199))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_minhash_near_dedup, op3_toxicity, op4_benchmark_decontamination, op5_substring_dedup, op6_warc_round_trip, op7_embedding_near_dedup, op8_secret_scan, op9_best_fit_packing, op10_url_filter, op11_spelling_variants, op12_line_dedup, op13_vector_codes)}
SQL: dict[str, str] = {
    "op2_minhash_near_dedup": sql.NEAR_DEDUP,
    "op4_benchmark_decontamination": sql.DECONTAMINATION,
    "op5_substring_dedup": sql.SUBSTRINGS,
    "op6_warc_round_trip": sql.ARCHIVES,
    "op7_embedding_near_dedup": sql.VECTORS,
    "op8_secret_scan": sql.SECRETS,
    "op10_url_filter": sql.URLS,
    "op11_spelling_variants": sql.SPELLING,
    "op12_line_dedup": sql.LINES,
    "op13_vector_codes": sql.CODES,
}
