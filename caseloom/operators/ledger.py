"""Hash chains over evidence, and real verification of both the chain and the evidence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.scores import block_hash

#: What stands for the previous hash of a first block.
FIRST_PREVIOUS = "0" * 64


def chained(blocks: DataFrame, ledger: str | None = None) -> DataFrame:
    """blocks(idx, ts, data_hash, action) with previous_hash and hash, each block's hash going into the next.

    A chain is sequential by nature, but only its last hash is carried: several ledgers, told apart by a column, are dealt
    out by it, sorted, and run through in batches, so no task holds a chain, and chains run side by side.
    """
    keys = [ledger] if ledger else []
    names = [*keys, "idx", "ts", "data_hash", "action"]
    rows = blocks.select(*names)
    rows = rows.repartition(ledger).sortWithinPartitions(ledger, "idx") if ledger else rows.coalesce(1).sortWithinPartitions("idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = object(), FIRST_PREVIOUS
        for batch in batches:
            previous, own = [], []
            of = batch.column(ledger).to_pylist() if ledger else [None] * len(batch)
            for case, i, ts, data, action in zip(of, *(batch.column(c).to_pylist() for c in ("idx", "ts", "data_hash", "action")), strict=True):
                if case != at:
                    at, before = case, FIRST_PREVIOUS
                previous.append(before)
                before = hashlib.sha256("|".join(str(x) for x in (i, str(ts)[:19], data, before, action) if x is not None).encode()).hexdigest()
                own.append(before)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(previous, pa.string()), pa.array(own, pa.string())], names=[*names, "previous_hash", "hash"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", previous_hash string, hash string")


def appended(ledger: DataFrame, block: DataFrame) -> DataFrame:
    """One new block(ts, data_hash, action) after the last of the ledger."""
    last = ledger.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("idx"), F.coalesce(F.max_by("hash", "idx"), F.lit(FIRST_PREVIOUS)).alias("previous_hash"))
    return block.join(F.broadcast(last)).select("idx", "ts", "data_hash", "action", "previous_hash", block_hash(F.col("idx"), F.col("ts"), F.col("data_hash"), F.col("previous_hash"), F.col("action")).alias("hash"))


def checked(ledger: DataFrame, by: str | None = None) -> DataFrame:
    """ledger with `broken`: its hash does not follow from its fields, or its previous hash or index from the block before; with `by`, in the ledger that this column names.

    The block before is found by a join on the index, so no window holds a whole chain.
    """
    keys = [*([by] if by else []), "idx"]
    before = ledger.select(*([by] if by else []), (F.col("idx") + 1).alias("idx"), F.col("hash").alias("_before"))
    own = block_hash(F.col("idx"), F.col("ts"), F.col("data_hash"), F.col("previous_hash"), F.col("action"))
    want = F.when(F.col("idx") == 0, F.lit(FIRST_PREVIOUS)).otherwise(F.col("_before"))
    return ledger.join(before, keys, "left").withColumn("broken", ~F.col("hash").eqNullSafe(own) | ~F.col("previous_hash").eqNullSafe(want)).drop("_before")


def verified(ledger: DataFrame, by: str | None = None) -> DataFrame:
    """blocks, intact, and the index of the first broken block: one row, or one for each ledger that the column `by` names."""
    return checked(ledger, by).groupBy(*([by] if by else [])).agg(F.count("*").alias("blocks"), (F.count_if("broken") == 0).alias("intact"), F.min(F.when(F.col("broken"), F.col("idx"))).alias("broken_index"))


def notarized(evidence: DataFrame, content: str) -> DataFrame:
    """evidence with the SHA-256 of its content."""
    return evidence.withColumn("sha256", F.sha2(F.col(content), 256))


def evidence_check(evidence: DataFrame, content: str, known: str = "sha256") -> DataFrame:
    """evidence with `intact`: its content has the hash that was noted, computed again."""
    return evidence.withColumn("intact", F.sha2(F.col(content), 256).eqNullSafe(F.col(known)))
