"""Line dedup: normalised lines as 128-bit keys, documents counted for each key, common lines dropped, the rest put together by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, dropped, written


def line_keys(lines: list[bytes], least: int) -> list[bytes | None]:
    """The digest of each line's key: the line without ASCII white space at its ends, A-Z as a-z; None if the key has under `least` code points."""
    out = []
    for line in lines:
        key = line.strip().lower()  # of bytes: ASCII only, so UTF-8 beyond it stays as it is
        long = len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _exploded(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, a, b): each row's distinct line keys as two longs."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, counts, keys = batch.column("doc_id"), [], []
        for text in batch.column("text").cast(pa.large_binary()).to_pylist():
            own = set(line_keys(text.split(b"\n"), least)) - {None} if text else ()
            counts.append(len(own))
            keys += sorted(own)
        pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["doc_id", "a", "b"])

    return by_batch(docs, run, "doc_id long, a long, b long")


def line_dedup(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for each row: the text without the lines that stand in `documents` documents or more.

    A line's key must have `least` code points to count; of a common key, the largest doc_id that holds it keeps all its
    lines. A null or empty text is one empty line. Rows of one doc_id are one document, so repeated rows raise no count;
    a row without doc_id is no document: it raises no count and keeps all its lines. An empty table gives an empty
    result, columns other than doc_id and text are not read, and a very long text costs its length in one task.

    Keys are counted with partial sums before any exchange, distinct documents only of keys that occur often enough;
    every join meets two written tables, so a key or document with very many rows can be split. A document gets only
    the keys that it loses itself.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = written(_exploded(docs.where("doc_id is not null"), least), "line_keys")
    often = written(held.groupBy("a", "b").count().where(F.col("count") >= documents).select("a", "b"), "often")
    met = written(held.join(often, ["a", "b"]).distinct(), "met")
    common = written(met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= documents).select("a", "b", "last"), "common")
    gone = written(met.join(common, ["a", "b"]).where("doc_id < last").groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("gone")), "gone")
    dropped(held, often, met, common)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, totals, losses = [], [], []
        for text, lost in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("gone"), strict=True):
            lines, out = (text or b"").split(b"\n"), set()
            if lost.is_valid:
                a, b = (lost.values.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
                raw = np.stack((a, b), 1).astype("<i8").tobytes()
                out = {raw[i : i + 16] for i in range(0, len(raw), 16)}
            kept = [x for x, k in zip(lines, line_keys(lines, least), strict=True) if k not in out] if out else lines
            texts.append(b"\n".join(kept))
            totals.append(len(lines))
            losses.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(losses, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return by_batch(docs.join(gone, "doc_id", "left"), run, "doc_id long, text string, n_lines long, n_dropped long")
