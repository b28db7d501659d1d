"""Vector codes: parts of integer vectors assigned to codebook entries, most of which segment-mean bounds rule out unseen."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Components from this size on are not coded, so that all squared distances of a vector and sums of a task stay whole in 64 bits.
LARGEST = 1 << 24
#: Rows that one vectorised step works on, and how much bounds give way to rounding.
STEP_ROWS, SLACK = 8192, 1e-6


def _blocks(rows: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, means, residual norms) of each row's consecutive blocks."""
    cuts = np.linspace(0, rows.shape[1], blocks + 1).astype(int)
    size = np.diff(cuts)
    mean = np.add.reduceat(rows, cuts[:-1], axis=1) / size
    left = rows - np.repeat(mean, size, axis=1)
    return size.astype(float), mean, np.sqrt(np.add.reduceat(left * left, cuts[:-1], axis=1))


class Codebook:
    """The entries of one part, with the block means and residual norms of each level, coarse to fine."""

    def __init__(self, entries: np.ndarray, levels: tuple[int, ...] = (1, 2)):
        self.entries = entries
        self.levels = [n for n in levels if n <= entries.shape[1]]
        self.blocks = [_blocks(entries, n) for n in self.levels]

    def survivors(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, entry) pairs, by row and entry, among which is every nearest entry.

        With a block's means and the norms of what is left of it, a squared distance is at least length * (difference
        of means)^2 + (difference of norms)^2 over the blocks, and at most the same with the sum of the norms. An entry
        whose least is over another's most is out; a finer level looks only at what the coarser one left.
        """
        row, entry = (x.ravel() for x in np.indices((len(rows), len(self.entries))))
        for n, (size, mean, left) in zip(self.levels, self.blocks, strict=True):
            _, own, own_left = _blocks(rows, n)
            apart = ((own[row] - mean[entry]) ** 2 * size).sum(1)
            least = apart + ((own_left[row] - left[entry]) ** 2).sum(1)
            most = apart + ((own_left[row] + left[entry]) ** 2).sum(1)
            bound = np.minimum.reduceat(most, np.flatnonzero(np.diff(row, prepend=-1)))
            stay = least * (1 - SLACK) - 1 <= bound[row] * (1 + SLACK) + 1
            row, entry = row[stay], entry[stay]
        return row, entry

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry in whole numbers; ties go to the lower index."""
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, entry = self.survivors(rows)
        apart = rows[row] - self.entries[entry]
        exact = np.einsum("ij,ij->i", apart, apart)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == least[row])
        hit = hit[np.diff(row[hit], prepend=-1) > 0]
        return entry[hit], least


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, ints): floor(scale * x) of each component; rows whose vector is null or holds null or non-finite components go. ints is null if a component is LARGEST or more."""
    kind = dict(vectors.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is not a number
            of = np.repeat(np.arange(len(size)), size)
            kept = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(of[~np.isfinite(flat)], minlength=len(size)) == 0)
            with np.errstate(over="ignore", invalid="ignore"):
                value = np.floor(flat * scale)
            fits = np.bincount(of[~(np.abs(value) < LARGEST)], minlength=len(size)) == 0
            value = np.where(np.abs(value) < LARGEST, value, 0).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            ints = pa.ListArray.from_arrays(pa.array(ends), pa.array(value), mask=pa.array(~fits))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), ints], names=["vec_id", "label", "ints"]).filter(pa.array(kept))

    return vectors.mapInArrow(run, f"vec_id long, label {kind}, ints array<int>")


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("ints").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _assigned(rows: np.ndarray, books: list[Codebook]) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, rows of the step, that part of them, indexes, squared distances)."""
    m = rows.shape[1] // len(books)
    for i in range(0, len(rows), STEP_ROWS):
        for p, book in enumerate(books):
            own = rows[i : i + STEP_ROWS, p * m : (p + 1) * m]
            yield p, slice(i, i + len(own)), own, *book.nearest(own)


def _moved(table: DataFrame, books: list[Codebook], dim: int) -> list[Codebook]:
    """The codebooks after one round: each task sums what it assigns, so the driver sees a sum for each component of an entry."""
    parts, (k, m) = len(books), books[0].entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, m), np.int64)
        for batch in batches:
            for p, _, own, index, _ in _assigned(_matrix(batch, dim), books):
                count[p] += np.bincount(index, minlength=k)
                np.add.at(total[p], index, own)
        part, entry, place = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(place), pa.array(np.repeat(count.ravel(), m)), pa.array(total.ravel())], names=["part", "entry", "place", "n", "total"])

    sums = table.select("ints").mapInArrow(run, "part int, entry int, place int, n long, total long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect()
    entries = np.stack([b.entries for b in books])
    for r in sums:
        entries[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return [Codebook(e) for e in entries]


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for each row of vectors(vec_id, label, embedding).

    Components become floor(scale * x), vectors are cut into `parts` equal parts, and each part position has a codebook
    of up to `entries` (at most 256), first those parts of the smallest vec_ids (of repeated ids the smallest vector),
    moved `rounds` times to the floored means of the parts nearest to them. `code` has two hexadecimal digits a part,
    `error` the squared distances summed, `label_error` the errors of a label summed (nulls together; null beyond 64
    bits). codebooks_sha256 is over all entries' decimal components by part, entry and place, joined by commas.

    Rows whose vector is null or holds null or non-finite components go. A vector that cannot be cut like that of the
    smallest vec_id, or has a component of LARGEST or more, stays with null code and error and moves nothing; so does
    every row if no row has an id or that vector cannot be cut into equal parts. Repeated rows count as often as they
    occur. An empty table gives an empty result; further columns are not read. What the driver sees is the codebooks
    and their sums, `entries` x the length of a vector.
    """
    kept = written(_whole(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")), scale), "whole_vectors")
    usable = kept.where("ints is not null and vec_id is not null")
    low = usable.agg(F.min(F.struct("vec_id", "ints")).alias("low")).first()["low"]
    dim = len(low["ints"]) if low else 0
    books: list[Codebook] = []
    if dim and dim % parts == 0:
        alike = F.size("ints") == dim
        seeds = [r["vec_id"] for r in usable.where(alike).select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
        rows = usable.where(alike & F.col("vec_id").isin(seeds)).groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id").collect()
        first = np.array([r["ints"] for r in rows], np.int64).reshape(len(rows), parts, dim // parts)
        books = [Codebook(first[:, p]) for p in range(parts)]
        for _ in range(rounds):
            books = _moved(kept.where(alike), books, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("ints")), -1).to_numpy(zero_copy_only=False)
            fits = np.flatnonzero(size == dim) if books else np.zeros(0, int)
            code, error = np.zeros((len(fits), parts), np.uint8), np.zeros(len(fits), np.int64)
            if len(fits):
                for p, at, _, index, apart in _assigned(_matrix(batch.take(pa.array(fits)), dim), books):
                    code[at, p] = index
                    error[at] += apart
            texts, errors = [None] * len(size), [None] * len(size)
            for i, c, e in zip(fits.tolist(), code, error.tolist(), strict=True):
                texts[i], errors[i] = c.tobytes().hex(), e
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = written(kept.mapInArrow(run, f"vec_id long, label {dict(kept.dtypes)['label']}, code string, error long"), "coded")
    dropped(kept)
    sums = coded.groupBy(F.col("label").alias("own")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = written(sums.select("own", F.expr("try_cast(total as long)").alias("label_error")), "label_errors")
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("own")), "left").select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
