"""Best-fit packing: length patterns by non-negative least squares over the histogram, residuals by best fit."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import steps, written
from .tokens import Encoder, default_paths

#: Pieces of one length are numbered in shares of about PIECES_EACH pieces of any length, but in SHARES_LEAST to SHARES_MOST;
#: the table of their counts, which the driver sees, has at most SHARES_MOST x size rows.
PIECES_EACH, SHARES_LEAST, SHARES_MOST = 50_000, 256, 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def patterns(size: int, depth: int = 3) -> np.ndarray:
    """All ways to fill a sequence of `size` exactly by at most `depth` (up to 3) lengths, descending; 0 stands for none."""
    a = np.arange(1, size + 1)
    rows = [np.array([[size, 0, 0]])]
    if depth >= 2:
        b = a[(a >= size - a) & (a < size)]
        rows.append(np.stack((b, size - b, 0 * b), 1))
    if depth >= 3:
        x, y = np.meshgrid(a, a, indexing="ij")
        z = size - x - y
        keep = (x >= y) & (y >= z) & (z > 0)
        rows.append(np.stack((x[keep], y[keep], z[keep]), 1))
    return np.concatenate(rows)


def non_negative_least_squares(forms: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 for which the patterns' total lengths come closest to counts, by accelerated projected gradient steps.

    counts[l] is how many pieces have length l. Errors weigh more for long lengths, which fit in fewer places.
    """
    size = len(counts) - 1
    weight = np.sqrt(np.arange(size + 1) / size)
    weight[0] = 0
    target = counts * weight
    used = np.flatnonzero(((counts[forms] > 0) | (forms == 0)).all(axis=1))
    own = forms[used]
    x = np.zeros(len(own))
    if not len(own):
        return np.zeros(len(forms))

    def product(v: np.ndarray) -> np.ndarray:
        return sum(np.bincount(own[:, j], v, size + 1) for j in range(own.shape[1])) * weight

    def transposed(r: np.ndarray) -> np.ndarray:
        r = r * weight
        return sum(r[own[:, j]] for j in range(own.shape[1]))

    v = np.random.default_rng(5).random(len(own))
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = transposed(product(v))
        top = np.linalg.norm(v)
        v /= top
    step, y, t = 1 / (1.05 * top), x, 1.0
    for _ in range(rounds):
        to = np.maximum(0, y - step * transposed(product(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = to + (t - 1) / t2 * (to - x)
        x, t = to, t2
    out = np.zeros(len(forms))
    out[used] = x
    return out


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) by best fit, longest pieces first, for all pieces of a length at a time.

    A piece goes to the sequence with the least room that holds it; that sequence then has the least room again, so each
    takes as many pieces of the length as fit before the next one is looked at.
    """
    size, room = len(counts) - 1, defaultdict(list)
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        for free in [f for f in sorted(room) if f >= length]:
            own, each = room.pop(free), free // length
            while own and n:
                form, m = own.pop()
                full = min(m, n // each)
                if full:
                    room[free - each * length].append(((*form, *(length,) * each), full))
                    n -= full * each
                    m -= full
                if m and n:  # fewer pieces are left than one sequence takes
                    room[free - n * length].append(((*form, *(length,) * n), 1))
                    m, n = m - 1, 0
                if m:
                    own.append((form, m))
            if own:
                room[free] += own
            if not n:
                break
        each = size // length
        if n >= each:
            room[size - each * length].append(((length,) * each, n // each))
        if n % each:
            room[size - n % each * length].append(((length,) * (n % each), 1))
    return [x for own in room.values() for x in own]


def plan(counts: np.ndarray, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) that use up counts[1:] exactly; no sequence is longer than len(counts) - 1.

    Patterns that fill a sequence take their fitted shares, rounded, and best fit packs what is left. Of the shares rounded to the
    nearest number, rounded down, and none at all, those stay that need the fewest sequences: never more than best fit alone.
    """
    size, counts = len(counts) - 1, counts.astype(np.int64)
    forms = patterns(size, depth) if counts.any() else np.zeros((0, 3), int)
    x = non_negative_least_squares(forms, counts.astype(float))
    best: list[tuple[tuple[int, ...], int]] | None = None
    for rounded in (np.rint(x), np.floor(x), np.zeros(len(x))):
        left, out = counts.copy(), []
        for i in np.argsort(-x, kind="stable"):
            if not rounded[i]:
                continue
            form = tuple(int(v) for v in forms[i] if v)
            n = min(int(rounded[i]), *(left[v] // form.count(v) for v in form))
            if n > 0:
                out.append((form, int(n)))
                for v in form:
                    left[v] -= n
        out += best_fit(left)
        if best is None or sum(n for _, n in out) < sum(n for _, n in best):
            best = out
    return best


def places(counts: np.ndarray, depth: int = 3) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (upper ranks, first sequences less the lower ranks, offsets) of the plan's slots for pieces numbered from 0."""
    rank, first, out = np.zeros(len(counts), np.int64), 0, defaultdict(list)
    for form, n in plan(counts, depth):
        at = 0
        for length in form:
            out[length].append((rank[length] + n, first - rank[length], at))
            rank[length] += n
            at += length
        first += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer: tuple[str, str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts (columns as in PIECES): each document's ids and end_id, cut from the end into pieces of `size`.

    A null or empty text has the end id alone. A null doc_id stays null. `ids` holds little-endian unsigned 32-bit ids
    if keep_ids is set, else null.
    """
    paths = tokenizer or default_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*paths)
        for batch in batches:
            for i, j in steps(batch.column("text")):
                own = batch.slice(i, j - i)
                ids, before = encoder.ids(own.column("text"))
                n = np.diff(before) + 1
                cuts = -(-n // size)
                doc = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                lead = n - (cuts - 1) * size
                start = np.where(piece == 0, 0, lead[doc] + (piece - 1) * size)
                length = np.where(piece == 0, lead[doc], size)
                whole = np.insert(ids, before[1:], np.uint32(end_id)).astype("<u4")
                at = (before[:-1] + np.arange(len(n)))[doc] + start
                raw = memoryview(whole).cast("B")
                spans = list(zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True))
                crc = [zlib.crc32(raw[a:b]) for a, b in spans]
                kept = [bytes(raw[a:b]) for a, b in spans] if keep_ids else [None] * len(spans)
                ids_of = own.column("doc_id").cast(pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def packed(docs: DataFrame, size: int = 1024, end_id: int = 2, depth: int = 3, tokenizer: tuple[str, str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: each sequence holds at most `size` tokens, without gaps from 0.

    The driver sees only how many pieces there are of each length and share (at most SHARES_MOST x size numbers). Pieces
    of full length are sequences of their own and take negative numbers. Repeated rows are packed as often as they
    occur; an empty table gives an empty result; columns other than doc_id and text are not read. Shares are dealt by
    the place of a row and not by its values, so that rows of one doc_id, or without any, spread over all of them.
    """
    table = written(pieces(docs, size, end_id, tokenizer, keep_ids).withColumn("dealt", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    if not keep_ids:
        table = table.drop("ids")
    number = min(SHARES_MOST, max(SHARES_LEAST, -(-table.count() // PIECES_EACH)))
    table = table.withColumn("share", F.pmod("dealt", F.lit(number)).cast("int")).drop("dealt")
    below = table.where(F.col("length") < size)
    shares = below.groupBy("length", "share").count().toArrow()
    counts = np.zeros((size + 1, number), np.int64)
    counts[shares.column("length").to_numpy(), shares.column("share").to_numpy()] = shares.column("count").to_numpy()
    before = np.cumsum(counts, axis=1) - counts
    slots = places(counts.sum(axis=1), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, share, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "share", "rank"))
            rank = rank - 1 + before[length, share]
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                own = length == k
                upper, shift, at = slots[int(k)]
                i = np.searchsorted(upper, rank[own], "right")
                seq[own], off[own] = shift[i] + rank[own], at[i]
            names = [c for c in batch.schema.names if c not in ("share", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    names = [c for c in table.columns if c != "share"]
    schema = ", ".join(f"{c} {dict(table.dtypes)[c]}" for c in names) + ", sequence_id long, offset long"
    ranked = below.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece")))
    full = table.where(F.col("length") == size).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(run, schema).unionByName(full)
