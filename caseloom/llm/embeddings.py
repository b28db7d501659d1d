"""Embedding near-dedup: p-stable (Gaussian) hashing of unit vectors in several tables, exact cosine checks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, longs, mix, written
from .components import components

#: Tables, projections for each, and the width of a quantisation step in units of the distance at the threshold.
TABLES, PROJECTIONS, WIDTH = 40, 8, 4.0
#: Members up to which a bucket is compared pair by pair, and members of a block beyond that.
FEW, BLOCK = 32, 512


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(usable, row lengths, vectors): a vector is usable if it has components, all finite and not all zero."""
    rows = [np.asarray(v, np.float64) if v is not None and len(v) and all(x is not None for x in v) else np.zeros(0) for v in column.to_pylist()]
    usable = np.array([len(r) > 0 and bool(np.isfinite(r).all()) and bool(r.any()) for r in rows], bool)
    return usable, np.array([len(r) for r in rows], np.int64), rows


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _hashed(vectors: DataFrame, cosine: float, tables: int, projections: int, width: float, seed: int) -> DataFrame:
    """(vec_id, label, key, buckets, vector): usable rows, a 128-bit key of the vector, its bucket in each table, its components as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = width * np.sqrt(max(2 - 2 * cosine, 1e-6))
        for batch in batches:
            usable, size, rows = _matrix(batch.column("embedding"))
            for dim in np.unique(size[usable]):
                at = np.flatnonzero(usable & (size == dim))
                own = np.stack([rows[i] for i in at])
                rng = np.random.default_rng([seed, int(dim)])
                a, b = rng.standard_normal((int(dim), tables * projections)), rng.random(tables * projections) * step
                cell = np.floor((_unit(own) @ a + b) / step).astype(np.int64).view(np.uint64)
                keys = np.empty((len(own), tables), np.uint64)
                for t in range(tables):
                    key = np.full(len(own), t + 1, np.uint64)
                    for p in range(projections):
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cell[:, t * projections + p])
                    keys[:, t] = key
                raw = [(r + 0.0).tobytes() for r in own]  # -0.0 is 0.0
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [picked.column("vec_id"), picked.column("label"), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * tables), longs(keys.reshape(-1))), pa.array(raw, pa.binary())],
                    names=["vec_id", "label", "key", "buckets", "vector"],
                )

    kind = dict(vectors.dtypes)["label"]
    return vectors.mapInArrow(run, f"vec_id long, label {kind}, key binary, buckets array<long>, vector binary")


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, each divided by its greatest component, so that squares neither overflow nor vanish."""
    values = column.to_pylist()
    rows = np.frombuffer(b"".join(values)).reshape(len(values), -1)
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def _confirmed(pairs: DataFrame, cosine: float, kind: str) -> DataFrame:
    """Of pairs (label, a, b, x, y) of vectors of one length those with the cosine, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.binary_length(batch.column("x")).to_numpy()
            for n in np.unique(size):
                own = batch.filter(pa.array(size == n))
                x, y = _rows(own.column("x")), _rows(own.column("y"))
                near = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)) >= cosine
                yield own.select(["label", "a", "b"]).filter(pa.array(near))

    return pairs.mapInArrow(run, f"label {kind}, a long, b long")


def _crowded(cells: DataFrame, cosine: float, tables: int, block: int, kind: str) -> DataFrame:
    """(label, rep, n, root): for members of crowded buckets, cells(label, bucket, n, rep, m, vector, crowded), what one block of a bucket tells.

    A bucket's members are dealt into blocks, and every two blocks are compared as matrices in a task of their own: so
    no pair becomes a row. n is the weight of the members that are near, root the smallest one reachable in the blocks.
    A pair that shares several crowded buckets counts in the one of the first table.
    """
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = cells.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("label", "bucket", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "rep", "m", "vector", "crowded")

    def run(table: pa.Table) -> pa.Table:
        out = []
        size = pa.compute.binary_length(table.column("vector")).to_numpy()
        for length in np.unique(size):
            own = table.filter(pa.array(size == length))
            rep, m, part = (own.column(c).to_numpy() for c in ("rep", "m", "part"))
            rows = _rows(own.column("vector"))
            square = (rows * rows).sum(1)
            near = rows @ rows.T / np.sqrt(np.outer(square, square)) >= cosine
            np.fill_diagonal(near, False)
            root = np.arange(len(rep))
            while True:
                low = np.minimum(root, np.where(near, root, len(rep)).min(1, initial=len(rep)))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            where = np.zeros((len(rep), tables), np.int64)
            for k, own_cells in enumerate(own.column("crowded").to_pylist()):
                for c in own_cells:
                    where[k, c["table"]] = c["bucket"]
            here = own.column("bucket")[0].as_py()
            for t in range(int(np.flatnonzero(where[0] == here)[0])):
                near &= (where[:, t, None] != where[None, :, t]) | (where[:, t, None] == 0)
            if own.column("i")[0].as_py() != own.column("j")[0].as_py():
                near &= part[:, None] != part[None, :]
            out.append(pa.table([own.column("label"), pa.array(rep), pa.array(near @ m), pa.array(rep[root])], names=["label", "rep", "n", "root"]))
        return pa.concat_tables(out)

    return met.groupBy("label", "bucket", "i", "j").applyInArrow(run, f"label {kind}, rep long, n long, root long")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = 7, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors(vec_id, embedding, label).

    Rows of one label are linked if they share a bucket in a table and the exact cosine of their whole vectors reaches
    the threshold; with the defaults a pair just at it is found with a probability over 0.999. n_links counts the other
    rows linked directly, component_id is the smallest vec_id reachable. Rows with a null label, id or vector, or with
    a vector that is zero, empty or has null or non-finite components, link with nothing (kept; a null id has a null
    component). Rows of one vec_id are one vector; extra columns are not read; empty tables give empty results.

    Equal vectors of a label are one class: its members are linked with each other by counting, only the class is
    hashed and compared, and its links count once for each member. Buckets of up to `few` classes are compared pair by
    pair; in larger ones, where nearly all pairs are links and each must be counted, blocks of about `block` classes are
    compared as matrices that yield counts: no row is made for a pair there, and no task holds more than two blocks.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    kind = dict(vectors.dtypes)["label"]
    usable = vectors.where("vec_id is not null and embedding is not null and label is not null")
    table = written(_hashed(usable, cosine, tables, projections, width, seed), "hashed")
    classes = written(table.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("m")), "classes")
    reps = table.join(classes, ["label", "key"]).where("vec_id = rep").select("rep", "label", "m", "buckets", "vector").dropDuplicates(["rep", "label"])
    reps = written(reps, "reps")
    cells = reps.select("rep", "label", F.posexplode("buckets").alias("table", "bucket"))
    sizes = written(cells.groupBy("label", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    cells = written(cells.join(sizes, ["label", "bucket"]), "cells")
    crowded = cells.where(F.col("n") > few).groupBy("label", "rep").agg(F.collect_list(F.struct("table", "bucket")).alias("crowded"))
    crowded = written(crowded, "crowded")

    small = cells.where(F.col("n") <= few).select("label", "bucket", "rep")
    pairs = small.withColumnRenamed("rep", "a").join(small.withColumnRenamed("rep", "b"), ["label", "bucket"]).where("a < b").select("label", "a", "b").distinct()
    whole = reps.join(crowded, ["label", "rep"], "left").select("label", "rep", "vector", F.col("crowded.bucket").alias("crowded"))
    side = lambda rep, vector, own: whole.toDF("label", rep, vector, own)
    pairs = pairs.join(side("a", "x", "p"), ["label", "a"]).join(side("b", "y", "q"), ["label", "b"])
    # Pairs that share a crowded bucket are counted there.
    pairs = pairs.where(~F.coalesce(F.arrays_overlap("p", "q"), F.lit(False)) & (F.octet_length("x") == F.octet_length("y")))
    links = written(_confirmed(pairs.select("label", "a", "b", "x", "y"), cosine, kind), "links")

    dense = cells.where(F.col("n") > few).join(reps.select("label", "rep", "m", "vector"), ["label", "rep"]).join(crowded, ["label", "rep"])
    dense = written(_crowded(dense, cosine, tables, block, kind).where("n > 0 or root != rep"), "dense")

    size = classes.select("label", "rep", "m")
    ends = links.select("label", F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("label", "b", "a"))
    beside = ends.join(size.select("label", F.col("rep").alias("other"), F.col("m").alias("n")), ["label", "other"]).select("label", "rep", "n")
    beside = beside.union(dense.select("label", "rep", "n")).groupBy("label", "rep").agg(F.sum("n").alias("near"))
    edges = links.select("a", "b").union(dense.where("root != rep").select("root", "rep").distinct())
    found = components(edges)
    linked = classes.join(beside, ["label", "rep"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    linked = linked.select("label", "key", (F.col("m") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("found"))
    found = written(table.select("vec_id", "label", "key").distinct().join(linked, ["label", "key"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("found").alias("found")), "vector_links")
    dropped(table, classes, reps, sizes, cells, crowded, links, dense)
    out = vectors.select("vec_id").join(found, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("found", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
