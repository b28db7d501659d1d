"""Near-duplicates by circulant MinHash: banding, exact Jaccard verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, binary, by_batch, distinct_sorted, dropped, freed, longs, mix, written
from .components import components

BANDS, ROWS = 32, 5
#: Rounds of linking each member of a bucket with one other before what remains is compared by prefix filtering.
ROUNDS = 2
#: Members that hold a shingle up to which it counts as rare in the last comparison.
COMMON = 24
#: 64-bit words in which a member's frequent shingles are marked for the last comparison.
MARKS = 16
_SIGMA = np.uint64(0xD6E8FEB86659FD93)


def _pi(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    return x


def circulant_signature(shingles: np.ndarray, before: np.ndarray, k: int) -> np.ndarray:
    """(k, sets) minima: the first permutation scatters each set's elements, the second one, shifted by 1 to k places around its circle, orders them anew for each coordinate. Sets must not be empty."""
    places = (mix(shingles * _SIGMA) >> np.uint64(32)).astype(np.uint32)
    starts = before[:-1]
    out = np.empty((k, len(starts)), np.uint32)
    for i in range(k):
        out[i] = np.minimum.reduceat(_pi(places + np.uint32(i + 1)), starts)
    return out


def _band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit keys of each band's coordinates and number."""
    out = np.empty((signature.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.full(signature.shape[1], b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[b * rows + r])
        out[:, b] = key
    return out


def signatures(docs: DataFrame, shingle: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): per row the size and a 128-bit key of its shingle set, and its band keys (null for an empty set)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        value, before = distinct_sorted(*Words(batch.column("text"), lower=True).grams(shingle, short=True))
        n = np.diff(before)
        raw = memoryview(np.ascontiguousarray(value)).cast("B")
        key = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        full = n > 0
        keys = _band_keys(circulant_signature(value, np.concatenate((before[:-1][full], before[-1:])), bands * rows), bands, rows) if full.any() else np.zeros((0, bands), np.uint64)
        at = np.concatenate(([0], np.cumsum(full * bands))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), longs(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(key, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "bands"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles): each row's shingle set as sorted 64-bit hashes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = binary(*distinct_sorted(*Words(batch.column("text"), lower=True).grams(shingle, short=True)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets.cast(pa.binary())], names=["doc_id", "shingles"])

    return by_batch(docs, run, "doc_id long, shingles binary")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, own in zip(batch.column("doc_id"), batch.column("shingles"), strict=True):
            values = np.frombuffer(own.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), doc.as_py())), pa.array(values)], names=["rep", "shingle"])


def _own_alone(sets: DataFrame) -> DataFrame:
    """(rep, alone): how many of a document's shingles no other of these documents has."""

    held = sets.mapInArrow(_exploded, "rep long, shingle long").groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("high")).where("rep = high")
    return held.groupBy("rep").agg(F.count("*").alias("alone"))


def _rest(members: DataFrame, buckets: DataFrame, sets: DataFrame, percent: int, spare: list[DataFrame]) -> DataFrame:
    """(a, b): all pairs of members(rep, n, component) in different components that can still be similar enough.

    Shingles that more than COMMON of the members hold are frequent, the others rare; f and r count a member's. A pair
    shares at most the lesser f and its common rare shingles. So either the lesser f suffices, and the pair is formed
    in a bucket, or it has a rare shingle in common, and then one among the first r - (0.8 n - f) + 1 of both in order
    of frequency. Postings of rare shingles are short, so the work follows the text and not a group's square.
    In a bucket, frequent shingles are also marked in 64 x MARKS bits inside the join: a bit that only one member has is
    a shingle that the other lacks, which lowers what they can share. So of copies too far from each other only a few
    make a pair, if their sets are not much larger than the bits; and a pair is formed in the least of its buckets only.
    Tables that can go after the pairs are written are added to `spare`.
    """
    spark = sets.sparkSession
    own = sets.join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    held = written(own.mapInArrow(_exploded, "rep long, shingle long").distinct(), "held_shingles")
    count = held.groupBy("shingle").agg(F.count("*").alias("df"))
    marks = (F.expr(f"bit_or(if(df > {COMMON} and pmod(shingle, {64 * MARKS}) div 64 = {i}, shiftleft(1L, cast(pmod(shingle, 64) as int)), 0L))") for i in range(MARKS))
    ranked = held.join(count, "shingle").groupBy("rep").agg(F.count_if(F.col("df") > COMMON).alias("f"), F.array(*marks).alias("marks"), F.sort_array(F.collect_list(F.when(F.col("df") <= COMMON, F.struct("df", "shingle")))).alias("rare"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100) - F.col("f"))
    table = ranked.join(members, "rep").withColumn("k", F.size("rare") - needed + 1)
    table = written(table.select("rep", "n", "component", "f", "marks", F.when(F.col("k") > 0, F.expr("filter(slice(rare, 1, cast(k as int)), x -> x.df > 1).shingle")).alias("prefix")), "ranked")
    spare += [held, table]
    freed(spark)
    bound = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    other = {"rep": "b", "n": "m", "component": "other", "f": "g", "marks": "marked", "every": "also"}
    keyed = table.select("rep", "n", "component", F.explode("prefix").alias("shingle"))
    rare = keyed.withColumnRenamed("rep", "a").join(keyed.select("shingle", *(F.col(c).alias(other[c]) for c in ("rep", "n", "component"))), "shingle").where("component < other").where(bound)
    lacks = lambda x, y: " + ".join(f"bit_count({x}[{i}] & ~{y}[{i}])" for i in range(MARKS))
    enough = F.expr(f"{100 + percent} * least(f, g) >= {percent} * (n + m)") & F.expr(f"{100 + percent} * least(f - ({lacks('marks', 'marked')}), g - ({lacks('marked', 'marks')})) >= {percent} * (n + m)")
    every = buckets.groupBy("rep").agg(F.collect_set("bucket").alias("every"))
    common = every.join(table.where(f"100 * f >= {percent} * n").drop("prefix"), "rep").select(F.explode("every").alias("bucket"), "every", "rep", "n", "component", "f", "marks")
    near = common.withColumnRenamed("rep", "a").join(common.select("bucket", *(F.col(c).alias(other[c]) for c in other)), "bucket").where("component < other").where(bound & enough & F.expr("array_min(array_intersect(every, also)) = bucket"))
    return rare.select("a", "b").union(near.select("a", "b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                s, t = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                at = np.searchsorted(t, s)
                at[at == len(t)] = len(t) - 1
                both = int((t[at] == s).sum())
                keep[i] = 100 * both >= percent * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs(doc_id, text).

    Shingles are runs of `shingle` white-space separated words with A-Z in lower case (the whole of a shorter text).
    Documents whose sets reach a Jaccard similarity of `percent` are linked; component_id is the smallest doc_id
    reachable and kept says whether it is the row's own. Null and empty texts link with nothing; a row without doc_id
    is kept, with a null component; rows of one doc_id are one document; extra columns are not read.

    Equal sets first collapse to one representative. Buckets of representatives (one for each band key) are then linked
    by stars: in each round every member is compared with one hub of its bucket if both are not connected yet. Last,
    members of different components in a bucket are compared by exact prefix filtering (see _rest), so no link is lost;
    members of one component never are, so a group of near copies costs a few comparisons for each copy.
    Pairs are only formed if their sizes allow the similarity, and the counts of their shingles that any other document
    of a shared bucket has at all: a copy with too many words of its own is never paired.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = written(signatures(docs, shingle, bands, rows), "signatures")
    members = every.select("doc_id", "n_shingles", "set_key")
    known = every.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # Tables that a join may meet with a key of very many rows are written first: then both its sides are plain and Spark can split the key.
    reps = written(known.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "representatives")
    banded = known.join(reps, "set_key").where("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("bucket")
    shared = written(shared, "shared_buckets")
    table = written(banded.join(shared, "bucket").distinct(), "buckets")
    wanted = table.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(_sets(docs.join(wanted, "doc_id"), shingle), "sets")
    freed(spark)
    # c: a document's shingles that some other one has. No pair shares more than the lesser c, which bounds its similarity.
    held = table.join(_own_alone(sets), "rep", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    buckets, table = table, written(held.where(f"100 * c >= {percent} * n"), "held")
    freed(spark)
    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m) and 100 * least(c, d) >= {percent} * (n + m - least(c, d))")
    links, spare = None, []
    label = table.select("rep", F.col("rep").alias("component")).distinct()
    for r in range(ROUNDS + 1):
        labelled = written(table.join(label, "rep"), "labelled")
        spare.append(labelled)
        mixed = written(labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("rep", "n", "c", "component"), F.col("rep") if r == 0 else F.xxhash64("rep", "bucket", F.lit(r))).alias("hub")).where("low < high"), "mixed")
        spare.append(mixed)
        if mixed.isEmpty():
            break
        if r < ROUNDS:
            pairs = labelled.join(mixed.select("bucket", "hub"), "bucket").where("component != hub.component").select(F.col("rep").alias("a"), "n", "c", F.col("hub.rep").alias("b"), F.col("hub.n").alias("m"), F.col("hub.c").alias("d"))
        else:
            own = labelled.join(mixed.select("bucket"), "bucket")
            left = written(own.select("rep", "n", "component").distinct(), "members")
            spare.append(left)
            pairs = _rest(left, own.select("bucket", "rep", "n"), sets, percent, spare)
        pairs = (pairs.where(fits) if r < ROUNDS else pairs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = written(_confirmed(pairs, sets, percent), "links")
        spare.append(found)
        links = found if links is None else links.union(found)
        own = components(links)
        label = written(table.select("rep").distinct().join(own, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component")), "labels")
        spare.append(label)
        freed(spark)
    spare.append(label := written(label, "components"))
    label = written(reps.join(label, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("found")), "found")
    alone = members.where("set_key is null").withColumn("found", F.lit(None).cast("long"))
    joined = members.where("set_key is not null").join(label, "set_key", "left").unionByName(alone)
    out = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = written(out, "near_duplicates")
    dropped(every, reps, shared, buckets, table, sets, label, *spare)
    return out
