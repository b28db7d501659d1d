"""Substring dedup by seed and extend: documents joined on winnowed anchors, matches extended both ways, maximal repeats removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_batch, dropped, freed, longs, written

#: Words of a seed. A window of n words holds n - SEED + 1 seeds, and the first of those with the least hash is its anchor.
SEED = 5


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """For each w neighbours the place of the first least one, by doubling."""
    span, value, at = 1, x, np.arange(len(x))
    while span < w:
        step = min(span, w - span)
        at = np.where(value[step:] < value[:-step], at[step:], at[:-step])
        value = np.minimum(value[:-step], value[step:])
        span += step
    return at


def _anchors(words: Words, n: int, seed: int) -> tuple[np.ndarray, ...]:
    """(anchor, text, place, first, windows) of each text's anchors in order: the seed's hash, its first word, and the first word and number of the windows that it anchors (words counted over all texts)."""
    value, before = words.grams(seed)
    w = n - seed + 1
    count = np.maximum(np.diff(before) - w + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(count)))
    if not bounds[-1]:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    text = np.repeat(np.arange(len(count)), count)
    gram = (before[:-1] - bounds[:-1])[text] + np.arange(bounds[-1])
    at = _least(value, w)[gram]
    start = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    shift = (words.before[:-1] - before[:-1])[text[start]]
    return value[at[start]], text[start], at[start] + shift, gram[start] + shift, np.diff(np.append(start, len(at)))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def _seeds(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """(anchor, doc_id): the anchors of each row's windows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchor, text, *_ = _anchors(Words(batch.column("text")), n, seed)
        yield pa.RecordBatch.from_arrays([longs(anchor), pa.array(_ids(batch)[text])], names=["anchor", "doc_id"])

    return by_batch(docs, run, "anchor long, doc_id long")


def _occurrences(seeded: DataFrame, n: int, seed: int) -> DataFrame:
    """(anchor, doc_id, at, low, windows): where the shared seeds of a document anchor windows.

    The windows begin `low`, low + 1, ... words before the seed, which is at word `at`; windows[i] is a hash of all the
    words of the one with low + i words before it. It is independent of the anchor, so both together are 128 bits.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = Words(batch.column("text"))
        anchor, text, place, first, windows = _anchors(words, n, seed)
        keep = np.zeros(len(anchor), bool)
        bounds = np.searchsorted(text, np.arange(len(batch) + 1))
        for i, s in enumerate(batch.column("seeds")):
            own = slice(bounds[i], bounds[i + 1])
            keep[own] = np.isin(anchor[own], np.asarray(s.values).view(np.uint64))
        anchor, text, place, first, windows = (x[keep] for x in (anchor, text, place, first, windows))
        value, before = words.grams(n, other=True)
        last = (before[:-1] - words.before[:-1])[text] + first + windows - 1
        ends = np.cumsum(windows)
        at = np.repeat(last + ends - windows, windows) - np.arange(windows.sum())  # from the window with the least words before the seed
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), longs(value[at]))
        small = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays([longs(anchor), pa.array(_ids(batch)[text]), small(place - words.before[text]), small(place - (first + windows - 1)), lists], names=["anchor", "doc_id", "at", "low", "windows"])

    return by_batch(seeded, run, "anchor long, doc_id long, at int, low int, windows array<long>")


def _extended(rows: DataFrame, hubs: DataFrame, n: int) -> DataFrame:
    """(anchor, doc_id, first, end, rest): each occurrence of an anchor matched with the hub, that in the smallest document.

    The match is extended to the left and to the right as far as the windows of both agree. first to end are its words,
    if the hub's document is a smaller one; `rest` are the windows beyond it, as (window, start), still undecided.
    """
    beyond = lambda i: ~F.coalesce(F.get("windows", i) == F.get("hub_windows", i + F.col("low") - F.col("hub_low")), F.lit(False))
    places = F.sequence(F.lit(0), F.size("windows") - 1)
    met = rows.join(hubs, "anchor").withColumn("agree", F.filter(places, lambda i: ~beyond(i)))
    late = (F.size("agree") > 0) & (F.col("doc_id") > F.col("hub"))
    start = lambda i: F.col("at") - F.col("low") - i
    words = [F.when(late, start(F.element_at("agree", -1))).alias("first"), F.when(late, start(F.col("agree")[0]) + n).alias("end")]
    rest = F.transform(F.filter(places, beyond), lambda i: F.struct(F.get("windows", i).alias("window"), start(i).alias("start")))
    return met.select("anchor", "doc_id", *words, rest.alias("rest")).where("first is not null or size(rest) > 0")


def _removed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    words = Words(batch.column("text"))
    raw = words.raw.tobytes()
    rows = []
    for i, repeats in enumerate(batch.column("repeats")):
        a, b = int(words.before[i]), int(words.before[i + 1])
        covered = np.zeros(b - a + 1, np.int64)
        if repeats.is_valid and b > a:
            first, end = (np.asarray(repeats.values.field(k), np.int64) for k in (0, 1))
            np.add.at(covered, first, 1)
            np.add.at(covered, end, -1)
        gone = np.cumsum(covered[:-1]) > 0
        # Maximal repeats: the stretches of covered words, as [first, end) words.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        keep = np.flatnonzero(~gone) + a
        kept = b" ".join([raw[s:e] for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])
        rows.append((b - a, int(gone.sum()), kept, edge.reshape(-1, 2)))
    yield pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows]),
            pa.array([r[2].decode() for r in rows]),
            pa.array([r[3].tolist() for r in rows], pa.list_(pa.list_(pa.int32()))),
        ],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "repeats"],
    )


def repeats(docs: DataFrame, n: int = 13, seed: int = SEED) -> DataFrame:
    """(doc_id, repeats): for documents with words to remove, array<struct<first, end>> of the words of matches with smaller documents."""
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and text is not null")
    seeds = _seeds(known, n, seed)
    shared = written(seeds.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "shared_seeds")
    freed(spark)
    own = written(seeds.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("seeds")), "seeds")
    freed(spark)
    rows = written(_occurrences(known.join(own, "doc_id"), n, seed), "occurrences")
    dropped(shared, own)
    freed(spark)
    hubs = rows.groupBy("anchor").agg(F.min_by(F.struct("doc_id", "low", "windows"), F.struct("doc_id", "at")).alias("hub"))
    hubs = written(hubs.select("anchor", F.col("hub.doc_id").alias("hub"), F.col("hub.low").alias("hub_low"), F.col("hub.windows").alias("hub_windows")), "hubs")
    met = written(_extended(rows, hubs, n), "matches")
    dropped(rows, hubs)
    freed(spark)
    beyond = met.select("anchor", "doc_id", F.explode("rest").alias("at")).select("anchor", "doc_id", "at.*")
    lowest = written(beyond.groupBy("anchor", "window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "lowest")
    late = beyond.join(lowest, ["anchor", "window"]).where("doc_id > low").select("doc_id", F.col("start").alias("first"), (F.col("start") + n).alias("end"))
    found = met.where("first is not null").select("doc_id", "first", "end").union(late)
    found = written(found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "end")).alias("repeats")), "repeats_of")
    dropped(met, lowest)
    freed(spark)
    return found


def substring_dedup(docs: DataFrame, n: int = 13, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, repeats) per row of docs(doc_id, text).

    A word is a run outside ASCII white space, unchanged. Each word goes that is covered by a window of n words whose
    words also start in a document with a smaller doc_id, as the input has them. `repeats` are the stretches of removed
    words as [first, end). A null text has no words. A row without doc_id loses nothing and takes nothing; rows of one
    doc_id are one document. Empty tables give empty results; extra columns are not read.

    Seed: every window has an anchor, its seed of the least hash, so equal windows share one, wherever they stand;
    anchors that only one document holds are dropped by a pre-aggregated minimum and maximum. Join and extend: each
    occurrence of an anchor is joined with the one in the smallest document, and the match is extended both ways as far
    as the texts agree. Windows that reach beyond it may still repeat elsewhere: they are joined with the smallest
    document that has the same window. So an occurrence meets one other, a window beyond its match one more, and the
    work grows with the text and not with the square of a passage's copies. Overlapping matches join to maximal repeats
    of n words or more. Windows are equal by 128 bits: 64 of the anchor and 64 of all their words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeats(docs, n, seed)
    # Rows without doc_id take no part in the join, where they would all be one key.
    none = docs.where("doc_id is null").withColumn("repeats", F.lit(None).cast("array<struct<first:int,end:int>>"))
    rows = docs.where("doc_id is not null").join(found, "doc_id", "left").select("doc_id", "text", "repeats").unionByName(none)
    return by_batch(rows, _removed, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, repeats array<array<int>>")
