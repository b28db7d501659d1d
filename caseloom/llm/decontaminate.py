"""Benchmark decontamination: MinHash containment search by size class, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, binary, by_batch, distinct_sorted, written
from .minhash import _SIGMA, _pi, mix

#: Classes of benchmark items, and shingles of theirs, held in memory at once, on the driver too; a larger benchmark takes as many passes over the documents as it has blocks.
BLOCK, SHINGLES = 20_000, 2_000_000
COORDINATES = 64
#: Words are runs of letters, digits and bytes beyond ASCII, A-Z in lower case.
GAPS = np.ones(256, bool)
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _item_sets(benchmark: DataFrame, shingle: int) -> DataFrame:
    """(item_id, words, shingles, key): each item's shingle set as sorted hashes, and 128 bits of it; an item of fewer words than a shingle has them all as its one shingle. Items without words or id are left out."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = Words(batch.column("text"), lower=True, gaps=GAPS)
        for k in range(1, shingle + 1):
            value, before = distinct_sorted(*own.grams(k))
            at = np.flatnonzero(own.counts >= k if k == shingle else own.counts == k)
            sets = binary(value, before).cast(pa.binary()).take(pa.array(at))
            keys = [xxhash.xxh3_128_digest(bytes([k]) + v.as_py()) for v in sets]
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at)), pa.array(np.full(len(at), k, np.int32)), sets, pa.array(keys, pa.binary())], names=["item_id", "words", "shingles", "key"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return by_batch(items, run, "item_id long, words int, shingles binary, key binary")


def item_classes(benchmark: DataFrame, shingle: int = 5) -> DataFrame:
    """(item_id, class_id): the item under which contaminated() reports an item, the smallest with the same shingle set."""
    sets = _item_sets(benchmark, shingle).select("item_id", "key")
    return sets.join(sets.groupBy("key").agg(F.min("item_id").alias("class_id")), "key").select("item_id", "class_id").distinct()


class Index:
    """Signatures of benchmark items, by size class: items with 2^c to 2^(c+1) - 1 shingles are sought in windows of that many.

    Rows are (item_id, words, shingles). Items of fewer words than a shingle are sought as they are, by hash.
    """

    def __init__(self, rows: list[tuple[int, int, bytes]], shingle: int, coordinates: int):
        self.items = [(item, np.frombuffer(own, np.uint64)) for item, words, own in rows if words == shingle]
        self.short: dict[int, dict[int, list[int]]] = {}
        for item, words, own in rows:
            if words < shingle:
                self.short.setdefault(words, {}).setdefault(int(np.frombuffer(own, np.uint64)[0]), []).append(item)
        self.shingle, self.k = shingle, coordinates
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_class: dict[int, list[tuple[int, int]]] = {}
        for n, (_, own) in enumerate(self.items):
            places = (mix(own * _SIGMA) >> np.uint64(32)).astype(np.uint32)
            for i in range(coordinates):
                low = int(_pi(places + np.uint32(i + 1)).min())
                by_class.setdefault(int(len(own)).bit_length() - 1, []).append((i << 32 | low, n))
        for c, pairs in by_class.items():
            own = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            self.classes[c] = own[:, 0].astype(np.uint64), own[:, 1]

    def candidates(self, value: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Pairs (text, item): the item agrees in a coordinate with a window of the text in the item's size class.

        Windows are two neighbouring blocks of 2^(c+1) shingles, so any run of as many lies in one whole. The blocks'
        minima of a class come from those of the class below.
        """
        n = np.diff(before)
        found = []
        if not self.classes or not n.any():
            return np.zeros((0, 2), np.int64)
        low = min(self.classes)
        width = 2 << low
        blocks = -(-n // width)
        start = np.repeat(before[:-1], blocks) + width * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        text = np.repeat(np.arange(len(n)), blocks)
        places = (mix(value * _SIGMA) >> np.uint64(32)).astype(np.uint32)
        least = np.stack([np.minimum.reduceat(_pi(places + np.uint32(i + 1)), start) for i in range(self.k)])
        for c in range(low, max(self.classes) + 1):
            if c in self.classes:
                keys, item = self.classes[c]
                window = least.copy()
                same = text[1:] == text[:-1]
                window[:, :-1][:, same] = np.minimum(least[:, :-1], least[:, 1:])[:, same]
                for i in range(self.k):
                    key = window[i].astype(np.uint64) | np.uint64(i << 32)
                    a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                    hit = np.flatnonzero(b > a)
                    if len(hit):
                        m = (b - a)[hit]
                        at = np.repeat(a[hit], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                        found.append(np.stack((np.repeat(text[hit], m), item[at]), 1))
            first = np.ones(len(text), bool)
            first[1:] = text[1:] != text[:-1]
            odd = (np.arange(len(text)) - np.maximum.accumulate(np.where(first, np.arange(len(text)), 0))) % 2
            pair = np.flatnonzero(odd == 0)
            least = np.minimum.reduceat(least, pair, axis=1)
            text = text[pair]
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, containment: float = 0.8, coordinates: int = COORDINATES, block: int = BLOCK, short: bool = True) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): documents that hold at least that share of an item's shingles.

    An item with fewer words than a shingle counts as one shingle, held by a text in which its words stand in a row; with
    short=False such items are left out. Items with equal shingle sets are one class, reported under its smallest
    item_id (item_classes() has the members). Null or empty items are in nothing; null and empty texts hold nothing;
    repeated rows are reported as often as they occur and a null doc_id stays null; extra columns are not read; empty
    tables give empty results.

    Classes are formed over the whole benchmark and divided into blocks of bounded size, each class in one, so the
    result does not depend on the blocks. Of several blocks each is searched and its findings are written before the next
    is read, so that driver and tasks hold one at a time; the documents are read once for each block and never shuffled.
    A very long text is a step of its own, which holds some numbers for each of its words.
    """
    sets = written(_item_sets(benchmark, shingle).where(F.lit(short) | (F.col("words") == shingle)), "item_sets")
    low = sets.groupBy("key").agg(F.min("item_id").alias("item_id"))
    classes = written(sets.join(low, ["key", "item_id"]).dropDuplicates(["key"]), "item_classes")
    total = classes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-total["n"] // block), -(-total["size"] // (8 * SHINGLES)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in range(blocks):
        own = classes.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("item_id", "words", "shingles").orderBy("item_id", "shingles")
        index = Index([(r[0], r[1], bytes(r[2])) for r in own.collect()], shingle, coordinates)

        def run(batch: pa.RecordBatch, index: Index = index) -> Iterator[pa.RecordBatch]:
            words = Words(batch.column("text"), lower=True, gaps=GAPS)
            value, before = words.grams(index.shingle)
            rows, last, own = [], -1, np.zeros(0, np.uint64)
            for t, i in index.candidates(value, before).tolist():
                if t != last:
                    last, own = t, np.sort(value[before[t] : before[t + 1]])
                item, want = index.items[i]
                at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                shared = int((own[at] == want).sum())
                if shared >= containment * len(want) - 1e-9:
                    rows.append((t, item, shared, len(want), shared / len(want)))
            for k, wanted in index.short.items():
                value, before = words.grams(k)
                at = np.flatnonzero(np.isin(value, np.fromiter(wanted, np.uint64, len(wanted))))
                held = {(t, v) for t, v in zip((np.searchsorted(before, at, "right") - 1).tolist(), value[at].tolist(), strict=True)}
                rows += [(t, item, 1, 1, 1.0) for t, v in sorted(held) for item in wanted[v]]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            ids = batch.column("doc_id").take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.float64())], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

        part = by_batch(docs, run, "doc_id long, item_id long, n_shared long, n_item long, containment double")
        part = part if blocks == 1 else written(part, "contaminated")
        out = part if out is None else out.union(part)
    return out
