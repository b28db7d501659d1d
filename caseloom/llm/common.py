"""Shared helpers: written tables in the shared folder, Arrow batches as bytes, vectorised words and shingles."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on; a longer document makes a step of its own.
STEP_BYTES = 1 << 20

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; on a cluster that would split the data over machines and is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="llm_shared_"))
        atexit.register(_LOCAL[0].cleanup)
    return f"file://{_LOCAL[0].name}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a Parquet table in the shared folder: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written() made and that all later results have been written without."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def freed(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more; else they stay on disk until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def steps(texts: pa.Array | pa.ChunkedArray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows holding about `limit` bytes each, one row at least."""
    n = len(texts)
    if not n:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i = 0
    while i < n:
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield i, min(j, n)
        i = j


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_GRAM = _odd(13, 64)
_LANE = _odd(14, 4)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Which bytes of an 8-byte chunk belong to a word of which 0 to 8 bytes are left.
_LEFT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers with well-spread bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _lanes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit states of each byte range: its length and its 8-byte chunks in order, each step a non-linear mix; xxh3 for ranges over LONG."""
    size = end - start
    a, b = (mix(size.astype(np.uint64) + k) for k in _LANE[:2])
    chunks = np.ndarray(len(raw) + 1, np.dtype("<u8"), np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))
    at = np.flatnonzero(size <= LONG)
    for j in range(0, LONG, 8):
        at = at[size[at] > j]
        if not len(at):
            break
        chunk = chunks[start[at] + j] & _LEFT[np.minimum(size[at] - j, 8)]
        a[at], b[at] = mix(a[at] ^ chunk), mix(b[at] + chunk * _LANE[2])
    whole = memoryview(raw)
    for i in np.flatnonzero(size > LONG).tolist():
        digest = xxhash.xxh3_128_intdigest(whole[start[i] : end[i]])
        a[i], b[i] = digest & 0xFFFFFFFFFFFFFFFF, digest >> 64
    return a, b


class Words:
    """Words of some texts: two independent 64-bit hashes of each, their byte ranges and the words before each text.

    A word is a run of bytes outside `gaps` (white space unless given); with `lower`, A-Z count as a-z. Words never
    cross the end of a text. All arrays are built by whole-array operations; besides a few bytes for each byte of the
    text they hold some numbers for each word. `hash` takes part in sets and signatures; where equality must hold
    over a whole corpus, `other` makes it 128 bits.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, gaps: np.ndarray = SPACE):
        self.raw, self.offsets = utf8(texts)
        n = len(self.raw)
        solid = ~gaps[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        first = np.empty(n, bool)
        last = np.empty(n, bool)
        if n:
            first[0], first[1:] = True, ~solid[:-1] | edge[1:n]
            last[-1], last[:-1] = True, ~solid[1:] | edge[1:n]
        self.start = np.flatnonzero(solid & first)
        self.end = np.flatnonzero(solid & last) + 1
        a, b = _lanes(_LOWER[self.raw] if lower else self.raw, self.start, self.end)
        self.hash = mix(a + (b << np.uint64(21) | b >> np.uint64(43)))
        self.other = mix(b ^ a * _LANE[3])
        #: Words before each text, and in all: text i has words before[i] to before[i + 1].
        self.before = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.before)

    def text_of(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.before) - 1), self.counts)

    def grams(self, k: int, short: bool = False, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, before): each text's runs of k words in order; with `short`, the whole of a text with fewer words, if it has any; with `other`, from the other hashes."""
        n, counts, word = len(self), self.counts, self.other if other else self.hash
        many = np.maximum(counts - k + 1, 0)
        before = np.concatenate(([0], np.cumsum(np.maximum(many, counts > 0) if short else many)))
        value = np.zeros(before[-1], np.uint64)
        long = many > 0
        if n >= k and long.any():
            every = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                every += word[j : n - k + 1 + j] * _GRAM[j]
            every = mix(every)
            inside = np.zeros(n - k + 1, bool)
            step = np.zeros(n - k + 2, np.int64)
            np.add.at(step, self.before[:-1][long], 1)
            np.add.at(step, self.before[:-1][long] + many[long], -1)
            inside = np.cumsum(step[:-1]) > 0
            to = np.repeat(long, np.diff(before))
            value[to] = every[inside]
        if short:
            for i in np.flatnonzero((counts > 0) & ~long):
                own = word[self.before[i] : self.before[i + 1]]
                value[before[i]] = mix((own * _GRAM[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
        return value, before


def distinct_sorted(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each group's distinct values in ascending order, and the new group bounds."""
    v, g = values.copy(), np.repeat(np.arange(len(before) - 1), np.diff(before))
    for i, j in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        v[i:j].sort()
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    return v[new], np.concatenate(([0], np.cumsum(np.bincount(g[new], minlength=len(before) - 1))))


def binary(values: np.ndarray, before: np.ndarray) -> pa.Array:
    """One little-endian binary value for each group of 64-bit integers."""
    return pa.Array.from_buffers(pa.large_binary(), len(before) - 1, [None, pa.py_buffer(np.ascontiguousarray(before * 8, np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with fn applied to pieces of about STEP_BYTES of the column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in steps(batch.column("text")):
                yield from fn(batch.slice(i, j - i))

    return df.mapInArrow(run, schema)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
