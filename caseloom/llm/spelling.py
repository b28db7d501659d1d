"""Spelling variants: words at one edit found by a rare-first prefix filter over positional bigrams, and the forms they vary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Different words that a task counts before it hands its sums on, and characters from which a text's words are counted one by one.
WORDS_HELD, LONG_TEXT = 200_000, 1 << 20
#: Bigrams are ordered by the frequency of their slot; so what tasks are sent is this many numbers at any alphabet.
SLOTS = 1 << 16


def damaged(doc_id: int | None, word: str, every: int) -> str:
    """The word, without one of its code points if `every` divides the crc32 of "<doc_id>:<word>" (a null doc_id writes nothing)."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    return word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, shortest: int = 6, fewest: int = 5, damage: int | None = None) -> DataFrame:
    """(word, n): words of docs(doc_id, text) of at least `shortest` code points, found at least `fewest` times in all.

    Words are maximal runs of RUN, with A-Z lower-cased. With `damage`, each word first goes through damaged(), which
    depends on the document and the word alone, so it is done once for each different word of a text. A null text has
    no words; repeated rows count as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                lower = (text.as_py() or "").encode().lower().decode()  # of bytes: A-Z only
                own = Counter(RUN.findall(lower)) if len(lower) < LONG_TEXT else Counter(m[0] for m in RUN.finditer(lower))
                for word, n in own.items():
                    if len(word) >= shortest:
                        if damage:
                            word = damaged(doc_id, word, damage)
                        if len(word) >= shortest:
                            counts[word] += n
                if len(counts) >= WORDS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


@lru_cache(1 << 16)
def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode()) % SLOTS


def _slot_counts(words: DataFrame) -> np.ndarray:
    """How many bigrams of the different words fall in each slot: SLOTS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for word in batch.column("word").to_pylist():
                for i in range(len(word) - 1):
                    total[_slot(word[i : i + 2])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in words.select("word").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def rarest(word: str, often: np.ndarray, k: int = 3) -> list[tuple[str, int]]:
    """The word's k rarest bigrams with their places; ties by the bigram, then by the place. Time is linear in the word."""
    return [(g, i) for _, g, i in nsmallest(k, ((int(often[_slot(word[i : i + 2])]), word[i : i + 2], i) for i in range(len(word) - 1)))]


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): for words(word, n), distinct words of four letters or more, all pairs at exactly one edit, in both directions.

    An edit destroys two bigrams of a word at most and makes two at most, and moves the others by one place at most. In
    one global order, here rarest first, two words at one edit therefore share one of their three first bigrams: at the
    same place if they are equally long, else at the same place or one later in the longer word. Those are the keys of
    the join; the edit distance is checked inside it, so what leaves it is pairs found, not candidates.
    """
    often = _slot_counts(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, g, at) for i, word in enumerate(batch.column("word").to_pylist()) for g, at in rarest(word, often)]
            picked = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([picked.column("word"), picked.column("n"), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["word", "n", "gram", "place"])

    held = written(words.select("word", "n").mapInArrow(run, "word string, n long, gram string, place int").withColumn("size", F.length("word")), "postings")
    one = held.select("gram", F.col("size").alias("s1"), F.col("place").alias("p1"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    meets = F.expr("explode(array(struct(s1 as size, p1 as place), struct(s1 + 1 as size, p1 as place), struct(s1 + 1 as size, p1 + 1 as place)))")
    one = one.withColumn("at", meets).select("gram", "at.size", "at.place", "a", "a_n", "s1")
    two = held.select("gram", "size", "place", F.col("word").alias("b"), F.col("n").alias("b_n"))
    found = one.join(two, ["gram", "size", "place"]).where("(size > s1 or a < b) and levenshtein(a, b, 1) = 1")
    found = written(found.select("a", "a_n", "b", "b_n").distinct(), "near")
    dropped(held)
    return found.selectExpr("a as word", "b as near", "b_n as near_n").union(found.selectExpr("b", "a", "a_n"))


def spelling_groups(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words(word, n): the form a word varies, and the last form that its forms lead to.

    A form is the near word of largest n (ties: the smallest in code-point order) if that is at least `times` the
    word's own n; else null, and the word is its own root. Counts grow by `times` along forms, so they make no rings
    and chains of few steps; each round of the loop doubles the steps taken. An empty table gives an empty result.
    """
    words = written(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = F.expr(f"-best.less >= {int(times)} * n")
    base = words.join(best, "word", "left").select("word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n"))
    base = written(base, "forms")
    to = written(base.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not to.where("moved").isEmpty():
        then = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, to = to, written(to.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(old)
    dropped(words)
    return base.join(to.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
