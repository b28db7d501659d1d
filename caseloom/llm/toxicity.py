"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice, takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, written

#: Characters that stand for a Latin letter, and digits and signs used in its place.
HOMOGLYPHS = {
    "а": "a", "α": "a", "à": "a", "á": "a", "â": "a", "ã": "a", "å": "a", "с": "c", "ç": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ε": "e", "è": "e", "é": "e", "ê": "e", "ë": "e",
    "һ": "h", "і": "i", "ι": "i", "ì": "i", "í": "i", "î": "i", "ï": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "н": "h", "ո": "n", "о": "o", "ο": "o", "ò": "o", "ó": "o", "ô": "o", "õ": "o",
    "р": "p", "ρ": "p", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ù": "u", "ú": "u", "û": "u", "ѵ": "v", "ν": "v", "ԝ": "w", "х": "x", "χ": "x", "у": "y", "ý": "y",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Phrases in which a lexicon word gives no offence; their words count for nothing.
EXCEPTIONS = ("pathetic fallacy", "trash can", "trash bin", "class clown fish", "clown fish", "sore loser clause")

_LETTERS = re.compile(r"[^\W\d_]")
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {i: chr(0x61 + i - a) for a in (0xFF21, 0xFF41) for i in range(a, a + 26)}
_RUN = re.compile(r"[\w@$!]+")
_INSIDE = re.compile(r"[^\W\d_][\d@$!]")
_FIRST = re.compile(r"[\d@$]")
_WORD = re.compile(r"[^\W\d_]+")
_UNLEET = str.maketrans(DIGITS)


def _unleet(m: re.Match) -> str:
    """A run of letters, digits and signs: all of it is read as letters if a digit or sign follows a letter, else what
    begins with the first digit that has a letter after it; signs of exclamation at the end stay. Each step looks at the run once."""
    run, at = m[0], 0
    if not _INSIDE.search(run):
        first = _FIRST.search(run)
        if not first or not _LETTERS.search(run, first.end()):
            return run
        at = first.start()
    end = len(run.rstrip("!"))
    return run[:at] + run[at:end].translate(_UNLEET) + run[end:]


_SIGN = re.compile(r"[0-9@$!]")
_SPACE = re.compile(r"\s|$")


def folded(text: str) -> str:
    """Lower case, homoglyphs as Latin letters, and digits or signs inside a word as the letters they stand for."""
    text = text.lower().translate(_FOLD)
    out, done = [], 0
    for m in _SIGN.finditer(text):  # only the stretches around such signs are looked at
        if m.start() >= done:
            start = max(done, text.rfind(" ", done, m.start()) + 1, text.rfind("\n", done, m.start()) + 1)
            end = _SPACE.search(text, m.end()).start()
            out += [text[done:start], _RUN.sub(_unleet, text[start:end])]
            done = end
    return "".join([*out, text[done:]])


def _outside(places: list[int], spans: list[tuple[int, int]]) -> list[bool]:
    """Which places lie in none of the spans (start, end): the furthest end of the spans that begin up to a place decides."""
    if not spans:
        return [True] * len(places)
    begin, end = np.array(sorted(spans)).T
    reach = np.concatenate(([-1], np.maximum.accumulate(end)))
    at = np.array(places, np.int64)
    return (reach[np.searchsorted(begin, at, "right")] <= at).tolist()


@dataclass
class Lexicon:
    """Folded words (whole) and word beginnings with their weights, and the logistic curve of a text's score."""

    words: dict[str, float]
    stems: dict[str, float]
    curve: tuple[float, ...] = (-4.0, 3.0, 0.0)
    exceptions: tuple[str, ...] = EXCEPTIONS
    _machine: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def _built(self) -> object:
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for kind, entries in (("stem", self.stems), ("word", self.words)):  # a whole word replaces the same beginning
                for w, x in entries.items():
                    self._machine.add_word(f" {w} " if kind == "word" else f" {w}", (kind, len(w), x))
            for e in self.exceptions:
                self._machine.add_word(f" {folded(e)} ", ("exception", len(folded(e)), 0.0))
            if not len(self._machine):
                self._machine.add_word(" \0", ("exception", 0, 0.0))
            self._machine.make_automaton()
        return self._machine

    def features(self, text: str | None) -> tuple[float, float]:
        """(strength, density): the log of 1 + the matched words' weights, and the same weights for each hundred words."""
        words = _WORD.findall(folded(text or ""))
        line = f" {' '.join(words)} "
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (kind, n, x) in self._built().iter(line):
            start = end - n + (kind == "stem")
            if kind == "exception":
                spared.append((start, end))
            else:
                found[start] = max(x, found.get(start, 0.0))
        total = sum(x for x, out in zip(found.values(), _outside(list(found), spared), strict=True) if out)
        return float(np.log1p(total)), float(np.log1p(100 * total / max(25, len(words))))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + features @ np.array(self.curve[1:]), -30, 30)))


def _counted(sample: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(kind, entry, toxic, clean): in how many texts of each label a folded word, or a word beginning of the given lengths, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = set(_WORD.findall(folded(text or "")))
                counts[label].update(words)
                counts[label].update({f" {w[:n]}" for w in words for n in lengths if len(w) >= n})
        keys = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array([k[:1] == " " for k in keys], pa.bool_()), pa.array([k.strip() for k in keys]), *(pa.array([counts[c][k] for k in keys], pa.int64()) for c in (1, 0))]
        yield pa.RecordBatch.from_arrays(cols, names=["stem", "entry", "toxic", "clean"])

    return sample.mapInArrow(run, "stem boolean, entry string, toxic long, clean long").groupBy("stem", "entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: int = 5, rate: float = 20, lengths: tuple[int, ...] = (4, 5, 6, 7), exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon learned from docs(doc_id, text) and labels(doc_id, toxic), of at most `sample` labelled rows.

    The bounded sample holds the rows of the smallest hashes of doc_id, of each label at most half. An entry's weight is
    the logarithm of how much oftener toxic texts hold it than clean ones; entries that occur in fewer than `least`
    different toxic texts, or less than `rate` times as often, are left out, and so is a beginning whose longer form or
    single word says as much. Near copies count once: of texts of one label that agree in the smallest hash of their
    five-word runs, that of the smallest doc_id is read. Null labels, ids and texts are no examples; of rows of one
    doc_id all are read, with the greatest label. Every step is ordered, so equal tables give equal lexicons.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for v in (0, 1)]
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    shingle = F.expr("array_min(transform(sequence(0, greatest(size(w) - 5, 0)), i -> xxhash64(slice(w, i + 1, 5))))")
    rows = written(rows.withColumn("w", F.split("text", r"\s+")).withColumn("key", shingle).groupBy("label", "key").agg(F.min(F.struct("doc_id", "text")).alias("one")).select("one.text", "label"), "labelled_sample")
    counts = _counted(rows, lengths).persist()
    n = {v: 0 for v in (0, 1)} | {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    odds = (F.col("toxic") / max(1, n[1])) / ((F.col("clean") + 0.5) / max(1, n[0]))
    best = counts.where((F.col("toxic") >= least) & (odds >= rate)).withColumn("rate", odds).orderBy("entry", "stem").collect()
    counts.unpersist()
    entries = {(r["stem"], r["entry"]): (r["toxic"], float(np.log(r["rate"]))) for r in best}
    words = {w: x for (stem, w), (_, x) in entries.items() if not stem}
    stems, order = {}, [(r["entry"], r["stem"], r["toxic"]) for r in best]
    for i, (w, stem, toxic) in enumerate(order):
        # A beginning must say more than any one word or any longer beginning that is in the list; all of them follow it, or are the word itself.
        longer = takewhile(lambda e: e[0].startswith(w), islice(order, i + 1, None))  # noqa: B023
        same = [e for e in order[max(0, i - 1) : i] if e[0] == w]
        if stem and not any(t >= 0.9 * toxic and (not s or len(v) > len(w)) for v, s, t in (*same, *longer)):
            stems[w] = entries[stem, w][1]
    lexicon = Lexicon(words, stems, exceptions=exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([lexicon.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("label")], names=["a", "b", "label"])

    seen = rows.mapInArrow(run, "a double, b double, label int").toPandas()
    if len(seen) and seen["label"].nunique() == 2:
        lexicon.curve = _logistic(seen[["a", "b"]].to_numpy(), seen["label"].to_numpy(float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """(intercept, slopes) of a ridge-penalised logistic regression, by damped Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-3, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) for each row; a null or empty text has the score of a text without a match. Extra columns are not read.

    Rows are scored one by one: repeated rows get equal scores as often as they occur, a null doc_id stays null, an empty
    table gives an empty result. A very long text, spaced or not, takes time in proportion to its length; it is held by one task.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.array([lexicon.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lexicon.score(x))], names=["doc_id", "score"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def held_out() -> Column:
    """Rows that nothing is learned from: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_column(lexicon: Lexicon):
    """A vectorised function of a text column that gives its score; the rest of a row stays where it is."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(lexicon.score(np.array([lexicon.features(t) for t in texts]).reshape(-1, 2)))

    return score
