"""Additive explanations of boosted trees: each feature's share of a row's margin, exactly, from the fitted nodes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.scores import feature_source, feature_text
from caseloom.operators.graph import shared_path

#: Rows that one vectorised step holds for all leaves of a tree.
STEP_ROWS = 2048


def _one_leaf(path: list[tuple[int, float, bool, float]]) -> tuple[list[int], list[float], list[float], list[float]]:
    """(features, low, high, shares) of a leaf's path of (feature, threshold, goes left, the child's share of its parent's cover): one interval (low, high] and one share for each different feature."""
    low, high, share = {}, {}, {}
    for feature, threshold, left, part in path:
        share[feature] = share.get(feature, 1.0) * part
        if left:
            high[feature] = min(high.get(feature, np.inf), threshold)
        else:
            low[feature] = max(low.get(feature, -np.inf), threshold)
    names = list(share)
    return names, [low.get(f, -np.inf) for f in names], [high.get(f, np.inf) for f in names], [share[f] for f in names]


def _shares(value: np.ndarray, part: np.ndarray) -> np.ndarray:
    """(leaf, pattern, feature): what each feature adds at each of the leaves, for every pattern of features whose interval holds the row.

    Without a feature, a row goes down both sides by cover. A leaf is then worth its value times the product of 1 or 0 for
    the features known and of their parts for those that are not, and a feature's share is the mean gain over all orders
    in which the u features become known: sums over subset sizes, as coefficients of a product of linear terms.
    """
    leaves, u = part.shape
    held = (np.arange(1 << u)[:, None] >> np.arange(u) & 1).astype(float)
    weight = np.array([factorial(s) * factorial(u - s - 1) / factorial(u) for s in range(u)])
    out = np.empty((leaves, 1 << u, u))
    for j in range(u):
        poly = np.zeros((leaves, 1 << u, u))
        poly[:, :, 0] = 1
        for k in range(u):
            if k != j:
                grown = poly * part[:, None, k, None]
                grown[:, :, 1:] += poly[:, :, :-1] * held[None, :, k, None]
                poly = grown
        out[:, :, j] = (poly @ weight) * (held[None, :, j] - part[:, None, j]) * value[:, None]
    return out


@dataclass
class Trees:
    """The leaves of fitted trees, grouped by the tree and the number of different features on their paths; bounded by the model, not by the data."""

    width: int
    base: float = 0.0
    #: (features, low, high, parts, values), each by leaf, of the leaves of one tree with equally many features.
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    _tables: list[np.ndarray] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def add(self, nodes: dict[int, tuple[int, float, int, int, float, float]], weight: float) -> None:
        """nodes: id to (feature or -1, threshold, left, right, prediction, cover), the root at 0."""
        by: dict[int, list] = {}
        todo: list[tuple[int, list]] = [(0, [])]
        while todo:
            at, path = todo.pop()
            feature, threshold, left, right, value, cover = nodes[at]
            if feature >= 0:
                for child, goes in ((left, True), (right, False)):
                    todo.append((child, [*path, (feature, threshold, goes, nodes[child][5] / cover if cover else 0.5)]))
                continue
            names, low, high, part = _one_leaf(path)
            self.base += weight * value * float(np.prod(part))
            if names:
                by.setdefault(len(names), []).append((names, low, high, part, weight * value))
        for own in by.values():
            self.groups.append(tuple(np.array(c) for c in zip(*own, strict=True)))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): with `base`, each row sums up to its margin."""
        if self._tables is None:
            self._tables = [_shares(value, part) for *_, part, value in self.groups]
        out = np.zeros((len(x), self.width))
        for i in range(0, len(x), STEP_ROWS):
            own = x[i : i + STEP_ROWS]
            for (names, low, high, part, _), table in zip(self.groups, self._tables, strict=True):
                leaves, u = part.shape
                seen = own[:, names.ravel()].reshape(len(own), leaves, u)
                pattern = ((seen > low) & (seen <= high)) @ (1 << np.arange(u))
                got = table[np.arange(leaves), pattern].reshape(len(own), leaves * u)
                place = np.zeros((leaves * u, self.width))
                place[np.arange(leaves * u), names.ravel()] = 1
                out[i : i + STEP_ROWS] += got @ place
        return out


def fitted_trees(model, width: int) -> Trees:
    """The trees of a fitted pipeline's last stage, read from its saved node table: one row a node, with its weighted cover."""
    trees, session = model.stages[-1], SparkSession.getActiveSession()
    path = shared_path(session, "trees")
    trees.write().overwrite().save(path)
    rows = session.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    by: dict[int, dict] = {}
    for r in rows:
        inner = r["leftChild"] >= 0
        by.setdefault(r["treeID"], {})[r["id"]] = (r["split"]["featureIndex"] if inner else -1, r["split"]["leftCategoriesOrThreshold"][0] if inner else 0.0, r["leftChild"], r["rightChild"], r["prediction"], r["impurityStats"][0])
    out = Trees(width)
    for i, weight in enumerate(trees.treeWeights):
        out.add(by[i], weight)
    return out


def explained(trees: Trees, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with base_margin and contributions, one for each of the columns; null features count as 0, as in the model's own scores.

    A margin is base_margin plus the contributions, and the probability 1 / (1 + exp(-2 margin)). Scored in Arrow batches;
    tasks are sent the leaves of the model only.
    """

    @F.pandas_udf("array<double>")
    def shares(*features: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in features])
        return pd.Series(list(trees.contributions(np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf))))

    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    return rows.withColumn("base_margin", F.lit(trees.base)).withColumn("contributions", shares(*x))


def top_factors(rows: DataFrame, key: Sequence[str], columns: Sequence[str], top: int = 4) -> DataFrame:
    """(key, place, feature, value, contribution, direction, explanation, source): the largest contributions of each explained row, ties in the order of the columns.

    The choice is made inside the row, by sorting its array of features.
    """
    one = lambda i, c: F.struct((-F.abs(F.round(F.col("contributions")[i], 9))).alias("size"), F.lit(i).alias("at"), F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value"), F.col("contributions")[i].alias("contribution"))
    first = F.slice(F.array_sort(F.array(*(one(i, c) for i, c in enumerate(columns)))), 1, top)
    out = rows.select(*key, F.posexplode(first).alias("place", "f")).select(*key, (F.col("place") + 1).alias("place"), "f.feature", "f.value", F.round("f.contribution", 6).alias("contribution"))
    return with_texts(out, F.col("contribution") > 0)


def with_texts(rows: DataFrame, positive: Column) -> DataFrame:
    """rows(feature, value) with direction, a sentence and the source of the evidence."""
    return rows.withColumns({"direction": F.when(positive, "positive").otherwise("negative"), "explanation": feature_text(F.col("feature"), F.col("value"), positive), "source": feature_source(F.col("feature"))})


def against_means(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, feature, value, direction, explanation, source) of each of the columns that differs from its mean (column mean_<name>), as with_texts() has them.

    What hangs on the feature's name is settled in the plan, as each has its own expression; a row says nothing but its values.
    """
    kinds = dict(rows.dtypes)

    def one(c: str) -> Column:
        value, mean = F.col(c).cast("double"), F.col(f"mean_{c}")
        held = value if kinds[c] in ("int", "bigint") else F.round(value, 6)
        up = value > mean
        return F.when(held != mean, F.struct(F.lit(c).alias("feature"), value.alias("value"), F.when(up, "positive").otherwise("negative").alias("direction"), feature_text(F.lit(c), value, up).alias("explanation"), feature_source(F.lit(c)).alias("source")))

    return rows.select(*key, F.explode(F.array_compact(F.array(*(one(c) for c in columns)))).alias("f")).select(*key, "f.*")


def evidence_records(factors: DataFrame, key: Sequence[str], records: DataFrame) -> DataFrame:
    """(key, feature, source, record_id): the records(key, source, record_id) behind each factor; features of several sources ("master intelligence") rest on the records of all.

    One row a record, so no group of a pair's records is held together. The factors have at most as many rows a key as
    there are features; both sides are plain, so a pair with very many records can be split.
    """
    own = factors.select(*key, "feature", "source")
    one = own.where("source != 'master intelligence'").join(records, [*key, "source"])
    every = own.where("source = 'master intelligence'").drop("source").join(records, list(key))
    return one.select(*key, "feature", "source", "record_id").unionByName(every.select(*key, "feature", "source", "record_id"))
