"""Learned scores: isolation forest, density clusters, boosted lead ranking, evaluation."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from caseloom.functions.scores import anomaly_band
from caseloom.operators.graph import components, cut
from caseloom.operators.ranking import exact_quantile, ranked, running_sum

LEAD_FEATURES = ("communication_frequency", "average_call_duration", "transaction_count", "total_amount", "average_amount", "shared_case_count", "evidence_count", "multi_source_support")


def _expected_depth(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n keys."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grown_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, cut, left, right) or (-1, leaf depth, 0, 0) of a tree of random cuts, the root first."""
    limit, nodes, todo = int(np.ceil(np.log2(max(len(x), 2)))), [None], [(0, x, 0)]
    while todo:
        at, own, depth = todo.pop()
        spread = np.flatnonzero(own.max(axis=0) > own.min(axis=0)) if len(own) > 1 else []
        if depth >= limit or not len(spread):
            nodes[at] = (-1, depth + float(_expected_depth(len(own))), 0, 0)
            continue
        f = int(rng.choice(spread))
        at_value = rng.uniform(own[:, f].min(), own[:, f].max())
        nodes[at] = (f, at_value, len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(len(nodes) - 2, own[own[:, f] < at_value], depth + 1), (len(nodes) - 1, own[own[:, f] >= at_value], depth + 1)]
    return nodes


@dataclass
class Forest:
    """Node arrays of trees of random cuts; rows that few cuts set apart are unusual. Its size follows from trees x sample, not from the data."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean depth over the expected one: near 1 for unusual rows."""
        depth = np.zeros(len(x))
        for f, at_value, left, right in self.trees:
            at = np.zeros(len(x), int)
            while (inner := f[at] >= 0).any():
                i = np.flatnonzero(inner)
                go = x[i, f[at[i]]] < at_value[at[i]]
                at[i] = np.where(go, left[at[i]], right[at[i]])
            depth += at_value[at]
        return 2 ** (-depth / max(len(self.trees), 1) / max(float(_expected_depth(self.size)), 1e-9))


def tree_samples(rows: DataFrame, n: int, features: Sequence[str], key: Sequence[str], trees: int, sample: int) -> DataFrame:
    """(tree, features): for each tree `sample` of the n rows, or all of fewer, drawn by a hash of the key.

    Where there are rows enough, the hash deals every row to one tree or none, so all trees draw from all rows in one
    pass and share none; else rows are dealt out again, in as many rounds as it takes, each by a hash of its own. Of what a
    tree is dealt the smallest hashes stay, which Spark looks for before the exchange too, so not even a key of very many
    rows comes to a task as a whole.
    """
    each = sample + 6 * math.isqrt(sample)
    slots = max(1, n // each)
    rounds = -(-trees // min(slots, trees))
    dealt = rows.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), *(F.col(c).cast("double").alias(c) for c in features)).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    keys = [f"_k{i}" for i in range(len(key))]
    slot = F.pmod(F.xxhash64(F.col("_round"), *keys), F.lit(slots))
    dealt = dealt.withColumn("tree", (F.col("_round") * min(slots, trees) + slot).cast("int")).where((slot < min(slots, trees)) & (F.col("tree") < trees))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(-1), "tree", *keys), *keys, *features)
    return dealt.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).select("tree", *features)


def grown_forest(samples: DataFrame, features: Sequence[str], size: int, seed: int) -> Forest:
    """One group a tree, grown where it lies; the driver gets the nodes, at most 2 x trees x sample rows of numbers."""

    def grow(own: pd.DataFrame) -> pd.DataFrame:
        tree = int(own["tree"].iloc[0])
        x = own[list(features)].to_numpy(float)
        nodes = grown_tree(x[np.lexsort(x.T[::-1])], np.random.default_rng([seed, tree]))
        return pd.DataFrame(nodes, columns=["feature", "value", "low", "high"]).assign(tree=tree, node=range(len(nodes)))[["tree", "node", "feature", "value", "low", "high"]]

    table = samples.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, value double, low int, high int").orderBy("tree", "node").toArrow()
    tree, *rest = (table.column(c).to_numpy() for c in ("tree", "feature", "value", "low", "high"))
    cuts = np.flatnonzero(np.diff(tree)) + 1
    return Forest(list(zip(*(np.split(c, cuts) for c in rest), strict=True)) if len(tree) else [], size)


def anomalies(rows: DataFrame, features: Sequence[str], contamination: float = 0.05, trees: int = 300, sample: int = 256, seed: int = 42, least: int = 10, key: Sequence[str] = ()) -> DataFrame:
    """rows with anomaly_score (0.5 at the cut that the given share of all rows exceeds), its band and flag; zeros with fewer than `least` rows.

    Each tree of an isolation forest is grown by a task on `sample` rows of its own, drawn from all rows by a hash of the key (all columns but the features, if none is
    given), so that equal features are drawn as often as they occur. Every row is scored in Arrow batches, and the cut is
    the exact quantile of all scores, to 6 digits. Null features count as 0.
    """
    filled = cut(rows.fillna(0, list(features)))
    key = list(key) or [c for c in rows.columns if c not in features] or list(features)
    n = filled.count()
    if n < least:
        return rows.withColumns({"anomaly_score": F.lit(0.0), "anomaly_level": F.lit("LOW"), "is_anomaly": F.lit(False)})
    forest = grown_forest(tree_samples(filled, n, features, key, trees, sample), features, min(sample, n), seed)

    @F.pandas_udf(DoubleType())
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.column_stack([c.to_numpy(float) for c in columns])))

    out = cut(filled.withColumn("anomaly_score", F.round(scored(*(F.col(c).cast("double") for c in features)), 6)))
    at = exact_quantile(out, "anomaly_score", 1 - contamination)
    score = F.round(F.col("anomaly_score") - at + 0.5, 6)
    return out.withColumn("anomaly_score", score).withColumn("anomaly_level", anomaly_band(F.col("anomaly_score"))).withColumn("is_anomaly", F.col("anomaly_score") > 0.5)


def scaled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features less their mean over their population deviation (1 for none)."""
    stats = rows.agg(*(F.avg(c).alias(f"_m_{c}") for c in features), *(F.stddev_pop(c).alias(f"_s_{c}") for c in features))
    joined = rows.join(F.broadcast(stats))
    return joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in features}).drop(*(f"_{k}_{c}" for c in features for k in "ms"))


def _apart(x: Column, y: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def _box_apart(low: Column, high: Column, other_low: Column, other_high: Column, nearest: bool) -> Column:
    """The smallest, or largest, squared distance between points of two boxes."""
    sides = F.arrays_zip(low.alias("a"), high.alias("b"), other_low.alias("c"), other_high.alias("d"))
    gap = (lambda s: F.greatest(F.lit(0.0), s["a"] - s["d"], s["c"] - s["b"])) if nearest else (lambda s: F.greatest(s["d"] - s["a"], s["b"] - s["c"]))
    return F.aggregate(F.transform(sides, lambda s: gap(s) * gap(s)), F.lit(0.0), lambda s, v: s + v)


def density_clusters(rows: DataFrame, key: str, features: Sequence[str], eps: float = 0.5, least: int = 3, fewest: int = 5) -> DataFrame:
    """(key, cluster, is_core): DBSCAN on scaled features; -1 for noise, and for all of fewer than `fewest` rows.

    A row is core with `least` rows within eps, itself included; a border row goes to the cluster of its smallest core
    neighbour. Clusters are numbered by their smallest core key. Null features count as the mean; keys are distinct.

    Rows fall in cells of side eps / sqrt(d), all of whose points are within eps of each other. A cell of `least` rows is
    dense: all its rows are core and of one cluster, without a pair. Rows of other cells, fewer than `least` a cell, are
    held against the boxes of the cells near by: a dense box that lies wholly within eps counts as a whole, and only
    rows of boxes cut by the distance are compared. Two dense cells are one cluster if a row of one, that nearest to the
    other's centre, is within eps of such a row of the other; only pairs of cells that this leaves open, and that no other link
    has joined, compare the rows that are within eps of the other's box.
    """
    reach = eps * eps + 1e-12
    d, c = len(features), F.col
    side = eps / math.sqrt(d)
    x = F.array(*(F.coalesce(c(f), F.lit(0.0)) for f in features))
    own = scaled(rows.select(c(key).alias("id"), *features), features).select("id", x.alias("x"))
    own = cut(own.withColumn("cell", F.transform("x", lambda v: F.floor(v / side))))
    n_rows = own.count()
    if n_rows < fewest:
        return rows.select(key, F.lit(-1).alias("cluster"), F.lit(False).alias("is_core"))
    box = [f(c("x")[i]) for f in (F.min, F.max, F.avg) for i in range(d)]
    cells = own.groupBy("cell").agg(F.count("*").alias("n"), F.min("id").alias("unit"), F.array(*box[:d]).alias("low"), F.array(*box[d : 2 * d]).alias("high"), F.array(*box[2 * d :]).alias("mid"))
    # Cells near by, in either order, over up to five features: the middles of two cells within eps are a cell's side further apart at most, so they lie in one block of side eps + side or in blocks side by side.
    steps = list(itertools.product((-1, 0, 1), repeat=min(d, 5)))
    cells = cut(cells.withColumn("block", F.array(*(F.floor((c("cell")[i] + 0.5) * side / (eps + side)) for i in range(min(d, 5))))))
    side_of = lambda s: [c(k).alias(f"{s}_{k}") for k in ("cell", "n", "unit", "low", "high", "mid")]
    around = cells.withColumn("block", F.explode(F.array(*(F.array(*(c("block")[i] + s[i] for i in range(len(s)))) for s in steps)))).select("block", *side_of("a"))
    near = around.join(cells.select("block", *side_of("b")), "block").where(c("a_cell") != c("b_cell")).where(_box_apart(c("a_low"), c("a_high"), c("b_low"), c("b_high"), True) <= reach)
    near = cut(near.drop("block"))
    dense = cells.where(c("n") >= least).select("cell", "unit")
    sparse = own.join(cells.where(c("n") < least).select("cell", "n", "low"), "cell").select("id", "x", "cell")
    sparse = cut(sparse)
    # Rows of sparse cells against sparse cells: at most least - 1 rows each.
    other = sparse.select(c("id").alias("other"), c("x").alias("y"), c("cell").alias("b_cell"))
    links = near.where((c("a_n") < least) & (c("b_n") < least)).select(c("a_cell").alias("cell"), "b_cell").union(sparse.select("cell", c("cell").alias("b_cell")).distinct())
    few = sparse.join(links, "cell").join(other, "b_cell").where(_apart(c("x"), c("y")) <= reach).select("id", "other")
    # Rows of sparse cells against dense ones: by the box where that decides, else row by row.
    to = sparse.join(near.where((c("a_n") < least) & (c("b_n") >= least)).select(c("a_cell").alias("cell"), "b_cell", "b_n", "b_unit", "b_low", "b_high"), "cell")
    to = to.withColumns({"least": _box_apart(c("x"), c("x"), c("b_low"), c("b_high"), True), "most": _box_apart(c("x"), c("x"), c("b_low"), c("b_high"), False)}).where(c("least") <= reach)
    whole = to.where(c("most") <= reach).select("id", c("b_unit").alias("unit"), c("b_n").alias("n"), c("b_unit").alias("first"))
    members = own.join(dense, "cell").select(c("cell").alias("b_cell"), c("id").alias("other"), c("x").alias("y"))
    part = to.where(c("most") > reach).select("id", "x", "b_cell", c("b_unit").alias("unit")).join(members, "b_cell").where(_apart(c("x"), c("y")) <= reach).groupBy("id", "unit").agg(F.count("*").alias("n"), F.min("other").alias("first"))
    few, many = cut(few), cut(whole.unionByName(part))
    count = few.groupBy("id").agg(F.count("*").alias("n")).unionByName(many.groupBy("id").agg(F.sum("n").alias("n"))).groupBy("id").agg(F.sum("n").alias("n"))
    alone = cut(count.where(c("n") >= least).select("id"))
    # Links of core units: a dense cell by its smallest key, a core row of a sparse cell by its own.
    core_of = lambda k: alone.withColumnRenamed("id", k)
    edges = few.join(alone, "id").join(core_of("other"), "other").select(c("id").alias("src"), c("other").alias("dst")).union(many.join(alone, "id").select("id", "unit"))
    pairs = near.where((c("a_n") >= least) & (c("b_n") >= least) & (c("a_unit") < c("b_unit")))
    inside = _box_apart(c("a_low"), c("a_high"), c("b_low"), c("b_high"), False) <= reach
    edges = edges.union(pairs.where(inside).select("a_unit", "b_unit"))
    open_pairs = cut(pairs.where(~inside).select("a_cell", "a_unit", "a_mid", "a_low", "a_high", "b_cell", "b_unit", "b_mid", "b_low", "b_high"))
    point = own.join(dense.select("cell"), "cell").select("cell", "x")
    closest = lambda s, o: open_pairs.join(point.withColumnRenamed("cell", f"{s}_cell"), f"{s}_cell").groupBy("a_unit", "b_unit").agg(F.min_by("x", F.struct(_apart(c("x"), c(f"{o}_mid")), c("x"))).alias(f"{s}_x"))
    met = closest("a", "b").join(closest("b", "a"), ["a_unit", "b_unit"]).where(_apart(c("a_x"), c("b_x")) <= reach)
    edges = cut(edges.union(met.select("a_unit", "b_unit")))
    units = cut(dense.select(c("unit").alias("id")).union(alone))
    label = components(units, edges)
    left = open_pairs.join(label.select(c("id").alias("a_unit"), c("component").alias("a_part")), "a_unit").join(label.select(c("id").alias("b_unit"), c("component").alias("b_part")), "b_unit").where("a_part != b_part")
    left = cut(left)
    if not left.isEmpty():
        facing = lambda s, o, name: left.join(point.withColumnRenamed("cell", f"{s}_cell"), f"{s}_cell").where(_box_apart(c("x"), c("x"), c(f"{o}_low"), c(f"{o}_high"), True) <= reach).select("a_unit", "b_unit", c("x").alias(name)).distinct()
        touching = facing("a", "b", "x").join(facing("b", "a", "y"), ["a_unit", "b_unit"]).where(_apart(c("x"), c("y")) <= reach).select("a_unit", "b_unit").distinct()
        label = components(units, edges.union(touching))
    label = cut(label)
    core = own.join(dense, "cell").select("id", "unit").union(alone.select("id", c("id").alias("unit")))
    core_rows = core.join(label.select(c("id").alias("unit"), "component"), "unit").select("id", "component", F.lit(True).alias("is_core"))
    # A border row's smallest core neighbour.
    first = few.join(core_of("other"), "other").select("id", "other").union(many.select("id", "first")).join(alone, "id", "left_anti").groupBy("id").agg(F.min("other").alias("other"))
    border = first.join(core_rows.select(c("id").alias("other"), "component"), "other").select("id", "component", F.lit(False).alias("is_core"))
    numbers = ranked(label.select("component").distinct(), "component", name="number").select("component", (c("number") - 1).cast("int").alias("cluster"))
    found = core_rows.union(border).join(numbers, "component").select(c("id").alias(key), "cluster", "is_core")
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def lead_model(features: DataFrame, columns: Sequence[str] = LEAD_FEATURES, label: str = "is_lead", iterations: int = 400, depth: int = 6, step: float = 0.05, share: float = 0.8, seed: int = 42):
    """A fitted pipeline of gradient-boosted trees, or None if only one class is there."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    if features.select(label).distinct().count() < 2:
        return None
    trees = GBTClassifier(labelCol=label, featuresCol="_x", maxIter=iterations, maxDepth=depth, stepSize=step, subsamplingRate=share, featureSubsetStrategy=str(share), seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_x"), trees]).fit(features.fillna(0, list(columns)))


def predicted_leads(model, features: DataFrame, columns: Sequence[str] = LEAD_FEATURES, label: str = "is_lead") -> DataFrame:
    """features with lead_score, the model's probability; without a model, as only one class is there, that class is certain."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        return features.fillna(0, list(columns)).withColumn("lead_score", F.col(label).cast("double"))
    out = model.transform(features.fillna(0, list(columns)))
    return out.withColumn("lead_score", F.round(vector_to_array("probability")[1], 6)).drop("_x", "rawPrediction", "probability", "prediction")


def evaluated(rows: DataFrame, score: Column, label: Column, threshold: float = 0.5) -> DataFrame:
    """One row: precision, recall, F1 and the area under the ROC curve (ties count half), from counts of each distinct score."""
    own = rows.select(score.alias("s"), label.cast("int").alias("y")).where("s is not null and y is not null")
    by = own.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    wins = running_sum(by, "s", "n", "below").agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    hit = own.agg(F.count_if((F.col("s") >= threshold) & (F.col("y") == 1)).alias("tp"), F.count_if((F.col("s") >= threshold) & (F.col("y") == 0)).alias("fp"), F.count_if((F.col("s") < threshold) & (F.col("y") == 1)).alias("fn"))
    r = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return hit.join(wins).select(r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(2 * tp, 2 * tp + fp + fn).alias("f1"), r(F.col("wins"), F.col("pos") * F.col("neg")).alias("auc"))


def precision_at(rows: DataFrame, score: str, label: str, key: str, k: int) -> DataFrame:
    """The share of positives among the k best scores, ties by key."""
    return rows.orderBy(F.desc(score), key).limit(k).agg(F.round(F.avg(F.col(label).cast("int")), 6).alias("precision_at_k"))


def with_injected(rows: DataFrame, injected: DataFrame) -> DataFrame:
    """rows and made anomalies with is_injected 0 and 1; numbers that the made ones lack are 0."""
    both = rows.withColumn("is_injected", F.lit(0)).unionByName(injected.withColumn("is_injected", F.lit(1)), allowMissingColumns=True)
    return both.fillna(0)


def shifted(rows: DataFrame, features: Sequence[str], key: Sequence[str], distances: Sequence[int], share: int = 97) -> DataFrame:
    """rows with `distance` 0, and for each given distance a copy of about one row in `share`, by a hash of its key, moved by so many standard deviations in every feature, away from the mean."""
    stats = rows.agg(*(F.avg(c).alias(f"_m_{c}") for c in features), *(F.stddev_pop(c).alias(f"_s_{c}") for c in features))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(7), *key), F.lit(share)) == 0).join(F.broadcast(stats)).withColumn("distance", F.explode(F.array(*(F.lit(d) for d in distances))))
    away = {c: F.col(c) + F.when(F.col(c) >= F.col(f"_m_{c}"), F.col("distance")).otherwise(-F.col("distance")) * F.col(f"_s_{c}") for c in features}
    made = drawn.withColumns(away).select(*rows.columns, "distance")
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.col(c).cast("double") for c in features if kinds[c] != "double"}).withColumn("distance", F.lit(0)).unionByName(made)


def flagged_by_distance(scored: DataFrame) -> DataFrame:
    """(distance, rows, flagged, rate) of scored(distance, is_anomaly): at 0 the false-positive rate, beyond it how many made rows are found."""
    return scored.groupBy("distance").agg(F.count("*").alias("rows"), F.count_if("is_anomaly").alias("flagged")).withColumn("rate", F.round(F.col("flagged") / F.col("rows"), 6))


def injected_metrics(scored: DataFrame, order: Sequence[str], at: Sequence[int] = (50, 100, 500)) -> DataFrame:
    """One row for scored(anomaly_score, is_anomaly, is_injected): detection rate of made rows, rate of flagged real ones, and the share of made rows among the first k by score, ties by the given columns."""
    flagged, made = F.col("is_anomaly"), F.col("is_injected") == 1
    rates = scored.agg(F.round(F.try_divide(F.count_if(flagged & made), F.count_if(made)), 6).alias("detection_rate"), F.round(F.try_divide(F.count_if(flagged & ~made), F.count_if(~made)), 6).alias("false_positive_rate"))
    for k in at:
        first = scored.orderBy(F.desc("anomaly_score"), *order).limit(k)
        rates = rates.join(F.broadcast(first.agg(F.round(F.count_if(made) / k, 6).alias(f"precision_at_{k}"))))
    return rates
