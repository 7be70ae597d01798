"""Isolation forest (Liu, Ting and Zhou, 2008) and path-dependent attributions for it.

Trees see a few hundred rows each. Those rows are picked on the cluster, by hashes that do not
depend on partitioning, and only they come to the driver: at most trees * sample rows of
twelve numbers. The finished forest is broadcast, and every entity is scored in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..settings import DEFAULTS, FEATURES
from .scaling import min_max, moments


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Tree:
    """Arrays over nodes; feature -1 marks a leaf. ``depth`` is the expected depth below a leaf included."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    depth: np.ndarray

    def paths(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.nonzero(inner)[0]
            node = at[rows]
            below = x[rows, self.feature[node]] < self.cut[node]
            at[rows] = np.where(below, self.left[node], self.right[node])
        return self.depth[at]


def grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows), depth + average_path(len(rows))])
        spread = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        open_ = np.nonzero(spread > 0)[0]
        if depth < limit and len(open_):
            f = int(rng.choice(open_))
            low, high = x[rows, f].min(), x[rows, f].max()
            cut = low + (high - low) * (1 - rng.random())
            below = x[rows, f] < cut
            if below.all() or not below.any():
                return me
            nodes[me][:4] = [f, cut, 0, 0]
            nodes[me][2] = split(rows[below], depth + 1)
            nodes[me][3] = split(rows[~below], depth + 1)
        return me

    split(np.arange(len(x)), 0)
    t = np.array(nodes)
    return Tree(t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4], t[:, 5])


@dataclass
class Forest:
    trees: list[Tree]
    sample: int
    columns: list[str]
    scale: dict[str, tuple[float, float]]

    def _scaled(self, frame: pd.DataFrame) -> np.ndarray:
        return np.column_stack([(frame[c].to_numpy(float) - self.scale[c][0]) / self.scale[c][1] for c in self.columns])

    def anomaly(self, frame: pd.DataFrame) -> np.ndarray:
        """2^(-mean path / c(sample)): near 1 for rows that are easy to isolate."""
        if not self.trees:
            return np.zeros(len(frame))
        x = self._scaled(frame)
        mean = np.mean([t.paths(x) for t in self.trees], axis=0)
        return np.power(2.0, -mean / max(average_path(self.sample), 1e-9))

    def attributions(self, frame: pd.DataFrame) -> np.ndarray:
        """Path-dependent Shapley values of the mean depth per feature, negated: higher pushes towards anomalous.

        Along a path each split moves the expected depth from its node's to the child's;
        the exact values average that over feature orders. Rows add up to mean expected
        depth less own depth.
        """
        x = self._scaled(frame)
        out = np.zeros((len(x), len(self.columns)))
        for tree in self.trees:
            for r in range(len(x)):
                out[r] -= _tree_shap(tree, x[r])
        return out / max(1, len(self.trees))


def _tree_shap(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Exact path-dependent Shapley values of one tree (Lundberg and others, 2018)."""
    phi = np.zeros(len(x))

    def extend(path: list[list[float]], zero: float, one: float, feature: int) -> list[list[float]]:
        path = [p[:] for p in path] + [[feature, zero, one, 1.0 if not path else 0.0]]
        n = len(path) - 1
        for i in range(n - 1, -1, -1):
            path[i + 1][3] += one * path[i][3] * (i + 1) / (n + 1)
            path[i][3] = zero * path[i][3] * (n - i) / (n + 1)
        return path

    def unwound(path: list[list[float]], i: int) -> float:
        n, (_, zero, one, _), total = len(path) - 1, path[i], 0.0
        carry = path[n][3]
        for j in range(n - 1, -1, -1):
            if one:
                part = carry * (n + 1) / ((j + 1) * one)
                total += part
                carry = path[j][3] - part * zero * (n - j) / (n + 1)
            elif zero:
                total += path[j][3] * (n + 1) / (zero * (n - j))
        return total

    def unwind(path: list[list[float]], i: int) -> list[list[float]]:
        path = [p[:] for p in path]
        n, (_, zero, one, _) = len(path) - 1, path[i]
        carry = path[n][3]
        for j in range(n - 1, -1, -1):
            if one:
                old = path[j][3]
                path[j][3] = carry * (n + 1) / ((j + 1) * one)
                carry = old - path[j][3] * zero * (n - j) / (n + 1)
            else:
                path[j][3] = path[j][3] * (n + 1) / (zero * (n - j))
        for j in range(i, n):
            path[j][:3] = path[j + 1][:3]
        return path[:-1]

    def walk(node: int, path: list[list[float]], zero: float, one: float, feature: int) -> None:
        path = extend(path, zero, one, feature)
        if tree.feature[node] < 0:
            for i in range(1, len(path)):
                phi[int(path[i][0])] += unwound(path, i) * (path[i][2] - path[i][1]) * tree.depth[node]
            return
        f = int(tree.feature[node])
        hot, cold = (tree.left[node], tree.right[node]) if x[f] < tree.cut[node] else (tree.right[node], tree.left[node])
        zero_in, one_in = 1.0, 1.0
        seen = next((i for i in range(1, len(path)) if path[i][0] == f), None)
        if seen is not None:
            zero_in, one_in = path[seen][1], path[seen][2]
            path = unwind(path, seen)
        size = tree.size[node]
        walk(int(hot), path, zero_in * tree.size[hot] / size, one_in, f)
        walk(int(cold), path, zero_in * tree.size[cold] / size, 0.0, f)

    walk(0, [], 1.0, 1.0, -1)
    return phi


def fit(features: DataFrame, *, trees: int = DEFAULTS.forest_trees, sample: int = DEFAULTS.forest_sample, seed: int = DEFAULTS.seed, key: str = "entity_id") -> Forest:
    """A forest over standardised features."""
    columns = list(FEATURES)
    count = features.count()
    forest = Forest([], max(1, min(sample, count)), columns, moments(features, columns))
    if not count:
        return forest
    # Each tree takes the rows whose hashes, drawn anew for every tree, are smallest. Hashes below ``least`` hold about twice as many.
    least = min(2**63 - 1, int(2 * (sample + 32) / count * 2**64) - 2**63)
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, F.col(key)).alias("draw"))), lambda d: d["draw"] <= F.lit(least))
    chosen = features.select(*columns, F.col(key).alias("key"), F.explode(drawn).alias("d")).select(*columns, "key", "d.*").toPandas()  # trees * sample rows, about twice
    chosen = chosen.sort_values(["tree", "draw", "key"], kind="stable")
    for t, rows in chosen.groupby("tree", sort=True):
        own = rows.head(sample)
        forest.trees.append(grow(forest._scaled(own[columns]), np.random.default_rng([seed, t])))
    return forest


def scores(features: DataFrame, forest: Forest | None = None, **options) -> DataFrame:
    """(entity_id, isolation_forest_score), from 0 to 1 over all entities."""
    spark = features.sparkSession
    ship(spark)
    forest = forest or fit(features, **options)
    shared = spark.sparkContext.broadcast(forest)  # trees * 2 * sample nodes at most

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"entity_id": batch.entity_id, "raw": shared.value.anomaly(batch)})

    raw = features.select("entity_id", *FEATURES).mapInPandas(score, "entity_id string, raw double")
    return min_max(raw, "raw", "isolation_forest_score").select("entity_id", "isolation_forest_score")


def explain(features: DataFrame, ranked: DataFrame, forest: Forest, top_n: int = DEFAULTS.explained_top) -> DataFrame:
    """(entity_id, attributions map) of the ``top_n`` best ranked entities."""
    spark = features.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(forest)
    top = ranked.orderBy("rank").limit(top_n).select("entity_id")

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = shared.value.attributions(batch)
            yield pd.DataFrame({"entity_id": batch.entity_id, "attributions": [dict(zip(shared.value.columns, map(float, v), strict=True)) for v in values]})

    rows = features.join(top, "entity_id", "left_semi").select("entity_id", *FEATURES).repartition(8)
    return rows.mapInPandas(attribute, "entity_id string, attributions map<string,double>")
