"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are dealt into blocks. For each pair of blocks one task builds a cover
tree over either side and walks both together. A node covers its points within a radius
around its centre, which bounds every inner product between two nodes:

    q.d <= cq.cd + rq |cd| + rd |cq| + rq rd

A pair of nodes is left out if that bound is below the worst k-th score so far of the
query node's queries. Points that no other point shares a ball with stay in a bundle at
their parent, so that a flat data set is scored by matrix products rather than point by
point. Each pair of blocks yields k rows per query, and a last ranking merges them.

Components are taken as floor(scale * x) and scores are exact: products run in double
precision while they fit 53 bits, and as Python integers otherwise, where scores
that no long can hold are set to its limits.

Every row is a candidate of its own, and only a query's own row is left out of its
answers. Rows are told apart by a hash of id and vector and, where both repeat, by an
ordinal, so that reruns agree whatever ids repeat.

Defined cases: vectors that are null, or hold null or non-finite components, take no part,
nor do rows with a null id; rows that repeat an id are each candidate and query, with the others
of their id among their answers; shorter vectors count as filled up with zeros; ids may be
numbers, strings or dates, and ties go to the smaller id; empty tables give empty results; other columns
are passed by.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import repeated

DATA_BLOCK = 4096
QUERY_BLOCK = 1024
_LEAF = 48
_SHRINK = 0.6
_LONG = (-(2**63), 2**63 - 1)
#: What tells rows apart beside their id.
_ROW = ("k1", "k2", "ordinal")


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


class Node:
    """A ball with its points: ``children`` split them, or ``members`` lists them."""

    __slots__ = ("centre", "children", "members", "norm", "radius")

    def __init__(self, centre: np.ndarray, radius: float, members: np.ndarray, children: list[Node] | None = None):
        self.centre, self.radius, self.members, self.children = centre, radius, members, children or []
        self.norm = float(np.linalg.norm(centre))


def cover_tree(points: np.ndarray) -> Node:
    """A cover tree over the rows of ``points``, whose radii shrink by a fixed factor from level to level."""
    squares = np.einsum("ij,ij->i", points, points)

    def distances(to: int, among: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares[among] - 2 * (points[among] @ points[to]) + squares[to], 0))

    def build(centre: int, among: np.ndarray, away: np.ndarray) -> Node:
        radius = float(away.max(initial=0.0)) * (1 + 1e-12) + 1e-6
        if len(among) <= _LEAF or away.max() <= 1e-6:
            return Node(points[centre], radius, among)
        target = float(away.max()) * _SHRINK
        # Farthest-first centres until every point lies within the next level's radius.
        nearest, owner, centres = away.copy(), np.zeros(len(among), np.int64), [centre]
        while nearest.max() > target:
            new = int(among[nearest.argmax()])
            d = distances(new, among)
            closer = d < nearest
            nearest[closer], owner[closer] = d[closer], len(centres)
            centres.append(new)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        children, alone = [], []
        for i, c in enumerate(centres):
            own = order[cuts[i] : cuts[i + 1]]
            if len(own) == 1:
                alone.append(among[own[0]])
            else:
                children.append(build(c, among[own], nearest[own]))
        if not children:
            return Node(points[centre], radius, among)
        if alone:
            children.append(Node(points[centre], radius, np.sort(np.array(alone))))
        return Node(points[centre], radius, among, children)

    everything = np.arange(len(points))
    return build(0, everything, distances(0, everything))


class Search:
    """The k best of ``data`` for each of ``queries``; ids break ties and exclude a query's own row."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
        order = np.argsort(data_ids, kind="stable")  # so that stable sorts leave ties with the smaller id
        self.q, self.qi, self.d, self.di, self.k = queries, query_ids, data[order], data_ids[order], k
        self.pruned = self.scored = 0
        width = max(queries.shape[1], 1)
        top = max(np.abs(queries).max(initial=0), np.abs(data).max(initial=0))
        self.exact = top < math.sqrt(2**53 / width)
        self.best = np.full((len(queries), k), -np.inf) if self.exact else np.full((len(queries), k), None, object)
        self.ids = np.full((len(queries), k), -1, np.int64)
        self.kth = np.full(len(queries), -np.inf)
        self.fast = (self.q.astype(float), self.d.astype(float)) if self.exact else None

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.q) and len(self.d):
            if self.exact:
                self._pair(cover_tree(self.fast[0]), cover_tree(self.fast[1]))
            else:
                self._score(np.arange(len(self.q)), np.arange(len(self.d)))
        return self.best, self.ids

    @staticmethod
    def _bound(a: Node, b: Node) -> float:
        return float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius

    def _pair(self, a: Node, b: Node) -> None:
        bound = self._bound(a, b)
        if bound + abs(bound) * 1e-9 + 1e-6 < self.kth[a.members].min():
            self.pruned += len(a.members) * len(b.members)
        elif a.children and (a.radius >= b.radius or not b.children):
            for child in a.children:
                self._pair(child, b)
        elif b.children:
            for child in sorted(b.children, key=lambda c: -self._bound(a, c)):
                self._pair(a, child)
        else:
            self._score(a.members, b.members)

    def _score(self, qs: np.ndarray, ds: np.ndarray) -> None:
        self.scored += len(qs) * len(ds)
        ds = np.sort(ds)
        if self.exact:
            scores = self.fast[0][qs] @ self.fast[1][ds].T
            scores[self.qi[qs][:, None] == self.di[ds][None, :]] = -np.inf
            rows = np.nonzero((scores >= self.kth[qs][:, None]).any(axis=1))[0]
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                q = qs[part]
                values = np.concatenate([self.best[q], scores[part]], axis=1)
                ids = np.concatenate([self.ids[q], np.broadcast_to(self.di[ds], (len(q), len(ds)))], axis=1)
                by_id = np.argsort(ids, axis=1, kind="stable")
                values, ids = np.take_along_axis(values, by_id, 1), np.take_along_axis(ids, by_id, 1)
                top = np.argsort(-values, axis=1, kind="stable")[:, : self.k]
                self.best[q], self.ids[q] = np.take_along_axis(values, top, 1), np.take_along_axis(ids, top, 1)
                self.kth[q] = self.best[q][:, -1]
            return
        for q in qs:
            own = [int(x) for x in self.q[q]]
            scores = [(sum(x * int(y) for x, y in zip(own, self.d[d], strict=True)), int(self.di[d])) for d in ds if self.di[d] != self.qi[q]]
            found = sorted((-min(max(score, _LONG[0]), _LONG[1]), vec_id) for score, vec_id in scores)
            for i, (score, vec_id) in enumerate(found[: self.k]):
                self.best[q, i], self.ids[q, i] = -score, vec_id


def _whole(vectors: pd.Series, width: int, scale: float) -> np.ndarray:
    """floor(scale * x), as Python integers if any is beyond what a double holds exactly."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if np.abs(out).max(initial=0) * 2 < 2**53 / max(abs(scale), 1):
        return np.floor(out * scale)
    return np.array([[math.floor(Fraction(float(x)) * Fraction(scale)) for x in row] for row in out], dtype=object).reshape(out.shape)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, <id>, score): the k best rows for each row for which ``is_query`` holds.

    ``is_query`` is a condition on the id, in a column named ``id``.
    """
    ship(vectors.sparkSession)
    own = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    keyed = own.select("id", "v", F.xxhash64(F.lit(1), "id", "v").alias("k1"), F.xxhash64("v", "id", F.lit(2)).alias("k2"))
    equal = keyed.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("v").alias("v"), F.count("*").alias("n"))
    rows = repeated(equal, "n", "k1", "k2").drop("n")
    n, asked = rows.agg(F.count("*"), F.count_if(is_query)).first()
    d_blocks, q_blocks = max(1, math.ceil(n / data_block)), max(1, math.ceil(asked / query_block))
    spread = lambda salt, blocks: F.pmod(F.xxhash64(F.lit(salt), *_ROW), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asking = rows.where(is_query).select("id", *_ROW, "v", spread(1, q_blocks).alias("qb")).withColumn("db", every(d_blocks))
    data = rows.select("id", *_ROW, "v", spread(2, d_blocks).alias("db")).withColumn("qb", every(q_blocks))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        width = max([0, *left.v.map(len), *right.v.map(len)])
        q, d = _whole(left.v, width, scale), _whole(right.v, width, scale)
        # Places of both sides' rows in one order by id: equal places are the same row, and the smaller one wins ties.
        both = pd.concat([left[["id", *_ROW]], right[["id", *_ROW]]], ignore_index=True)
        order = both.drop_duplicates().sort_values(["id", *_ROW], ignore_index=True)
        place = both.merge(order.reset_index(names="place"), on=["id", *_ROW], how="left").place.to_numpy()
        best, found = Search(q, place[: len(left)], d, place[len(left) :], k).run()
        keep = found >= 0 if best.dtype == object else np.isfinite(best.astype(float))
        asked_by = left.iloc[np.nonzero(keep)[0]].reset_index(drop=True)
        to = order.iloc[found[keep]].reset_index(drop=True)
        sides = {f"query_{c}": asked_by[c] for c in ("id", *_ROW)} | {c: to[c] for c in ("id", *_ROW)}
        return pd.DataFrame({**sides, "score": [int(s) for s in best[keep]]})

    kind = own.schema["id"].dataType.simpleString()
    row = ", ".join(f"{c} long" for c in _ROW)
    asker = ", ".join(f"query_{c} long" for c in _ROW)
    shape = f"query_id {kind}, {asker}, id {kind}, {row}, score long"
    found = asking.groupBy("qb", "db").cogroup(data.groupBy("qb", "db")).applyInPandas(search, shape)
    place = F.row_number().over(Window.partitionBy("query_id", *[f"query_{c}" for c in _ROW]).orderBy(F.col("score").desc(), "id", *_ROW))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
