"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample (Gong and Lazebnik) turns each vector into a
balanced binary code whose Hamming distance follows the angle. Codes are cut into
segments with one table each; a vector is filed under its segment's value and under every
value one bit away, so that two vectors meet wherever a segment differs in two bits or
fewer. With three segments no pair within 8 bits is missed. Candidates are
ranked again by the cosine of the original vectors, and only those at the threshold
link.

A pair may meet many times over. It counts only at its canonical meeting point: the first
segment that brings it together, and there the smallest value between the two. So
counts of links need no pass that removes repeats.

Equal vectors are one entry with a count: they take part once, and each of them has the
links of all. Vectors are scaled to length one once, before any pair is looked at.

Where a table bucket holds few vectors, candidate pairs are joined and looked up. Where it
holds many, its members meet in square blocks of bounded size: a task compares two parts of
the bucket by matrix product and gives back only each vector's number of links and the
smallest vector it is tied to. Both ways take the same candidates, those within ``RADIUS`` bits, and
the same cosine, a sum from the first component to the last, so that links do not depend
on how full a bucket is. No group of copies is ever written out as pairs.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components
link with nothing and are kept; rows that repeat an id count once, with the smallest usable
vector; rows with a null id take no part and are kept, in one row; vectors of other lengths
than the most common one in the sample link by cosine only with equal lengths, filled up or cut
for their codes; empty tables give empty results; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import ship
from .common import broadcast_if_small, checkpoint, join_hot, materialize
from .topk import usable

SAMPLE = 8192
BITS = 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members up to which a bucket's candidates are joined as pairs.
COLD_BUCKET = 32
#: Members of one part of a large bucket.
PART = 512
#: Radius of the search in bits of the whole code; codes at cosine 0.95 differ in about 6.5 bits of 64.
RADIUS = 20
#: Products of matrices sum in another order; cosines this near the threshold are summed again.
_NEAR = 1e-9


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) such that the signs of (x - mean) @ projection are the code of x."""
    width = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(width)
    centred = sample - mean
    # Principal axes from the covariance, which is as small as the vectors are short.
    axes = np.linalg.eigh(centred.T @ centred)[1].T[::-1]
    rng = np.random.default_rng(seed)
    main = axes[: min(bits, width)].T
    if bits > width:  # more bits than dimensions: random directions fill up
        main = np.hstack([main, rng.standard_normal((width, bits - width)) / np.sqrt(width)])
    v = centred @ main
    rotation, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(rounds if len(sample) else 0):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return mean, main @ rotation


def encode(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64-bit codes as signed integers."""
    signs = (vectors - mean) @ projection >= 0
    return np.packbits(signs, axis=1, bitorder="little").view("<i8").ravel()


def _segment(code: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1))


def _filed_under(points: Column, seg: int) -> Column:
    return F.transform(points, lambda p: F.struct(F.lit(seg).alias("seg"), p.alias("point")))


def _meeting_point(a: Column, b: Column) -> Column:
    """The smallest value within one bit of both segment values, which differ in two bits at most."""
    diff, both = a.bitwiseXOR(b), a.bitwiseAND(b)
    lowest = both.bitwiseOR(diff.bitwiseAND(-diff))
    two = F.when(F.bit_count(a.bitwiseAND(diff)) == 1, both).otherwise(lowest)
    return F.when(F.bit_count(diff) < 2, F.least(a, b)).otherwise(two)


def _canonical_here(a: str, b: str) -> Column:
    """Whether columns seg and point are where codes ``a`` and ``b`` count as met."""
    here, earlier = F.lit(False), F.lit(True)
    for s, (at, width) in enumerate(SEGMENTS):
        x, y = _segment(F.col(a), at, width), _segment(F.col(b), at, width)
        here = here | ((F.col("seg") == s) & earlier & (F.col("point") == _meeting_point(x, y)))
        earlier = earlier & (F.bit_count(x.bitwiseXOR(y)) > 2)
    return here


def _met_here(a: np.ndarray, b: np.ndarray, seg: int, point: int) -> np.ndarray:
    """The same for all pairs of two arrays of codes, as a matrix."""
    a, b = a.view(np.uint64)[:, None], b.view(np.uint64)[None, :]
    met = np.ones((a.shape[0], b.shape[1]), bool)
    for s, (at, width) in enumerate(SEGMENTS[: seg + 1]):
        mask = np.uint64((1 << width) - 1)
        x, y = (a >> np.uint64(at)) & mask, (b >> np.uint64(at)) & mask
        diff = x ^ y
        n = np.bitwise_count(diff)
        if s < seg:
            met &= n > 2
            continue
        both = x & y
        two = np.where(np.bitwise_count(x & diff) == 1, both, both | (diff & (~diff + np.uint64(1))))
        met &= (n <= 2) & (np.where(n < 2, np.minimum(x, y), two) == np.uint64(point))
    return met


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows filled up with zeros to equal length, and their lengths."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    out = np.zeros((len(lengths), lengths.max(initial=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out, lengths


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    top = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows of length one, summed from the first component to the last."""
    return np.cumsum(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _close(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine at the threshold, as a matrix."""
    product = x @ y.T
    close = product >= threshold
    i, j = np.nonzero(np.abs(product - threshold) <= _NEAR)
    close[i, j] = _cosines(x[i], y[j]) >= threshold
    return close


def _block(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one pair of parts of a bucket: per vector their number, and the smallest vector it is tied to here."""
    seg, point, i, j = (int(block[c].iloc[0]) for c in ("seg", "point", "i", "j"))
    block = block.sort_values("id", kind="stable")
    rows, (x, lengths) = block.part.to_numpy(), _matrix(block.unit)
    ids, codes, times = block.id.to_numpy(), block.code.to_numpy(), block.times.to_numpy()
    left, right = np.nonzero(rows == i)[0], np.nonzero(rows == j)[0]
    near = np.bitwise_count(codes[left][:, None] ^ codes[right][None, :]) <= RADIUS
    near &= _met_here(codes[left], codes[right], seg, point) & (lengths[left][:, None] == lengths[right][None, :]) & (ids[left][:, None] != ids[right][None, :])
    linked = near & _close(x[left], x[right], threshold)
    counts = np.zeros(len(ids), np.int64)
    counts[left] += linked @ times[right]
    if i != j:
        counts[right] += times[left] @ linked
    label = np.arange(len(ids))  # rows are in order of id
    while True:
        old = label.copy()
        big = len(ids)
        label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], big).min(axis=1, initial=big))
        label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], big).min(axis=0, initial=big))
        if (label == old).all():
            break
    some = counts > 0
    return pd.DataFrame({"id": ids[some], "n": counts[some], "least": ids[label[some]]})


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, cold_bucket: int = COLD_BUCKET, part: int = PART) -> DataFrame:
    """One row per id: n_links, component_id (smallest id reachable), kept (whether that is its own).

    ``sample`` bounds the vectors that the rotation is learned on; all are coded and filed.
    """
    ship(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    good = usable(F.col(vector_col)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("v"))
    rows = materialize(rows.groupBy("id").agg(F.min("v").alias("v")))  # nulls give way to a usable vector
    linkable = rows.where("id is not null and v is not null")
    seen = linkable.orderBy(F.xxhash64(F.lit(9), F.col("id")), "id").limit(sample).select("v").toPandas().v
    width = int(seen.map(len).mode().iloc[0]) if len(seen) else 1

    def fit(batch: pd.Series) -> np.ndarray:
        out = np.zeros((len(batch), width))
        for i, x in enumerate(batch):
            out[i, : min(len(x), width)] = x[:width]
        return _unit(out)

    mean, projection = learn_rotation(fit(seen))

    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, lengths = _matrix(batch)
            units = [list(row[:n]) for row, n in zip(_unit(x), lengths, strict=True)]
            yield pd.DataFrame({"code": encode(fit(batch), mean, projection) if len(batch) else [], "unit": units})

    distinct = materialize(linkable.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("times")))
    coded = distinct.select("id", "times", F.pandas_udf(code, "code long, unit array<double>")("v").alias("c"))
    coded = materialize(coded.select("id", "times", "c.code", "c.unit"))
    units = coded.select("id", "times", "unit")
    filings = []
    for s, (at, w) in enumerate(SEGMENTS):
        own = _segment(F.col("code"), at, w)
        points = F.concat(F.array(own), F.array(*[own.bitwiseXOR(F.lit(1 << b)) for b in range(w)]))
        filings.append(_filed_under(points, s))
    filed = coded.select("id", "code", F.explode(F.concat(*filings)).alias("f")).select("id", "code", "f.*")
    sizes = filed.groupBy("seg", "point").agg(F.count("*").alias("n"))
    crowded = broadcast_if_small(sizes.where(F.col("n") > cold_bucket))

    cold = filed.join(crowded, ["seg", "point"], "left_anti")
    other = cold.select("seg", "point", F.col("id").alias("id2"), F.col("code").alias("code2"))
    within = F.bit_count(F.col("code").bitwiseXOR(F.col("code2"))) <= RADIUS
    pairs = cold.join(other, ["seg", "point"]).where((F.col("id") < F.col("id2")) & within & _canonical_here("code", "code2")).select("id", "id2")
    both = pairs.join(units, "id").join(units.select(F.col("id").alias("id2"), F.col("times").alias("times2"), F.col("unit").alias("unit2")), "id2")

    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            (x, n), (y, m) = _matrix(a), _matrix(b)
            most = max(x.shape[1], y.shape[1])
            x, y = (np.pad(z, ((0, 0), (0, most - z.shape[1]))) for z in (x, y))
            yield pd.Series((n == m) & (_cosines(x, y) >= threshold))

    close = checkpoint(both.where(F.pandas_udf(linked, "boolean")("unit", "unit2")).select("id", "times", "id2", "times2"))

    parts = F.ceil(F.col("n") / part).cast("int")
    hot = filed.join(crowded, ["seg", "point"]).withColumn("p", parts).withColumn("part", F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.col("p")).cast("int"))
    hot = hot.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("p") - 1))).withColumn("i", F.least("part", "with")).withColumn("j", F.greatest("part", "with"))
    hot = hot.join(units, "id").select("seg", "point", "i", "j", "part", "id", "times", "code", "unit")
    tied = hot.groupBy("seg", "point", "i", "j").applyInPandas(lambda b: _block(b, threshold), "id long, n long, least long")
    tied = checkpoint(tied.groupBy("id", "least").agg(F.sum("n").alias("n")))

    ends = F.array(F.struct("id", F.col("times2").alias("n")), F.struct(F.col("id2").alias("id"), F.col("times").alias("n")))
    each = close.select(F.explode(ends).alias("e")).select("e.id", "e.n")
    links = each.unionByName(tied.select("id", "n")).groupBy("id").agg(F.sum("n").alias("others")).withColumnRenamed("id", "k")
    edges = close.select(F.col("id").alias("a"), F.col("id2").alias("b")).unionByName(tied.select(F.col("id").alias("a"), F.col("least").alias("b")))
    components = connected_components(edges).withColumnRenamed("id", "c")
    found = distinct.join(links, F.col("id") == F.col("k"), "left").join(components, F.col("id") == F.col("c"), "left")
    n_links = F.col("times") - 1 + F.coalesce("others", F.lit(0))
    found = materialize(found.select("v", "times", n_links.alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    alone = rows.where("id is null or v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = join_hot(linkable, found, ["v"]).select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
