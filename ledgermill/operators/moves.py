"""The rounds and levels of the Louvain method over arrays, in one task or in blocks of nodes.

A graph of few edges is settled by one task. A larger one is dealt into blocks by its nodes' keys: a block holds
its nodes, their edges, and which other nodes it sees; what a round needs from other blocks (the communities of seen nodes and the weights of
communities) travels as packed arrays, one for each pair of blocks. So a round shuffles no row for an edge, and no task
holds more than a block. Both ways make the same moves.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Directed edges, repeated ones included, that one task settles at most, and that a block holds about.
FEW_EDGES, BLOCK_EDGES = 3_000_000, 1_000_000
#: Share of the gain of one pair of rounds above which the next pair counts as no progress.
STALLED = 0.9
#: A message: from one block to another, packed arrays of a kind, and two sums for the driver.
MESSAGE = "dest int, src int, kind string, data binary, x double, y double"
_SCHEMA = pa.schema([("dest", pa.int32()), ("src", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("x", pa.float64()), ("y", pa.float64())])
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
Message = tuple[int, int, str, tuple, float, float]


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def turns(keys: np.ndarray, seed: int, r: int) -> np.ndarray:
    """Whose turn it is in round ``r``: half of the keys in even rounds and the others in the next, by Spark's xxhash64(seed + r / 2, key)."""
    first = np.array([seed + r // 2], np.uint64)
    start = _mixed(_rotated((np.array([42], np.uint64) + _P5 + np.uint64(4)) ^ (first * _P1), 23) * _P2 + _P3)
    h = (start + _P5 + np.uint64(8)) ^ (_rotated(keys.view(np.uint64) * _P2, 31) * _P1)
    return (_mixed(_rotated(h, 27) * _P1 + _P4) & np.uint64(1)) == r % 2


def _firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in columns that are sorted together."""
    n = len(sorted_columns[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns]) if n else False
    return np.flatnonzero(new)


def summed(a: np.ndarray, b: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (a, b) in order without repeats, with their summed weights, or 1 if there are none."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = _firsts(a, b)
    return a[at], b[at], np.add.reduceat(w[order], at) if w is not None and len(at) else np.ones(len(at))


def judged(turn: np.ndarray, k: np.ndarray, c: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, seen_c: np.ndarray, seen_s: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """(communities after the nodes on ``turn`` have moved, their summed gain).

    Nodes have weight k, community c and its weight s; an edge leads from node a to the b-th of those that are seen, with their communities and the weights of these.
    """
    me, mine = np.flatnonzero(turn), turn[a]
    b = b[mine]
    # The own community is an option of every node, if need be with no weight towards it.
    who, to, weight, towards = np.concatenate([a[mine], me]), np.concatenate([seen_c[b], c[me]]), np.concatenate([seen_s[b], s[me]]), np.concatenate([w[mine], np.zeros(len(me))])
    if not len(me):
        return c, 0.0
    order = np.lexsort((to, who))
    who, to = who[order], to[order]
    at = _firsts(who, to)
    in_w, who, to, weight = np.add.reduceat(towards[order], at), who[at], to[at], weight[order[at]]
    own = to == c[who]
    # Gain of joining, with the node itself taken out of its own community first.
    gain = np.round(in_w - k[who] * (weight - own * k[who]) / (2 * total), 9)
    node = _firsts(who)
    most = np.maximum.reduceat(gain, node)
    best = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(node, len(who)))))
    best = best[_firsts(who[best])]  # on ties the smallest; a tie with the own community is no gain
    more = most - gain[own]
    moves = more > 1e-9
    out = c.copy()
    out[me[moves]] = to[best][moves]
    return out, float(more[moves].sum())


def _ended(gains: list[float], least_gain: float) -> bool:
    pair, before = sum(gains[-2:]), sum(gains[-4:-2])
    return len(gains) % 2 == 0 and (pair <= least_gain or len(gains) > 2 and pair > STALLED * before)


def settled(ids: np.ndarray, k: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, best: float, seed: int, least_gain: float) -> np.ndarray:
    """The community, by key, of each node of a graph with sorted keys ``ids``, over all levels; edges in both directions by place in ``ids``."""
    top = np.arange(len(ids))
    while True:
        c = np.arange(len(ids))
        gains: list[float] = []
        while not gains or not _ended(gains, least_gain):
            s = np.bincount(c, k, len(ids))
            c, gain = judged(turns(ids, seed, len(gains)), k, c, s[c], a, b, w, c, s[c], total)
            gains.append(gain / total)
        kept, place = np.unique(c, return_inverse=True)
        weights, ca, cb = np.bincount(place, k), place[a], place[b]
        cut = ca != cb
        a, b, w = summed(ca[cut], cb[cut], w[cut])
        q = 1 - w.sum() / 2 / total - ((weights / (2 * total)) ** 2).sum()
        if q <= best + least_gain:
            break
        best, ids, k, top = q, ids[kept], weights, place[top]
        if not len(a):
            break
    return ids[top]


def _pack(rows: Iterator[Message]) -> pa.Table:
    columns = list(zip(*((d, s, kind, pickle.dumps(data, 5), x, y) for d, s, kind, data, x, y in rows), strict=True)) or [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _unpack(table: pa.Table | pa.RecordBatch) -> dict[str, list[tuple[int, tuple]]]:
    """kind -> (src, arrays) in the order of src."""
    found: dict[str, list[tuple[int, tuple]]] = {}
    for src, kind, data in zip(table["src"].to_pylist(), table["kind"].to_pylist(), table["data"], strict=True):
        found.setdefault(kind, []).append((src, pickle.loads(data.as_buffer())))
    return {kind: sorted(rows, key=lambda row: row[0]) for kind, rows in found.items()}


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0, as all weights are, in their smallest type."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x


def _joined(rows: list[tuple], types: str) -> list[np.ndarray]:
    return [np.concatenate([np.empty(0, t), *(row[i] for row in rows)]) for i, t in enumerate(types)]


def _split(blocks: int, keys: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(block, keys, arrays...) for each block that owns some of the keys; the order within a block stays."""
    owner = keys % blocks
    order = np.argsort(owner.astype(np.uint16) if blocks < 1 << 16 else owner, kind="stable")
    at = _firsts(owner[order])
    for rows in np.split(order, at[1:]) if len(order) else ():
        yield (int(owner[rows[0]]), keys[rows], *(x[rows] for x in arrays))


def _dealt(blocks: int) -> Callable:
    """Edges between keys, as rows, to packed edges in both directions, each at the block of its first node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flushed() -> list[pa.RecordBatch]:
            a, b = _joined(held, "qq")
            held.clear()
            return _pack((p, -1, "edges", (x, y, None), 0.0, 0.0) for p, x, y in _split(blocks, np.concatenate([a, b]), np.concatenate([b, a]))).to_batches()

        for batch in batches:
            held.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
            if sum(len(a) for a, _ in held) >= BLOCK_EDGES // 2:
                yield from flushed()
        yield from flushed()

    return run


def _gathered(found: dict) -> tuple:
    """(ids, k, a, b, w): nodes and edges from packed edges, and from packed weights of nodes unless nodes weigh as much as their edges."""
    parts = [row for _, row in found.get("edges", [])]
    whole = [row for _, row in found.get("weights", [])]
    a, b = _joined([row[:2] for row in parts], "qq")
    a, b, w = summed(a, b, np.concatenate([row[2] for row in parts]) if parts and parts[0][2] is not None else None)
    keys, weights = _joined(whole, "qd") if whole else (a, w)
    ids, place = np.unique(keys, return_inverse=True)
    return ids, np.bincount(place, weights, len(ids)), np.searchsorted(ids, a).astype(np.int32), b, w


def _grouped(messages: DataFrame, blocks: int, run: Callable[[int, dict], Iterator[Message]]) -> DataFrame:
    """``run`` for each block over the messages to it."""

    def one(key: tuple, table: pa.Table) -> pa.Table:
        return _pack(run(key[0].as_py(), _unpack(table)))

    return messages.repartitionById(blocks, "dest").groupBy("dest").applyInArrow(one, MESSAGE)


def _state(blocks: int, me: int, ids: np.ndarray, k: np.ndarray, c: np.ndarray, gain: float) -> Iterator[Message]:
    """A block's nodes with their communities, and what its nodes add to the weight of each."""
    yield me, me, "state", (ids, c), gain, 0.0
    u, place = np.unique(c, return_inverse=True)
    for p, keys, sums in _split(blocks, u, np.bincount(place, k, len(u))):
        yield p, me, "sums", (keys, sums), 0.0, 0.0


def _built(packed: DataFrame, blocks: int) -> DataFrame:
    """Blocks with their first state; x is the weight of a block's edges."""

    def gather(me: int, found: dict) -> Iterator[Message]:
        ids, k, a, b, w = _gathered(found)
        seen = list(_split(blocks, np.unique(b)))
        keys = np.concatenate([np.empty(0, np.int64), *(s[1] for s in seen)])
        order = np.argsort(keys)
        yield me, me, "graph", (ids, k, a, order[np.searchsorted(keys, b, sorter=order)].astype(np.int32), w), 0.0, 0.0
        for p, asked in seen:
            yield p, me, "asks", (asked,), 0.0, 0.0

    def link(me: int, found: dict) -> Iterator[Message]:
        ids, k, a, b, w = found["graph"][0][1]
        yield me, me, "links", (np.bincount(a, minlength=len(ids)).astype(np.int32), b, _small(w)), 0.0, 0.0
        yield me, me, "nodes", (ids, _small(k)), float(w.sum()), 0.0
        yield me, me, "sends", tuple((p, np.searchsorted(ids, asked).astype(np.int32)) for p, (asked,) in found.get("asks", [])), 0.0, 0.0
        yield from _state(blocks, me, ids, k, ids, 0.0)

    return materialize(_grouped(_grouped(packed, blocks, gather), blocks, link))


def _exchanged(state: DataFrame, graph: DataFrame, blocks: int) -> DataFrame:
    """What a block needs for a round: its graph, its own communities with their weights, and those of all nodes it sees."""

    def weigh(me: int, found: dict) -> Iterator[Message]:
        rows = found["sums"]
        keys, sums = _joined([row for _, row in rows], "qd")
        _, place = np.unique(keys, return_inverse=True)
        whole = np.bincount(place, sums)[place]
        for (src, _), part in zip(rows, np.split(whole, np.cumsum([len(row[0]) for _, row in rows])[:-1]), strict=True):
            yield src, me, "totals", (part,), 0.0, 0.0

    def tell(me: int, found: dict) -> Iterator[Message]:
        _, c = found["state"][0][1]
        u, place = np.unique(c, return_inverse=True)
        s = np.empty(len(u))
        s[np.argsort(u % blocks, kind="stable")] = np.concatenate([t for _, (t,) in found["totals"]])
        s = _small(s)[place]
        yield me, me, "own", (c, s), 0.0, 0.0
        for p, rows in found["sends"][0][1]:
            yield p, me, "seen", (c[rows], s[rows]), 0.0, 0.0

    totals = _grouped(state.where("kind = 'sums'"), blocks, weigh)
    told = _grouped(totals.unionByName(state.where("kind = 'state'")).unionByName(graph.where("kind = 'sends'")), blocks, tell)
    return told.unionByName(graph.where("kind in ('nodes', 'links')"))


def _known(found: dict) -> tuple:
    """(ids, k, c, s, a, b, w, seen c, seen s) of a block after an exchange."""
    (ids, k), (degrees, b, w), (c, s) = found["nodes"][0][1], found["links"][0][1], found["own"][0][1]
    return ids, k.astype(float), c, s.astype(float), np.repeat(np.arange(len(ids), dtype=np.int32), degrees), b, w, *_joined([row for _, row in found.get("seen", [])], "qd")


def _moved(state: DataFrame, graph: DataFrame, blocks: int, seed: int, r: int, total: float) -> DataFrame:
    """The state after round ``r``; x is the gain of a block."""

    def move(me: int, found: dict) -> Iterator[Message]:
        ids, k, c, *rest = _known(found)
        c, gain = judged(turns(ids, seed, r), k, c, *rest, total)
        yield from _state(blocks, me, ids, k, c, gain)

    return materialize(_grouped(_exchanged(state, graph, blocks), blocks, move))


def _contracted(state: DataFrame, graph: DataFrame, blocks: int) -> DataFrame:
    """Packed edges between communities, x their number and y their weight, and weights of communities, y summing their squares."""

    def contract(me: int, found: dict) -> Iterator[Message]:
        _, k, c, weights, a, b, w, seen, _ = _known(found)
        ca, cb, w = c[a], seen[b], w.astype(float)
        cut = ca != cb
        for p, x, y, v in _split(blocks, *summed(ca[cut], cb[cut], w[cut])):
            yield p, me, "edges", (x, y, v), float(len(x)), float(v.sum())
        u, at, place = np.unique(c, return_index=True, return_inverse=True)
        for p, keys, sums, whole in _split(blocks, u, np.bincount(place, k, len(u)), weights[at]):
            yield p, me, "weights", (keys, sums), 0.0, float((sums * whole).sum())

    return materialize(_grouped(_exchanged(state, graph, blocks), blocks, contract))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, c) from states."""
    for batch in batches:
        for _, (ids, c) in _unpack(batch)["state"]:
            yield from pa.table({"id": ids, "c": c}).to_batches(max_chunksize=100_000)


def _by_one(packed: DataFrame, total: float | None, best: float, seed: int, least_gain: float) -> DataFrame:
    """(id, c) over all levels from here on, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, k, a, b, w = _gathered(_unpack(pa.Table.from_batches(list(batches))))
        c = settled(ids, k, a, np.searchsorted(ids, b), w, total or w.sum() / 2, best, seed, least_gain)
        yield from pa.table({"id": ids, "c": c}).to_batches(max_chunksize=100_000)

    return materialize(packed.select("src", "kind", "data").repartition(1).mapInArrow(run, "id long, c long"))


def levels(edges: DataFrame, *, seed: int, least_gain: float) -> list[DataFrame]:
    """edges(a, b), undirected between keys that are hashes -> a table (id, c) for each level; c are the nodes of the next. Repeats have no effect."""
    size, out, total, best = 2 * edges.count(), [], None, -1.0
    blocks = max(1, math.ceil(size / BLOCK_EDGES))
    packed = edges.select("a", "b").mapInArrow(_dealt(blocks), MESSAGE)
    while size > FEW_EDGES:
        graph = _built(packed, blocks)
        total = total or graph.where("kind = 'nodes'").agg(F.sum("x")).first()[0] / 2
        state, gains = graph, []
        while not gains or not _ended(gains, least_gain):
            state = _moved(state, graph, blocks, seed, len(gains), total)
            gains.append(state.agg(F.sum("x")).first()[0] / total)
        packed = _contracted(state, graph, blocks)
        of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0.0))
        size, cut, squares = packed.agg(of("edges", "x"), of("edges", "y"), of("weights", "y")).first()
        q = 1 - cut / 2 / total - squares / (2 * total) ** 2
        if q <= best + least_gain:
            return out
        best = q
        out.append(state.where("kind = 'state'").select("src", "kind", "data").mapInArrow(_pairs, "id long, c long"))
        if not size:
            return out
    return [*out, _by_one(packed, total, best, seed, least_gain)]
