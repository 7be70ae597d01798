"""Exact substring deduplication with suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere
else. Texts are anchored by content: of the ``anchor`` byte strings within a window of
``length`` bytes, the one with the smallest hash is the window's anchor. Equal windows
have equal anchors, so that only windows with a common anchor need comparing. Texts with very many
copies go as a whole; one copy of each stays as a partner for others. Runs of
windows with the same anchor form a segment; segments go through three steps.

1. Segments are counted by anchor and content, as hashes. Most anchors occur once and
   end here. Where a whole segment recurs, all its windows are repeats.
2. Of anchors with several contents, one copy of each content is cut from its text.
3. Segments with the same anchor are cut down to what agrees with another one on both sides of
   the anchor, and joined into one string, in which the bytes that all windows hold are one letter.
   Its suffix array, built by linear grouping, brings equal windows next to each other, and
   neighbours that share ``length`` bytes are marked. Contents that recur as a whole need no marks of
   their own but take part as partners.

An anchor with very many contents (one boilerplate passage with thousands of endings) is split
by content before it reaches a task: windows that lie in the same narrow range around the
anchor share a longer core, which takes the anchor's place. A task that still meets a large
group narrows the range further, down to single windows. So no task holds more of a group than it
has distinct neighbourhoods, and nothing is dropped.

Hashes only select what is compared, but for whole texts and whole segments: the equality of texts
rests on 128 bits, that of segments on 64 bits within the same 64-bit anchor. Texts, anchors and
contents that very many rows share are joined where those rows are.

Defined cases: a null text counts as empty; texts shorter than ``length`` have nothing
to remove; matches do not cross texts but may overlap, also within one text; repeated rows, even
with one id, are texts that repeat each other; an empty table gives an empty result; other columns
are passed by.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import HOT_KEY, broadcast_if_small, checkpoint, join_hot, materialize
from .gsaca import suffix_array

LENGTH = 400
ANCHOR = 128
#: Contents of one anchor beyond which it is split by longer cores, and the parts that its windows fall into.
CROWDED = 256
PARTS = 8
#: Bytes of one group beyond which a task narrows the range further.
LARGE = 300_000
#: Bytes of segments that one task of suffix sorting is meant to get.
TASK_BYTES = 1_000_000

_LETTERS = np.random.default_rng(20_011).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def segments(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, offset of the anchor from the start, anchor hash) of each segment of ``data``."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    with np.errstate(over="ignore"):
        x, power, m = _LETTERS[np.frombuffer(data, np.uint8)], _BASE, 1
        while m < anchor:  # hashes of 2m bytes from two of m
            x = x[:-m] * np.uint64(power) + x[m:]
            power, m = power * power % 2**64, m * 2
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    width = length - anchor + 1
    least, m = x, 1
    while m * 2 <= width:
        least, m = np.minimum(least[:-m], least[m:]), m * 2
    if width > m:
        least = np.minimum(least[: m - width], least[width - m :])
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(np.concatenate([start, [len(least)]]))
    # A window's anchor is the first place in it that has the least hash. In repetitive text a run of
    # windows with one hash has several such places, and is a segment for each.
    first, number, offset, hashes = [], [], [], least[start]
    owner = []
    for k, (p, n) in enumerate(zip(start.tolist(), count.tolist(), strict=True)):
        end = p + n
        for place in np.flatnonzero(x[p : end - 1 + width] == hashes[k]).tolist():
            if p >= end:
                break
            place += int(start[k])
            number.append(min(place + 1, end) - p)
            first.append(p)
            offset.append(place - p)
            owner.append(k)
            p = place + 1
    return np.array(first), np.array(number), np.array(offset), hashes[owner].view(np.int64)


def repeated_windows(parts: list[bytes], length: int, cores: list[tuple[int, int]] | None = None) -> list[list[int]]:
    """For each part the starts of its windows of ``length`` bytes that occur at another place, by suffix array.

    ``cores``: for each part a range of bytes that all its windows hold, at the same place relative to the
    anchor in all parts. It is sorted as one letter, which stands for these bytes and no others.
    """
    # A separator ends each part; all are the same letter, and windows with one in them are not compared.
    text, owner, first = [], [], []
    names: dict[bytes, int] = {}
    for k, part in enumerate(parts):
        first.append(len(text))
        if cores is None:
            text += part
        else:
            a, b = cores[k]
            text += part[:a]
            text.append(257 + names.setdefault(part[a:b], len(names)))
            text += part[b:]
        text.append(256)
        owner += [k] * (len(text) - first[k])
    last = [len(part) - length for part in parts]
    marked: list[set[int]] = [set() for _ in parts]
    before, at, window = -1, 0, b""
    for i in suffix_array(text):
        k = owner[i]
        start = i - first[k]  # no window starts behind a core, so that places up to there are those of the part
        if start > last[k]:
            before = -1  # its window holds a separator: it ends a run of equal windows
            continue
        own = parts[k][start : start + length]
        if before >= 0 and own == window:
            marked[before].add(at)
            marked[k].add(start)
        before, at, window = k, start, own
    return [sorted(m) for m in marked]


def _agreement(strings: list[bytes]) -> list[int]:
    """For each string the bytes of its longest common prefix with any other one; those next in order have it."""
    most = [0] * len(strings)
    order = sorted(range(len(strings)), key=strings.__getitem__)
    for a, b in zip(order, order[1:], strict=False):
        n = min(len(strings[a]), len(strings[b]))
        apart = int.from_bytes(strings[a][:n], "big") ^ int.from_bytes(strings[b][:n], "big")
        same = n - (apart.bit_length() + 7) // 8
        most[a], most[b] = max(most[a], same), max(most[b], same)
    return most


def _matching(rows: list[tuple[bytes, int, int]], length: int) -> list[list[int]]:
    """Starts of repeated windows as ``_narrow`` gives them, which sees only what may recur of each content.

    A window that recurs agrees with that of another content before and behind the anchor. So bytes that
    lie further from the anchor than a content agrees with any other one are cut off first.
    """
    left = _agreement([content[:offset][::-1] for content, offset, _ in rows])
    right = _agreement([content[offset:] for content, offset, _ in rows])
    alive = [k for k in range(len(rows)) if left[k] + right[k] >= length]
    cut = [(rows[k][0][rows[k][1] - left[k] : rows[k][1] + right[k]], left[k], left[k] + right[k] - length + 1) for k in alive]
    out: list[list[int]] = [[] for _ in rows]
    for k, starts in zip(alive, _narrow(cut, length, length), strict=True):
        out[k] = [rows[k][1] - left[k] + s for s in starts]
    return out


def _narrow(rows: list[tuple[bytes, int, int]], length: int, span: int) -> list[list[int]]:
    """rows: (content, offset of the anchor, windows). Starts of repeated windows, as ``repeated_windows`` gives them.

    A large group is split: windows that begin from ``span`` places relative to the anchor, and
    agree in the bytes that all of these share, form a group of their own.
    """
    if len(rows) < 2:
        # A window may recur within one content too, but never at another place of the anchor: not here.
        return [[] for _ in rows]
    if sum(len(r[0]) for r in rows) <= LARGE or span <= 1:
        # All windows hold the bytes from where the last one starts to where the first one ends, seen from the anchor.
        low, high = max(n - 1 - offset for _, offset, n in rows), length - max(offset for _, offset, _ in rows)
        return repeated_windows([r[0] for r in rows], length, [(offset + low, offset + high) for _, offset, _ in rows])
    out: list[list[int]] = [[] for _ in rows]
    step = max(1, span // 4)
    groups: dict[tuple, dict[bytes, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for k, (content, offset, windows) in enumerate(rows):
        for slot in range(offset // step - (offset - windows + 1) // step + 1):
            low = offset // step - slot  # windows begin ``low * step`` up to ``low * step + step - 1`` before the anchor
            begin, end = max(0, offset - low * step - step + 1), min(windows - 1, offset - low * step)
            if begin <= end:
                core = content[offset - low * step : offset - low * step - step + 1 + length]
                groups[low, core][content[begin : end + length]].append((k, begin))
    for (low, _), contents in groups.items():
        if len(contents) == 1:
            ((part, places),) = contents.items()
            found = [list(range(len(part) - length + 1))] if len(places) > 1 else [[]]
        else:
            parts = list(contents)
            at = [contents[p][0] for p in parts]
            found = _narrow([(p, rows[k][1] - begin, len(p) - length + 1) for p, (k, begin) in zip(parts, at, strict=True)], length, step)
            found = [list(range(len(p) - length + 1)) if len(contents[p]) > 1 else f for p, f in zip(parts, found, strict=True)]
        for places, starts in zip(contents.values(), found, strict=True):
            for k, begin in places:
                out[k] += [begin + s for s in starts]
    return out


def _ranges(starts: list[int]) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of sorted numbers."""
    if not starts:
        return []
    x = np.asarray(starts)
    cut = np.flatnonzero(np.diff(x) > 1)
    return list(zip(x[np.concatenate([[0], cut + 1])].tolist(), x[np.concatenate([cut, [len(x) - 1]])].tolist(), strict=True))


def removed_spans(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) covered by windows that begin at first..last of each range."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(windows):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last + length)
        else:
            out.append((first, last + length))
    return out


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


KEY = ["k1", "k2"]


def _keys(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(text, F.lit(2)).alias("k2")]


def copied_texts(keyed: DataFrame, least: int = HOT_KEY) -> DataFrame:
    """keyed(k1, k2, ...) -> (k1, k2) of the texts that more than ``least`` rows have."""
    return broadcast_if_small(keyed.groupBy(*KEY).agg(F.count("*").alias("times")).where(F.col("times") > least).select(*KEY))


def repeated_ranges(keyed: DataFrame, copied: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, crowded: int = CROWDED) -> DataFrame:
    """(k1, k2, first, last): ranges of window starts that recur, of the texts that are not ``copied``.

    keyed(k1, k2, text): the texts of ``length`` bytes and more; ``copied``: their ``copied_texts``.
    """
    ship(keyed.sparkSession)
    # Of texts with very many copies, one takes part.
    partners = materialize(keyed.join(copied, KEY).groupBy(*KEY).agg(F.first("text").alias("text")))
    keyed = keyed.join(copied, KEY, "left_anti").unionByName(partners)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k1, k2, text in zip(frame.k1, frame.k2, frame.text, strict=True):
                data = _bytes(text)
                at, n, off, h = segments(data, length, anchor)
                c = np.fromiter((xxhash.xxh3_64_intdigest(data[a : a + w + length - 1]) for a, w in zip(at.tolist(), n.tolist(), strict=True)), np.uint64, len(at)).view(np.int64)
                out.append(np.stack([np.full(len(at), k1), np.full(len(at), k2), at, n, off, h, c]))
            if out:
                yield pd.DataFrame(np.concatenate(out, axis=1).T, columns=["k1", "k2", "at", "n", "off", "h", "c"])

    found = materialize(keyed.mapInPandas(find, "k1 long, k2 long, at long, n long, off long, h long, c long"))
    anchors = checkpoint(found.groupBy("h").agg(F.count("*").alias("times"), (F.min("c") != F.max("c")).alias("mixed")).where("times > 1"))
    shared = materialize(join_hot(found, anchors, ["h"]).drop("times"))
    contents = shared.where("mixed").groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("k1", "k2", "at", "n", "off")).alias("one"))
    contents = checkpoint(contents)
    kinds = contents.groupBy("h").agg(F.count("*").alias("kinds"))
    again = contents.where("times > 1").select("h", "c", "times")
    whole = shared.where("not mixed").select("k1", "k2", "at", "n").unionByName(join_hot(shared.where("mixed"), again, ["h", "c"]).select("k1", "k2", "at", "n"))
    whole = whole.select("k1", "k2", F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last"))

    wanted = contents.join(kinds, "h").select("one.*", "h", (F.col("times") > 1).alias("whole"), (F.col("kinds") > crowded).alias("crowded"))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n", "off", "h", "whole", "crowded")).alias("cuts"))
    step = max(1, math.ceil((length - anchor + 1) / PARTS))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k1, k2, text, cuts in zip(frame.k1, frame.k2, frame.text, frame.cuts, strict=True):
                data = _bytes(text)
                for c in cuts:
                    at, n, off = c["at"], c["n"], c["off"]
                    if not c["crowded"]:
                        out.append((c["h"], k1, k2, at, n, off, c["whole"], data[at : at + n + length - 1]))
                        continue
                    for low in range((off - n + 1) // step, off // step + 1):
                        begin, end = max(0, off - low * step - step + 1), min(n - 1, off - low * step)
                        if begin <= end:
                            core = data[at + off - low * step : at + off - low * step - step + 1 + length]
                            key = xxhash.xxh3_64_intdigest(core, seed=low) ^ (c["h"] & (2**64 - 1))
                            out.append((key - 2**64 if key >= 2**63 else key, k1, k2, at + begin, end - begin + 1, off - begin, c["whole"], data[at + begin : at + end + length]))
            yield pd.DataFrame(out, columns=["g", "k1", "k2", "at", "n", "off", "whole", "content"])

    pieces = wanted.join(keyed, ["k1", "k2"]).select("k1", "k2", "text", "cuts").mapInPandas(cut, "g long, k1 long, k2 long, at long, n long, off long, whole boolean, content binary")
    total = contents.agg(F.sum(F.col("one.n") + (length - 1))).first()[0] or 0
    tasks = max(1, math.ceil(total / TASK_BYTES))

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        groups = defaultdict(dict)
        for g, k1, k2, at, n, off, whole, content in frame.itertuples(index=False):
            # Parts of different contents may be equal; they are repeats of each other.
            groups[g].setdefault((off, bytes(content)), []).append((k1, k2, at, n, whole))
        out = []
        for group in groups.values():
            rows = [(content, off, len(content) - length + 1) for off, content in group]
            marks = _matching(rows, length)
            for starts, (_, _, windows), places in zip(marks, rows, group.values(), strict=True):
                runs = [(0, windows - 1)] if len(places) > 1 else _ranges(sorted(starts))
                out += [(k1, k2, at + a, at + b) for k1, k2, at, _, whole in places if not whole for a, b in runs]
        return pd.DataFrame(out, columns=["k1", "k2", "first", "last"])

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(tasks)).cast("int"))
    marked = dealt.groupBy("bucket").applyInPandas(lambda f: sort(f.drop(columns="bucket")), "k1 long, k2 long, first long, last long")
    return whole.unionByName(marked)


def substring_report(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED, hot_text: int = HOT_KEY, keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep`` the kept bytes and the spans."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    short, long = rows.where(size < length), rows.where(size >= length).select("id", *_keys(F.col("text")), "text")
    keyed = long.select(*KEY, "text")
    copied = copied_texts(keyed, hot_text)
    ranges = repeated_ranges(keyed, copied, length=length, anchor=anchor, crowded=crowded)
    each = ranges.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))  # rows with one text find the same
    span = "array<struct<first:long,end:long>>"

    def settled(df: DataFrame, gone: bool) -> DataFrame:
        """The report of texts that go, or stay, as a whole."""
        kept = F.encode(F.lit("") if gone else F.coalesce("text", F.lit("")), "UTF-8")
        spans = F.array(F.struct(F.lit(0).cast("long").alias("first"), size.alias("end"))) if gone else F.array()
        return df.select(F.col("id").alias(id_col), size.alias("n_bytes"), (size if gone else F.lit(0)).cast("long").alias("n_removed"), F.lit(int(gone)).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), *([kept.alias("kept"), spans.cast(span).alias("spans")] if keep else []))

    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (f", kept binary, spans {span}" if keep else "")

    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for text, windows in zip(texts, found, strict=True):
                data = _bytes(text)
                spans = removed_spans([(w["first"], w["last"]) for w in windows], length) if windows is not None else []
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                row = (len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest())
                out.append((*row, rest, [{"first": a, "end": b} for a, b in spans]) if keep else row)
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept", "spans"] if keep else [])])

    once = long.join(copied, KEY, "left_anti").join(each, KEY, "left")
    once = once.select(F.col("id").alias(id_col), F.pandas_udf(apply, fields)("text", "ranges").alias("r")).select(id_col, "r.*")
    return once.unionByName(settled(long.join(copied, KEY, "left_semi"), True)).unionByName(settled(short, False))


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """The report for a list of texts by counting all windows, for tests."""
    seen: dict[bytes, int] = defaultdict(int)
    data = [_bytes(t) for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] += 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
