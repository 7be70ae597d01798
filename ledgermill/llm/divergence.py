"""Audit of how sources diverge from each other and from their language.

Terms are counted for each language and source; a language keeps the terms of ``min_docs`` of its
documents. A term's weight in a group is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), all in whole numbers.

*Pairs.* The distance of two sources sums abs(p - q) over all kept terms, most of which a source does not
have. Those weigh the same in it, its base b. So only terms that both have are joined:

    D(g, h) = V abs(bg - bh) + own(g, bh) + own(h, bg) + both(g, h)
    own(g, b) = sum over the terms of g of abs(p - b) - abs(bg - b)
    both      = sum over shared terms of abs(p - q) - abs(p - bh) - abs(q - bg) + abs(bg - bh)

``own`` depends on a histogram of p alone.

*Terms.* The ``top`` terms of each group come from a radix select. A sort key is four bytes of value, descending, and the
UTF-8 bytes of the term. Histograms over two bytes at a time, at most 65,537 cells for each group,
find the cell that holds the last row wanted; what lies before it is taken, and the next two bytes decide within it.
So ties refine by the bytes of terms, and no group is ever sorted as a whole.

Counting runs in Arrow batches: a task adds up to a bounded table of its own and hands it on when full, so
that what is shuffled are sums. Only sums for each language, source and term leave the texts.

Defined cases: null texts, languages and sources are empty strings; a group without terms is there with count 0
for each kept term; a language with V = 0 has pairs of value 0 and no terms; repeated rows and ids count
each; texts of any length count whole; an empty table gives an empty result; ids and columns of other names play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, materialize

TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"  # as bytes: of UTF-8 all that is beyond ASCII counts as letters
#: Distinct terms that a task holds before it hands its sums on.
HELD = 200_000
#: Bytes of UTF-8 that a task cuts into terms at once.
CHUNK = 1 << 20
COUNTS = "lang string, source string, term string, n long, docs long"


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about CHUNK bytes that cut no term."""
    start, border = 0, re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
    while len(text) - start > CHUNK:
        cut = border.search(text, start + CHUNK)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, source, text) -> sums of occurrences and of documents; each group has a row for the empty term."""
    find = re.compile(TERM).findall
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush():
        for (lang, source), (n, docs) in held.items():
            terms = [*n]
            names = [t.decode("utf-8", "replace") for t in terms]
            columns = [[lang] * len(terms), [source] * len(terms), names, [n[t] for t in terms], [docs[t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter({b"": 0}), Counter()))
            raw, seen, before = text.as_py().encode("utf-8").lower(), set(), len(n)  # bytes: only A-Z change
            for piece in _pieces(raw):
                terms = find(piece)
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            size += len(n) - before
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it; each occurring group has a row for the empty term too."""
    filled = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in dict.fromkeys((lang_col, source_col, text_col))])
    rows = filled.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _weight(n: str | Column, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exact beyond what a long holds."""
    above = (F.col(n) if isinstance(n, str) else n).cast("decimal(20,0)") + F.lit(5)
    below = F.col(total).cast("decimal(20,0)") + 5 * F.col(kept)
    return F.lit(1) + F.call_function("div", above * F.lit(1_000_000_000), below)


def _weights(counts: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """groups(lang, source, total, kept, base) and sparse(lang, source, term, p, q, base): the kept terms that a group has."""
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = materialize(kept)
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    sparse = materialize(counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"))
    totals = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["kept", "total", "lang_total"])
    base = F.when(F.col("kept") > 0, _weight(F.lit(0), "total", "kept")).otherwise(0)
    groups = broadcast_if_small(groups.withColumn("base", base))  # one row for each group
    weighed = sparse.join(groups, ["lang", "source"])
    return groups, weighed.select("lang", "source", "term", _weight("n", "total", "kept").alias("p"), _weight("all", "lang_total", "kept").alias("q"), "base")


def pair_distances(groups: DataFrame, sparse: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each source to each other one of its language."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"))
    pairs = groups.select("lang", "source", "kept", "base").join(other, "lang").where("source <> item")
    plain = pairs.select("lang", "source", "item", (F.col("kept") * F.abs(F.col("base") - F.col("item_base"))).alias("value"))
    # How many terms of a source weigh the same is all that the base of another one meets.
    alike = sparse.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("m"))
    own = alike.join(other, "lang").where("source <> item")
    own = own.select("lang", "source", "item", (F.col("m") * (F.abs(F.col("p") - F.col("item_base")) - F.abs(F.col("base") - F.col("item_base")))).alias("value"))
    own = own.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    left = sparse.select("lang", "term", F.col("source").alias("a"), "p", F.col("base").alias("pb"))
    right = sparse.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("r"), F.col("base").alias("rb"))
    gain = F.abs(F.col("p") - F.col("r")) - F.abs(F.col("p") - F.col("rb")) - F.abs(F.col("r") - F.col("pb")) + F.abs(F.col("pb") - F.col("rb"))
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(gain).alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    shared = own.select("lang", F.col("source").alias("a"), F.col("item").alias("b"), "value").unionByName(both)
    parts = plain.unionByName(shared.select("lang", sides.alias("s"), "value").select("lang", "s.source", "s.item", "value"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


#: Bytes of the sort key that one round of the radix select looks at.
DIGIT = 2


def _sort_key(value: str, text: str) -> Column:
    """Bytes in whose order values descend and texts ascend; values take four bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.lit((1 << 32) - 1) - F.col(value)), 8, "0")), F.encode(F.col(text), "UTF-8"))


def select_top(rows: DataFrame, group: list[str], *, value: str, text: str, top: int) -> DataFrame:
    """The ``top`` rows of each group by value (0 to 2^32 - 1) descending, then by the bytes of ``text``, which is unique within the group.

    Each round counts the rows of the groups that are still open by their next bytes and takes the cell that
    holds row number ``top``. A group closes when all of that cell is wanted.
    """
    keyed = materialize(rows.withColumn("key", _sort_key(value, text)))
    sizes = keyed.groupBy(*group).agg(F.count("*").alias("rows"))
    # limit: keys up to it are wanted, and those that go on from it unless it is a whole key; null where all are.
    closed = sizes.where(F.col("rows") <= top).select(*group, F.lit(None).cast("binary").alias("limit"), F.lit(False).alias("ended"))
    open_ = broadcast_if_small(sizes.where(F.col("rows") > top).select(*group, F.lit(b"").alias("prefix"), F.lit(top).cast("long").alias("need")))
    at = 0
    while not open_.isEmpty():
        digit = F.substring(F.col("key"), at * DIGIT + 1, DIGIT)
        cells = keyed.join(open_, group).where(F.substring(F.col("key"), 1, at * DIGIT) == F.col("prefix"))
        cells = cells.groupBy(*group, "prefix", "need", digit.alias("digit")).agg(F.count("*").alias("rows"))
        upto = F.sum("rows").over(Window.partitionBy(*group).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        cell = cells.withColumn("upto", upto).where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("rows") < F.col("need")))
        cell = checkpoint(cell.select(*group, F.concat("prefix", "digit").alias("prefix"), (F.col("need") - F.col("upto") + F.col("rows")).alias("need"), "rows", (F.length("digit") < DIGIT).alias("ended")))
        closed = closed.unionByName(cell.where("rows = need").select(*group, F.col("prefix").alias("limit"), "ended"))
        open_ = broadcast_if_small(cell.where("rows <> need").drop("rows", "ended"))
        at += 1
    limits = broadcast_if_small(closed)
    wanted = F.col("limit").isNull() | (F.col("key") <= F.col("limit")) | (~F.col("ended") & F.startswith(F.col("key"), F.col("limit")))
    return keyed.join(limits, group).where(wanted).drop("limit", "ended")


def source_divergence(docs: DataFrame, *, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: all other sources and the ``top`` terms of each source of each language."""
    counts = materialize(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col))
    groups, sparse = _weights(counts, min_docs)
    sparse = materialize(sparse)
    group = ["lang", "source"]
    pairs = pair_distances(groups, sparse).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item")))
    rising = sparse.where("p > q").select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = select_top(rising, group, value="value", text="item", top=top)
    terms = best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("key")))
    shape = lambda df, part: df.select(*group, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return shape(pairs, "pair").unionByName(shape(terms, "term"))
