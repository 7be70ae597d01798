"""Audit of how five filters act together, in every order.

Native expressions give each text a mask of the filters that it fails; a histogram of masks,
32 cells for each part of the corpus, is then all that any order of the filters depends on.
A: fewer than ``min_words`` words. B: distinct words are under ``min_distinct`` percent of the words.
C: capitals are over ``max_capitals`` percent of the code points. D: a character of ``SYMBOLS``.
E: the text is that of a smaller id, anywhere in the table.

Only E looks beyond a row. Texts are grouped by their SHA-256, so that whole texts aren't
shuffled; only texts that occur more than once are joined back, those of very many rows in place.
A row that fails E enters the histogram as one row less in the cell without that bit and one more in the
cell with it, so that labels are joined once. Before that join rows are counted by id, part and mask: an
id that very many rows share, or that is null, arrives as a few rows.

Defined cases: a null text is an empty one; a null part is the empty string; a null id is neither
smaller nor greater than another and has no label; rows that share id and text fail E alike, by smaller ids
only; an id with several labels counts as good or toxic if one of them says so; a part with
no failure has all its rows of zeros; an empty table gives an empty result; columns
of other names play no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

FILTERS = "ABCDE"
SYMBOLS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"


def _text_mask(text: Column, min_words: int, min_distinct: int, max_capitals: int) -> Column:
    """The bits of A to D; E is known only after grouping."""
    words = F.array_remove(F.split(text, SPACES), "")

    def bits(w: Column) -> Column:
        fails = [
            w["n"] < min_words,
            100 * w["distinct"] < min_distinct * w["n"],
            100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > max_capitals * F.length(text),
            text.rlike(SYMBOLS),
        ]
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    return F.element_at(F.transform(counts, bits), 1)


def failure_masks(docs: DataFrame, *, min_words: int = 100, min_distinct: int = 80, max_capitals: int = 10, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask, weight): weights sum to the number of rows with that id, part and mask of all five filters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), _text_mask(text, min_words, min_distinct, max_capitals).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialize(rows)
    shared = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("times"))
    shared = materialize(shared.where(F.col("least") < F.col("most")).drop("most"))
    later = join_hot(rows, shared, ["digest"]).where(F.col("id") > F.col("least"))
    moves = F.explode(F.array(F.struct(F.col("mask").alias("cell"), F.lit(-1).alias("weight")), F.struct((F.col("mask") + 16).alias("cell"), F.lit(1).alias("weight"))))
    moved = later.select("id", "part", moves.alias("m")).select("id", "part", F.col("m.cell").alias("mask"), "m.weight")
    return rows.select("id", "part", "mask", F.lit(1).alias("weight")).unionByName(moved)


def mask_histogram(masks: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): one row for each cell that has ever held a row."""
    counted = masks.groupBy("id", "part", "mask").agg(F.sum("weight").alias("n")).where("n <> 0")
    mark = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(mark(quality_col).alias("good"), mark(toxic_col).alias("toxic")).where("good + toxic > 0")
    share = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return counted.join(marks, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), share("good"), share("toxic"))


def _orders(like: DataFrame) -> DataFrame:
    """All orders of the filters, a row for each step: filter_order, step, f (bit of its filter) and before (bits of those before it)."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, k, before))
            before |= 1 << k
    return like.sparkSession.createDataFrame(rows, "filter_order string, step int, f int, before int")


def interactions(cells: DataFrame) -> DataFrame:
    """cells(part, mask, n, good, toxic) -> one row for each part, order of filters and step.

    What a step does depends on its filter and the set of those before it: 80 cases for each part.
    """
    cases = cells.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(31))))
    cases = cases.withColumn("bit", F.expr("shiftleft(1, f)")).where(F.col("before").bitwiseAND(F.col("bit")) == 0)
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda cond, c, name: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long").alias(name)
    # Of the 120 orders those in which this filter comes first among all that a row fails.
    first = F.sum(F.when(fails, F.expr("n * 120 div greatest(bit_count(mask), 1)")).otherwise(0)).cast("long").alias("shapley")
    judged = cases.groupBy("part", "f", "before").agg(
        total(~fails & ~gone, "n", "kept"), total(fails & ~gone, "n", "removed"), total(fails & gone, "n", "redundant"), total(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        total(fails & ~gone, "good", "good_lost"), total(fails & ~gone, "toxic", "toxic_lost"), first,
    )
    named = judged.join(F.broadcast(_orders(cells)), ["f", "before"])  # 600 rows
    return named.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, *, min_words: int = 100, min_distinct: int = 80, max_capitals: int = 10, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of ``docs`` whole: 600 rows for each part."""
    masks = failure_masks(docs, min_words=min_words, min_distinct=min_distinct, max_capitals=max_capitals, id_col=id_col, text_col=text_col, part_col=part_col)
    return interactions(mask_histogram(masks, labels, id_col=id_col))
