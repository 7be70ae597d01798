"""Mixing sources to target weights by pivotal dependent rounding.

Sources share a budget of words by weight; a source's target stops at ``max_repeats``
times its size and what it cannot take is shared again by weight. A document of a
source is then due target / size copies. The whole part is taken as it is; the
fractional parts are rounded dependently. Two documents with fractional copies
x and y and sizes a and b transfer mass (a dx = -b dy, so that the words taken stay the
same) until one of the two is integral, in a random direction whose odds keep each
expectation. What is left is one fractional document for each group; those meet in the
next level of a reduction tree, up to the last one of a source, which is rounded alone.
A large document left over would miss the target by much, and the many small ones of its source
could not make up for it one by one. So documents above a thousandth of their source
are rounded first, in descending order, each against a pool: the smaller ones that are due the same fraction as most of
their source. The document is taken with the odds of its own fraction, always; what it gains or loses, the fractions of the
pool lose or gain in one proportion, as far as they can bear it in both directions, so that every
expectation is kept exactly. That takes one small array for each source. The smaller documents then enter the tree with what
is left of their fractions. A source misses its target by less than a thousandth of its size and the few large documents that have little smaller beside them to make up
for them; a document that has more words than the fractions of its pool are due, or leave out, misses by the excess, taken or not.

The tree is built of groups of about ``fan_in`` documents: every level is one shuffle of
the narrow residuals and one native fold, and the number of levels grows with
the logarithm of the rows. All draws are hashes of rows, so that reruns agree.

Rows that agree in every column form one unit: as many whole copies as their number times the
fraction holds, and one fractional copy that is rounded like a document.

Defined cases: a null text has size 0; documents of size 0 take 0 words; a null source is a
source of its own, ordered last; ids may be null, repeated and of any type; texts of any length
count whole; with no words at all every target is 0; an empty table gives an empty result;
``mix_sources`` passes other columns by and ``mixed_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bits_for, broadcast_if_small, cell_of, checkpoint, let, repeated, row_keys, shuffle_key

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a larger share of their source are rounded one by one; so there are at most 1 / GIANT of them.
GIANT = 0.001
ITEM = "struct<k1:bigint,k2:bigint,size:bigint,x:double>"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, *, weights: Sequence[float], share: float, max_repeats: float) -> DataFrame:
    """sized(name, none, size) -> one row per source with source_size and target.

    The resharing has a closed form. With sources ordered by limit over weight, let
    level_k be what a unit of weight gets if exactly the sources before k are at their
    limits. The level that holds is the largest one.
    """
    sums = sized.groupBy("name", "none").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("none", "name")  # one row for each source from here on
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    limits = sums.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(max_repeats)))
    everything = Window.orderBy(F.col("limit") / F.col("weight"), "none", "name")
    past = everything.rowsBetween(Window.unboundedPreceding, -1)
    full = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(full) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("limit").over(past), F.lit(0.0))) / (F.sum("weight").over(full) - F.coalesce(F.sum("weight").over(past), F.lit(0.0)))
    levels = limits.withColumn("level", level)
    return levels.withColumn("target", F.least("limit", F.col("weight") * F.max("level").over(full))).select("name", "none", "source_size", "target")


def _unit(seed: int, *parts: Column) -> Column:
    """A hash of ``parts`` as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") / F.lit(float(1 << 53))


def _fold(items: Column, seed: int, level: int) -> Column:
    """items: array of ITEM, all of them fractional -> struct(out: array of ITEM, now integral; rest: ITEM or null)."""
    none = F.lit(None).cast(ITEM)

    def item(of: Column, x: Column) -> Column:
        return F.struct(of["k1"].alias("k1"), of["k2"].alias("k2"), of["size"].alias("size"), x.cast("double").alias("x"))

    def meet(state: Column, new: Column) -> Column:
        def pair(old: Column) -> Column:
            a, b = old["size"].cast("double"), new["size"].cast("double")
            # up: the old one gains, the new one loses; down: the reverse. Both in copies of the old one.
            draw = _unit(seed, old["k1"], new["k1"], old["k2"], new["k2"], F.lit(level))
            moves = F.struct(F.least(1 - old["x"], new["x"] * b / a).alias("up"), F.least(old["x"], (1 - new["x"]) * b / a).alias("down"), (a / b).alias("ratio"), draw.alias("draw"))

            def move(m: Column) -> Column:
                rises = m["draw"] * (m["up"] + m["down"]) < m["down"]
                old_ends = F.when(rises, m["up"] >= 1 - old["x"]).otherwise(m["down"] >= old["x"])
                old_x = F.when(rises, F.when(old_ends, F.lit(1.0)).otherwise(old["x"] + m["up"])).otherwise(F.when(old_ends, F.lit(0.0)).otherwise(old["x"] - m["down"]))
                new_x = F.when(old_ends, F.when(rises, new["x"] - m["up"] * m["ratio"]).otherwise(new["x"] + m["down"] * m["ratio"])).otherwise(F.when(rises, F.lit(0.0)).otherwise(F.lit(1.0)))
                whole = let(F.struct(old_ends.alias("old_ends"), old_x.alias("old"), F.least(F.greatest(new_x, F.lit(0.0)), F.lit(1.0)).alias("new")), close)
                return whole

            def close(e: Column) -> Column:
                first = F.when(e["old_ends"], item(old, e["old"])).otherwise(item(new, e["new"]))
                second = F.when(e["old_ends"], item(new, e["new"])).otherwise(item(old, e["old"]))
                return let(F.struct(first.alias("first"), second.alias("second")), settle)

            def settle(e: Column) -> Column:
                open_ = (e["second"]["x"] > 0) & (e["second"]["x"] < 1)
                done = F.when(open_, F.array(e["first"])).otherwise(F.array(e["first"], e["second"]))
                return F.struct(F.concat(state["out"], done).alias("out"), F.when(open_, e["second"]).otherwise(none).alias("rest"))

            return let(moves, move)

        fresh = F.struct(state["out"].alias("out"), item(new, new["x"]).alias("rest"))
        return F.when(state["rest"].isNull(), fresh).otherwise(let(state["rest"], pair))

    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("out"), none.alias("rest"))
    return F.aggregate(items, start, meet)


def _against_the_pool(giants: Column, mass: Column, size: Column, seed: int) -> Column:
    """giants: array of (item, pooled) in descending order of size; ``mass`` and ``size``: sums of size * x and size over the pool, pooled giants included.

    The common change of the pool is kept as x -> scale * x + shift. -> struct(out: array of ITEM, all integral, scale, shift).
    """

    def meet(state: Column, entry: Column) -> Column:
        new, pooled = entry["item"], entry["pooled"]
        w = new["size"].cast("double")
        own = F.when(pooled, F.least(F.greatest(state["scale"] * new["x"] + state["shift"], F.lit(0.0)), F.lit(1.0))).otherwise(new["x"])

        def pool(x: Column) -> Column:
            held = F.greatest(state["mass"] - F.when(pooled, w * x).otherwise(0.0), F.lit(0.0))
            size = state["size"] - F.when(pooled, w).otherwise(0.0)
            rises = _unit(seed, new["k1"], new["k2"], F.lit(-2)) < x
            return let(F.struct(held.alias("held"), F.greatest(size - held, F.lit(0.0)).alias("room"), size.alias("size"), rises.alias("rises"), (w * (1 - x)).alias("gain"), (w * x).alias("loss")), move)

        def move(m: Column) -> Column:
            # The part of gain and loss that the pool can bear, whichever of them comes.
            part = F.least(F.lit(1.0), F.when(m["gain"] > 0, m["held"] / m["gain"]).otherwise(1.0), F.when(m["loss"] > 0, m["room"] / m["loss"]).otherwise(1.0))
            share = F.when(m["rises"], F.when(m["held"] > 0, part * m["gain"] / m["held"]).otherwise(0.0)).otherwise(F.when(m["room"] > 0, part * m["loss"] / m["room"]).otherwise(0.0))
            return let(F.struct(F.least(share, F.lit(1.0)).alias("share"), m.alias("of")), close)

        def close(e: Column) -> Column:
            m, keep = e["of"], 1 - e["share"]
            done = F.struct(new["k1"].alias("k1"), new["k2"].alias("k2"), new["size"].alias("size"), F.when(m["rises"], 1.0).otherwise(0.0).alias("x"))
            shift = state["shift"] * keep + F.when(m["rises"], 0.0).otherwise(e["share"])
            mass = F.when(m["rises"], m["held"] * keep).otherwise(m["held"] + m["room"] * e["share"])
            return F.struct(F.concat(state["out"], F.array(done)).alias("out"), (state["scale"] * keep).alias("scale"), shift.alias("shift"), mass.alias("mass"), m["size"].alias("size"))

        return let(own, pool)

    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("out"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("shift"), mass.alias("mass"), size.cast("double").alias("size"))
    return F.aggregate(giants, start, meet)


FIELDS = ["k1", "k2", "size", "x"]


def _tree(left: DataFrame, *, seed: int, rows: int, fan_in: int) -> DataFrame:
    """Round fractional units by the reduction tree; the last one of each source is rounded alone."""
    step = max(2, fan_in).bit_length() - 1
    bits = max(0, bits_for(rows, fan_in, least=0, most=30))
    level, out = 0, None
    left = left.withColumn("key", shuffle_key(seed, "k1", "k2"))
    left = left.withColumn("cell", cell_of(F.col("key"), bits) if bits else F.lit(0))
    while True:
        groups = left.groupBy("name", "none", "cell").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", F.struct(*FIELDS).alias("item")))).alias("all"))
        folded = checkpoint(groups.withColumn("f", _fold(F.transform("all", lambda e: e["item"]), seed, level)).select("name", "none", "cell", "f"))
        done = folded.select("name", "none", F.explode("f.out").alias("i")).select("name", "none", "i.*")
        out = done if out is None else out.unionByName(done)
        left = folded.where("f.rest is not null").select("name", "none", "cell", "f.rest.*").withColumn("key", shuffle_key(seed + level + 1, "k1", "k2"))
        if not bits:
            break
        drop = min(step, bits)
        bits, level = bits - drop, level + 1
        left = left.withColumn("cell", F.shiftright("cell", drop))
    return out.unionByName(_alone(left, seed).select("name", "none", *FIELDS))


def _alone(left: DataFrame, seed: int) -> DataFrame:
    """Units that no other one is left to pair with, rounded at random."""
    return left.withColumn("x", F.when(_unit(seed, F.col("k1"), F.col("k2"), F.lit(-1)) < F.col("x"), 1.0).otherwise(0.0))


def pivotal_round(units: DataFrame, *, seed: int, rows: int, fan_in: int = 64, giant: float = GIANT) -> DataFrame:
    """units(name, none, k1, k2, size, x) with 0 < x < 1 and size > 0 -> the same with x 0.0 or 1.0.

    k1 and k2 tell units apart. Each x keeps its expectation. Within (name, none) the sum of size * x stays the same but for
    the last unit of the tree, which is rounded at random, and large units that the pool cannot make up for.
    """
    sums = units.groupBy("name", "none").agg(F.sum("size").alias("total"), F.mode("x", True).alias("usual"))
    sums = broadcast_if_small(sums)  # one row for each source
    weighed = units.join(sums, ["name", "none"]).withColumn("large", F.col("size") >= F.col("total") * giant).withColumn("pooled", F.col("x") == F.col("usual"))
    weighed = checkpoint(weighed)
    pools = weighed.where("pooled").groupBy("name", "none").agg(F.sum(F.col("size") * F.col("x")).alias("mass"), F.sum("size").alias("size"))
    # At most 1 / giant of them for each source.
    order = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "k1", "k2", "pooled", F.struct(*FIELDS).alias("item"))))
    large = weighed.where("large").groupBy("name", "none").agg(order.alias("all")).join(broadcast_if_small(pools), ["name", "none"])
    large = checkpoint(large.select("name", "none", _against_the_pool(F.transform("all", lambda e: F.struct(e["item"].alias("item"), e["pooled"].alias("pooled"))), F.col("mass"), F.col("size"), seed).alias("f")))
    one_by_one = large.select("name", "none", F.explode("f.out").alias("i")).select("name", "none", "i.*")
    change = broadcast_if_small(large.select("name", "none", "f.scale", "f.shift"))
    moved = F.coalesce("scale", F.lit(1.0)) * F.col("x") + F.coalesce("shift", F.lit(0.0))
    small = weighed.where("not large").join(change, ["name", "none"], "left")
    small = small.withColumn("x", F.when(F.col("pooled"), F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))).otherwise(F.col("x"))).select("name", "none", *FIELDS)
    open_ = (F.col("x") > 0) & (F.col("x") < 1)
    out = one_by_one.unionByName(small.where(~open_))
    return out.unionByName(_tree(small.where(open_), seed=seed, rows=rows, fan_in=fan_in)).select("name", "none", *FIELDS)


def _planned(docs: DataFrame, *, weights: Sequence[float], share: float, max_repeats: float, seed: int, fan_in: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per distinct row of ``docs``: k1, k2, id, name, none, size, n (its number), source_size, target, base and extra.

    Each of the n rows is copied ``base`` times, and ``extra`` of them once more.
    """
    sized = docs.select(*row_keys(docs), F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("name"), F.col(source_col).isNull().alias("none"), word_count(F.col(text_col)).alias("size"))
    same = [F.first(c).alias(c) for c in ("id", "name", "none", "size")]
    sized = checkpoint(sized.groupBy("k1", "k2").agg(*same, F.count("*").alias("n")))  # narrow; keeps the texts from being counted at each level
    targets = broadcast_if_small(source_targets(sized.select("name", "none", (F.col("size") * F.col("n")).alias("size")), weights=weights, share=share, max_repeats=max_repeats))
    due = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = sized.join(targets, ["name", "none"]).withColumn("base", F.floor(due).cast("long")).withColumn("over", F.col("n") * (due - F.floor(due)))
    planned = planned.withColumn("more", F.floor(F.col("over") + 1e-9).cast("long")).withColumn("x", F.col("over") - F.col("more"))
    units = planned.where("x > 1e-9").select("name", "none", *FIELDS)
    bits = pivotal_round(units, seed=seed, rows=sized.count(), fan_in=fan_in).select("k1", "k2", F.col("x").alias("bit"))
    joined = planned.join(bits, ["k1", "k2"], "left")
    return joined.withColumn("extra", F.col("more") + F.coalesce("bit", F.lit(0.0)).cast("long")).drop("over", "more", "x", "bit")


def mix_sources(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeats: float = 2.0, seed: int = 77, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies and taken (copies * size).

    ``weights`` go to the sources in code point order, over and over; ``share`` is the
    mixture's size over that of all documents.
    """
    planned = _planned(docs, weights=weights, share=share, max_repeats=max_repeats, seed=seed, fan_in=fan_in, id_col=id_col, text_col=text_col, source_col=source_col)
    each = repeated(planned, "n", "k1", "k2")
    copies = (F.col("base") + (F.col("ordinal") < F.col("extra")).cast("long")).alias("copies")
    each = each.select("id", F.when(~F.col("none"), F.col("name")).alias("source"), "size", "source_size", "target", copies)
    return each.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeats: float = 2.0, seed: int = 77, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` as mixed: each row as often as its copies say, with the columns of ``docs``."""
    planned = _planned(docs, weights=weights, share=share, max_repeats=max_repeats, seed=seed, fan_in=fan_in, id_col=id_col, text_col=text_col, source_col=source_col)
    planned = planned.select("k1", "k2", (F.col("n") * F.col("base") + F.col("extra")).alias("times"))
    # Whole rows travel as one struct, so that no name of theirs meets one of these. Equal rows go as one.
    rows = docs.select(F.struct("*").alias("row"), *row_keys(docs)).dropDuplicates(["k1", "k2"])
    return repeated(rows.join(planned, ["k1", "k2"]), "times", "k1", "k2").select("row.*")
