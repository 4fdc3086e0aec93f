"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words: its weight's share of the whole mix, stopped at a
multiple of the source's own size, the excess shared out again by weight.  A document of a
source should then appear ``target / size of the source`` times: a whole number of copies and
a fraction.  The fractions are rounded dependently: of two documents, mass (in words) moves
from one to the other, in the direction that a fair draw picks, until one of them holds none
or all of its words.  Each draw keeps every expectation, each move keeps the source's total
exactly, so a source ends within half a document of its target.

The draws run as a reduction tree.  Documents are hashed into blocks of bounded size; a fold
inside one row pairs a block's documents until one fractional document is left, and only that
residual goes on to the next level.  A hot source is many blocks, and no level collects more
than a block in one place.  Draws are hashes of the documents, so reruns agree whatever the
layout of the input.

Rows of equal id, source, size and text are one item with a multiplicity, so a document
repeated millions of times is one item.  Its copies are dealt to its rows evenly: the rows are
numbered by range and prefix sums, so no task holds all rows of a document.

Defined cases: a null text has no words and is never taken; a null source is a source of its
own, after all others, and so is an empty one; equal documents in several sources are one item
in each; an empty table, or one without words, gives targets of 0; ids may be null or
repeated; further columns, whatever their names, pass through ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import let, n_words_of, numbered, row_hash, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Mean number of items in a block of the reduction tree.
BLOCK = 64
#: Sources beyond this are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, weight and target from rows (source, source_size).

    Sharing again until nobody is above its stop is water filling: with sources in the order
    of stop / weight, the first k are stopped, and the rest get one level times their weight.
    """
    named = numbered(sizes.select("source", "source_size"), [F.col("source").isNull(), F.col("source")], row="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = named.select("source", "source_size", weight.alias("weight"), "place")
    by_stop = [F.col("source_size") / F.col("weight"), F.col("place")]
    filled = written(numbered(ranked, by_stop, {"stopped": "source_size", "lighter": "weight"}, row="order"), "mix-stops")
    whole = filled.agg((F.sum("source_size") * F.lit(share)).alias("mix"), F.sum("weight").alias("weights"))
    filled = filled.crossJoin(F.broadcast(whole))  # one row
    level = (F.col("mix") - most * F.col("stopped")) / (F.col("weights") - F.col("lighter"))
    free = F.when(level * F.col("weight") <= most * F.col("source_size"), level)
    levels = filled.agg(F.max(free).alias("level"))
    target = F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))
    joined = filled.crossJoin(F.broadcast(levels))  # one row
    return joined.select("source", "source_size", "weight", F.coalesce(target, (most * F.col("source_size")).cast("double")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _fold(items: Column, level: int, seed: int) -> Column:
    """Rounds a block: struct(rest, done), where ``done`` holds (item, up) of the items that became integral.

    ``items``: array of struct(size, mass, key, item) with 0 < mass < size; draws depend on ``key`` alone.
    """
    none = F.array().cast("array<struct<item:bigint,up:int>>")
    start = F.struct(items[0].alias("rest"), none.alias("done"))

    def pair(acc: Column, new: Column) -> Column:
        def of(s: Column) -> Column:
            a, b, done = s["a"], s["b"], s["done"]
            down, up = F.least(a["mass"], b["size"] - b["mass"]), F.least(b["mass"], a["size"] - a["mass"])
            to_b = _uniform(a["key"], b["key"], F.lit(level), F.lit(seed)) * (down + up) < up
            emptied, filled = a["mass"] <= b["size"] - b["mass"], b["mass"] <= a["size"] - a["mass"]
            item = lambda x, mass: F.struct(x["size"].alias("size"), mass.alias("mass"), x["key"].alias("key"), x["item"].alias("item"))
            won = lambda x, n: F.array_append(done, F.struct(x["item"].alias("item"), F.lit(n).alias("up")))
            state = lambda rest, out: F.struct(rest.alias("rest"), out.alias("done"))
            return (
                F.when(to_b & emptied, state(item(b, a["mass"] + b["mass"]), won(a, 0)))
                .when(to_b, state(item(a, a["mass"] - (b["size"] - b["mass"])), won(b, 1)))
                .when(filled, state(item(a, a["mass"] + b["mass"]), won(b, 0)))
                .otherwise(state(item(b, b["mass"] - (a["size"] - a["mass"])), won(a, 1)))
            )

        return let(F.struct(acc["rest"].alias("a"), new.alias("b"), acc["done"].alias("done")), of)

    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, pair)


def round_copies(items: DataFrame, seed: int = 0) -> DataFrame:
    """(item, up) for items (source, item, key, size, mass) with 0 <= mass <= size; ``up`` is 0 or 1.

    ``item`` is unique; ``key`` is a hash that reruns give again.  Level by level, items are hashed into blocks by source; one fold rounds a block, its rest is
    an item of the next level.  A rest whose mass reached 0 or its size is done.
    """
    done: DataFrame | None = None
    rows, level = written(items, "mix-level"), 0
    while True:
        open_ = (F.col("mass") > 1e-6) & (F.col("mass") < F.col("size") - 1e-6)
        near = rows.where(~open_)
        near = near.select("item", (F.col("mass") > F.col("size") / 2).cast("int").alias("up"))
        done = near if done is None else done.unionByName(near)
        rows = rows.where(open_)
        counts = rows.groupBy("source").agg(F.count("*").alias("_n"))
        most = counts.agg(F.max("_n")).first()[0] or 0
        if most == 0:
            return done
        if most == 1:  # the roots: nothing is left to pair with, so each goes to its nearer end
            last = rows.select("item", (F.col("mass") * 2 > F.col("size")).cast("int").alias("up"))
            return done.unionByName(last)
        blocks = math.ceil(most / BLOCK)
        bucketed = rows.withColumn("_b", F.pmod(F.xxhash64("key", F.lit(level), F.lit(seed)), F.lit(blocks)))
        # large documents first, so that a small one is more likely to stay
        folded = written(
            bucketed.groupBy("source", "_b")
            .agg(F.sort_array(F.collect_list(F.struct("size", "mass", "key", "item")), asc=False).alias("items"))
            .select("source", _fold(F.col("items"), level, seed).alias("f"))
            .select("source", "f.rest", F.col("f.done").alias("out")),
            "mix-level",
        )
        done = done.unionByName(folded.select(F.explode("out").alias("o")).select("o.item", "o.up"))
        rows, level = folded.select("source", "rest.item", "rest.key", "rest.size", "rest.mass"), level + 1


def _with_targets(items: DataFrame, targets: DataFrame) -> DataFrame:
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = targets.withColumnRenamed("source", "_source")
    return items.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


_IDENTITY = ("doc_id", "source", "size", "text_hash")


def _identified(docs: DataFrame) -> DataFrame:
    """What tells documents apart, and all columns of a row as ``whole``."""
    text = F.col("text")
    return docs.select("doc_id", "source", n_words_of(text).alias("size"), F.xxhash64(text).alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))


def _same(left: str, right: str) -> Column:
    on = F.lit(True)
    for c in _IDENTITY:
        on &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def mix_items(rows: DataFrame, seed: int = 0) -> DataFrame:
    """One row for each distinct document of ``rows`` (doc_id, source, size, text_hash): its multiplicity ``m`` and the copies of all its rows together."""
    parts = [c for name in _IDENTITY for c in (F.col(name).isNull(), F.col(name))]
    counted = rows.groupBy(*_IDENTITY).agg(F.count("*").alias("m")).withColumn("key", F.xxhash64(*parts))
    items = written(counted.withColumn("item", F.monotonically_increasing_id()), "mix-items")
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    joined = _with_targets(items, written(source_targets(sizes), "mix-targets"))
    wanted = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(wanted + 1e-9)
    joined = joined.withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(F.lit(0)).cast("long"))
    mass = F.greatest(F.lit(0.0), (wanted - F.col("whole")) * F.col("size"))
    ups = round_copies(joined.where("size > 0").select("source", "item", "key", "size", mass.alias("mass")), seed)
    return written(joined.join(ups, "item", "left").withColumn("copies", F.col("whole") + F.coalesce("up", F.lit(0))), "mix-copies")


def _dealt(rows: DataFrame, items: DataFrame) -> DataFrame:
    """``rows`` (with the identity's columns and ``whole``) as (whole, size, source_size, target, n): each row's share of its item's copies.

    Rows of repeated documents are written with a number of their own; narrow rows of (item, hash of the whole row,
    number) are put in order by range, and each one's place among its item's rows gives its share.
    """
    joined = rows.alias("r").join(items.alias("i"), _same("r", "i"))
    joined = joined.select("r.whole", "i.item", "i.m", "i.copies", "i.size", "i.source_size", "i.target")
    out = ("whole", "size", "source_size", "target")
    once = joined.where("m = 1").select(*out, F.col("copies").alias("n"))
    if items.where("m > 1").isEmpty():
        return once
    again = written(joined.where("m > 1").withColumn("id", F.monotonically_increasing_id()), "mix-repeated")
    placed = written(numbered(again.select("item", "m", "copies", "id", row_hash(again.schema["whole"].dataType, "whole").alias("h")), ["item", "h"]), "mix-places")
    firsts = placed.groupBy("item").agg(F.min("row").alias("first"))
    extra = F.when(F.col("row") - F.col("first") < F.pmod("copies", "m"), 1).otherwise(0)
    share = placed.join(firsts, "item").select("id", (F.expr("copies div m") + extra).alias("n"))
    return once.unionByName(again.join(share, "id").select(*out, "n"))


def op4(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The contract's columns."""
    rows = written(_identified(docs.select("doc_id", "source", "text")).withColumn("whole", F.struct("doc_id")), "mix-rows")
    return _dealt(rows, mix_items(rows.drop("whole"), seed)).select("whole.doc_id", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` in the mix's proportions: rows not taken are gone, rows taken twice are there twice."""
    rows = _identified(docs)
    dealt = _dealt(rows, mix_items(rows.drop("whole"), seed).where("copies > 0"))
    return dealt.where("n > 0").select("whole", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("k")).select("whole.*")
