"""Ranked lexical search over a two-level quantised index.

A document's score for an item is the sum of weight times impact over the item's terms, in integers.
The index has one row for each document with, for every term that is asked for, its number of occurrences
(the exact level) and its impact as a byte, rounded upward (the cheap level).  Bytes bound a score from both sides:

- the bounds pass reads bytes alone and gives each item its k-th highest lower bound, over all documents;
- the rescoring pass finds every document whose upper bound reaches that, and scores it exactly in integers.

So the result is exact, whatever the bytes lose.  In both passes a block of documents is first bounded by the
highest byte of each term in the block; items that the whole block cannot serve go no further.

Items are taken in blocks of ``BLOCK_BYTES`` of terms, and each block is sent to all tasks: the blocks bound what is
broadcast, however many items there are.  The index of a block holds the terms of its items, for every document.  The
passes shuffle at most k rows of an item and task, cut again before they meet.

Defined cases: a null or empty text, or one without terms, is no document of the statistics and scores nothing; an item
without terms, and any item if no document has its terms, has no rows; repeated documents are ranked each, ties of
score and id in any order (their rows are equal), a null id after all others of its score; each row of the items is
an item of its own, so a repeated item repeats its rows; an empty table on either side gives an empty result; texts are read
whole however long; further columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanforge.llm.common import LOWER, UPPER, drop, written
from scanforge.llm.pieces import release, slices

TOP = 20
#: Of the score: an impact is SCALE * tf div (1000 * tf + SATURATION * m), m = 100 - NORM + (NORM * n * N) div L.
SCALE, SATURATION, NORM = 1_000_000_000, 12, 25
#: An impact is below this; one byte stands for a 255th of it.
MOST_IMPACT, LEVELS = 1_000_000, 255
#: Terms of one block of items, in bytes.
BLOCK_BYTES = 8 << 20
TEXT_BYTES = 4 << 20
#: Bytes looked at together: documents of a block times terms of its items.
CELLS = 2_000_000
#: Everything of ASCII but digits and letters separates terms; A-Z are lower-cased; bytes of other characters stay.
_TERMS = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text, in order, repeats included."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_TERMS).split()


@dataclass
class Items:
    """A block of items: their ids, and for each distinct (item, term) the term's number and its repeats."""

    ids: list
    vocabulary: dict[bytes, int]
    starts: np.ndarray  # where each item's terms begin
    terms: np.ndarray
    repeats: np.ndarray


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks; those without terms are left out."""

    def block(rows: list[tuple[object, Counter]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        numbers = [vocabulary.setdefault(t, len(vocabulary)) for _, counts in rows for t in counts]
        sizes = [len(counts) for _, counts in rows]
        return Items([i for i, _ in rows], vocabulary, np.cumsum([0, *sizes[:-1]]), np.array(numbers), np.array([n for _, counts in rows for n in counts.values()]))

    held, size = [], 0
    for row in items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).toLocalIterator():
        if counts := Counter(terms_of(row["t"])):
            held.append((row["i"], counts))
            size += sum(len(t) + 40 for t in counts)
        if size >= most:
            yield block(held)
            held, size = [], 0
    if held:
        yield block(held)


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf): every document's terms of the vocabulary, ascending, and their occurrences, as packed 32-bit integers; n counts all its terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a block's terms

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                sizes, terms, tfs = [], [], []
                for text in part.column("text").cast(pa.binary()):
                    words = terms_of(text.as_py())
                    found = sorted((at, n) for w, n in Counter(words).items() if (at := get(w)) is not None)
                    both = np.array(found, dtype="<u4").reshape(-1, 2)
                    sizes.append(len(words))
                    terms.append(both[:, 0].tobytes())
                    tfs.append(both[:, 1].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tf"])
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return written(rows.mapInArrow(postings, "doc_id long, n long, terms binary, tf binary"), "search-postings", batch=1000)


def document_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents that hold each term; as many rows reach the driver as a block has terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms in batch.column("terms"):
                sums[np.frombuffer(terms.as_buffer(), "<u4")] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for row in index.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return out


def weights_of(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def impacts(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """The exact impacts, in whole numbers below ``MOST_IMPACT``."""
    return SCALE * tf // (1000 * tf + SATURATION * m)


def impact_bytes(exact: np.ndarray) -> np.ndarray:
    """The impacts' bytes, rounded upward: (b - 1) * MOST_IMPACT / LEVELS < impact <= b * MOST_IMPACT / LEVELS."""
    return (-(-exact * LEVELS // MOST_IMPACT)).astype(np.uint8)


def quantise(index: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index with ``m`` and, one for each of its terms, the impact bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ms, levels = [], []
            for n, tf in zip(batch.column("n").to_pylist(), batch.column("tf"), strict=True):
                ms.append(100 - NORM + NORM * n * n_docs // max(n_terms, 1))
                levels.append(impact_bytes(impacts(np.frombuffer(tf.as_buffer(), "<u4").astype(np.int64), ms[-1])).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ms, pa.int64()), pa.array(levels, pa.binary())], names=[*batch.schema.names, "m", "levels"])

    return written(index.where("octet_length(terms) > 0").mapInArrow(add, "doc_id long, n long, terms binary, tf binary, m long, levels binary"), "search-index", batch=1000)


@dataclass
class Scorer:
    """Sums of weighted bytes or impacts over the items' terms, for blocks of documents."""

    items: Items
    weights: np.ndarray  # of each distinct (item, term), repeats included

    def sums(self, table: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Documents x the chosen items: weighted sums of ``table`` (documents x terms)."""
        if len(which) == len(self.items.ids):
            at, starts = slice(None), self.items.starts
        else:
            ends = np.r_[self.items.starts[1:], len(self.items.terms)]
            sizes = (ends - self.items.starts)[which]
            starts = np.cumsum(sizes) - sizes
            at = np.repeat(self.items.starts[which] - starts, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(table[:, self.items.terms[at]] * self.weights[at], starts, axis=1)

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, bytes as documents x terms) of each block of a batch."""
        n_terms = len(self.items.vocabulary)
        step = max(1, CELLS // max(len(self.items.terms), n_terms))
        for first in range(0, batch.num_rows, step):
            rows = batch.slice(first, step)
            table = np.zeros((rows.num_rows, n_terms), np.uint8)
            for i, (terms, levels) in enumerate(zip(rows.column("terms"), rows.column("levels"), strict=True)):
                table[i, np.frombuffer(terms.as_buffer(), "<u4")] = np.frombuffer(levels.as_buffer(), np.uint8)
            yield first, table

    def able(self, table: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The items for which a document as good as the block's best in every term would reach ``least``."""
        best = self.sums(table.max(0, keepdims=True), np.arange(len(self.items.ids)))[0]
        return np.flatnonzero((best >= least) & (best > 0))


def kth_lower_bounds(index: DataFrame, scorer: Scorer, top: int = TOP) -> np.ndarray:
    """Each item's ``top``-th highest lower bound over all documents, 0 where fewer have one above 0."""
    shared = index.sparkSession.sparkContext.broadcast(scorer)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = np.zeros((len(own.items.ids), top), np.int64)
        for batch in batches:
            for _, table in own.blocks(batch):
                least = np.maximum(table, 1) - 1  # what is certain of a byte
                which = own.able(least, best.min(1) + 1)
                if len(which):
                    both = np.concatenate([best[which], own.sums(least, which).T], axis=1)
                    best[which] = np.partition(both, both.shape[1] - top, axis=1)[:, -top:]
        item, at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best[item, at])], names=["item", "bound"])
        release()

    rows = index.select("terms", "levels").mapInArrow(bound, "item long, bound long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"))
    kth = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).where(F.col("rank") == top)
    out = np.zeros(len(scorer.items.ids), np.int64)
    for row in kth.select("item", "bound").toLocalIterator():  # one row an item
        out[row["item"]] = row["bound"]
    return out


def rescored(index: DataFrame, scorer: Scorer, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score): exact scores of every document whose upper bound reaches the item's ``least``."""
    shared = index.sparkSession.sparkContext.broadcast((scorer, least))

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, floor = shared.value
        for batch in batches:
            ids, items, scores = [], [], []
            for first, table in own.blocks(batch):
                which = own.able(table, floor)
                if not len(which):
                    continue
                upper = own.sums(table, which)
                reach = (upper >= floor[which]) & (upper > 0)
                for i in np.flatnonzero(reach.any(1)):
                    row = first + int(i)
                    tf = np.frombuffer(batch.column("tf")[row].as_buffer(), "<u4").astype(np.int64)
                    exact = np.zeros((1, table.shape[1]), np.int64)
                    exact[0, np.frombuffer(batch.column("terms")[row].as_buffer(), "<u4")] = impacts(tf, batch.column("m")[row].as_py())
                    chosen = which[reach[i]]
                    score = own.sums(exact, chosen)[0]
                    ids += [batch.column("doc_id")[row].as_py()] * int((score > 0).sum())
                    items.append(chosen[score > 0])
                    scores.append(score[score > 0])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items), pa.int64()), pa.array(ids, pa.int64()), pa.array(np.concatenate(scores), pa.int64())], names=["item", "doc_id", "score"])
        release()

    return index.select("doc_id", "terms", "tf", "m", "levels").mapInArrow(rescore, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents of all."""
    spark, found = docs.sparkSession, None
    for block in item_blocks(items, item_id, "text", block_bytes):
        postings = build_index(docs, block.vocabulary)
        whole = postings.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        weights = weights_of(document_frequencies(postings, len(block.vocabulary)), whole["n"])
        index = quantise(postings, whole["n"], whole["l"])
        drop(postings)
        scorer = Scorer(block, weights[block.terms] * block.repeats)
        best = written(rescored(index, scorer, kth_lower_bounds(index, scorer, top)), "search-scores")
        drop(index)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {dict(items.dtypes)[item_id]}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ranked = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return spark.createDataFrame([], f"item_id {dict(items.dtypes)[item_id]}, rank int, doc_id long, score long")
    return found


def op12(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns."""
    return search(docs, items)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, row_number() OVER () AS iid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
q AS (SELECT item_id, iid, term, count(*) AS c FROM (SELECT item_id, iid, unnest(w) AS term FROM b) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
m AS (SELECT rid, doc_id, 100 - {NORM} + ({NORM} * len(w) * s.n) // greatest(s.l, 1) AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY term),
x AS (
  SELECT iid, item_id, rid, doc_id, sum(c * weight * (({SCALE} * tf) // (1000 * tf + {SATURATION} * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN t USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, rid)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
