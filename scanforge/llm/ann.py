"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of ``BOOKS`` codebooks, all over the full
dimension.  The codebooks are k-means over successive residuals, each then refitted against what the
others leave.  Encoding is a beam search over the books.  With the norm of its sum stored, a
vector's distance to a query needs only one table look-up for each book; the ``RERANK``
nearest by that estimate are measured exactly, in double precision, on the original vectors.

Equal vectors: beyond the ``k + 1`` smallest rows of one vector none can be among the ``k`` nearest,
since ties go to the smaller id, so the index leaves the others out and loses nothing.

Fitting uses at most ``FIT_ROWS`` vectors (those with the smallest row hashes).  The index is a table of
chunks of codes, which stays where it lies: the queries pass it in rounds of ``QUERY_BYTES``, each round's are
broadcast, and a task goes through its chunks with one block of them after the other.  So no code is shuffled, what is shuffled are the
``RERANK`` best of a query and task, and a round's broadcast is bounded however many queries there are.
Only (query, row) pairs of the best come back to the vectors.

Defined cases: vectors that are null, zero, or hold null, NaN or infinite components take no
part, nor do those whose length isn't the most common one (the smaller on a tie); rows with a null id
take no part; rows with equal ids are each a candidate, and each a query of its own; an empty table
gives an empty result; with fewer than ``k`` candidates all are returned; further columns don't matter.
Components are doubles throughout; the codes are of vectors shifted and scaled to the sample's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanforge.llm.common import written

BOOKS, WORDS, BEAM = 28, 256, 4
FIT_ROWS = 16_384
RERANK = 256
QUERY_BLOCK = 256
CHUNK = 8192
#: Chunks that a task holds while the blocks of queries pass, and bytes of query vectors in a round.
GROUP, QUERY_BYTES = 64, 64 << 20


def is_usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class AdditiveQuantizer:
    books: np.ndarray  # (books, words, dimension)

    @classmethod
    def fit(cls, sample: np.ndarray, n_books: int = BOOKS, n_words: int = WORDS, rounds: int = 5, refits: int = 1, seed: int = 0) -> AdditiveQuantizer:
        rng = np.random.default_rng(seed)
        n_words = max(1, min(n_words, len(sample)))
        rest, books = sample.astype(np.float32), []
        for _ in range(n_books):
            words = rest[rng.choice(len(rest), n_words, replace=False)].copy()
            for _ in range(rounds):
                nearest = _nearest(rest, words)
                sums = np.zeros_like(words)
                np.add.at(sums, nearest, rest)
                counts = np.bincount(nearest, minlength=n_words)
                words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], rest[rng.integers(0, len(rest), n_words)])
            rest = rest - words[_nearest(rest, words)]
            books.append(words)
        fitted = cls(np.stack(books).astype(np.float32))
        for _ in range(refits):
            codes, _ = fitted.encode(sample)
            own = fitted.books.copy()
            left = sample.astype(np.float32) - sum(own[m][codes[:, m]] for m in range(n_books))
            for m in range(n_books):  # each book anew against what the others leave
                left += own[m][codes[:, m]]
                sums = np.zeros_like(own[m])
                np.add.at(sums, codes[:, m], left)
                counts = np.bincount(codes[:, m], minlength=n_words)
                own[m] = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], own[m])
                left -= own[m][codes[:, m]]
            fitted = cls(own)
        return fitted

    def encode(self, vectors: np.ndarray, beam: int = BEAM, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) and the squared norms of the sums they stand for."""
        vectors = vectors.astype(np.float32)
        n_books, n_words, dim = self.books.shape
        codes = np.empty((len(vectors), n_books), dtype=np.uint8)
        norms = np.empty(len(vectors), dtype=np.float32)
        for at in range(0, len(vectors), chunk):
            x = vectors[at : at + chunk]
            row = np.arange(len(x))[:, None]
            rest, error = x[:, None, :], np.einsum("nd,nd->n", x, x)[:, None]
            path = np.zeros((len(x), 1, 0), dtype=np.uint8)
            for m in range(n_books):
                words = self.books[m]
                scores = (error[:, :, None] - 2 * (rest @ words.T) + np.einsum("kd,kd->k", words, words)).reshape(len(x), -1)
                width = min(beam, scores.shape[1])
                best = np.argpartition(scores, width - 1, axis=1)[:, :width]
                parent, word = best // n_words, best % n_words
                error = np.take_along_axis(scores, best, 1)
                rest = rest[row, parent] - words[word]
                path = np.concatenate([path[row, parent], word[:, :, None].astype(np.uint8)], axis=2)
            won = error.argmin(1)
            codes[at : at + chunk] = path[row[:, 0], won]
            total = x - rest[row[:, 0], won]
            norms[at : at + chunk] = np.einsum("nd,nd->n", total, total)
        return codes, norms

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """-2 q.c for each query, book and word."""
        return -2 * np.einsum("qd,mkd->qmk", queries.astype(np.float32), self.books, optimize=True)


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    half = np.einsum("kd,kd->k", words, words) / 2
    return np.concatenate([(half - x[i : i + 4096] @ words.T).argmin(1) for i in range(0, len(x), 4096)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v) of the vectors that take part; ``row`` is unique, and rows of equal ids have ascending numbers."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & is_usable(F.col("v")))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.col("n").desc(), "d").limit(1).first()
    return rows.where(F.size("v") == (first["d"] if first else 0)).select("row", "id", "v")


@dataclass(frozen=True)
class Index:
    """``vectors``: (row, id, v) of all; ``chunks``: rows of packed row numbers, ids, codes and norms."""

    vectors: DataFrame
    chunks: DataFrame
    quantizer: AdditiveQuantizer | None
    shift: np.ndarray
    scale: float
    k: int


def _scaled(vectors: np.ndarray, shift: np.ndarray, scale: float) -> np.ndarray:
    """In units of the sample, within the range whose squares a float holds."""
    return np.clip(vectors / scale - shift, -1e15, 1e15).astype(np.float32)


def build_index(vectors: DataFrame, k: int = 10) -> Index:
    """The index of (row, id, v) for up to ``k`` neighbours, its quantizer fitted on a sample."""
    n = vectors.count()
    share = min(1.0, 1.5 * FIT_ROWS / max(n, 1))
    bucket = F.pmod(F.xxhash64("id", "row"), F.lit(1 << 30))
    sample = vectors.where(bucket < int(share * (1 << 30)) + 1).orderBy(F.xxhash64("id", "row")).limit(FIT_ROWS).select("v").toArrow()
    if not sample.num_rows:
        return Index(vectors, vectors, None, np.empty(0), 1.0, k)
    dim = len(sample.column("v")[0])
    matrix = _matrix(sample.column("v").combine_chunks(), dim)
    scale = float(np.median(np.abs(matrix).max(axis=1))) or 1.0
    shift = np.median(matrix / scale, axis=0)
    spread = float(np.median(np.abs(matrix / scale - shift).max(axis=1)))
    if 0 < spread < 1:  # vectors far from zero and near each other
        shift, scale = shift / spread, scale * spread
    quantizer = AdditiveQuantizer.fit(_scaled(matrix, shift, scale))
    shared = vectors.sparkSession.sparkContext.broadcast((quantizer.books, shift, scale))  # BOOKS x WORDS x dimension
    kept = vectors.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id", "row"))).where(F.col("place") <= k + 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, shift, scale = shared.value
        own, held, size = AdditiveQuantizer(books), [], 0

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate(x).tobytes() for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], names=["rows", "ids", "codes", "norms"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                codes, norms = own.encode(_scaled(_matrix(batch.column("v"), dim), shift, scale))
                held.append((batch.column("row").to_numpy(), batch.column("id").to_numpy(), codes, norms))
                size += batch.num_rows
                if size >= CHUNK:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    chunks = kept.select("row", "id", "v").mapInArrow(encode, "rows binary, ids binary, codes binary, norms binary")
    return Index(vectors, written(chunks.withColumn("chunk", F.monotonically_increasing_id()), "ann-chunks"), quantizer, shift, scale, k)


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k smallest (score, id, other) of each row."""
    order = np.lexsort((others, ids, scores, rows))
    rows, scores, ids, others = rows[order], scores[order], ids[order], others[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.empty(0, bool)
    rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    keep = rank < k
    return rows[keep], scores[keep], ids[keep], others[keep]


def _blocks(queries: DataFrame, n_blocks: int, dim: int) -> DataFrame:
    """(block, q_rows, q): packed row numbers and vectors of the queries, by hash of the row."""

    def pack(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        vectors = _matrix(table.column("v").combine_chunks(), dim)
        return pa.table({"block": pa.array([block], pa.int64()), "q_rows": [table.column("row").to_numpy().tobytes()], "q": [vectors.tobytes()]})

    keyed = queries.select("row", "v", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block"))
    return keyed.groupBy("block").applyInArrow(pack, "block long, q_rows binary, q binary")


def _passed(index: Index, held: list[tuple[bytes, bytes]], rerank: int, before: DataFrame | None) -> DataFrame:
    """(query_row, vec_row, vec_id, estimate): the best of each task for these blocks of queries, after those of ``before``."""
    shared = index.vectors.sparkSession.sparkContext.broadcast((index.quantizer.books, index.shift, index.scale, held))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, shift, scale, blocks = shared.value
        own = AdditiveQuantizer(books)
        none = (np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64), np.empty(0, np.int64))
        found, chunks = [none] * len(blocks), []

        def meet() -> None:
            for k, (q_rows, q) in enumerate(blocks):
                rows_q = np.frombuffer(q_rows, np.int64)
                tables = own.tables(_scaled(np.frombuffer(q, np.float64).reshape(len(rows_q), -1), shift, scale))
                for rows, ids, norms, codes in chunks:
                    estimate = np.repeat(norms[None, :], len(rows_q), 0)
                    for m in range(codes.shape[1]):
                        estimate += tables[:, m, :][:, codes[:, m]]
                    estimate[rows_q[:, None] == rows[None, :]] = np.inf
                    most = min(len(rows), rerank)
                    edge = np.partition(estimate, most - 1, axis=1)[:, most - 1 : most]
                    at, column = np.nonzero((estimate <= edge) & (estimate < np.inf))
                    f = found[k]
                    found[k] = _best(np.r_[f[0], at], np.r_[f[1], estimate[at, column]], np.r_[f[2], ids[column]], np.r_[f[3], rows[column]], rerank)
            chunks.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                rows, ids, norms = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("rows", np.int64), ("ids", np.int64), ("norms", np.float32)))
                chunks.append((rows, ids, norms, np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(len(rows), -1)))
                if len(chunks) >= GROUP:
                    meet()
        meet()
        for (q_rows, _), f in zip(blocks, found, strict=True):
            columns = [pa.array(np.frombuffer(q_rows, np.int64)[f[0]]), pa.array(f[3]), pa.array(f[2]), pa.array(f[1].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_row", "vec_row", "vec_id", "estimate"])

    # a task gives RERANK rows a query, so none goes through fewer than GROUP chunks
    spread = index.chunks.coalesce(max(1, math.ceil(index.chunks.count() / GROUP)))
    met = written(spread.select("rows", "ids", "codes", "norms").mapInArrow(search, "query_row long, vec_row long, vec_id long, estimate double"), "ann-near", batch=16)
    return met if before is None else before.unionByName(met)


def nearest(index: Index, queries: DataFrame, rerank: int = RERANK) -> DataFrame:
    """query_row, query_id, rank, vec_row, vec_id and score of each query's ``k`` nearest other rows.

    ``queries`` are rows of the index's vectors (row, id, v).
    """
    spark, k = index.vectors.sparkSession, index.k
    n_queries = queries.count() if index.quantizer else 0
    if not n_queries:
        return spark.createDataFrame([], "query_row long, query_id long, rank int, vec_row long, vec_id long, score double")
    dim = index.quantizer.books.shape[2]
    blocks = written(_blocks(queries, math.ceil(n_queries / QUERY_BLOCK), dim), "ann-blocks")
    near, held, size = None, [], 0
    for row in blocks.select("q_rows", "q").toLocalIterator():  # a round at a time
        held.append((bytes(row["q_rows"]), bytes(row["q"])))
        size += len(held[-1][1])
        if size >= QUERY_BYTES:
            near, held, size = _passed(index, held, rerank, near), [], 0
    if held:
        near = _passed(index, held, rerank, near)
    by_estimate = Window.partitionBy("query_row").orderBy("estimate", "vec_id", "vec_row")
    near = near.withColumn("place", F.row_number().over(by_estimate)).where(F.col("place") <= rerank).select("query_row", "vec_row")
    of = lambda name, rows: rows.select(F.col("row").alias(f"{name}_row"), F.col("id").alias(f"{name}_id"), F.col("v").alias(f"{name}_v"))
    met = near.join(of("vec", index.vectors), "vec_row").join(of("query", queries), "query_row")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                diff = _matrix(batch.column("vec_v"), dim) - _matrix(batch.column("query_v"), dim)
                score = pa.array(np.sqrt(np.square(diff).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_row", "query_id", "vec_row", "vec_id")), score], names=["query_row", "query_id", "vec_row", "vec_id", "score"])

    scored = met.mapInArrow(exact, "query_row long, query_id long, vec_row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "vec_row")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_row", "vec_id", "score")


def op7(embeddings: DataFrame) -> DataFrame:
    """The contract's columns: queries are the rows whose id is divisible by 100."""
    vectors = usable(embeddings, "vec_id", "embedding")
    return nearest(build_index(vectors), vectors.where("id % 100 = 0")).select("query_id", "rank", "vec_id", "score")
