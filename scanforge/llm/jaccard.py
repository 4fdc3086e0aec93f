"""Exact n-gram Jaccard join: size-banded tiles, bitmap bounds, sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct word 5-grams.  Equal sets are one node
from the start, so exact copies never meet in pairs.

Tiles.  Two sets at similarity t or more share at least ceil(t * size) members, so they share
one among the first ``size - ceil(t * size) + 1`` of each under any one order.  The order is
rarest first, by a counting sketch of fixed size over all documents (a wrong count costs time,
never a link).  A tile is such a member together with a size band (sizes of one binary order):
a set goes to the tiles of its own band, and one within t of the next band also to that band's,
there only to meet sets of that band.  A pair must also pass the position bound: what still
follows the shared member must be able to reach the overlap needed.  Members that the sketch
shows to be in very many documents have their tiles dealt over several tasks by salt.

Links.  A pair's overlap is bounded from above with hashed bitmaps as long as the sets (bits set
on one side alone are members missing on the other), then the sorted arrays are intersected.
All pairs of small tiles are tried at once.  In large tiles, rounds first try promising pairs: each
node with its neighbour in size order and with the tile's hub; components follow by star
contraction, and the last round tries every pair of a tile whose documents are still in
different components.  So a group of thousands of near copies costs about its size, not its
square, and no link between components is lost: the components are exact.  ``links`` gives
every link between nodes instead, and costs as much as there are such pairs.

Nothing about all documents reaches the driver but the sketch (one byte a cell) and a bitmap of
fixed size that says which documents' sets are needed for intersections.  Every intermediate is
a table in the shared folder, removed when it has been read for the last time.

Defined cases: a document of fewer than five words has its whole word sequence as one member;
a null or empty text has none and links with nothing; rows with equal ids are judged by their
own texts; a null id never names a component, but its text links others; an empty table gives an
empty result; further columns don't matter.  Hash collisions (64 bits) can change an overlap by
one with a chance of about size**2 / 2**64 for a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import drop, row_hash, written
from scanforge.llm.pieces import release, slices, words

N = 5
#: Similarity as a fraction: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
SKETCH_BITS = 22
SKETCH_SLICE = 1 << 16
NEEDED_BITS = 24
#: Tiles of at most so many nodes have all their pairs tried at once.
SMALL = 8
#: Neighbours in size order are looked for within blocks of so many rows of a tile.
BLOCK = 64
#: A member's tile is dealt out by salt, one for about so many documents beyond the usual of its cell (255 salts at most).
HOT_ROWS = 2000
#: Rounds of promising pairs in large tiles before all pairs that are left.
ROUNDS = 2
#: Texts are shingled in slices of about so many bytes; pairs and sets travel in Arrow batches of so many rows.
TEXT_BYTES, WIDE_ROWS = 2 << 20, 256
#: Positions beyond are taken as this one, which only loosens a bound.
LAST_POS = (1 << 24) - 1
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _windows(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each text's range of them, the hash of the n words from each place on, and the texts' word counts."""
    dictionary, codes, offsets = words(texts, lower=True)
    distinct = dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct))[codes]
    windows = np.empty(0, np.uint64)
    if len(hashes) >= n:
        windows = hashes[: len(hashes) - n + 1] * _ODD[0]
        for k in range(1, n):
            windows += hashes[k : len(hashes) - n + 1 + k] * _ODD[k]
        windows = _mixed(windows)
    return hashes, offsets, windows, np.diff(offsets)


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """The ascending distinct shingle hashes (uint64) of each text."""
    hashes, offsets, windows, lengths = _windows(texts, n)
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(lengths)
    for i in np.flatnonzero(lengths):
        start, length = int(offsets[i]), int(lengths[i])
        if length >= n:
            found = np.sort(windows[start : start + length - n + 1])
            out[i] = found[np.r_[True, found[1:] != found[:-1]]]
        else:
            mixed = (hashes[start : start + length] * _ODD[:length]).sum(dtype=np.uint64)
            out[i] = _mixed(np.array([mixed ^ np.uint64(length)], dtype=np.uint64))
    return out


def _occurrences(texts: pa.Array, n: int = N) -> np.ndarray:
    """The shingle hashes of all texts, repeats included; texts shorter than a shingle give none."""
    _, offsets, windows, lengths = _windows(texts, n)
    inside = np.ones(len(windows), dtype=bool)
    ends = offsets[1:-1]  # the windows that start up to n - 1 words before a text's end run into the next
    for k in range(1, n):
        at = ends - k
        at = at[(at >= 0) & (at < len(windows))]
        inside[at] = False
    return windows[inside]


def needed(size: int) -> int:
    """The least overlap of a set of this size in a link."""
    return -(-NUMERATOR * size // DENOMINATOR)


def node_of(members: np.ndarray) -> int:
    """A 64-bit identity of a set."""
    if not len(members):
        return 0
    both = np.array([members.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mixed(members + _ODD[1]))], dtype=np.uint64)
    return int(_mixed(both[:1] + _mixed(both[1:] + np.uint64(len(members))))[0].astype(np.int64))


def signature(members: np.ndarray) -> bytes:
    """A bitmap with at least as many bits as members (a power of two, 64 at least)."""
    bits = max(64, 1 << (len(members) - 1).bit_length())
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(members & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def overlap_bound(a: bytes, size_a: int, b: bytes, size_b: int) -> int:
    """An upper bound of the overlap of two sets from their bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):  # bit index modulo the shorter length
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(size_a - int(np.bitwise_count(x & ~y).sum()), size_b - int(np.bitwise_count(y & ~x).sum()))


def linked(overlap: int, size_a: int, size_b: int) -> bool:
    return DENOMINATOR * overlap >= NUMERATOR * (size_a + size_b - overlap)


def _sketch(docs: DataFrame) -> tuple[np.ndarray, float]:
    """A level for each cell of member hashes, and the usual count of a cell.  A level says by how many standard deviations a cell exceeds it, on a log scale.

    A member of many documents stands out of its cell although the cell's usual count grows with the corpus.
    """

    def packed(k: int, task: int, own: np.ndarray) -> dict | None:
        at = np.flatnonzero(own)
        pack = zstandard.ZstdCompressor(level=1).compress
        return {"slice": k, "task": task, "at": pack(at.astype("<u2").tobytes()), "n": pack(own[at].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())} if len(at) else None

    def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
        unpack = zstandard.ZstdDecompressor().decompress
        return np.frombuffer(unpack(row["at"]), "<u2").astype(np.int64), np.ascontiguousarray(np.frombuffer(unpack(row["n"]), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)

    def sent(rows: list[dict | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r for r in rows if r], schema=pa.schema([("slice", pa.int32()), ("task", pa.int64()), ("at", pa.binary()), ("n", pa.binary())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        held, size = [], 0

        def add() -> None:
            at, n = np.unique((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32), return_counts=True)
            cells[at] += np.minimum(n, (1 << 32) - 1 - cells[at]).astype(np.uint32)  # a full cell stays full

        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                held.append(_occurrences(part.column("text")))
                size += len(held[-1])
                if size > 1_000_000:
                    add()
                    held, size = [], 0
        if size:
            add()
        task = TaskContext.get().partitionId()
        held = []
        release()
        yield sent([packed(k, task, cells[k * SKETCH_SLICE : (k + 1) * SKETCH_SLICE]) for k in range(len(cells) // SKETCH_SLICE)])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = sums.setdefault((row["slice"], row["task"]), np.zeros(SKETCH_SLICE, dtype=np.uint32))
                at, n = unpacked(row)
                own[at] += np.minimum(n, (1 << 32) - 1 - own[at])
        for (k, task), own in sums.items():
            yield sent([packed(k, task, own)])

    schema = "slice int, task long, at binary, n binary"
    rows = written(docs.select("text").mapInArrow(count, schema), "jaccard-sketch")
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    n_slices = (1 << SKETCH_BITS) // SKETCH_SLICE
    while True:  # a tree of 32 summands a step
        tasks, before = math.ceil(tasks / 32), rows
        keyed = rows.withColumn("task", F.col("task") % tasks)
        rows = written(keyed.repartition(min(n_slices * tasks, 4096), "slice", "task").mapInArrow(add_up, schema), "jaccard-sketch")
        drop(before)
        if tasks == 1:
            break
    cells = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for row in rows.toLocalIterator():  # n_slices rows
        at, n = unpacked(row)
        cells[row["slice"] * SKETCH_SLICE + at] = n
    drop(rows)
    usual = max(1.0, float(np.median(cells)))
    excess = np.maximum(cells.astype(np.float32) - np.float32(usual), 0) / np.float32(math.sqrt(usual))
    return np.minimum(255, 8 * np.log2(1 + excess)).astype(np.uint8), usual


def _salts(levels: np.ndarray, usual: float) -> np.ndarray:
    """The number of salts of members at these levels."""
    excess = (np.exp2(levels / 8) - 1) * math.sqrt(usual)
    return np.clip(np.ceil(excess / HOT_ROWS), 1, 255).astype(np.int64)


def dealt(node: int, counts: np.ndarray) -> np.ndarray:
    """A node's salt for each of its members with so many salts: 0 only for members that aren't salted."""
    return np.where(counts > 1, 1 + (node & 0x7FFFFFFF) % counts, 0)


def band_of(size: int) -> int:
    return size.bit_length()


def _banded(members: np.ndarray, band: int) -> np.ndarray:
    return (members ^ _mixed(np.array([band], dtype=np.uint64) * _ODD[2])).astype(np.int64)


def tile_keys(members: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Keys of a set's tiles, how many of them (the first) are of its own band, and the levels of their members.

    ``levels``: the members' levels; rare ones come first.
    """
    size = len(members)
    order = np.argsort(levels, kind="stable")
    own = size - needed(size) + 1
    band = band_of(size)
    next_least = 1 << band  # sizes of the next band begin here
    other = 0
    if DENOMINATOR * size >= NUMERATOR * next_least:
        other = size + 1 - -(-NUMERATOR * (size + next_least) // (NUMERATOR + DENOMINATOR))
    first = members[order[:own]]
    keys = np.concatenate([_banded(first, band), _banded(members[order[:other]], band + 1)])
    return keys, own, np.concatenate([levels[order[:own]], levels[order[:other]]])


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, h, n, node, and of one document of each node in a task: signature and tile keys with their salts.

    ``docs`` holds doc_id, text and h, a hash that tells rows apart.
    """
    found, usual = _sketch(docs)
    shared = docs.sparkSession.sparkContext.broadcast((found, _salts(np.arange(256), usual)))  # one byte a cell, and the salts of each level

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rare, deal), seen = shared.value, set()
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                nodes, sizes, signatures, keys, owns, salts = [], [], [], [], [], []
                for members in shingle_sets(part.column("text")):
                    size, node = len(members), node_of(members)
                    nodes.append(node)
                    sizes.append(size)
                    if not size or node in seen:
                        for column in (signatures, keys, owns, salts):
                            column.append(None)
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    key, own, levels = tile_keys(members, rare[(members >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)])
                    salt = dealt(node, deal[levels])
                    signatures.append(signature(members))
                    keys.append(key)
                    owns.append(own)
                    salts.append(salt.astype(np.uint8).tobytes() if salt.any() else None)
                names = ["doc_id", "h", "n", "node", "sig", "keys", "own", "salts"]
                columns = [part.column("doc_id").cast(pa.int64()), part.column("h"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(owns, pa.int32()), pa.array(salts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    schema = "doc_id long, h long, n long, node long, sig binary, keys array<long>, own int, salts binary"
    return written(docs.select("doc_id", "h", "text").mapInArrow(profile, schema), "jaccard-profiles", batch=1000)


def _salted(salt: Column) -> Column:
    """The key with the salt mixed in; doing it again takes it out."""
    return F.col("key").bitwiseXOR(salt * F.lit(0x1E3779B97F4A7C))


def _tiles(profiles: DataFrame) -> DataFrame:
    """(key, block, m, salt, members): tiles of two nodes or more in blocks of their rows by size; members (n, node, pos, own).

    One word holds n, pos, own and the salt.  A tile of a salted member is dealt over the salts, and none of
    its rows is dropped for being alone there.
    """
    rows = profiles.where("keys is not null").select(F.posexplode("keys").alias("i", "key"), "node", "n", "own", "salts")
    pos = F.least(F.when(F.col("i") < F.col("own"), F.col("i")).otherwise(F.col("i") - F.col("own")), F.lit(LAST_POS)).cast("long")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.conv(F.hex(F.substring("salts", F.col("i") + 1, F.lit(1))), 16, 10).cast("long"))
    word = F.shiftleft("n", 33) + F.shiftleft(pos, 9) + F.when(F.col("i") < F.col("own"), 256).otherwise(0) + salt
    rows = rows.select(_salted(salt).alias("tile"), "node", word.alias("w"))
    window = "OVER (PARTITION BY tile ORDER BY w, node)"
    once = rows.selectExpr("*", f"lag(node) {window} AS same").where("same IS NULL OR same <> node").drop("same")  # copies met in several tasks
    near = once.selectExpr("*", f"lag(node) {window} AS before", f"lead(node) {window} AS after").where("before IS NOT NULL OR after IS NOT NULL OR (w & 255) > 0")
    near = near.selectExpr("tile", "node", "w", f"row_number() {window} - 1 AS place", "count(*) OVER (PARTITION BY tile) AS m")
    member = F.struct(F.shiftright("w", 33).alias("n"), "node", F.shiftright(F.col("w").bitwiseAND((1 << 33) - 1), 9).alias("pos"), (F.col("w").bitwiseAND(256) > 0).alias("own"))
    blocks = near.groupBy("tile", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.first("m").alias("m"), F.first("w").bitwiseAND(255).alias("salt"), F.sort_array(F.collect_list(member)).alias("members"))
    blocks = blocks.withColumnRenamed("tile", "key").withColumn("key", _salted(F.col("salt")))
    return written(blocks, "jaccard-tiles")


def _may_link(x: str, y: str) -> str:
    """SQL for the bands, the sizes and the position bound of two rows of a tile, whose columns have these prefixes."""
    n, m = f"{x}n", f"{y}n"
    least = f"ceil({NUMERATOR}.0D * ({n} + {m}) / {NUMERATOR + DENOMINATOR})"
    return f"({x}own OR {y}own) AND {DENOMINATOR} * least({n}, {m}) >= {NUMERATOR} * greatest({n}, {m}) AND ({x}pos >= {LAST_POS} OR {y}pos >= {LAST_POS} OR 1 + least({n} - {x}pos - 1, {m} - {y}pos - 1) >= {least})"


def _pairs_inside(tiles: DataFrame, reach: str) -> DataFrame:
    """(a, b): the pairs of a block whose places are at most ``reach`` apart and that may link."""
    pairs = f"flatten(transform(members, (x, i) -> transform(filter(slice(members, i + 2, {reach}), y -> {_may_link('x.', 'y.')}), y -> struct(least(x.node, y.node) AS a, greatest(x.node, y.node) AS b))))"
    return tiles.select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b")


def _large_rows(tiles: DataFrame) -> DataFrame:
    """(key, block, node, n, pos, own) of the tiles with more than SMALL nodes, salted ones included."""
    large = tiles.where((F.col("m") > SMALL) | (F.col("salt") > 0)).select("key", (F.col("block") * 256 + F.col("salt")).alias("block"), F.explode("members").alias("x"))
    return written(large.select("key", "block", "x.node", "x.n", "x.pos", "x.own"), "jaccard-large")


def _open_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``root``, of the tiles that still hold several components."""
    named = written(rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-named")
    open_keys = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    found = written(named.join(open_keys, "key", "left_semi"), "jaccard-open")
    drop(named)
    return found


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) worth trying next: each node with its neighbour in size order, and with its tiles' hub.

    The hub of a tile is the node whose tiles are the most crowded in all: the original that
    edited copies resemble more than they resemble each other.  Of either kind each node
    keeps the partner it meets in most tiles.
    """
    window = "OVER (PARTITION BY key, block ORDER BY n, node)"
    near = rows.selectExpr("*", *[f"lag({c}) {window} AS p_{c}" for c in ("node", "n", "pos", "own", "root")])
    neighbours = near.where("p_root <> root AND " + _may_link("p_", "")).selectExpr("p_node AS a", "node AS b", "0 AS kind")
    runs = rows.groupBy("key").agg(F.count("*").alias("run"))
    crowd = rows.select("key", "node").join(runs, "key").groupBy("node").agg(F.sum("run").alias("crowd"))
    hubs = rows.join(crowd, "node").groupBy("key").agg(F.max_by(F.struct("node", "n", "pos", "own", "root"), F.struct("crowd", "node")).alias("h"))
    hubs = hubs.selectExpr("key", "h.node AS h_node", "h.n AS h_n", "h.pos AS h_pos", "h.own AS h_own", "h.root AS h_root")
    stars = rows.join(hubs, "key").where("h_root <> root AND " + _may_link("h_", "")).selectExpr("h_node AS a", "node AS b", "1 AS kind")
    met = neighbours.unionByName(stars).groupBy("a", "b", "kind").agg(F.count("*").alias("k"))
    best = met.groupBy("b", "kind").agg(F.max_by("a", F.struct("k", "a")).alias("a"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest(rows: DataFrame, apart: bool = True) -> DataFrame:
    """All pairs (a, b) of a tile that may link, only those of different roots if ``apart``."""
    x = rows.selectExpr("key", "node AS x_node", "n AS x_n", "pos AS x_pos", "own AS x_own", "root AS x_root")
    y = rows.withColumnRenamed("key", "y_key")
    on = "key = y_key AND (x_n < n OR (x_n = n AND x_node < node)) AND " + _may_link("x_", "") + (" AND x_root <> root" if apart else "")
    return x.join(y, F.expr(on)).select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()


def _cell(h: str) -> Column:
    return F.pmod(F.col(h), F.lit(1 << NEEDED_BITS))


def _needed_docs(hashes: DataFrame) -> bytes:
    """A bitmap of fixed size over the rows' hashes."""
    cells = hashes.select(_cell("h").alias("c")).selectExpr("bitmap_bucket_number(c + 1) - 1 AS b", "bitmap_bit_position(c + 1) AS p")  # the functions count from 1
    rows = cells.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()  # 2**NEEDED_BITS bits at most
    out = bytearray(((1 << NEEDED_BITS) >> 3) + 8192)
    for row in rows:
        at = row["b"] * 4096
        out[at : at + 4096] = row["bits"]
    return bytes(out)


def _bounds(a: pa.Array, a_n: np.ndarray, b: pa.Array, b_n: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of pairs of sets from their bitmaps: ``overlap_bound`` for many pairs."""
    out = np.empty(len(a), dtype=np.int64)
    both = [pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (a, b)]
    kinds, which = np.unique(np.stack(both, 1), axis=0, return_inverse=True)
    for k, (la, lb) in enumerate(kinds):
        at = np.flatnonzero(which.reshape(-1) == k)
        x, y = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1) for c in (a, b))
        while x.shape[1] > y.shape[1]:  # bit index modulo the shorter length
            x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
        only = lambda u, v: np.bitwise_count(u & ~v).sum(axis=1, dtype=np.int64)
        out[at] = np.minimum(a_n[at] - only(x, y), b_n[at] - only(y, x))
    return out


def _verified(pairs: DataFrame, profiles: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by bitmaps and then by exact intersection."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_n, b_n = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            most = _bounds(batch.column("a_sig"), a_n, batch.column("b_sig"), b_n)
            yield batch.select(["a", "b"]).filter(pa.array(DENOMINATOR * most >= NUMERATOR * (a_n + b_n - most)))

    side = lambda df, x, value: df.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col(value).alias(f"{x}_{value}"))
    both = pairs.join(side(classes, "a", "sig"), "a").join(side(classes, "b", "sig"), "b")
    left = written(both.select("a", "b", "a_n", "b_n", "a_sig", "b_sig").mapInArrow(bounded, "a long, b long"), "jaccard-bounded", batch=1000)
    nodes = written(left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "h"), "node"), "jaccard-needed")
    wanted = docs.sparkSession.sparkContext.broadcast(_needed_docs(nodes))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(wanted.value, np.uint8), set()
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            hits = batch.filter(pa.array((bits[cells >> 3] >> (cells & 7)) & 1 == 1))
            for part in slices(hits, "text", TEXT_BYTES):
                for h, m in zip(part.column("h").to_pylist(), shingle_sets(part.column("text")), strict=True):
                    node = node_of(m)
                    if node not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(node)
                        yield pa.RecordBatch.from_arrays([pa.array([h], pa.int64()), pa.array([node], pa.int64()), pa.array([len(m)], pa.int64()), pa.array([m.tobytes()], pa.binary())], names=["h", "node", "n", "members"])

    every = docs.select("h", "text", _cell("h").alias("cell")).mapInArrow(sets, "h long, node long, n long, members binary")
    # a repeated row gives its node's set again; the aggregation keeps one
    members = written(every.join(nodes, ["node", "h"], "left_semi").select("node", "n", "members"), "jaccard-sets", batch=1000)
    once = members.dropDuplicates(["node"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_members"), batch.column("b_members"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = left.join(side(once, "a", "members"), "a").join(side(once, "b", "members"), "b")
    found = written(both.select("a", "b", "a_members", "b_members").mapInArrow(exact, "a long, b long"), "jaccard-links", batch=WIDE_ROWS)
    drop(left, nodes, members)
    return found


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in a link: star contraction, each round two joins on narrow rows."""
    edges = written(links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct(), "stars")
    for _ in range(most_rounds):
        ends = edges.selectExpr("u AS node", "1 AS up", "0 AS down").unionByName(edges.selectExpr("v AS node", "0 AS up", "1 AS down"))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break  # every node is a root or hangs from one
        # large star: a node's larger neighbours go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v")
        large = written(large.distinct(), "stars")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").unionByName(least.selectExpr("u", "m AS v"))
        edges = written(small.distinct(), "stars")
    else:
        raise RuntimeError(f"components are not stars after {most_rounds} rounds")
    roots = edges.selectExpr("u AS node", "v AS root")
    return roots.unionByName(edges.selectExpr("v AS node", "v AS root").distinct())


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with further links taken in: only the components they join are contracted, not all links again."""
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    found = written(components(ends), "jaccard-joined")
    moved = roots.join(found.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(moved.unionByName(found.join(roots, "node", "left_anti")), "jaccard-roots")


def _rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash that tells rows with different ids or texts apart."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()).alias("h"))


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, classes, tiles): documents' nodes; nodes' least document id, signature and the row that gives their set; tiles."""
    profiles = _profiles(rows)
    tiles = _tiles(profiles)
    narrow = written(profiles.drop("keys", "own", "salts"), "jaccard-narrow")
    drop(profiles)
    classes = narrow.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("h").alias("h"), F.first("n").alias("n"), F.max("sig").alias("sig"))
    return narrow, written(classes, "jaccard-classes"), tiles


def jaccard_components(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, classes, roots) of rows (doc_id, text, h): documents' nodes, nodes' least ids, and the root of every linked node."""
    profiles, classes, tiles = _grouped(rows)
    inside = _pairs_inside(tiles.where((F.col("m") <= SMALL) & (F.col("salt") == 0)), str(SMALL))
    large = _large_rows(tiles)
    pairs = written(inside.unionByName(_candidates(large.withColumn("root", F.col("node")))).distinct(), "jaccard-pairs")
    drop(tiles)
    roots = written(components(_verified(pairs, profiles, classes, rows)), "jaccard-roots")
    drop(pairs)
    left = _open_rows(large, roots)
    drop(large)
    for _ in range(ROUNDS - 1):
        pairs = written(_candidates(left), "jaccard-pairs")
        if pairs.isEmpty():
            break
        before, roots = (left, roots), _merged(roots, _verified(pairs, profiles, classes, rows))
        left = _open_rows(left, roots)
        drop(pairs, *before)
    pairs = written(_rest(left), "jaccard-rest")
    if pairs.isEmpty():
        return profiles, classes, roots
    return profiles, classes, _merged(roots, _verified(pairs, profiles, classes, rows))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every link (a, b, a < b) between different sets, and membership (doc_id, n, node) of every row; a and b are nodes."""
    rows = _rows_of(docs)
    profiles, classes, tiles = _grouped(rows)
    inside = _pairs_inside(tiles.where((F.col("m") <= SMALL) & (F.col("salt") == 0)), str(SMALL))
    large = _large_rows(tiles).withColumn("root", F.col("node"))
    pairs = written(inside.unionByName(_rest(large)).distinct(), "jaccard-pairs")
    return _verified(pairs, profiles, classes, rows), profiles.select("doc_id", "n", "node")


def _members(profiles: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, h, n, root (null if the set is empty) and component_id of every row."""
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.select("node", "root").join(least, "root").select(F.col("node").alias("_node"), "root", "component_id")
    joined = profiles.join(of_node, (F.col("n") > 0) & (F.col("node") == F.col("_node")), "left")
    return joined.select("doc_id", "h", "n", "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least document id reachable by links) of every row."""
    found = _members(*jaccard_components(_rows_of(docs)))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs)


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the least id (null last), then of the least hash of the row.

    Rows without words link with nothing and all stay, and so do different texts under one id.
    """
    hashed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), row_hash(docs.schema).alias("h"))
    found = _members(*jaccard_components(hashed.select("doc_id", "text", "h")))
    found = written(found.select("doc_id", "h", "n", "root"), "jaccard-found")
    least = found.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("x"))
    chosen = least.select("x.doc_id", "x.h", F.lit(True).alias("one")).unionByName(found.where("n = 0").select("doc_id", "h", F.lit(False).alias("one")).distinct())
    # rows that are equal in all columns share their hash; one of them is enough
    copies = found.groupBy("doc_id", "h").agg(F.count("*").alias("copies"))
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.h") == F.col("r.h"))
    chosen = written(chosen.alias("l").join(copies.alias("r"), on).select("l.doc_id", "l.h", (F.col("one") & (F.col("copies") > 1)).alias("fold")), "jaccard-chosen")
    kept = hashed.alias("l").join(chosen.alias("r"), on).select("l.whole", "l.doc_id", "l.h", "r.fold")
    folded = kept.where("fold").groupBy("doc_id", "h").agg(F.first("whole").alias("whole"))
    return kept.where("not fold").select("whole").unionByName(folded.select("whole")).select("whole.*")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(win, ' ')) AS g FROM (
    SELECT doc_id, list_slice(w, i, i + 4) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, list_concat(w, ['<short>']) FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS doc_id, doc_id AS r FROM d UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(c.r) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id GROUP BY ALL
"""
