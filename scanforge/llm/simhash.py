"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has a bit for each of 64 places: 1 if more than half of the text's word shingles have it in
their hash.  Two fingerprints link when at most ``THRESHOLD`` bits differ; equal fingerprints are one
class from the start.

Anchors.  The 64 bits are cut into blocks, each with a perfect cyclic code: two binary Golay codes of length 23
(every word is within 3 bits of exactly one code word) and two repetition codes of length 9 (within 4).  A code word of
each block makes an anchor; the anchors cover all fingerprints with radius 3 + 3 + 4 + 4 = 14.  A fingerprint has one home, the
anchor within every block's radius.  One that differs from it in t bits is at most t bits farther from that home, over all
blocks, so a fingerprint goes to every anchor whose blocks exceed their radius by ``THRESHOLD`` in all: about 70 of 2**26.
Whatever links meets at the home of either; other meetings of an anchor are chance.

Compare.  At each anchor those at home are compared with all that came, in blocks of fixed size, and what links is
joined there by union-find, so an anchor gives at most one link a row, never a pair list.  Anchors that are home to many (a
count over homes says which) are dealt over several groups: each takes a share of those at home and all that came.  Components of
the links come by star contraction.

Defined cases: a text with fewer words than a shingle is one shingle; a null or empty text, or one without words, has fingerprint
zero and links like any other; repeated rows are one class; a null id takes part, and a component's id is its least id that is not
null (null if there is none); an empty table gives an empty result; texts are read whole however long; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import LOWER, UPPER, bitmap_of, drop, written
from scanforge.llm.pieces import release, slices
from scanforge.operators.graph import components

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Blocks of the 64 bits, from the lowest: length, generator polynomial (bit i: coefficient of x**i) and radius of a perfect cyclic code.
GOLAY, REPEAT_9 = (23, 0b110001110101, 3), (9, 0b111111111, 4)
CODES = (GOLAY, GOLAY, REPEAT_9, REPEAT_9)
#: About so many fingerprints at home share a group; those that came are compared in blocks of this size.
HOMES, CAME = 2000, 1024
TEXT_BYTES = 2 << 20
#: An anchor is told by so many bits.
CELL_BITS = sum(length - generator.bit_length() + 1 for length, generator, _ in CODES)
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text."""
    words = ((text.encode() if isinstance(text, str) else text) or b"").translate(_LOWERED).split()  # exactly \x20 and \x09-\x0D separate
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]][: len(words) - size + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@dataclass
class Code:
    """A block's code: the errors of each syndrome up to a weight, lightest excess over the radius first."""

    length: int
    checks: np.ndarray  # syndrome of each bit
    errors: np.ndarray
    first: np.ndarray  # a syndrome's place in ``errors``
    upto: np.ndarray  # [syndrome, e]: its errors that exceed the radius by e at most

    def syndromes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for i, check in enumerate(self.checks):
            out ^= np.where((values >> np.uint64(i)) & np.uint64(1), check, 0)
        return out


@cache
def code_of(length: int, generator: int, radius: int, threshold: int) -> Code:
    """The cyclic code's table, from its generator polynomial."""
    degree, power, checks = generator.bit_length() - 1, 1, []
    for _ in range(length):
        checks.append(power)
        power <<= 1
        if power >> degree:
            power ^= generator
    rows = []
    for weight in range(min(length, radius + threshold) + 1):
        for bits in combinations(range(length), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= checks[b]
            rows.append((syndrome, max(0, weight - radius), sum(1 << b for b in bits)))
    table = np.array(sorted(rows), dtype=np.int64)
    syndromes = np.arange(1 << degree)
    first = np.searchsorted(table[:, 0], syndromes)
    upto = np.stack([np.bincount(table[table[:, 1] <= e, 0], minlength=1 << degree) for e in range(threshold + 1)], axis=1)
    return Code(length, np.array(checks), table[:, 2].astype(np.uint64), first, upto)


def anchors(prints: np.ndarray, codes: tuple = CODES, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in ``prints``, anchors, home): the anchors of each fingerprint, one of them its home."""
    place, anchor, left = np.arange(len(prints)), prints.copy(), np.full(len(prints), threshold)
    home, shift = np.ones(len(prints), bool), 0
    for one in codes:
        code = code_of(*one, threshold)
        values = (prints >> np.uint64(shift)) & np.uint64((1 << code.length) - 1)
        syndromes = code.syndromes(values)[place]
        n = code.upto[syndromes, left]
        rows = np.repeat(np.arange(len(place)), n)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        s, left = syndromes[rows], left[rows]
        excess = (nth[:, None] >= code.upto[s]).sum(1)
        place, anchor, home, left = place[rows], anchor[rows] ^ (code.errors[code.first[s] + nth] << np.uint64(shift)), home[rows] & (excess == 0), left - excess
        shift += code.length
    return place, anchor, home


def _row_groups(near: np.ndarray) -> np.ndarray:
    """For each row of a boolean matrix the first row that it is connected with through common columns."""
    first, left, columns = np.arange(len(near)), np.ones(len(near), bool), near.sum(0) > 1
    for i in np.flatnonzero(near[:, columns].any(1)):
        if not left[i]:
            continue
        left[i] = False
        new = np.array([i])
        while len(new):
            own = np.flatnonzero(near[new].any(0) & columns)
            columns[own] = False
            new = np.flatnonzero(near[:, own].any(1) & left)
            left[new] = False
            first[new] = i
    return first


def joined(homes: np.ndarray, came: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), at most one for each fingerprint, that connect what pairs within the threshold connect: those at home with each other and with those that came."""
    parent = list(range(len(homes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for block in (homes, came):
        for k in range(0, len(block), CAME):
            part = block[k : k + CAME]
            near = np.bitwise_count(homes[:, None] ^ part[None, :]) <= threshold
            if block is came:
                met = near.any(0)
                a.append(part[met])
                b.append(homes[near[:, met].argmax(0)])
            if len(homes) > 1:
                for i, j in enumerate(_row_groups(near).tolist()):
                    parent[root(i)] = root(j)
    roots = np.array([root(i) for i in range(len(homes))], dtype=np.int64)
    return np.concatenate([homes, *a]), np.concatenate([homes[roots], *b])


def compare(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (anchor, share, home, print) in order of anchor, share and home first."""
    key, homes, came = None, [], []

    def found() -> Iterator[pa.RecordBatch]:
        if homes and (len(homes) > 1 or came):
            a, b = joined(np.array(homes, np.int64).view(np.uint64), np.array(came, np.int64).view(np.uint64))
            apart = a != b
            if apart.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[apart].view(np.int64)), pa.array(b[apart].view(np.int64))], names=["a", "b"])

    for batch in groups:
        if not batch.num_rows:
            continue
        anchor, share = batch.column("anchor").to_numpy(), batch.column("share").to_numpy()
        home, prints = batch.column("home").to_numpy(zero_copy_only=False), batch.column("print").to_numpy()
        cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(share) != 0)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(anchor)], strict=True):
            if key != (anchor[a], share[a]):
                yield from found()
                key, homes, came = (anchor[a], share[a]), [], []
            here = home[a:b]
            homes += prints[a:b][here].tolist()
            came += prints[a:b][~here].tolist()
            if len(came) >= 64 * CAME:  # all at home come first
                yield from found()
                came = []
    yield from found()
    release()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                prints = np.fromiter((fingerprint(t.as_py()) for t in part.column("text").cast(pa.binary())), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return written(rows.mapInArrow(of, "doc_id long, print long"), "simhash-prints", batch=1000)


def _cells(anchor: np.ndarray, codes: tuple = CODES) -> np.ndarray:
    """The anchors' numbers below 2**26: the high bits of each code word, which tell it from all others."""
    cells, shift = np.zeros(len(anchor), np.int64), 0
    for length, generator, _ in codes:
        degree = generator.bit_length() - 1
        cells = (cells << (length - degree)) | ((anchor >> np.uint64(shift + degree)) & np.uint64((1 << (length - degree)) - 1)).astype(np.int64)
        shift += length
    return cells


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column print) that connect exactly what pairs within the threshold connect."""

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, anchor, _ = anchors(batch.column("print").to_numpy().view(np.uint64), threshold=0)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(_cells(anchor))], names=["anchor", "cell"])

    homes = written(prints.mapInArrow(at_home, "anchor long, cell long"), "simhash-homes")
    # only anchors that are somebody's home matter
    homely = prints.sparkSession.sparkContext.broadcast(bitmap_of(homes.select("cell"), CELL_BITS))  # a bit an anchor, 8 MB

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(homely.value, np.uint8)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                own = batch.column("print")[i : i + 2000].to_numpy()
                place, anchor, home = anchors(own.view(np.uint64))
                cells = _cells(anchor)
                at = np.flatnonzero((bits[cells >> 3] >> (cells & 7)) & 1)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(own[place[at]]), pa.array(home[at])], names=["anchor", "print", "home"])

    rows = prints.mapInArrow(placed, "anchor long, print long, home boolean")
    sizes = homes.groupBy("anchor").agg(F.ceil(F.count("*") / HOMES).alias("shares"))
    met = written(rows.join(sizes, "anchor").withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("print"), F.col("shares")))), "simhash-anchors")
    living = met.where("home").select("anchor", F.col("own").alias("share"), "home", "print")
    # each share meets all that came, and those at home in other shares
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")
    guests = met.where("not home or shares > 1").select("anchor", every, F.lit(False).alias("home"), "print", "own").where("own is null or own <> share").drop("own")
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = living.unionByName(guests).repartition(n, "anchor", "share").sortWithinPartitions("anchor", "share", F.desc("home"))
    found = written(dealt.mapInArrow(compare, "a long, b long"), "simhash-links")
    drop(homes, met)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least id reachable by links) of every row."""
    rows = fingerprints(docs)
    classes = written(rows.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "simhash-classes")
    roots = components(links(classes.select("print")))
    named = classes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_print = named.select("print", "root").join(least, "root").select("print", "component_id")
    return rows.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs)
