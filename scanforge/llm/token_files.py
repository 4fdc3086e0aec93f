"""Token ids as Arrow files of fixed-size lists.

The ids of all documents, each closed by an end id, form one stream in ascending document
id order.  It is cut into sequences of equal length; a file holds record batches of
``BATCH_SEQUENCES`` sequences with two fixed-size-list columns, ``ids`` and ``mask`` (false
where the file's last sequence is padded).  Nothing is compressed, so a mapped file gives
sequence i as a view, without reading the rest.  Beside each file lies an index of its
documents (id, first position, number of ids).

Plan: the texts are range-partitioned by document id (the format needs the order), sorted
within their range and encoded by Arrow batches; a task holds one slice of text and one batch
of sequences.  Each task attempt writes files of its own name and returns them as a manifest
row; only the rows of successful attempts count, so retries and lost executors leave unused
files, never wrong ones.  Offsets between files come from one total for each file.

The tokenizers library encodes each distinct piece of text once for as long as the worker
remembers it (see ``pieces`` for why that equals encoding whole texts).  A text that holds the string of an
added token is encoded whole, so that the library finds the token there as it does by default.

The files lie in the shared folder and are opened with Arrow, under the scheme that Spark gives the path.

Defined cases: a null or empty text is the end id alone; null ids come first; equal ids are
ordered by their position in the input; an empty table gives an empty result; a very long text is a
slice of its own; further columns don't matter.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanforge.llm.common import new_path, written
from scanforge.llm.pieces import PieceEncoder, release, slices

SEQUENCE = 2048
BATCH_SEQUENCES = 64
END_ID = 2
LEAST_PART, MOST_PART = 4 << 20, 256 << 20
#: Texts are encoded in slices of about so many bytes: the larger, the more pieces are shared.
ENCODED_BYTES = 8 << 20
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def tokenizer_encoder(tokenizer_path: str, special_in_text: bool = True) -> tuple[PieceEncoder, int]:
    """This worker's encoder by the tokenizers library, with what it remembers, and the size of its vocabulary.

    ``special_in_text``: whether the string of a special token in a text is that token, as the library has it by
    default, or ordinary text.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = not special_in_text
    parts = json.loads(tokenizer.to_str())
    before = parts["pre_tokenizer"] or {}
    cuts = not parts["normalizer"] and not parts["truncation"] and not parts["padding"] and before.get("type") == "ByteLevel" and before.get("use_regex") is True and not before.get("add_prefix_space")
    whole = tuple(t["content"] for t in parts["added_tokens"] if special_in_text or not t["special"])
    batch = 2048

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for i in range(0, len(texts), batch) for e in tokenizer.encode_batch_fast(texts[i : i + batch], add_special_tokens=False)]

    return PieceEncoder(encode, cuts=cuts, whole=whole), tokenizer.get_vocab_size()


#: Names that Hadoop has for stores which Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _local(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, rest = uri.split(":", 1)
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark's default file system gives it; the files must be in a store that all executors share."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    scheme, rest = uri.split(":", 1)
    if scheme not in ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss", *_SCHEMES):
        raise ValueError(f"Arrow opens no files under {scheme}://; give another folder as `out`")
    return f"{scheme}://" + "/" * (scheme == "file") + rest.lstrip("/")


def part_count(rows: DataFrame, size: Column) -> int:
    """Partitions for rows of these sizes: the session's number, unless parts would be under LEAST_PART or over MOST_PART bytes."""
    total = rows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(n, -(-total // LEAST_PART)), -(-total // MOST_PART))


class SequenceWriter:
    """Appends ids; writes full batches of equal-length sequences as they fill."""

    def __init__(self, sink: pa.NativeFile, id_type: pa.DataType, length: int = SEQUENCE, sequences: int = BATCH_SEQUENCES) -> None:
        self.length, self.rows, self.type = length, sequences, id_type
        self.schema = pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        per_batch = self.length * self.rows
        if self.n_held >= per_batch:
            ids = np.concatenate(self.held)
            full = len(ids) // per_batch * per_batch
            for at in range(0, full, per_batch):
                self._write(ids[at : at + per_batch], per_batch)
            self.held, self.n_held = [ids[full:]], len(ids) - full

    def _write(self, ids: np.ndarray, n_real: int) -> None:
        mask = np.arange(len(ids)) < n_real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(self.type.to_pandas_dtype())), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        if len(ids):
            padded = np.zeros(-(-len(ids) // self.length) * self.length, dtype=ids.dtype)
            padded[: len(ids)] = ids
            self._write(padded, len(ids))
        self.file.close()


class TokenFile:
    """Random access to a file's sequences, and to its documents by their positions."""

    def __init__(self, uri: str) -> None:
        system, path = _local(uri)
        self._source = pa.memory_map(path) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(path)
        self._reader = pa.ipc.open_file(self._source)
        self.length = self._reader.schema.field("ids").type.list_size
        self._batches: dict[int, tuple[np.ndarray, pa.Array]] = {}
        first = self._reader.get_batch(0).num_rows if self._reader.num_record_batches else 0
        self.per_batch = first or 1

    def __len__(self) -> int:
        n = self._reader.num_record_batches
        return 0 if not n else (n - 1) * self.per_batch + self._reader.get_batch(n - 1).num_rows

    def _batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        if k not in self._batches:
            batch = self._reader.get_batch(k)
            self._batches = {k: (batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten())}
        return self._batches[k]

    def sequence(self, i: int) -> np.ndarray:
        """The ids of sequence i, a view of the mapped file."""
        ids, _ = self._batch(i // self.per_batch)
        at = i % self.per_batch * self.length
        return ids[at : at + self.length]

    def mask(self, i: int) -> np.ndarray:
        _, mask = self._batch(i // self.per_batch)
        return mask.slice(i % self.per_batch * self.length, self.length).to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from position ``start`` of the file."""
        per, out = self.per_batch * self.length, []
        while n > 0:
            ids, _ = self._batch(start // per)
            got = ids[start % per : start % per + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)


@dataclass(frozen=True)
class TokenDataset:
    """The files of a run: a manifest table (file, index, part, n_docs, n_tokens, base)."""

    manifest: DataFrame

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file, index, base in zip(*(batch.column(c).to_pylist() for c in ("file", "index", "base")), strict=True):
                    tokens = TokenFile(file)
                    system, path = _local(index)
                    with pa.ipc.open_file(system.open_input_file(path)) as rows:
                        for k in range(rows.num_record_batches):
                            part = rows.get_batch(k)
                            starts, counts = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                            crcs = [zlib.crc32(tokens.span(s, n).astype("<u4").data) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                            columns = [part.column("doc_id"), pa.array(starts + base), part.column("n_tokens"), pa.array(crcs, pa.int64())]
                            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

        files = self.manifest.select("file", "index", "base")
        return files.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, length: int = SEQUENCE, out: str | None = None, special_in_text: bool = True) -> TokenDataset:
    """Encodes every text and writes the files under ``out`` (a new shared folder, if None)."""
    spark = docs.sparkSession
    uri = _qualified(spark, out or new_path(spark, "tokens"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocab = tokenizer_encoder(tokenizer_path, special_in_text)
        id_type = pa.uint16() if vocab <= 1 << 16 else pa.uint32()
        writer = index = None
        n_docs = n_tokens = 0
        name = f"{uri}/{uuid.uuid4().hex}"
        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                if writer is None:
                    system, base = _local(name)
                    system.create_dir(os.path.dirname(base), recursive=True)
                    sinks = system.open_output_stream(base + ".arrow"), system.open_output_stream(base + ".index.arrow")
                    writer = SequenceWriter(sinks[0], id_type, length)
                    index = pa.ipc.new_file(sinks[1], INDEX)
                ids, bounds = encoder(part.column("text"))
                counts = np.diff(bounds) + 1
                ends = np.cumsum(counts)
                closed = np.full(int(ends[-1]), end_id, dtype=np.uint32)
                real = np.ones(len(closed), dtype=bool)
                real[ends - 1] = False
                closed[real] = ids
                writer.append(closed)
                index.write_batch(pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(n_tokens + ends - counts), pa.array(counts)], schema=INDEX))
                n_docs, n_tokens = n_docs + part.num_rows, n_tokens + int(ends[-1])
        release()
        if writer is not None:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            from pyspark import TaskContext

            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name + ".arrow"], "index": [name + ".index.arrow"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    n_parts = part_count(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    keyed = docs.select("doc_id", "text").withColumn("_tie", F.monotonically_increasing_id())
    order = ["doc_id", "_tie"]  # the bounds are sampled without reading a text
    ranged = keyed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = written(ranged.mapInArrow(encode, "part int, file string, index string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return TokenDataset(manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))))


def op1(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The contract's columns, read back from the files."""
    return write_tokens(docs, tokenizer_path).documents()
