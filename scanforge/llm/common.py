"""What the operators share: value binding and ASCII word rules, and the tables of the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanforge.tables import drop, new_path, numbered, remove, shared_dir, written

__all__ = ["LOWER", "SPACES", "UPPER", "WORD", "bitmap_of", "drop", "let", "row_hash", "n_words_of", "new_path", "numbered", "remove", "shared_dir", "table", "words_of", "written"]

#: Java regular expression of the white space between words, and of a word.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words (runs of other than ASCII white space) of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words_of(text: Column) -> Column:
    """Number of words as a long, without the empty pieces at either end."""
    return F.size(words_of(text)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hashable(value: Column, kind: T.DataType) -> Column:
    """The value with its maps, at any depth, as sorted arrays of their entries."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(_hashable(e["key"], kind.keyType).alias("key"), _hashable(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType) and _has_map(kind):
        return F.transform(value, lambda e: _hashable(e, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        return F.when(value.isNotNull(), F.struct(*[_hashable(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return F.to_json(value) if isinstance(kind, T.VariantType) else value


def _has_map(kind: T.DataType) -> bool:
    inner = {T.ArrayType: lambda k: [k.elementType], T.StructType: lambda k: [f.dataType for f in k.fields]}.get(type(kind))
    return isinstance(kind, (T.MapType, T.VariantType)) or inner is not None and any(map(_has_map, inner(kind)))


def row_hash(schema: T.StructType, row: str | None = None) -> Column:
    """A 64-bit hash of all columns (of the fields of the struct ``row``), of any type; which of them are null counts."""
    at = (lambda name: F.col(f"`{row}`")[name]) if row else (lambda name: F.col(f"`{name}`"))
    return F.xxhash64(*[c for f in schema.fields for c in (_hashable(at(f.name), f.dataType), at(f.name).isNull())])


def bitmap_of(cells: DataFrame, bits: int) -> bytes:
    """A bitmap of 2**bits bits with those of the only column's values set, lowest bit of a byte first."""
    (cell,) = cells.columns
    placed = cells.selectExpr(f"bitmap_bucket_number(`{cell}` + 1) - 1 AS b", f"bitmap_bit_position(`{cell}` + 1) AS p")  # the functions count from 1
    rows = placed.groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).toLocalIterator()  # 4 kB each, 2**bits bits in all
    out = bytearray(((1 << bits) >> 3) + 4096)
    for row in rows:
        out[row["b"] * 4096 : (row["b"] + 1) * 4096] = row["bits"]
    return bytes(out)
