"""Binary scans, rasters and masks, by their public formats."""

from __future__ import annotations

import io
import math
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from scanforge.operators.points import with_stats
from scanforge.sources.text import scan_name

#: Bytes of a file that one task reads, and records of one batch.
RUN_BYTES, RECORDS_PER_BATCH = 32 << 20, 200_000

#: Fixed layout of LAS point records: name, kind, byte offset (formats 0-3, then 6-8).
LAS_OLD = {"X": ("<i4", 0), "Y": ("<i4", 4), "Z": ("<i4", 8), "Intensity": ("<u2", 12), "flags": ("u1", 14), "class_id": ("u1", 15)}
LAS_NEW = {"X": ("<i4", 0), "Y": ("<i4", 4), "Z": ("<i4", 8), "Intensity": ("<u2", 12), "flags": ("u1", 14), "class_id": ("u1", 16)}
LAS_COLOUR_AT = {2: 20, 3: 28, 7: 30, 8: 30}
LAS_SCHEMA = "scan_id string, point_id long, X double, Y double, Z double, Intensity int, return_number int, class_id int, r int, g int, b int"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def las_header(raw: bytes) -> dict[str, object]:
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    if raw[104] & 0xC0:
        raise ValueError("compressed (LAZ) records; only uncompressed LAS can be read")
    minor, start, kind, length, n = raw[25], *struct.unpack_from("<I", raw, 96), raw[104] & 63, *struct.unpack_from("<H", raw, 105), *struct.unpack_from("<I", raw, 107)
    if minor >= 4 and len(raw) >= 255:
        n = struct.unpack_from("<Q", raw, 247)[0] or n
    return {"start": start, "format": kind, "length": length, "n": n, "scale": struct.unpack_from("<3d", raw, 131), "offset": struct.unpack_from("<3d", raw, 155), "box": struct.unpack_from("<6d", raw, 179)}


class LasPartition(InputPartition):
    """The records of a file that begin within a range of its bytes."""

    def __init__(self, path: str, name: str, low: int, high: int) -> None:
        self.path, self.name, self.low, self.high = path, name, low, high


class LasReader(DataSourceReader):
    """A partition for each run of bytes, from a listing of the files alone; its task reads the header and its own records.

    Bounds on X, Y and Z that a query filters by skip files whose header's box is elsewhere, and rows before they leave the task;
    only the columns asked for are decoded.
    """

    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns
        self.box = {a: [-math.inf, math.inf] for a in "XYZ"}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - the interface's name
        for f in filters:
            axis = getattr(f, "attribute", None)
            if axis and len(axis) == 1 and axis[0] in self.box and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                bounds, value = self.box[axis[0]], float(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    bounds[0] = max(bounds[0], value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    bounds[1] = min(bounds[1], value)
            yield f  # the bounds are only looked at roughly: Spark filters the rows again

    def partitions(self) -> list[LasPartition]:
        system, base = _open(self.path)
        info = system.get_file_info(base)
        single = info.type == pafs.FileType.File
        files = [info] if single else [f for f in system.get_file_info(pafs.FileSelector(base, recursive=True)) if f.path.lower().endswith((".las", ".laz"))]
        root = base.rsplit("/", 1)[0] if single else base.rstrip("/")
        return [LasPartition(f.path, f.path[len(root) + 1 :], low, min(low + RUN_BYTES, f.size)) for f in sorted(files, key=lambda f: f.path) for low in range(0, f.size, RUN_BYTES)]

    def _elsewhere(self, header: dict[str, object]) -> bool:
        """Whether the header's box (greatest and least X, then Y, then Z) misses what is asked for."""
        box, step = header["box"], header["scale"]  # records are rounded to whole steps
        if not any(box):  # not filled in
            return False
        return any(box[2 * i] + step[i] < low or box[2 * i + 1] - step[i] > high for i, (low, high) in enumerate(self.box.values()))

    def read(self, partition: LasPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as source:
            h = las_header(source.read_at(375, 0))
            if self._elsewhere(h):
                return
            first, last = (min(h["n"], max(0, -(-(at - h["start"]) // h["length"]))) for at in (partition.low, partition.high))
            for at in range(first, last, RECORDS_PER_BATCH):
                n = min(RECORDS_PER_BATCH, last - at)
                yield self._batch(partition.name, h, at, source.read_at(n * h["length"], h["start"] + at * h["length"]))

    def _batch(self, name: str, h: dict[str, object], first: int, raw: bytes) -> pa.RecordBatch:
        fields = dict(LAS_NEW if h["format"] >= 6 else LAS_OLD)
        if h["format"] in LAS_COLOUR_AT:
            fields |= {c: ("<u2", LAS_COLOUR_AT[h["format"]] + 2 * i) for i, c in enumerate("rgb")}
        kind = np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": h["length"]})
        rows, numbers = np.frombuffer(raw, dtype=kind), np.arange(first, first + len(raw) // h["length"])
        place = {a: (lambda i=i, a=a: rows[a] * h["scale"][i] + h["offset"][i]) for i, a in enumerate("XYZ")}
        for axis, (low, high) in self.box.items():
            if low > -math.inf or high < math.inf:
                inside = (place[axis]() >= low) & (place[axis]() <= high)
                rows, numbers = rows[inside], numbers[inside]
        made = {
            "scan_id": lambda: pa.array([name] * len(rows)),
            "point_id": lambda: pa.array(numbers),
            **{a: (lambda a=a: pa.array(place[a]())) for a in "XYZ"},
            "Intensity": lambda: pa.array(rows["Intensity"].astype(np.int32)),
            "return_number": lambda: pa.array((rows["flags"] & (15 if h["format"] >= 6 else 7)).astype(np.int32)),
            "class_id": lambda: pa.array((rows["class_id"] if h["format"] >= 6 else rows["class_id"] & 31).astype(np.int32)),
            **{c: (lambda c=c: pa.array(rows[c].astype(np.int32)) if c in fields else pa.nulls(len(rows), pa.int32())) for c in "rgb"},
        }
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)


class LasDataSource(DataSource):
    """``spark.read.format("las").load(path)``: one file, or the .las files below a folder; with ``.schema(...)`` some of the columns."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return LAS_SCHEMA

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(self.options["path"], schema.names)


def read_las(spark: SparkSession, path: str, fill_intensity: bool = True, columns: list[str] | None = None) -> DataFrame:
    """LAS points; where a file has no intensity at all, the mean colour; colours by their own maxima, if all are there.

    ``columns``: only these, as they are stored.  Filters on X, Y and Z reach the files' headers.
    """
    spark.dataSource.register(LasDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    if columns:
        kinds = dict(c.split() for c in LAS_SCHEMA.split(", "))
        return spark.read.format("las").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).load(path)
    df = spark.read.format("las").load(path)
    if not fill_intensity:
        return df
    df = with_stats(df, "scan_id", _i=F.max("Intensity"), _r=F.max("r"), _g=F.max("g"), _b=F.max("b"))
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    df = df.withColumn("Intensity", F.when((F.col("_i") == 0) & mean.isNotNull(), mean).otherwise(F.col("Intensity")).cast("double"))
    coloured = (F.col("_r") > 0) & (F.col("_g") > 0) & (F.col("_b") > 0)
    return df.withColumns({f"{c}_unit": F.when(coloured, F.col(c) / F.col(f"_{c}")) for c in "rgb"}).drop("_i", "_r", "_g", "_b")


def las_head(n: int, low: np.ndarray, high: np.ndarray, scale: float = 0.001) -> tuple[bytes, np.ndarray]:
    """Header of a LAS 1.2 file (format 3) for n points between two corners, and its offset."""
    offset = np.floor(low)
    head = bytearray(227)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 2, 3
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<HI", head, 105, 34, n)
    struct.pack_into("<3d3d", head, 131, *[scale] * 3, *offset)
    struct.pack_into("<6d", head, 179, *np.c_[high, low].ravel())
    return bytes(head), offset


def las_records(df: pd.DataFrame, offset: np.ndarray, scale: float = 0.001) -> bytes:
    """Records of format 3 of X, Y, Z, Intensity, class_id and r, g, b."""
    kind = np.dtype({"names": ["x", "y", "z", "i", "f", "c", "r", "g", "b"], "formats": ["<i4"] * 3 + ["<u2", "u1", "u1"] + ["<u2"] * 3, "offsets": [0, 4, 8, 12, 14, 15, 28, 30, 32], "itemsize": 34})
    rows = np.zeros(len(df), dtype=kind)
    for k, c in enumerate("xyz"):
        rows[c] = np.rint((df[c.upper()].to_numpy(dtype=np.float64) - offset[k]) / scale)
    rows["i"], rows["f"], rows["c"] = df.get("Intensity", 0), df.get("return_number", 1), df["class_id"]
    for c in "rgb":
        rows[c] = df.get(c, 0)
    return rows.tobytes()


def las_bytes(df: pd.DataFrame, scale: float = 0.001) -> bytes:
    """A whole LAS file."""
    xyz = df[["X", "Y", "Z"]].to_numpy(dtype=np.float64)
    head, offset = las_head(len(df), xyz.min(0) if len(df) else np.zeros(3), xyz.max(0) if len(df) else np.zeros(3), scale)
    return head + las_records(df, offset, scale)


_PLY_KINDS = {"float64": ("double", "<f8"), "float32": ("float", "<f4"), "int64": ("int", "<i4"), "int32": ("int", "<i4"), "int16": ("short", "<i2"), "int8": ("char", "i1"), "uint8": ("uchar", "u1"), "uint16": ("ushort", "<u2")}


def ply_head(n: int, kinds: dict[str, str]) -> bytes:
    """Header of a binary little-endian PLY; doubles stay doubles."""
    return "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property {_PLY_KINDS[k][0]} {c}" for c, k in kinds.items()], "end_header", ""]).encode()


def ply_records(df: pd.DataFrame, kinds: dict[str, str]) -> bytes:
    rows = np.empty(len(df), dtype=[(c, _PLY_KINDS[k][1]) for c, k in kinds.items()])
    for c in kinds:
        rows[c] = df[c]
    return rows.tobytes()


def ply_bytes(df: pd.DataFrame) -> bytes:
    """A whole PLY file with a typed property for each numeric column."""
    kinds = {c: str(df[c].dtype) for c in df.columns}
    return ply_head(len(df), kinds) + ply_records(df, kinds)


def scan_file(out: str, scan: object, ending: str) -> str:
    """A file's place under ``out``: the whole scan name, quoted, so that no two scans share one."""
    return f"{out.rstrip('/')}/{urllib.parse.quote(str(scan), safe='/=').replace('..', '%2E%2E')}.{ending}"


def streamed_files(df: DataFrame, out: str, ending: str, order: list[str], begin: Callable[[pd.Series], tuple[bytes, object]], records: Callable[[pd.DataFrame, object], bytes], stats: dict[str, Column]) -> DataFrame:
    """A file for each scan, written batch by batch; returns (scan_id, path, n).

    A file needs its rows in one stream, so a scan is one task's rows, but a task holds one Arrow batch of them.  ``stats`` are
    aggregates of a scan for its header; ``begin`` makes header and state from them, ``records`` the bytes of a batch.  An attempt
    writes under a name of its own and moves the file into place, so retries and lost executors leave no half files.
    """
    sums = df.groupBy("scan_id").agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in stats.items()])
    ordered = df.join(sums, "scan_id").repartition("scan_id").sortWithinPartitions("scan_id", *order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        sink = scan = state = None
        n = 0

        def done() -> pd.DataFrame:
            sink.close()
            system.move(temporary, base)
            return pd.DataFrame({"scan_id": [scan], "path": [base], "n": [n]})

        for frame in batches:
            for name, part in frame.groupby("scan_id", sort=False):
                if name != scan:
                    if sink is not None:
                        yield done()
                    scan, n = name, 0
                    system, base = _open(scan_file(out, scan, ending))
                    system.create_dir(base.rsplit("/", 1)[0], recursive=True)
                    temporary = f"{base}.{uuid.uuid4().hex}"
                    sink = system.open_output_stream(temporary)
                    head, state = begin(part.iloc[0])
                    sink.write(head)
                sink.write(records(part, state))
                n += len(part)
        if sink is not None:
            yield done()

    return ordered.mapInPandas(write, "scan_id string, path string, n long")


def write_scans(df: DataFrame, out: str, kind: str = "las", drop_class: int | None = 0, class_col: str = "class_id") -> DataFrame:
    """A LAS or PLY file for each scan."""
    if drop_class is not None and class_col in df.columns:
        df = df.where(F.col(class_col) != drop_class)
    df = df.withColumn("scan_id", F.col("scan_id").cast("string"))
    order = ["point_id"] if "point_id" in df.columns else []
    if kind == "las":
        stats = {f"_{k}{a}": fn(a).cast("double") for a in "XYZ" for k, fn in (("lo", F.min), ("hi", F.max))}

        def begin(row: pd.Series) -> tuple[bytes, np.ndarray]:
            return las_head(int(row["_n"]), np.array([row[f"_lo{a}"] for a in "XYZ"]), np.array([row[f"_hi{a}"] for a in "XYZ"]))

        return streamed_files(df, out, "las", order, begin, las_records, stats)
    names = {"double": "float64", "float": "float32", "bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}
    kinds = {c: names[t] for c, t in df.dtypes if t in names}
    return streamed_files(df, out, "ply", order, lambda row: (ply_head(int(row["_n"]), kinds), kinds), ply_records, {})


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """Little-endian float32 quadruples: X, Y, Z, Intensity."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["scan_id"], frame["content"], strict=True):
                xyzi = np.frombuffer(content, dtype="<f4").reshape(-1, 4).astype(np.float64)
                yield pd.DataFrame({"scan_id": name, "point_id": np.arange(len(xyzi)), "X": xyzi[:, 0], "Y": xyzi[:, 1], "Z": xyzi[:, 2], "Intensity": xyzi[:, 3]})

    files = spark.read.format("binaryFile").load(path).select(scan_name(spark, path), "content")
    return files.mapInPandas(decode, "scan_id string, point_id long, X double, Y double, Z double, Intensity double")


def png_bytes(mask: np.ndarray) -> bytes:
    """An 8-bit PNG, grey (H, W) or colour (H, W, 3)."""
    mask = np.ascontiguousarray(mask, dtype=np.uint8)
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", mask.shape[1], mask.shape[0], 8, 2 if mask.ndim == 3 else 0, 0, 0, 0)
    lines = b"".join(b"\0" + row.tobytes() for row in mask)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_array(raw: bytes) -> np.ndarray:
    """Pixels (H, W, channels) of a non-interlaced PNG; a palette's colours in place of its indexes."""
    at, data, size, palette = 8, b"", None, None
    while at < len(raw):
        n, tag = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if tag == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if interlace:
                raise ValueError("interlaced PNG")
            size = height, width, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        elif tag == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif tag == b"IDAT":
            data += body
        at += 12 + n
    height, width, channels = size
    step, line_bytes = max(1, channels * depth // 8), (width * channels * depth + 7) // 8
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + line_bytes)
    out = np.zeros((height, line_bytes), np.uint8)
    before = np.zeros(line_bytes, np.int64)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + before
        elif kind:
            for x in range(len(line)):
                left = line[x - step] if x >= step else 0
                corner = before[x - step] if x >= step else 0
                guess = left + before[x] - corner
                nearest = min((left, before[x], corner), key=lambda v: abs(guess - v))
                line[x] = (line[x] + {1: left, 3: (left + before[x]) // 2, 4: nearest}[int(kind)]) & 255
        before = line & 255
        out[y] = before
    if depth == 16:
        pixels = out.view(">u2").astype(np.uint16).reshape(height, width, channels)
    elif depth == 8:
        pixels = out.reshape(height, width, channels)
    else:
        bits = np.unpackbits(out, axis=1)[:, : width * depth].reshape(height, width, depth)
        pixels = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]
    return pixels if palette is None else palette[pixels[..., 0]]


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, y_pix, x_pix, class_id) of grey PNG masks, or r, g, b of colour ones in one array."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["scan_id"], frame["content"], strict=True):
                pixels = png_array(content)
                y, x = np.indices(pixels.shape[:2])
                yield pd.DataFrame({"scan_id": name, "y_pix": y.ravel(), "x_pix": x.ravel(), "values": list(pixels.reshape(-1, pixels.shape[2]).astype(np.int32))})

    files = spark.read.format("binaryFile").load(path).select(scan_name(spark, path), "content")
    df = files.mapInPandas(decode, "scan_id string, y_pix int, x_pix int, values array<int>")
    return df.withColumn("class_id", F.get("values", 0))


def write_masks(df: DataFrame, out: str, height: int, width: int, label: str = "class_id") -> DataFrame:
    """A grey PNG for each scan; a canvas is one task's rows."""

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((height, width), np.uint8)
        mask[frame["y_pix"], frame["x_pix"]] = frame[label]
        scan = str(frame["scan_id"].iloc[0])
        system, base = _open(scan_file(out, scan, "png"))
        system.create_dir(base.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(base) as sink:
            sink.write(png_bytes(mask))
        return pd.DataFrame({"scan_id": [scan], "path": [base]})

    return df.groupBy("scan_id").applyInPandas(write, "scan_id string, path string")


def write_cube(cube: DataFrame, out: str, channels: list[str], height: int, width: int) -> DataFrame:
    """(scan_id, path, n): each scan's dense raster as a float32 array (H, W, C) in a .npy file, row by row of the image; see ``write_cube_metadata``."""

    def begin(row: pd.Series) -> tuple[bytes, None]:
        if int(row["_n"]) != height * width:
            raise ValueError(f"{row['scan_id']}: {row['_n']} pixels for a canvas of {height} x {width}")
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": (height, width, len(channels))})
        return head.getvalue(), None

    narrow = cube.select(F.col("scan_id").cast("string").alias("scan_id"), "y_pix", "x_pix", *[F.col(f"`{c}`").cast("float").alias(c) for c in channels])
    return streamed_files(narrow, out, "npy", ["y_pix", "x_pix"], begin, lambda part, _: part[channels].to_numpy(dtype="<f4").tobytes(), {})


def write_cube_metadata(metadata: DataFrame, path: str, height: int, width: int) -> None:
    """The channels' metadata (channel, place, type, note, counts, sparkline) as one document, JSON and so YAML too."""
    rows = metadata.agg(F.sort_array(F.collect_list(F.struct("place", "channel", "type", "note", "counts", "sparkline"))).alias("channels"))
    whole = rows.select(F.to_json(F.struct(F.array(F.lit(height), F.lit(width), F.size("channels")).alias("shape"), F.lit("float32").alias("dtype"), "channels")).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def read_cube_metadata(spark: SparkSession, path: str) -> dict[str, object]:
    import json

    return json.loads(spark.read.text(path).first()[0])


def read_cube(spark: SparkSession, path: str, channels: list[str] | None = None, metadata: str | None = None) -> DataFrame:
    """(scan_id, y_pix, x_pix, channels..) of (H, W, C) arrays in .npy files, channels by name or by their metadata document."""
    if channels is None:
        channels = [c["channel"] for c in read_cube_metadata(spark, metadata)["channels"]]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["scan_id"], frame["content"], strict=True):
                cube = np.load(io.BytesIO(content), allow_pickle=False)
                if cube.shape[2] != len(channels):
                    raise ValueError(f"{name}: {cube.shape[2]} channels, {len(channels)} names")
                y, x = np.indices(cube.shape[:2])
                yield pd.DataFrame({"scan_id": name, "y_pix": y.ravel(), "x_pix": x.ravel()} | {c: cube[..., i].ravel().astype(np.float64) for i, c in enumerate(channels)})

    files = spark.read.format("binaryFile").load(path).select(scan_name(spark, path), "content")
    return files.mapInPandas(decode, "scan_id string, y_pix int, x_pix int, " + ", ".join(f"`{c}` double" for c in channels))
