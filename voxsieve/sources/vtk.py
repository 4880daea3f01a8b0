"""Image and point files of the XML kind with appended data: .vti for fields, .vtp for clouds of samples.

Nothing is read but the timesteps and cells that are asked for: a file's header says where its arrays begin, and slices are cut from ranges of cells. In
a compressed array the table of its blocks says which bytes hold which cells, so a slice inflates its own blocks only. Files are
written by ranges (sources/ranges.py), each by as many tasks as it has ranges.

Read are point data of one piece, appended as they are or compressed by zlib, of any number type and byte order. Other
encodings, several pieces and other files are an error that says so.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree.ElementTree import XMLPullParser

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import GridConfig
from .ranges import BATCH, CELLS_PER_TASK, Frame, Pack, Pruning, Slice, Stored, asked, file_name, packed, stored, u64, write_ranges
from .raw import cells_batch, joined, stored_in
from .shared import attach

#: Number types by their names in these files.
TYPES = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8"}
NAMES = {v: k for k, v in TYPES.items()}
#: Bytes of the header of a file that is written here, filled with spaces.
HEAD = 1024


@dataclass
class Array:
    """An appended array: name, number type, numbers in a tuple, and the byte where its length stands."""

    name: str
    dtype: np.dtype
    width: int
    at: int


@dataclass
class Header:
    """What the XML before the appended data says."""

    kind: str = ""
    extent: tuple[int, ...] = ()
    spacing: tuple[float, ...] = (1.0, 1.0, 1.0)
    origin: tuple[float, ...] = (0.0, 0.0, 0.0)
    points: int = 0
    length: np.dtype = np.dtype("<u4")
    deflated: bool = False
    arrays: dict[str, list[Array]] = field(default_factory=dict)

    @property
    def dims(self) -> tuple[int, int, int]:
        e = self.extent
        return e[1] - e[0] + 1, e[3] - e[2] + 1, e[5] - e[4] + 1

    def array(self, wanted: str) -> Array:
        """A point array by name or number; the first if nothing is said."""
        own = self.arrays.get("PointData", [])
        found = [a for k, a in enumerate(own) if wanted in ("", a.name, str(k))]
        if not found or found[0].width != 1:
            raise ValueError(f"no point array {wanted!r} of single numbers among {[a.name for a in own]}")
        return found[0]


def header(store: pafs.FileSystem, file: Stored) -> Header:
    size, raw = 1 << 13, b""
    while (mark := re.search(rb"<AppendedData([^>]*)>\s*_", raw)) is None:
        if len(raw) >= file.size:
            raise ValueError(f"{file.name} has no appended data: only those are read")
        raw = file.read(store, 0, min(size, file.size))
        size *= 4
    if b'"raw"' not in mark[1]:
        raise ValueError(f"{file.name}: appended data are encoded as text, which isn't read")
    out, parser, inside, pieces, order = Header(), XMLPullParser(events=("start", "end")), [], 0, "<"
    parser.feed(raw[: mark.start()])
    numbers = lambda text, kind: tuple(kind(x) for x in text.split())
    for event, tag in parser.read_events():
        if event == "end":
            inside.pop()
            continue
        inside.append(tag.tag)
        get = tag.attrib.get
        if tag.tag == "VTKFile":
            order = "<" if get("byte_order", "LittleEndian") == "LittleEndian" else ">"
            out.kind, out.length, out.deflated = get("type", ""), np.dtype(order + TYPES[get("header_type", "UInt32")]), "compressor" in tag.attrib
            if out.deflated and get("compressor") != "vtkZLibDataCompressor":
                raise ValueError(f"{file.name}: {get('compressor')} isn't read")
        elif tag.tag == "ImageData":
            out.extent = numbers(get("WholeExtent"), int)
            out.spacing, out.origin = numbers(get("Spacing", "1 1 1"), float), numbers(get("Origin", "0 0 0"), float)
        elif tag.tag == "Piece":
            pieces += 1
            out.points = int(get("NumberOfPoints", "0"))
            if pieces > 1 or (out.extent and numbers(get("Extent"), int) != out.extent):
                raise ValueError(f"{file.name} has several pieces, which aren't read")
        elif tag.tag == "DataArray":
            if get("format") != "appended":
                raise ValueError(f"{file.name}: the array {get('Name')} isn't appended")
            out.arrays.setdefault(inside[-2], []).append(Array(get("Name", ""), np.dtype(order + TYPES[get("type")]), int(get("NumberOfComponents", "1")), mark.end() + int(get("offset"))))
    return out


def slices(store: pafs.FileSystem, file: Stored, t: int, head: Header, arrays: list[Array], first: int, end: int) -> list[Slice]:
    """Slices of the tuples first to end of a file, which all these arrays have."""
    places = [_blocks(store, file, head, a) for a in arrays]
    return [Slice(file, t, at, min(at + CELLS_PER_TASK, end), tuple(_cut(p, a, at, min(at + CELLS_PER_TASK, end)) for p, a in zip(places, arrays, strict=True))) for at in range(first, end, CELLS_PER_TASK)]


def _blocks(store: pafs.FileSystem, file: Stored, head: Header, a: Array) -> tuple[int, np.ndarray | None]:
    """The byte where an array's numbers begin, and for deflated ones the ends of its blocks there with the size of an inflated one."""
    width = head.length.itemsize
    if not head.deflated:
        return a.at + width, None
    n, size, last = (int(x) for x in np.frombuffer(file.read(store, a.at, 3 * width), head.length))
    table = np.frombuffer(file.read(store, a.at + 3 * width, n * width), head.length).astype(np.int64)
    return a.at + (3 + n) * width, np.concatenate([[size if n > 1 or not last else last, 0], np.cumsum(table)])


def _cut(place: tuple[int, np.ndarray | None], a: Array, first: int, end: int) -> tuple:
    """Where the tuples from first to end stand: (byte, None), or (bytes to inflate, each with its size, and how many to pass over)."""
    width = a.dtype.itemsize * a.width
    begin, table = place
    if table is None:
        return a.dtype.str, begin + first * width, None
    size, ends = int(table[0]), table[1:]
    low, high = first * width // size, -(-end * width // size)
    return a.dtype.str, first * width - low * size, [(begin + int(ends[k]), int(ends[k + 1] - ends[k])) for k in range(low, high)]


def numbers(store: pafs.FileSystem, part: Slice, which: int, width: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """(first tuple, numbers) of a slice's array, some at a time."""
    dtype, skip, blocks = part.where[which]
    dtype = np.dtype(dtype)
    step = dtype.itemsize * width
    if blocks is None:
        for at in range(part.start, part.end, BATCH):
            n = min(BATCH, part.end - at)
            yield at, np.frombuffer(part.file.read(store, skip + (at - part.start) * step, n * step), dtype)
        return
    at, held = part.start, b""
    for begin, size in blocks:
        held += zlib.decompress(part.file.read(store, begin, size))
        held, skip = held[skip:], max(0, skip - len(held))
        n = min(len(held) // step, part.end - at)
        if n:
            yield at, np.frombuffer(held[: n * step], dtype)
            at, held = at + n, held[n * step :]


class ImageFiles(DataSource):
    """Format vti: options path (a folder URI), pattern (first group is the timestep), array (name or number), what (cells, or info: a row a file)."""

    @classmethod
    def name(cls) -> str:
        return "vti"

    def schema(self) -> str:
        if self.options.get("what") == "info":
            return "t int, file string, x_dim int, y_dim int, z_dim int, spacing array<double>, origin array<double>, extent array<int>, arrays array<string>"
        return "t int, gid bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return ImageReader(o["path"], o["pattern"], o.get("array", ""), o.get("what") == "info", o)


class ImageReader(Pruning, DataSourceReader):
    def __init__(self, folder: str, pattern: str, array: str, info: bool, options: dict[str, str]):
        super().__init__(options)
        self.folder, self.pattern, self.array, self.info = folder, re.compile(pattern), array, info

    def partitions(self) -> list[InputPartition]:
        store, files = stored(self.folder)
        parts = []
        for f in files:
            m = self.pattern.search(f.name)
            if not m or not self.wanted(int(m[1])):
                continue
            head = header(store, f)
            if head.kind != "ImageData":
                raise ValueError(f"{f.name} holds {head.kind}, not ImageData")
            if self.info:
                parts.append(Slice(f, int(m[1]), 0, 1, (head,)))
                continue
            first, end = self.cells(int(np.prod(head.dims)))
            parts += slices(store, f, int(m[1]), head, [head.array(self.array)], first, end)
        return packed(parts)

    def read(self, pack: Pack) -> Iterator[pa.RecordBatch]:
        store = stored_in(self.folder)
        yield from joined(b for part in pack.slices for b in self.batches(store, part))

    def batches(self, store: pafs.FileSystem, part: Slice) -> Iterator[pa.RecordBatch]:
        if self.info:
            h = part.where[0]
            x, y, z = h.dims
            row = {"t": part.t, "file": part.file.name, "x_dim": x, "y_dim": y, "z_dim": z, "spacing": list(h.spacing), "origin": list(h.origin), "extent": list(h.extent), "arrays": [a.name for a in h.arrays.get("PointData", [])]}
            ints, doubles = pa.int32(), pa.list_(pa.float64())
            types = [ints, pa.string(), ints, ints, ints, doubles, doubles, pa.list_(ints), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), types, strict=True)], names=list(row))
            return
        for at, values in numbers(store, part, 0):
            yield cells_batch(part.t, at, values)


class PointFiles(DataSource):
    """Format vtp: options path, pattern and array; rows (t, place, x, y, z, value)."""

    @classmethod
    def name(cls) -> str:
        return "vtp"

    def schema(self) -> str:
        return "t int, place bigint, x double, y double, z double, value double"

    def reader(self, schema) -> DataSourceReader:
        return PointReader(self.options["path"], self.options["pattern"], self.options.get("array", ""), self.options)


class PointReader(Pruning, DataSourceReader):
    def __init__(self, folder: str, pattern: str, array: str, options: dict[str, str]):
        super().__init__(options)
        self.folder, self.pattern, self.array = folder, re.compile(pattern), array

    def partitions(self) -> list[InputPartition]:
        store, files = stored(self.folder)
        parts = []
        for f in files:
            m = self.pattern.search(f.name)
            if m and self.wanted(int(m[1])):
                head = header(store, f)
                if head.kind != "PolyData":
                    raise ValueError(f"{f.name} holds {head.kind}, not PolyData")
                parts += slices(store, f, int(m[1]), head, [head.arrays["Points"][0], head.array(self.array)], 0, head.points)
        return packed(parts)

    def read(self, pack: Pack) -> Iterator[pa.RecordBatch]:
        store = stored_in(self.folder)
        yield from joined(b for part in pack.slices for b in self.batches(store, part))

    def batches(self, store: pafs.FileSystem, part: Slice) -> Iterator[pa.RecordBatch]:
        # points and values may be cut elsewhere where they are compressed
        at = np.concatenate([v for _, v in numbers(store, part, 0, 3)]).reshape(-1, 3).astype(np.float64)
        values = np.concatenate([v for _, v in numbers(store, part, 1)]).astype(np.float64)
        for a in range(0, len(values), BATCH):
            b = min(a + BATCH, len(values))
            place = np.arange(part.start + a, part.start + b)
            columns = [np.full(b - a, part.t, np.int32), place, *(np.ascontiguousarray(at[a:b, k]) for k in range(3)), values[a:b]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t", "place", "x", "y", "z", "value"])


def read_vti(spark: SparkSession, folder: str, pattern: str, array: str | int = "", times: tuple[int, int] | None = None, cells: tuple[int, int] | None = None) -> DataFrame:
    """The field (t, gid, value) of a folder's image files; of these timesteps and cells only, first and last, if that is asked."""
    spark.dataSource.register(ImageFiles)
    return spark.read.format("vti").options(path=folder, pattern=pattern, array=str(array), **asked(times, cells)).load()


def vti_info(spark: SparkSession, folder: str, pattern: str, times: tuple[int, int] | None = None) -> DataFrame:
    """(t, file, x_dim, y_dim, z_dim, spacing, origin, extent, arrays) of each image file, from the headers alone."""
    spark.dataSource.register(ImageFiles)
    return spark.read.format("vti").options(path=folder, pattern=pattern, what="info", **asked(times)).load()


def read_vtp(spark: SparkSession, folder: str, pattern: str, array: str | int = "", times: tuple[int, int] | None = None) -> DataFrame:
    """(t, place, x, y, z, value) of a folder's point files; of these timesteps only, first and last, if that is asked."""
    spark.dataSource.register(PointFiles)
    return spark.read.format("vtp").options(path=folder, pattern=pattern, array=str(array), **asked(times)).load()


_FOOT = b"\n</AppendedData>\n</VTKFile>\n"


def _head(kind: str, body: str) -> bytes:
    text = f'<?xml version="1.0"?>\n<VTKFile type="{kind}" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n{body}\n'.encode()
    mark = b'<AppendedData encoding="raw">\n_'
    if len(text) + len(mark) > HEAD:
        raise ValueError("the array's name is too long")
    return text + b" " * (HEAD - len(text) - len(mark)) + mark


@dataclass
class ImageFrame(Frame):
    dims: tuple[int, int, int]
    spacing: tuple[float, float, float]
    origin: tuple[float, float, float]
    array: str
    dtype: str
    start: int = HEAD + 8

    def pieces(self, numbers: int) -> list[tuple[int, bytes]]:
        extent = " ".join(f"0 {d - 1}" for d in self.dims)
        place = f'Origin="{" ".join(map(str, self.origin))}" Spacing="{" ".join(map(str, self.spacing))}"'
        array = f'<DataArray type="{NAMES[self.dtype[1:]]}" Name="{self.array}" NumberOfComponents="1" format="appended" offset="0"/>'
        body = f'<ImageData WholeExtent="{extent}" {place}>\n<Piece Extent="{extent}">\n<PointData Scalars="{self.array}">\n{array}\n</PointData>\n<CellData/>\n</Piece>\n</ImageData>'
        return [(0, _head("ImageData", body) + u64(numbers)), (self.start + numbers, _FOOT)]


@dataclass
class PointFrame(Frame):
    array: str
    start: int = HEAD + 8

    def pieces(self, numbers: int) -> list[tuple[int, bytes]]:
        n = numbers // 16
        points = '<Points>\n<DataArray type="Float32" Name="Points" NumberOfComponents="3" format="appended" offset="0"/>\n</Points>'
        values = f'<PointData Scalars="{self.array}">\n<DataArray type="Float32" Name="{self.array}" NumberOfComponents="1" format="appended" offset="{8 + 12 * n}"/>\n</PointData>'
        body = f'<PolyData>\n<Piece NumberOfPoints="{n}" NumberOfVerts="0" NumberOfLines="0" NumberOfStrips="0" NumberOfPolys="0">\n{points}\n{values}\n</Piece>\n</PolyData>'
        return [(0, _head("PolyData", body) + u64(12 * n)), (self.start + 12 * n, u64(4 * n)), (self.start + 8 + 16 * n, _FOOT)]


def frame_of(named: str) -> Frame:
    kind, options = json.loads(named)
    return (ImageFrame if kind == "image" else PointFrame)(**options)


def write_vti(cells: DataFrame, folder: str, cfg: GridConfig, name: str = "field_{t}.vti", value: str = "value", array: str = "values", dtype: str = "<f8", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), origin: tuple[float, float, float] = (0.0, 0.0, 0.0), per_task: int = CELLS_PER_TASK, layout: str = "files") -> None:
    """One image file for each timestep, which tasks write by ranges of cells; an incomplete timestep is an error. Nulls are written as NaN."""
    width, start = np.dtype(dtype).itemsize, ImageFrame.start
    frame = json.dumps(["image", {"dims": cfg.dims, "spacing": spacing, "origin": origin, "array": array, "dtype": dtype}])
    rows = cells.select(file_name(name, F.col("t")).alias("file"), (start + width * F.col("gid")).alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("value"))
    write_ranges(rows, folder, dtype, frame, layout, per_task, start + width * cfg.cells + len(_FOOT))


def write_vtp(points: DataFrame, folder: str, name: str = "cloud_{t}.vtp", array: str = "samples", per_task: int = CELLS_PER_TASK, layout: str = "files") -> None:
    """One point file for each timestep of points (t, place, x, y, z, value); places go from 0 without gaps."""
    sizes = points.groupBy("t").agg(F.count("*").alias("n"))
    start = PointFrame.start
    at = lambda k: start + 12 * F.col("place") + 4 * k
    parts = [F.struct(at(k).cast("long").alias("at"), F.col(c).cast("double").alias("value")) for k, c in enumerate("xyz")]
    parts.append(F.struct((start + 8 + 12 * F.col("n") + 4 * F.col("place")).cast("long").alias("at"), F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value")))
    numbers = attach(points, sizes, ["t"]).select(file_name(name, F.col("t")).alias("file"), F.explode(F.array(*parts)).alias("p")).select("file", "p.at", "p.value")
    write_ranges(numbers, folder, "<f4", json.dumps(["points", {"array": array}]), layout, per_task)
