"""Files of numbers that many tasks write and read by ranges.

Writing: rows (file, at, value) say which number stands at which byte of which file; a null says that there is such a file,
however empty. Tasks write runs of them into a staging
folder beside the target; a commit checks that each file's runs leave no gap and do not overlap, adds the file's frame (what
stands before and after the numbers, where a format has that), and moves the files to their place. A task that fails leaves
nothing there; one that runs twice writes the same bytes twice. Where a store allows writes at a place in a file (a mounted
folder), a file is one file; elsewhere, or with option layout=parts, a folder of parts named by the byte at which they begin.

Reading: files and folders of parts look alike to the readers; timesteps and cells that aren't asked for aren't read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, InputPartition, WriterCommitMessage

from ..functions.geometry import div

#: Cells that one task reads at most, and numbers that it writes into one range.
CELLS_PER_TASK = 4 << 20
#: Numbers in one batch of rows.
BATCH = 1 << 18

#: Tasks that slices of small files are put together for, and cells that opening such a file is worth.
PACKS, FILE_COST = 64, 1 << 13

_PART = re.compile(r"part-([0-9]{16})")


@dataclass
class Stored:
    """A file, or the parts of one in order: name, and (first byte, bytes, path) of each."""

    name: str
    pieces: list[tuple[int, int, str]]

    @property
    def size(self) -> int:
        return self.pieces[-1][0] + self.pieces[-1][1]

    def read(self, store: pafs.FileSystem, at: int, n: int) -> bytes:
        out = []
        for first, size, path in self.pieces:
            a, b = max(at, first), min(at + n, first + size)
            if a < b:
                with store.open_input_file(path) as f:
                    out.append(f.read_at(b - a, a - first))
        return b"".join(out)


def stored(folder: str) -> tuple[pafs.FileSystem, list[Stored]]:
    """The files below a folder, in order of their names."""
    store, base = pafs.FileSystem.from_uri(folder)
    found: dict[str, Stored] = {}
    for f in store.get_file_info(pafs.FileSelector(base, recursive=True)):
        if f.type == pafs.FileType.File:
            part = _PART.fullmatch(f.base_name)
            path = os.path.dirname(f.path) if part else f.path
            found.setdefault(path, Stored(os.path.basename(path), [])).pieces.append((int(part[1]) if part else 0, f.size, f.path))
    for s in found.values():
        s.pieces.sort()
        if any(a[0] + a[1] != b[0] for a, b in zip(s.pieces, s.pieces[1:], strict=False)):
            raise ValueError(f"{s.name}: parts are missing")
    return store, [found[p] for p in sorted(found)]


class Slice(InputPartition):
    """Cells from start to end of a file of timestep t; where says the reader's own things, such as where cells begin."""

    def __init__(self, file: Stored | None, t: int, start: int, end: int, where: tuple = ()):
        self.file, self.t, self.start, self.end, self.where = file, t, start, end, where


@dataclass
class Pack(InputPartition):
    """Slices that one task reads."""

    slices: list[Slice]


def packed(slices: list[Slice]) -> list[InputPartition]:
    """Successive slices put together for about PACKS tasks, or more where these would have over CELLS_PER_TASK cells. Each slice counts for FILE_COST cells more than it has."""
    sizes = [s.end - s.start + FILE_COST for s in slices]
    limit, out, held = min(CELLS_PER_TASK, sum(sizes) / PACKS), [Pack([])], 0
    for s, size in zip(slices, sizes, strict=True):
        if held and held + size > limit:
            out.append(Pack([]))
            held = 0
        out[-1].slices.append(s)
        held += size
    return out


class Pruning:
    """The timesteps and cells that a reader is asked for, as options times and cells: first and last of each.

    They are options and not filters that Spark pushes down, as Spark 4.1 keeps what was pushed with the source and not with the
    scan: two scans of one DataFrame, such as of a self-join, would both read what the last one's filters left.
    """

    def __init__(self, options: dict[str, str]):
        bounds = lambda name: tuple(int(x) for x in options[name].split(",")) if options.get(name) else None
        self.times, self.only = bounds("times"), bounds("cells_from_to")

    def wanted(self, t: int) -> bool:
        return self.times is None or self.times[0] <= t <= self.times[1]

    def cells(self, n: int) -> tuple[int, int]:
        """First cell and the one after the last, of n."""
        return (max(0, self.only[0]), min(n, self.only[1] + 1)) if self.only else (0, n)


def asked(times: tuple[int, int] | None, cells: tuple[int, int] | None = None) -> dict[str, str]:
    """The options for first and last timestep and cell."""
    return {name: f"{own[0]},{own[1]}" for name, own in (("times", times), ("cells_from_to", cells)) if own}


class Frame:
    """What surrounds the numbers of a file: (byte, bytes) pieces, given how many bytes of numbers there are. This one is empty."""

    start = 0

    def pieces(self, numbers: int) -> list[tuple[int, bytes]]:
        return []

    def gaps(self, numbers: int) -> list[tuple[int, int]]:
        """Runs (byte, bytes) between the numbers that the frame fills."""
        return [(at, len(b)) for at, b in self.pieces(numbers)]


@dataclass
class Written(WriterCommitMessage):
    """Runs (file, first byte, bytes) that a task wrote."""

    runs: list[tuple[str, int, int]]


class RangeFiles(DataSource):
    """Format rangefiles, for writing: options path, staging, dtype (of the numbers), layout, frame (by frame_of()), and bytes (of each file, if known)."""

    @classmethod
    def name(cls) -> str:
        return "rangefiles"

    def schema(self) -> str:
        return "file string, at bigint, value double"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return RangeWriter(o["path"], o["staging"], o["dtype"], o["layout"], o["frame"], int(o["bytes"]))


class RangeWriter(DataSourceArrowWriter):
    def __init__(self, path: str, staging: str, dtype: str, layout: str, frame: str, bytes_: int):
        self.path, self.staging, self.dtype, self.layout, self.frame, self.bytes = path, staging, np.dtype(dtype), layout, frame, bytes_

    def _whole(self, store: pafs.FileSystem) -> bool:
        return self.layout != "parts" and isinstance(store, pafs.LocalFileSystem)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = pafs.FileSystem.from_uri(self.staging)
        out = _Runs(store, base, self._whole(store))
        try:
            for batch in iterator:
                absent = batch.column(2).is_null()
                for file in batch.column(0).filter(absent).unique().to_pylist():
                    out.add(file, 0, b"")
                batch = batch.filter(pc.invert(absent))
                files, at = batch.column(0), batch.column(1).to_numpy()
                raw = batch.column(2).to_numpy(zero_copy_only=False).astype(self.dtype)
                breaks = np.flatnonzero(np.diff(at) != self.dtype.itemsize) + 1
                codes = files.dictionary_encode()
                breaks = np.union1d(breaks, np.flatnonzero(np.diff(codes.indices.to_numpy())) + 1).astype(np.int64)
                for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(at)], strict=True):
                    if a < b:
                        out.add(files[a].as_py(), int(at[a]), raw[a:b].tobytes())
        finally:
            out.close()
        return Written(out.runs)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = pafs.FileSystem.from_uri(self.staging)
        _, target = pafs.FileSystem.from_uri(self.path)
        runs: dict[str, list[tuple[int, int]]] = {}
        for m in messages:
            for file, at, n in m.runs if m else ():
                runs.setdefault(file, []).append((at, n))
        try:
            for file, own in sorted(runs.items()):
                frame = frame_of(self.frame)
                numbers = sum(n for _, n in own)
                end = 0
                for at, n in sorted([*own, *frame.gaps(numbers)]):
                    if at != end:
                        raise ValueError(f"{file}: numbers are missing or repeated near byte {min(at, end)}")
                    end += n
                if self.bytes not in (-1, end):
                    raise ValueError(f"{file} has {end} bytes, {self.bytes} are expected: numbers are missing at its end")
                for at, piece in frame.pieces(numbers):
                    out = _Runs(store, base, self._whole(store))
                    out.add(file, at, piece)
                    out.close()
            store.create_dir(target, recursive=True)
            for file in runs:
                if store.get_file_info(f"{target}/{file}").type == pafs.FileType.Directory:
                    store.delete_dir(f"{target}/{file}")
                store.move(f"{base}/{file}", f"{target}/{file}")
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = pafs.FileSystem.from_uri(self.staging)
        if store.get_file_info(base).type == pafs.FileType.Directory:
            store.delete_dir(base)


class _Runs:
    """Successive runs of one task, kept open as long as they go on."""

    def __init__(self, store: pafs.FileSystem, base: str, whole: bool):
        self.store, self.base, self.whole, self.runs, self.out, self.handle = store, base, whole, [], None, None

    def add(self, file: str, at: int, raw: bytes) -> None:
        last = self.runs[-1] if self.runs else None
        if not last or last[0] != file or last[1] + last[2] != at:
            self.close()
            if self.whole:
                path = f"{self.base}/{file}"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                self.handle = os.open(path, os.O_RDWR | os.O_CREAT, 0o666)
            else:
                self.store.create_dir(f"{self.base}/{file}", recursive=True)
                self.out = self.store.open_output_stream(f"{self.base}/{file}/part-{at:016d}")
            self.runs.append(last := (file, at, 0))
        if self.whole:
            done = 0
            while done < len(raw):
                done += os.pwrite(self.handle, raw[done:], at + done)
        else:
            self.out.write(raw)
        self.runs[-1] = (file, last[1], last[2] + len(raw))

    def close(self) -> None:
        if self.handle is not None:
            os.close(self.handle)
        if self.out is not None:
            self.out.close()
        self.out = self.handle = None


def frame_of(named: str) -> Frame:
    """A frame from its text form; the formats with frames have their own module."""
    if not named:
        return Frame()
    from . import vtk

    return vtk.frame_of(named)


def write_ranges(rows: DataFrame, folder: str, dtype: str, frame: str = "", layout: str = "files", per_task: int = CELLS_PER_TASK, size: int = -1) -> None:
    """Write rows (file, at, value): value is the number of that dtype at byte at of the file, which has size bytes if that is known.

    Each task writes ranges of per_task numbers.
    """
    spark = rows.sparkSession
    spark.dataSource.register(RangeFiles)
    step = per_task * np.dtype(dtype).itemsize
    dealt = rows.select("file", F.col("at").cast("long").alias("at"), "value").withColumn("range", div(F.col("at"), step))
    ordered = dealt.repartition("file", "range").sortWithinPartitions("file", "at").drop("range")
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    ordered.write.format("rangefiles").options(path=folder, staging=staging, dtype=dtype, layout=layout, frame=frame, bytes=str(size)).mode("append").save()


def offsets(sizes: DataFrame, by: str, order: str, size: str, chunk: int = 4096) -> DataFrame:
    """sizes with the column offset: the sum of size over the earlier rows of each group.

    A prefix sum in two steps, over chunks of the order column and inside them, so a long group isn't one task's.
    """
    rows = sizes.withColumn("__chunk", div(F.col(order), chunk))
    sums = rows.groupBy(by, "__chunk").agg(F.sum(size).alias("__sum"))
    upto = W.partitionBy(by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(by, "__chunk", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(size).over(W.partitionBy(by, "__chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = rows.withColumn("__inside", inside).join(before, [by, "__chunk"])
    return found.withColumn("offset", (F.col("__before") + F.col("__inside")).cast("long")).drop("__chunk", "__inside", "__before")


def file_name(pattern: str, t: Column) -> Column:
    """pattern with {t} replaced."""
    head, _, tail = pattern.partition("{t}")
    return F.concat(F.lit(head), t.cast("string"), F.lit(tail))


def u64(n: int) -> bytes:
    return struct.pack("<Q", n)
