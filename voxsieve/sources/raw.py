"""Raw float32 files and sample files: readers that split files by ranges of cells, and writers whose tasks write such ranges.

A timestep's file is headerless little-endian float32, x fastest. Samples of a timestep are three files: ids (int32), values
(float32) and for each region the number of its samples or -1 where it reuses the timestep before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import GridConfig
from ..functions.geometry import block_id
from .ranges import BATCH, CELLS_PER_TASK, Pack, Pruning, Slice, Stored, asked, file_name, offsets, packed, stored, write_ranges
from .shared import written


class RawGrid(DataSource):
    """Format rawgrid: options path (a folder URI), pattern (first group is the timestep) and cells (of one timestep)."""

    @classmethod
    def name(cls) -> str:
        return "rawgrid"

    def schema(self) -> str:
        return "t int, gid bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return RawGridReader(self.options["path"], self.options["pattern"], int(self.options["cells"]), self.options)


class RawGridReader(Pruning, DataSourceReader):
    def __init__(self, folder: str, pattern: str, cells: int, options: dict[str, str]):
        super().__init__(options)
        self.folder, self.pattern, self.n = folder, re.compile(pattern), cells

    def partitions(self) -> list[InputPartition]:
        parts, (first, end) = [], self.cells(self.n)
        for f in stored(self.folder)[1]:
            if m := self.pattern.search(f.name):
                if f.size != 4 * self.n:
                    raise ValueError(f"{f.name} has {f.size} bytes, {4 * self.n} are expected")
                if self.wanted(int(m[1])):
                    parts += [Slice(f, int(m[1]), at, min(at + CELLS_PER_TASK, end)) for at in range(first, end, CELLS_PER_TASK)]
        return packed(parts)

    def read(self, pack: Pack) -> Iterator[pa.RecordBatch]:
        store = stored_in(self.folder)
        yield from joined(b for part in pack.slices for b in self.batches(store, part))

    def batches(self, store: pa.fs.FileSystem, part: Slice) -> Iterator[pa.RecordBatch]:
        for at in range(part.start, part.end, BATCH):
            n = min(BATCH, part.end - at)
            yield cells_batch(part.t, at, np.frombuffer(part.file.read(store, 4 * at, 4 * n), "<f4"))


def stored_in(folder: str) -> pa.fs.FileSystem:
    return pa.fs.FileSystem.from_uri(folder)[0]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together to about BATCH rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def cells_batch(t: int, first: int, values: np.ndarray) -> pa.RecordBatch:
    """Rows (t, gid, value) of successive cells."""
    n = len(values)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.arange(first, first + n)), pa.array(values.astype(np.float64))], names=["t", "gid", "value"])


def read_raw(spark: SparkSession, folder: str, pattern: str, cfg: GridConfig, times: tuple[int, int] | None = None, cells: tuple[int, int] | None = None) -> DataFrame:
    """The field (t, gid, value) of a folder's raw files; of these timesteps and cells only, first and last, if that is asked."""
    spark.dataSource.register(RawGrid)
    return spark.read.format("rawgrid").options(path=folder, pattern=pattern, cells=str(cfg.cells), **asked(times, cells)).load()


def write_raw(field: DataFrame, folder: str, cfg: GridConfig, name: str = "field_{t}.bin", value: str = "value", per_task: int = CELLS_PER_TASK, layout: str = "files") -> None:
    """One raw file for each timestep, which tasks write by ranges of cells. A timestep that lacks cells or repeats some is an error, and then no file appears."""
    rows = field.select(file_name(name, F.col("t")).alias("file"), (4 * F.col("gid")).alias("at"), F.col(value).cast("double").alias("value"))
    # a null is a number that isn't there
    write_ranges(rows.withColumn("value", F.coalesce("value", F.lit(float("nan")))), folder, "<f4", layout=layout, per_task=per_task, size=4 * cfg.cells)


def write_samples(samples: DataFrame, blocks: DataFrame, folder: str, per_task: int = CELLS_PER_TASK, layout: str = "files") -> None:
    """The three files of each timestep, samples in order of region and id. A prefix sum over the regions' counts places the samples, so tasks write ranges of a file."""
    placed = written(place_samples(samples), "placed")
    times = written(blocks.select("t").distinct(), "times")

    def write(rows: DataFrame, kind: str, dtype: str) -> None:
        named = rows.unionByName(times.select("t", F.lit(0).cast("long").alias("at"), F.lit(None).cast("double").alias("value")))
        write_ranges(named.withColumn("file", file_name(f"sampled_{kind}_{{t}}.bin", F.col("t"))), folder, dtype, layout=layout, per_task=per_task)

    at = (4 * F.col("place")).alias("at")
    write(placed.select("t", at, F.col("gid").cast("double").alias("value")), "id", "<i4")
    write(placed.select("t", at, F.coalesce("value", F.lit(float("nan"))).alias("value")), "data", "<f4")
    total = F.when(F.col("reused"), -1).otherwise(F.col("n_samples")).cast("double").alias("value")
    write(blocks.select("t", (4 * F.col("block_id").cast("long")).alias("at"), total), "total", "<i4")


def place_samples(samples: DataFrame) -> DataFrame:
    """samples with place: their number in order of region and id within the timestep, from 0."""
    sizes = samples.groupBy("t", "block_id").agg(F.count("*").alias("n"))
    inside = F.row_number().over(W.partitionBy("t", "block_id").orderBy("gid")) - 1
    firsts = offsets(sizes, "t", "block_id", "n").select("t", "block_id", "offset")
    return samples.withColumn("__inside", inside).join(firsts, ["t", "block_id"]).withColumn("place", F.col("offset") + F.col("__inside")).drop("__inside", "offset")


class SampleFiles(DataSource):
    """Format samplefiles: option path; rows (t, gid, value), or (t, block_id, total) with option what=blocks."""

    @classmethod
    def name(cls) -> str:
        return "samplefiles"

    def schema(self) -> str:
        return "t int, block_id int, total int" if self.options.get("what") == "blocks" else "t int, gid bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return SampleFilesReader(self.options["path"], self.options.get("what") == "blocks", self.options)


class SampleFilesReader(Pruning, DataSourceReader):
    def __init__(self, folder: str, blocks: bool, options: dict[str, str]):
        super().__init__(options)
        self.folder, self.blocks = folder, blocks

    def partitions(self) -> list[InputPartition]:
        files = {f.name: f for f in stored(self.folder)[1]}
        parts = []
        for name, f in files.items():
            m = re.fullmatch(rf"sampled_{'total' if self.blocks else 'id'}_([0-9]+)\.bin", name)
            if m and self.wanted(int(m[1])):
                other: Stored | None = None if self.blocks else files[f"sampled_data_{m[1]}.bin"]
                n = f.size // 4
                parts += [Slice(f, int(m[1]), at, min(at + CELLS_PER_TASK, n), (other,)) for at in range(0, n, CELLS_PER_TASK)]
        return packed(parts)

    def read(self, pack: Pack) -> Iterator[pa.RecordBatch]:
        store = stored_in(self.folder)
        yield from joined(b for part in pack.slices for b in self.batches(store, part))

    def batches(self, store: pa.fs.FileSystem, part: Slice) -> Iterator[pa.RecordBatch]:
        for at in range(part.start, part.end, BATCH):
            n = min(BATCH, part.end - at)
            load = lambda file, kind, at=at, n=n: np.frombuffer(file.read(store, 4 * at, 4 * n), kind)
            times, numbers = pa.array(np.full(n, part.t, np.int32)), load(part.file, "<i4")
            if self.blocks:
                yield pa.RecordBatch.from_arrays([times, pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(numbers)], names=["t", "block_id", "total"])
            else:
                yield pa.RecordBatch.from_arrays([times, pa.array(numbers.astype(np.int64)), pa.array(load(part.where[0], "<f4").astype(np.float64))], names=["t", "gid", "value"])


def read_samples(spark: SparkSession, folder: str, cfg: GridConfig, times: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, blocks) from a folder of sample files; of these timesteps only, first and last, if that is asked."""
    spark.dataSource.register(SampleFiles)
    load = lambda what: spark.read.format("samplefiles").options(path=folder, what=what, **asked(times)).load()
    samples = load("samples").select("t", "gid", block_id(F.col("gid"), cfg).alias("block_id"), "value")
    blocks = load("blocks").select("t", "block_id", F.greatest("total", F.lit(0)).cast("long").alias("n_samples"), (F.col("total") < 0).alias("reused"))
    return samples, blocks


def read_roi(spark: SparkSession, path: str) -> DataFrame:
    """(t, x0, x1, y0, y1, z0, z1) from lines of six numbers, whatever stands around them; line k is timestep k."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("t", "line"))
    numbers = F.transform(F.split(F.regexp_replace("line", "[^0-9,]", ""), ","), lambda x: x.cast("int"))
    return lines.where(F.col("line").rlike("[0-9]")).select("t", *[numbers[k].alias(n) for k, n in enumerate(("x0", "x1", "y0", "y1", "z0", "z1"))])


def write_stats(stats: DataFrame, path: str) -> None:
    """A report with a header line, one row for each timestep."""
    stats.write.option("header", True).csv(path)
