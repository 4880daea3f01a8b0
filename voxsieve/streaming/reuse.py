"""Histogram reuse as a stateful stream: the same decisions as the batch window, made when a region's timestep is complete.

State of a region: its last complete timestep, that one's histogram and whether it reused, and the counts of timesteps that
are still arriving. Cells of a timestep no later than the last complete one are late and dropped. A complete timestep waits for
earlier ones that have begun to arrive, and if the first timestep's number is given for every one from that on; otherwise a
timestep of which nothing has come is a gap, after which nothing is reused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import GridConfig
from ..functions import geometry as g
from ..sources.shared import new_path

OUTPUT = "t int, block_id int, hist array<long>, reused boolean"
STATE = "last_t int, hist array<long>, reused boolean, times array<int>, counts array<long>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of a batch counted by region, timestep and bin, so that a state's rows are as few as its bins and not as its cells."""
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by(["block_id", "t", "bin"]).aggregate([([], "count_all")])
        yield from found.rename_columns(["block_id", "t", "bin", "n"]).to_batches()


def reuse_stream(field: DataFrame, cfg: GridConfig, first: int | None = None) -> DataFrame:
    """(t, block_id, hist, reused) of a streaming field, as regions complete. Given the first timestep's number, each one from that on is waited for."""
    low, high = map(F.lit, cfg.lifetime)
    cells = field.select(g.block_id(F.col("gid"), cfg).alias("block_id"), "t", g.bin_id(F.col("value"), low, high, cfg.num_bins).alias("bin"))
    cells = cells.mapInArrow(_counted, "block_id int, t int, bin int, n long")
    bins, volume = cfg.num_bins, cfg.block_volume

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, hist, reused, times, counts = state.get if state.exists else (None if first is None else first - 1, [], False, [], [])
        open_ = {t: list(counts[k * bins : (k + 1) * bins]) for k, t in enumerate(times)}
        for part in parts:
            for (t, b), n in part.groupby(["t", "bin"])["n"].sum().items():
                if last is None or t > last:
                    open_.setdefault(int(t), [0] * bins)[int(b)] += int(n)
        out = []
        for t in sorted(open_):
            own = open_[t]
            if sum(own) < volume or (first is not None and t > last + 1):
                break
            reused = last == t - 1 and not reused and list(hist) == own
            last, hist = t, own
            out.append((t, key[0], own, reused))
        for t, *_ in out:
            del open_[t]
        rest = sorted(open_)
        state.update((last, list(hist), reused, rest, [n for t in rest for n in open_[t]]))
        yield pd.DataFrame(out, columns=["t", "block_id", "hist", "reused"])

    return cells.groupBy("block_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, out: str | None = None, marks: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return its rows as a table. With the folders of an earlier run it goes on from there."""
    spark: SparkSession = stream.sparkSession
    out, marks = out or new_path(spark, name), marks or new_path(spark, f"{name}-progress")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def in_files(rows: DataFrame, name: str, parts: int) -> DataFrame:
    """rows as a stream of a file a batch: written as so many files by ranges of the timestep, which may come in any order."""
    spark, folder = rows.sparkSession, new_path(rows.sparkSession, name)
    rows.repartitionByRange(parts, "t").write.parquet(folder)
    return field_stream(spark, folder, "*.parquet", rows.schema)


def field_stream(spark: SparkSession, folder: str, glob: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
