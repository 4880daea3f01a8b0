"""Error reuse with fill as a stream: each batch brings timesteps, which are judged, decided and filled up one after another.

What a timestep keeps is in pieces of the two tables that the batch form writes too (temporal.StepTables), and the timestep
after it reads them from there, so nothing else has to be remembered. A batch is made idempotent by its number: what it wrote
carries the number, a batch that comes again after a failure writes the same pieces anew, and a stream that is started
again with its checkpoint goes on at its last timestep. A timestep has to come whole in one batch, and batches in ascending
order; one that comes in another batch than before, or after a later one, is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GridConfig
from ..operators import sampling, temporal
from ..sources.shared import written


def fill_stream(field: DataFrame, cfg: GridConfig, folder: str, marks: str) -> None:
    """Run over all that is there of a streaming field (t, gid, value); samples and flags go to the folder, progress to marks."""
    writer = field.writeStream.foreachBatch(lambda rows, number: take(rows, number, cfg, folder)).option("checkpointLocation", marks)
    writer.trigger(availableNow=True).start().awaitTermination()


def take(rows: DataFrame, number: int, cfg: GridConfig, folder: str) -> None:
    """One batch: its timesteps in order, by runs where they are many."""
    spark = rows.sparkSession
    tables = temporal.StepTables(spark, folder)
    cells = written(sampling.judged(rows, cfg), "judged")
    first, end, count = cells.agg(F.min("t"), F.max("t"), F.count_distinct("t")).first()
    if not count:
        return
    samples, flags = tables.whole("samples"), tables.whole("flags")
    others = flags.where(F.col("batch") != number)
    if (last := others.agg(F.max("t")).first()[0]) is not None and last >= first:
        raise ValueError(f"timesteps from {first} of batch {number} came before, or after a later one")
    before = [written(kept.where((F.col("batch") != number) & (F.col("t") == first - 1)).drop("batch"), "before") for kept in (samples, flags)]
    if temporal.by_runs(count, cfg):
        flags = temporal.flags_by_runs(cells, cfg, first, end, tuple(before))
        tables.keep(flags, "flags", first, number)
        tables.keep(temporal.samples_by_runs(cells, flags, cfg), "samples", first, number)
        return
    at = last
    for t in [r.t for r in cells.select("t").distinct().orderBy("t").collect()]:
        now = cells.where(F.col("t") == t)
        flags = tables.keep(temporal.error_step(now, *(before if at == t - 1 else (None, None)), cfg), "flags", t, number)
        before = [tables.keep(temporal.own_samples(now, flags).unionByName(sampling.fill(now, flags, cfg)), "samples", t, number), flags]
        at = t


def results(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(samples, blocks) of the timesteps that a stream has kept so far."""
    tables = temporal.StepTables(spark, folder)
    samples, flags = tables.whole("samples").drop("batch"), tables.whole("flags").drop("batch")
    return samples, temporal.blocks_of(samples, flags)
