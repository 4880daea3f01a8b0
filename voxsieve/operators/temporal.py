"""Reuse of the previous timestep's samples, region by region.

A region that may reuse at t, judged against t-1, does so unless it reused at t-1. Inside a run of successive such timesteps
that is every second one, so the recurrence is a window over each region's timesteps and needs no loop.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import AbstractContextManager, nullcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GridConfig
from ..functions.geometry import uniform
from ..sources.shared import attach, new_path, written
from .sampling import fill, judged
from .stats import block_histogram


def alternating(rows: DataFrame, may_reuse: Column) -> DataFrame:
    """rows (t, block_id, ...) with the column reused, where may_reuse compares with the timestep before."""
    by_block = W.partitionBy("block_id").orderBy("t")
    marked = rows.withColumn("__may", F.coalesce(may_reuse, F.lit(False)) & (F.lag("t").over(by_block) == F.col("t") - 1))
    runs = marked.withColumn("__run", F.sum(F.when(F.col("__may"), 0).otherwise(1)).over(by_block))
    place = F.row_number().over(W.partitionBy("block_id", "__run").orderBy("t")) - 1
    return runs.withColumn("reused", place % 2 == 1).drop("__may", "__run")


def reuse_by_histogram(field: DataFrame, cfg: GridConfig, shapes: DataFrame | None = None) -> DataFrame:
    """(t, block_id, hist, reused): a region may reuse if its histogram equals the last one. shapes is block_histogram(), if it is there already."""
    by_block = W.partitionBy("block_id").orderBy("t")
    return alternating(block_histogram(field, cfg) if shapes is None else shapes, F.col("hist") == F.lag("hist").over(by_block))


def block_rmse(cells: DataFrame) -> DataFrame:
    """(t, block_id, n_reference, rmse): how far a region's cells are from the samples taken of them a timestep earlier.

    The samples, shifted by a timestep, meet the field by cell, so the join's small side is a hundredth of it or so and the
    engine may filter the field by it before any shuffle. rmse is null where the region had no sample.
    """
    before = cells.where("taken").select((F.col("t") + 1).alias("t"), "gid", F.col("value").alias("before"))
    gap = cells.select("t", "gid", "block_id", "value").join(before, ["t", "gid"]).select("t", "block_id", (F.col("value") - F.col("before")).alias("gap"))
    found = gap.groupBy("t", "block_id").agg(F.count("gap").alias("n_reference"), F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("rmse"))
    every = cells.select("t", "block_id").distinct()
    return every.join(found, ["t", "block_id"], "left").select("t", "block_id", F.coalesce("n_reference", F.lit(0)).cast("long").alias("n_reference"), "rmse")


def reuse_by_error(cells: DataFrame, cfg: GridConfig) -> DataFrame:
    """(t, block_id, n_reference, rmse, reused): a region may reuse if its RMSE is within the threshold."""
    return alternating(block_rmse(cells), F.col("rmse") <= F.lit(cfg.error_threshold))


def own_samples(cells: DataFrame, reused: DataFrame) -> DataFrame:
    """The samples taken afresh: those of regions that don't reuse."""
    return attach(cells.where("taken"), reused.select("t", "block_id", "reused"), ["t", "block_id"]).where("not reused").select("t", "gid", "block_id", "value", F.lit("importance").alias("kind"))


def filled_samples(cells: DataFrame, reused: DataFrame, cfg: GridConfig) -> DataFrame:
    """own_samples() and what fills up, which share the cells of the regions that don't reuse."""
    open_cells = attach(cells, reused.select("t", "block_id", "reused"), ["t", "block_id"]).where("not reused")
    own = open_cells.where("taken").select("t", "gid", "block_id", "value", F.lit("importance").alias("kind"))
    return own.unionByName(fill(cells, reused, cfg, open_cells))


def temporal_histogram_sample(field: DataFrame, cfg: GridConfig, with_fill: bool = True, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, blocks): samples by histogram reuse, with fill or without; blocks are (t, block_id, n_samples, reused).

    cells is judged(), if it is there already as a table.
    """
    reused = reuse_by_histogram(field, cfg).select("t", "block_id", "reused")
    if with_fill:
        cells = written(judged(field, cfg), "judged") if cells is None else cells
        reused = written(reused, "reused")  # what fills up reads them several times
        samples = filled_samples(cells, reused, cfg)
    else:
        samples = own_samples(judged(field, cfg) if cells is None else cells, reused)
    return samples, blocks_of(samples, reused)


def temporal_error_sample(field: DataFrame, cfg: GridConfig, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, blocks) by error reuse without fill: all timesteps at once. cells is judged(), if it is there already."""
    cells = judged(field, cfg) if cells is None else cells
    reused = reuse_by_error(cells, cfg).select("t", "block_id", "reused")
    samples = own_samples(cells, reused)
    return samples, blocks_of(samples, reused)


def error_step(now: DataFrame, before: DataFrame | None, flags_before: DataFrame | None, cfg: GridConfig) -> DataFrame:
    """(t, block_id, reused) of one timestep's judged cells, given the samples and flags of the timestep before, or none of them."""
    every = now.select("t", "block_id").distinct()
    if before is None:
        return every.withColumn("reused", F.lit(False))
    gap = F.col("value") - F.col("before")
    gaps = now.join(before.select("gid", F.col("value").alias("before")), "gid").groupBy("block_id").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))
    old = flags_before.select("block_id", F.col("reused").alias("was"))
    may = (F.col("rmse") <= F.lit(cfg.error_threshold)) & ~F.coalesce("was", F.lit(False))
    return every.join(gaps, "block_id", "left").join(old, "block_id", "left").select("t", "block_id", F.coalesce(may, F.lit(False)).alias("reused"))


class StepTables:
    """Samples and flags of successive timesteps in two tables in the shared folder, written piece by piece.

    A piece is a timestep or a run of them, named by its first one and by the batch that brought it. It counts once its samples
    are there, which are written last.
    """

    SHAPES = {"samples": "t int, gid long, block_id int, value double, kind string", "flags": "t int, block_id int, reused boolean"}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def keep(self, rows: DataFrame, name: str, first: int, batch: int = 0) -> DataFrame:
        """Write a piece, in place of what may be there, and return it."""
        path, columns = f"{self.folder}/{name}/batch={batch}/piece={first}", [c.split()[0] for c in self.SHAPES[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.SHAPES[name]).parquet(path)

    def pieces(self) -> list[tuple[int, int]]:
        """(batch, first timestep) of the pieces that count."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/samples")
        store = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = store.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(at, "batch=*/piece=*/_SUCCESS")) if store.exists(at) else None
        names = [(f.getPath().getParent().getParent().getName(), f.getPath().getParent().getName()) for f in found or ()]
        return sorted((int(b.partition("=")[2]), int(p.partition("=")[2])) for b, p in names)

    def whole(self, name: str) -> DataFrame:
        """(t, ...) of all pieces that count, with their batch."""
        kept, shape = self.pieces(), f"{self.SHAPES[name]}, batch int, piece int"
        if not kept:
            return self.spark.createDataFrame([], shape).drop("piece")
        found = self.spark.read.schema(shape).parquet(f"{self.folder}/{name}")
        return found.join(F.broadcast(self.spark.createDataFrame(kept, "batch int, piece int")), ["batch", "piece"]).drop("piece").select(*[c for c in found.columns if c != "piece"])


#: Cells that one task decides timestep after timestep, and up to how many timesteps are decided by a job each all the same.
RUN_CELLS, FEW = 1 << 18, 8


def by_runs(times: int, cfg: GridConfig) -> bool:
    """Whether so many timesteps are decided by runs. Large timesteps are not: each is a job over many tasks, of which there are then no more than the cells make up for."""
    return times > FEW and 2 * cfg.cells <= RUN_CELLS


_START = "run long, t int, block_id int, reused boolean, sampled boolean, gid long, value double"
_DECIDED = f"{_START}, rate double"


def _decided(cells: pd.DataFrame, start: pd.DataFrame, cfg: GridConfig) -> pd.DataFrame:
    """Flags and fill rates of a run's timesteps, and the samples of its last one, given those rows of the timestep before the run (or none).

    A region's rate is 0 from the first one on that would reach the budget, so its cells under the rate are those that fill adds. A sample without a value takes no part in errors and is left out. Rows are put in order, so that sums are the same each time.
    """
    cells = cells.sort_values(["t", "block_id", "gid", "value", "u"], ignore_index=True)
    start = start.sort_values(["sampled", "block_id", "gid", "value"], ignore_index=True)
    columns = {c: cells[c].to_numpy() for c in ("block_id", "gid", "value", "known", "taken", "u")}
    edges = np.flatnonzero(np.diff(cells["t"].to_numpy(), prepend=np.int64(-1) << 40)).tolist() + [len(cells)]
    sampled, budget, out, t_before = start["sampled"].to_numpy(bool), int(cfg.ratio * cfg.cells), [], None
    if len(start):
        t_before, regions, was = int(start["t"][0]), start["block_id"].to_numpy()[~sampled], start["reused"].to_numpy(bool)[~sampled]
        gids, values = start["gid"].to_numpy()[sampled], start["value"].to_numpy()[sampled]
    for a, b in zip(edges, edges[1:], strict=False):
        t, (block, gid, value, known, taken, u) = int(cells["t"].iat[a]), (c[a:b] for c in columns.values())
        blocks, at = np.unique(block, return_inverse=True)
        reused = np.zeros(len(blocks), bool)
        if t_before == t - 1:
            order = np.argsort(gids, kind="stable")
            gids, values = gids[order], values[order]
            low = np.searchsorted(gids, gid, "left")
            n = np.where(known, np.searchsorted(gids, gid, "right") - low, 0)
            cell = np.repeat(np.arange(b - a), n)
            gap = value[cell] - values[np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)]
            met = np.bincount(at[cell], minlength=len(blocks))
            sums = np.bincount(at[cell], gap * gap, len(blocks))
            may = np.zeros(len(blocks), bool)
            may[met > 0] = np.sqrt(sums[met > 0] / met[met > 0]) <= cfg.error_threshold
            reused = may & ~np.isin(blocks, regions[was])
        free = ~reused[at]
        had, n_open = int((taken & free).sum()), int((~reused).sum())
        rate = (budget - had) / n_open / cfg.block_volume if reused.any() and n_open and had < budget else 0.0
        drawn = free & ~taken & (u < rate)
        added = np.bincount(at[drawn], minlength=len(blocks))
        stops = np.flatnonzero((added > 0) & (had + np.cumsum(added) >= budget))
        rates = np.where(np.arange(len(blocks)) < (stops[0] if len(stops) else len(blocks)), rate, 0.0)
        own = free & (taken | (u < rates[at]))
        out.append((np.full(len(blocks), t), blocks, reused, rates))
        own &= known
        t_before, regions, was, gids, values = t, blocks, reused, gid[own], value[own]
    if not out:
        return pd.DataFrame(columns=["t", "block_id", "reused", "sampled", "gid", "value", "rate"])
    flags = pd.DataFrame({k: np.concatenate(c) for k, c in zip(("t", "block_id", "reused", "rate"), zip(*out, strict=True), strict=True)})
    ends = pd.DataFrame({"t": t_before, "block_id": block[own], "reused": False, "sampled": True, "gid": gids, "value": values, "rate": 0.0})
    return pd.concat([flags.assign(sampled=False, gid=0, value=0.0), ends], ignore_index=True)


def flags_by_runs(cells: DataFrame, cfg: GridConfig, first: int, last: int, before: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(t, block_id, reused, rate) of error reuse with fill for many small timesteps of judged cells, from first to last; before has samples and flags of earlier ones.

    A timestep's flags follow from the samples and flags of the one before it. Timesteps are cut into runs of RUN_CELLS cells or
    so, and each run is one task's work. All runs are decided at once, as if nothing came before them; then those whose start was
    another than assumed are decided again, until none is. So the first run is right at once and each round makes one more right
    at least. Mostly two or three rounds do, as flags depend little on what was long ago.
    """
    spark, steps = cells.sparkSession, max(1, RUN_CELLS // cfg.cells)
    run, path = F.floor(F.col("t") / F.lit(steps)).cast("long").alias("run"), new_path(cells.sparkSession, "runs")
    rows = cells.select(run, "t", "gid", "block_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("known"), "taken", uniform("fill", F.col("t"), F.col("gid"), cfg).alias("u"))
    rows.repartition("run").write.partitionBy("run").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    given = spark.createDataFrame([], _START)
    if before is not None:
        just, at = F.col("t") == first - 1, F.lit(first // steps).cast("long").alias("run")
        none = (F.lit(False).alias("sampled"), F.lit(0).cast("long").alias("gid"), F.lit(0.0).alias("value"))
        samples = before[0].where(just & F.col("value").isNotNull()).select(at, "t", "block_id", F.lit(False).alias("reused"), F.lit(True).alias("sampled"), "gid", "value")
        given = written(samples.unionByName(before[1].where(just).select(at, "t", "block_id", "reused", *none)), "starts")

    def decide(rows: DataFrame, starts: DataFrame) -> DataFrame:
        work = lambda key, cells, start: _decided(cells, start, cfg).assign(run=key[0])[[c.split()[0] for c in _DECIDED.split(", ")]]
        return rows.groupBy("run").cogroup(starts.groupBy("run")).applyInPandas(work, _DECIDED)

    assumed, found = given, written(decide(rows, given), "decided")
    while first // steps < last // steps:  # a single run has its start at once
        lasts = found.groupBy("run").agg(F.max("t").alias("t"))
        ends = attach(found, lasts, ["run", "t"]).select((F.col("run") + 1).alias("run"), "t", "block_id", "reused", "sampled", "gid", "value")
        starts = written(ends.unionByName(given), "starts")
        changed = [r.run for r in starts.exceptAll(assumed).unionByName(assumed.exceptAll(starts)).select("run").distinct().collect()]
        if not changed:
            break
        of = F.col("run").isin(changed)
        found, assumed = written(found.where(~of).unionByName(decide(rows.where(of), starts.where(of))), "decided"), starts
    return found.where("not sampled").select("t", "block_id", "reused", "rate")


def samples_by_runs(cells: DataFrame, flags: DataFrame, cfg: GridConfig) -> DataFrame:
    """The samples of judged cells by the flags and rates of flags_by_runs: the same as filled_samples() has, in one join."""
    drawn = uniform("fill", F.col("t"), F.col("gid"), cfg) < F.col("rate")
    free = attach(cells, flags.where("not reused").select("t", "block_id", "rate"), ["t", "block_id"]).where(F.col("taken") | drawn)
    return free.select("t", "gid", "block_id", "value", F.when(F.col("taken"), "importance").otherwise("fill").alias("kind"))


def temporal_error_sample_filled(field: DataFrame, cfg: GridConfig, cells: DataFrame | None = None, clock: Callable[[str, int | None], AbstractContextManager] = lambda step, t: nullcontext()) -> tuple[DataFrame, DataFrame]:
    """(samples, blocks) by error reuse with fill.

    What fill draws depends on how many regions reuse, and the next timestep is compared with all samples, fill included, so
    timesteps follow one another. Many small ones are decided by runs (flags_by_runs), and their samples then taken all at once. Few or large
    ones are a distributed job each over its own cells, a partition of their table, and its samples and flags are pieces of two
    tables in the shared folder. cells is judged(), if it is there already; clock(step, t) surrounds the parts of a timestep, or
    of all timesteps together where t is None.
    """
    spark = field.sparkSession
    cells = written(judged(field, cfg), "judged") if cells is None else cells
    count, first, last = cells.agg(F.count_distinct("t"), F.min("t"), F.max("t")).first()
    if by_runs(count, cfg):
        with clock("comparison", None):
            flags = flags_by_runs(cells, cfg, first, last)
        with clock("fill", None):
            samples = written(samples_by_runs(cells, flags, cfg), "samples")
        return samples, blocks_of(samples, flags.drop("rate"))
    path, schema = new_path(spark, "judged"), cells.schema
    cells.write.partitionBy("t").parquet(path)
    cells = spark.read.schema(schema).parquet(path)
    tables, last = StepTables(spark, new_path(spark, "steps")), None
    for t in [r.t for r in cells.select("t").distinct().orderBy("t").collect()]:
        now = cells.where(F.col("t") == t)
        follows = last is not None and last[0] == t - 1
        with clock("comparison", t):
            flags = tables.keep(error_step(now, last[1] if follows else None, last[2] if follows else None, cfg), "flags", t)
        with clock("fill", t):
            own = tables.keep(filled_samples(now, flags, cfg), "samples", t)
        last = (t, own, flags)
    samples, flags = tables.whole("samples").drop("batch"), tables.whole("flags").drop("batch")
    return samples, blocks_of(samples, flags)


def blocks_of(samples: DataFrame, reused: DataFrame) -> DataFrame:
    """(t, block_id, n_samples, reused)."""
    counts = samples.groupBy("t", "block_id").agg(F.count("*").alias("n_samples"))
    return reused.join(counts, ["t", "block_id"], "left").select("t", "block_id", F.coalesce("n_samples", F.lit(0)).cast("long").alias("n_samples"), "reused")


def coalesced(samples: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every timestep's effective samples: its own, and for reused regions those of the timestep before."""
    again = samples.withColumn("t", F.col("t") + 1)
    borrowed = attach(again, blocks.where("reused").select("t", "block_id"), ["t", "block_id"])
    return samples.unionByName(borrowed.select(*samples.columns))


def reuse_counts(blocks: DataFrame) -> DataFrame:
    """(t, blocks_reused, n_samples)."""
    return blocks.groupBy("t").agg(F.count_if("reused").alias("blocks_reused"), F.sum("n_samples").alias("n_samples"))
