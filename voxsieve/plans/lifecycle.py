"""Whole runs: sample a field by a named method, rebuild it, and report on it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GridConfig
from ..functions import geometry as g
from ..operators import importance, recon, sampling, stats, temporal
from ..sources import raw
from ..sources.shared import attach, written


def _importance(field: DataFrame, cfg: GridConfig, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    samples = sampling.importance_sample(field, cfg, cells)
    return samples, sampling.samples_per_block(field, samples, cfg).withColumn("reused", F.lit(False))


#: Sampling methods: each takes a field, settings and the judged cells, if these are there already as a table, and returns (samples, blocks).
METHODS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {
    "importance": _importance,
    "histogram_reuse": partial(temporal.temporal_histogram_sample, with_fill=False),
    "histogram_reuse_filled": temporal.temporal_histogram_sample,
    "error_reuse": temporal.temporal_error_sample,
    "error_reuse_filled": temporal.temporal_error_sample_filled,
}
#: The methods' customary numbers; three numbers differ in the processor only.
NUMBERED = {n: ("importance", "histogram_reuse_filled", "error_reuse_filled")[(n - 1) // 3] for n in range(1, 10)}


def sample(field: DataFrame, cfg: GridConfig, method: str | int, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return METHODS[NUMBERED[method] if isinstance(method, int) else method](field, cfg, cells=cells)


def rebuild(field: DataFrame, samples: DataFrame, blocks: DataFrame, cfg: GridConfig, nearest: int = 1) -> DataFrame:
    """Cells with value and rebuilt, from the effective samples of each timestep."""
    effective = temporal.coalesced(samples, blocks)
    return (recon.nn_reconstruct if nearest == 1 else recon.knn_reconstruct)(field, effective, cfg)


def assess(field: DataFrame, cfg: GridConfig, method: str | int, nearest: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """(t, n, max_diff, avg_diff, rmse, psnr, snr, blocks_reused, n_samples) of a method. cells is judged(), if it is there already as a table."""
    samples, blocks = sample(field, cfg, method, cells)
    samples, blocks = written(samples, "samples"), written(blocks, "blocks")
    pairs = rebuild(field, samples, blocks, cfg, nearest)
    return stats.paired_quality(pairs, F.col("value"), F.col("rebuilt")).join(temporal.reuse_counts(blocks), "t")


def assess_each(field: DataFrame, cfg: GridConfig, methods: list[str | int], nearest: int = 1) -> list[DataFrame]:
    """assess() of several methods over cells judged once. Each method is a chain of jobs, many of them short; the chains run beside one another."""
    cells, spark = written(sampling.judged(field, cfg), "judged"), field.sparkSession
    with ThreadPoolExecutor(len(methods)) as pool:
        return [one.result() for one in [pool.submit(inheritable_thread_target(spark)(assess), field, cfg, m, nearest, cells) for m in methods]]


#: The parts of sampling, in their order. Which of them a method has depends on it.
STEPS = ("histogram", "sort", "acceptance", "block_histogram", "comparison", "stencil", "fill", "gather")


class Clock:
    """Seconds by step, and by timestep where a step runs for each of them."""

    def __init__(self) -> None:
        self.seconds: dict[tuple[str, int | None], float] = {}

    @contextmanager
    def __call__(self, step: str, t: int | None = None) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[step, t] = self.seconds.get((step, t), 0.0) + time.monotonic() - began

    def table(self, step: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """rows() as a written table, whose making is the step."""
        with self(step):
            return written(rows(), step)

    def total(self, *steps: str) -> float:
        return sum(s for (step, _), s in self.seconds.items() if step in steps)

    def of(self, step: str, share: Column) -> Column:
        """A timestep's seconds of a step: its own where they were taken, and its share of those that all timesteps took together."""
        own = [x for t, s in self.seconds.items() if t[0] == step and t[1] is not None for x in (F.lit(t[1]), F.lit(s))]
        together = F.lit(self.seconds.get((step, None), 0.0)) * share
        if step not in {k for k, _ in self.seconds}:
            return F.lit(None).cast("double")
        return together + (F.coalesce(F.try_element_at(F.create_map(*own), F.col("t")), F.lit(0.0)) if own else F.lit(0.0))


def timed_sample(field: DataFrame, cfg: GridConfig, method: str | int, clock: Clock) -> tuple[DataFrame, DataFrame]:
    """(samples, blocks) of a method, as sample() has them, each step a table of its own that clock times."""
    name = NUMBERED[method] if isinstance(method, int) else method
    hist = clock.table("histogram", lambda: stats.histogram(field, cfg))
    clock.table("sort", lambda: importance.bin_order(hist))
    odds = clock.table("acceptance", lambda: importance.acceptance(hist, cfg))
    if name.startswith("histogram"):
        shapes = clock.table("block_histogram", lambda: stats.block_histogram(field, cfg))
        reused = clock.table("comparison", lambda: temporal.reuse_by_histogram(field, cfg, shapes).select("t", "block_id", "reused"))
    cells = clock.table("stencil", lambda: sampling.judged(field, cfg, odds))
    if name == "error_reuse_filled":
        samples, blocks = temporal.temporal_error_sample_filled(field, cfg, cells, clock)
        return clock.table("gather", lambda: samples), written(blocks, "blocks")
    if name == "importance":
        samples = clock.table("gather", lambda: cells.where("taken").select("t", "gid", "block_id", "value", F.lit("importance").alias("kind")))
        return samples, written(sampling.samples_per_block(field, samples, cfg).withColumn("reused", F.lit(False)), "blocks")
    if name.startswith("error"):
        reused = clock.table("comparison", lambda: temporal.reuse_by_error(cells, cfg).select("t", "block_id", "reused"))
    parts = [clock.table("fill", lambda: sampling.fill(cells, reused, cfg))] if name.endswith("filled") else []
    samples = clock.table("gather", lambda: reduce(DataFrame.unionByName, parts, temporal.own_samples(cells, reused)))
    return samples, written(temporal.blocks_of(samples, reused), "blocks")


def report(field: DataFrame, cfg: GridConfig, method: str | int, nearest: int = 1, clock: Clock | None = None) -> DataFrame:
    """Figures of a method by timestep with the run's settings, and its times and rates by step: 26 columns.

    Each step is a job of its own over all timesteps, and its seconds are shared out by the timesteps' cells; steps that run for
    one timestep after another, as those of error reuse with fill, have each one's own. Steps that a method hasn't got are null,
    and so is all about the rebuilt field where nearest is 0. Rates are by the size of a timestep's file, those of sorting and
    acceptance by the size of its histogram.
    """
    clock = clock or Clock()
    samples, blocks = timed_sample(field, cfg, method, clock)
    figures = ["max_diff", "avg_diff", "psnr", "snr"]
    if nearest:
        pairs = clock.table("recons", lambda: rebuild(field, samples, blocks, cfg, nearest).select("t", "gid", "value", "rebuilt"))
        quality = stats.paired_quality(pairs, F.col("value"), F.col("rebuilt")).select("t", *figures)
        counts = temporal.reuse_counts(blocks).join(quality, "t")
    else:
        counts = temporal.reuse_counts(blocks).select("*", *[F.lit(None).cast("double").alias(c) for c in figures])
    share = field.groupBy("t").agg(F.count("*").alias("cells")).withColumn("share", F.col("cells") / F.sum("cells").over(W.partitionBy(F.lit(0))))  # a row a timestep
    rows = written(counts.join(share, "t"), "report")
    of = {step: clock.of(step, F.col("share")) for step in (*STEPS, "recons")}
    file_gb, bins_gb = 4 * cfg.cells / 1e9, 4 * cfg.num_bins / 1e9
    sampling_s = sum((F.coalesce(of[step], F.lit(0.0)) for step in STEPS), F.lit(0.0))
    rate = lambda step: F.try_divide(F.lit(bins_gb if step in ("sort", "acceptance") else file_gb), of[step]).alias(f"{step}_gb_s")
    settings = {
        "method": method if isinstance(method, str) else NUMBERED[method],
        "file_gb": file_gb,
        "ratio": float(cfg.ratio),
        "region_dims": "/".join(map(str, cfg.block_dims)),
        "num_bins": cfg.num_bins,
        "reconstruction": {0: None, 1: "nearest"}.get(nearest, f"nearest_{cfg.neighbours}"),
    }
    return rows.select(
        "t", *[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in settings.items()],
        F.try_divide(F.lit(file_gb), sampling_s).alias("sampling_gb_s"), sampling_s.alias("sampling_s"), *map(rate, STEPS),
        of["recons"].alias("recons_s"), F.try_divide(F.lit(1000 * file_gb), of["recons"]).alias("recons_mb_s"),
        "blocks_reused", "n_samples", *figures, F.lit(field.sparkSession.sparkContext.defaultParallelism).alias("threads"),
    )


def short_report(rows: DataFrame) -> DataFrame:
    """The 19 columns of a report in microseconds and megabytes: of the steps only the histogram's and the drawing of samples."""
    us = lambda c: F.col(c) * 1e6
    of = lambda step, gb: F.try_divide(F.lit(1e6) * gb, F.col(f"{step}_gb_s"))
    return rows.select(
        "t", "method", (F.col("file_gb") * 1000).alias("file_mb"), "ratio", "region_dims", "num_bins", "reconstruction", (F.col("sampling_gb_s") * 1000).alias("sampling_mb_s"), us("sampling_s").alias("total_us"),
        of("histogram", F.col("file_gb")).alias("histogram_us"), of("stencil", F.col("file_gb")).alias("sample_us"), us("recons_s").alias("recons_us"), "recons_mb_s",
        "blocks_reused", "n_samples", "max_diff", "avg_diff", "psnr", "snr",
    )


def summaries(rows: DataFrame, settings: list[str], figures: list[str]) -> DataFrame:
    """rows with means over all timesteps as t = -1 and deviations as t = -2. The first timestep, which can't reuse, is left out of those of blocks_reused."""
    own = rows.select("t", *settings, *[F.col(c).cast("double").alias(c) for c in figures])
    first = own.agg(F.min("t").alias("first"))
    later = attach(own.withColumn("__one", F.lit(0)), first.withColumn("__one", F.lit(0)), ["__one"]).withColumn("blocks_reused", F.when(F.col("t") > F.col("first"), F.col("blocks_reused")))
    for t, summary in ((-1, F.avg), (-2, F.stddev_pop)):
        own = own.unionByName(later.groupBy(*settings).agg(F.lit(t).alias("t"), *[summary(c).alias(c) for c in figures]))
    return own


def sample_cloud(field: DataFrame, samples: DataFrame, blocks: DataFrame, cfg: GridConfig) -> DataFrame:
    """(t, place, x, y, z, value): every timestep's effective samples in order of region and cell, then the grid's corners out of the field.

    Regions that reuse show the samples of the timestep before. Corners keep the hull of the cloud whole; they follow in order of
    x, y and z, and stand there whether they were sampled or not.
    """
    points = raw.place_samples(temporal.coalesced(samples, blocks)).select("t", "place", "gid", "value")
    counts = points.groupBy("t").agg(F.count("*").alias("n"))
    at = [(x, y, z) for x in (0, cfg.dims[0] - 1) for y in (0, cfg.dims[1] - 1) for z in (0, cfg.dims[2] - 1)]
    cells = [(k, x + cfg.dims[0] * (y + cfg.dims[1] * z)) for k, (x, y, z) in enumerate(at)]
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).cast("long").alias("c")) for k, c in cells]))
    found = field.where(F.col("gid").isin([c for _, c in cells])).withColumn("corner", corner).where("corner.c = gid")
    nth = F.row_number().over(W.partitionBy("t").orderBy("corner.k")) - 1  # eight rows a timestep
    corners = attach(found.withColumn("nth", nth), counts, ["t"], "left").select("t", (F.coalesce("n", F.lit(0)) + F.col("nth")).alias("place"), "gid", "value")
    x, y, z = g.xyz(F.col("gid"), cfg)
    return points.unionByName(corners).select("t", "place", x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"), "value")


def snr_report(pairs: DataFrame, roi: DataFrame, cfg: GridConfig, filename: str) -> DataFrame:
    """(t, filename, snr, snr_roi) of rebuilt cells; filename holds {t}. snr_roi is null where no cell is of interest."""
    pairs = written(pairs.select("t", "gid", "value", "rebuilt"), "pairs")
    quality = lambda df: stats.paired_quality(df, F.col("value"), F.col("rebuilt")).select("t", "snr")
    inside = quality(stats.roi_cells(pairs, roi, cfg)).withColumnRenamed("snr", "snr_roi")
    return quality(pairs).join(inside, "t", "left").select("t", F.format_string(filename.replace("{t}", "%d"), "t").alias("filename"), "snr", "snr_roi")


def register_views(field: DataFrame, samples: DataFrame, blocks: DataFrame, rebuilt: DataFrame) -> None:
    """The tables of a run as the views field, samples, blocks and recon, for SQL."""
    for name, df in (("field", field), ("samples", samples), ("blocks", blocks), ("recon", rebuilt)):
        df.createOrReplaceTempView(name)
