"""Importance sampling, counts by region, and random fill up to the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GridConfig
from ..functions import geometry as g
from ..sources.shared import attach
from .importance import acceptance
from .stats import binned, histogram


def judged(field: DataFrame, cfg: GridConfig, odds: DataFrame | None = None) -> DataFrame:
    """(t, gid, block_id, value, p, taken) for every cell: taken where the cell's random number is under p.

    One pass over the cells; the ranges and probabilities by timestep are broadcast. odds is acceptance(), if it is there already.
    """
    cells = binned(field, cfg)
    odds = acceptance(histogram(field, cfg, cells), cfg) if odds is None else odds
    cells = attach(cells, odds.select("t", "bin", "p"), ["t", "bin"])
    taken = g.uniform("importance", F.col("t"), F.col("gid"), cfg) < F.col("p")
    return cells.select("t", "gid", g.block_id(F.col("gid"), cfg).alias("block_id"), "value", "p", taken.alias("taken"))


def importance_sample(field: DataFrame, cfg: GridConfig, cells: DataFrame | None = None) -> DataFrame:
    """(t, gid, block_id, value, kind) of the sampled cells. cells is judged(), if it is there already."""
    return (judged(field, cfg) if cells is None else cells).where("taken").select("t", "gid", "block_id", "value", F.lit("importance").alias("kind"))


def samples_per_block(field: DataFrame, samples: DataFrame, cfg: GridConfig) -> DataFrame:
    """(t, block_id, n_samples) for every region, those without a sample too."""
    counts = samples.groupBy("t", "block_id").agg(F.count("*").alias("n_samples"))
    blocks = field.select("t").distinct().withColumn("block_id", F.explode(F.sequence(F.lit(0), F.lit(cfg.blocks - 1))))
    return blocks.join(counts, ["t", "block_id"], "left").select("t", "block_id", F.coalesce("n_samples", F.lit(0)).cast("long").alias("n_samples"))


def fill(cells: DataFrame, reused: DataFrame, cfg: GridConfig, open_cells: DataFrame | None = None) -> DataFrame:
    """(t, gid, block_id, value, kind) of cells added at random to timesteps that reuse regions.

    cells is judged(); reused is (t, block_id, reused); open_cells are the cells that don't reuse, if they are there already. Where regions are reused and budget is left, the budget goes evenly to
    the other regions: each of their cells that isn't taken is drawn with one probability. Regions are filled in order of
    their number, up to the first that would reach the budget. No cell is drawn twice.
    """
    budget = F.lit(int(cfg.ratio * cfg.cells)).cast("long")
    open_cells = attach(cells, reused, ["t", "block_id"]).where("not reused") if open_cells is None else open_cells
    per_t = reused.groupBy("t").agg(F.count_if(~F.col("reused")).alias("n_open"), F.count_if("reused").alias("n_reused"))
    had = open_cells.groupBy("t").agg(F.count_if("taken").alias("had"))
    share = F.try_divide(F.try_divide(budget - F.col("had"), F.col("n_open")), F.lit(cfg.block_volume))
    rates = per_t.join(had, "t").withColumn("rate", F.when((F.col("n_reused") > 0) & (F.col("had") < budget), share).otherwise(0.0)).select("t", "had", "rate")
    drawn = attach(open_cells, rates, ["t"]).where(~F.col("taken") & (g.uniform("fill", F.col("t"), F.col("gid"), cfg) < F.col("rate")))
    running = F.sum("n").over(W.partitionBy("t").orderBy("block_id"))
    sums = drawn.groupBy("t", "block_id").agg(F.count("*").alias("n"), F.first("had").alias("had")).withColumn("sum", F.col("had") + running)
    stop = sums.where(F.col("sum") >= budget).groupBy("t").agg(F.min("block_id").alias("stop"))
    kept = attach(drawn, stop, ["t"], "left").where(F.col("stop").isNull() | (F.col("block_id") < F.col("stop")))
    return kept.select("t", "gid", "block_id", "value", F.lit("fill").alias("kind"))
