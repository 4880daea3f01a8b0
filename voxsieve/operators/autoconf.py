"""Choices made from the data: number of bins, error threshold and region size."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GridConfig
from .recon import nn_reconstruct
from .sampling import importance_sample
from .stats import paired_quality, percentile_by_index, percentiles_by_index


def scott(n: Column, sd: Column) -> Column:
    return F.pow(F.lit(24 * math.sqrt(math.pi)) / n, F.lit(1 / 3)) * sd


def doane(n: Column, span: Column, m: Column) -> Column:
    """m is the skewness, or the mean z-score in the variant that leaves it out."""
    spread = F.sqrt(F.lit(6.0) * (n - 2) / ((n + 1.0) * (n + 3)))
    return span / (1 + F.log2(n) + F.log2(1 + F.abs(m) / spread))


def sturges(n: Column, span: Column) -> Column:
    return span / F.log2(n + 1)


def freedman_diaconis(n: Column, iqr: Column) -> Column:
    return 2 * iqr / F.pow(n, F.lit(1 / 3))


def bin_widths(field: DataFrame, textbook: bool = False) -> DataFrame:
    """(t, n, sd, span, scott, doane, sturges) with the numbers of bins for each width."""
    moments = field.groupBy("t").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("sd"), (F.max("value") - F.min("value")).alias("span"), F.skewness("value").alias("skew"))
    m = F.coalesce("skew", F.lit(0.0)) if textbook else F.lit(0.0)
    n = F.col("n").cast("double")
    widths = moments.select("t", "n", "sd", "span", scott(n, F.col("sd")).alias("scott"), doane(n, F.col("span"), m).alias("doane"), sturges(n, F.col("span")).alias("sturges"))
    bins = lambda c: (F.ceil(F.try_divide("span", c)) + 1).cast("int")
    return widths.select("*", bins("scott").alias("scott_bins"), bins("doane").alias("doane_bins"), bins("sturges").alias("sturges_bins"))


def freedman_bins(field: DataFrame) -> DataFrame:
    """(t, n, iqr, width, bins) by Freedman and Diaconis, with quartiles by index; a width of 0 has no number of bins."""
    sound = field.where("value is not null and not isnan(value)")
    quartiles = percentiles_by_index(sound, "t", "value", [0.25, 0.75])
    spans = sound.groupBy("t").agg((F.max("value") - F.min("value")).alias("span"))
    found = quartiles.join(spans, "t").select("t", "n", (F.col("p1") - F.col("p0")).alias("iqr"), "span")
    found = found.withColumn("width", freedman_diaconis(F.col("n").cast("double"), F.col("iqr")))
    return found.select("t", "n", "iqr", "width", (F.ceil(F.try_divide("span", "width")) + 1).cast("int").alias("bins"))


def bins_sweep(field: DataFrame, cfg: GridConfig) -> DataFrame:
    """(num_bins, psnr, place) for Scott's and Doane's numbers of bins: how well each rebuilds the first timestep; Scott's alone,
    untried, for regions of one cell. Each candidate is a whole sampling and reconstruction of that timestep."""
    first = field.agg(F.min("t")).first()[0]
    start = field.where(F.col("t") == first)
    widths = bin_widths(start).select("scott_bins", "doane_bins").first()
    spark, shape = field.sparkSession, "num_bins int, psnr double, place int"
    if widths is None:
        return spark.createDataFrame([], shape)
    if cfg.block_dims == (1, 1, 1):
        return spark.createDataFrame([(widths.scott_bins, None, 0)], shape)
    tried = spark.createDataFrame([], shape)
    for place, bins in enumerate(dict.fromkeys(widths)):
        own = replace(cfg, num_bins=bins)
        rebuilt = nn_reconstruct(start, importance_sample(start, own), own)
        row = paired_quality(rebuilt, F.col("value"), F.col("rebuilt")).select(F.lit(bins).alias("num_bins"), "psnr", F.lit(place).alias("place"))
        tried = tried.unionByName(row)
    return tried


def auto_bins(field: DataFrame, cfg: GridConfig) -> DataFrame:
    """(num_bins, psnr): the best of the sweep, the first of equals."""
    return bins_sweep(field, cfg).orderBy(F.col("psnr").desc(), "place").limit(1).select("num_bins", "psnr")


def error_threshold(field: DataFrame, share: float = 0.75) -> DataFrame:
    """(value): the value at place int(n * share) among the ascending differences of the first two timesteps."""
    times = [r.t for r in field.select("t").distinct().orderBy("t").limit(2).collect()]
    if len(times) < 2:
        return field.sparkSession.createDataFrame([(None,)], "value double")
    two = field.where(F.col("t").isin(times))
    by_cell = W.partitionBy("gid").orderBy("t")
    gaps = two.select(F.abs(F.col("value") - F.lag("value").over(by_cell)).alias("gap"))
    return percentile_by_index(gaps, "gap", share)


def grid_extent(field: DataFrame, cfg: GridConfig) -> DataFrame:
    """(x_dim, y_dim, z_dim) as far as cells reach, for a known x and y dimension."""
    x, y, _ = cfg.dims
    return field.agg(F.max(F.col("gid") % x).alias("x"), F.max(F.expr(f"gid div {x} % {y}")).alias("y"), F.max(F.expr(f"gid div {x * y}")).alias("z")).select(*[(F.col(c) + 1).cast("int").alias(f"{c}_dim") for c in "xyz"])


def candidate_regions(extent: DataFrame) -> DataFrame:
    """(place, bx, by, bz, regions): region sizes from the divisors of each dimension, 3 at least and less than the whole, one
    for each number of regions: the first in order of x, y and z sizes. place counts from 0 in that order."""
    divisors = lambda c: F.filter(F.sequence(F.lit(1), F.col(c)), lambda i: (F.col(c) % i == 0) & (i >= 3) & (i < F.col(c)))
    sizes = extent.select("*", F.explode(divisors("x_dim")).alias("bx")).select("*", F.explode(divisors("y_dim")).alias("by")).select("*", F.explode(divisors("z_dim")).alias("bz"))
    volume = lambda *c: F.expr("*".join(f"cast({x} as bigint)" for x in c))
    counted = sizes.select("bx", "by", "bz", F.call_function("div", volume("x_dim", "y_dim", "z_dim"), volume("bx", "by", "bz")).alias("regions"))
    firsts = counted.groupBy("regions").agg(F.min(F.struct("bx", "by", "bz")).alias("s")).select("s.bx", "s.by", "s.bz", "regions")
    # divisors of three numbers: a handful of rows
    return firsts.withColumn("place", F.row_number().over(W.orderBy("bx", "by", "bz")) - 1).select("place", "bx", "by", "bz", "regions")


def auto_regions(extent: DataFrame, place: int = 3) -> DataFrame:
    """The candidate at the given place; no row if there are fewer."""
    return candidate_regions(extent).where(F.col("place") == place)


def auto_configure(field: DataFrame, cfg: GridConfig) -> GridConfig:
    """cfg with region size, number of bins and error threshold chosen from the field."""
    region = auto_regions(grid_extent(field, cfg)).first()
    if region is None:
        raise ValueError("too few region sizes divide these dims")
    cfg = replace(cfg, block_dims=(region.bx, region.by, region.bz))
    bins = auto_bins(field, cfg).first()
    threshold = error_threshold(field).first()
    return replace(cfg, num_bins=bins.num_bins if bins else cfg.num_bins, error_threshold=threshold.value if threshold.value is not None else cfg.error_threshold)



