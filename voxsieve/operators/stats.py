"""Aggregates over fields: ranges, histograms, counts by region, percentiles and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GridConfig
from ..functions import geometry as g
from ..sources.shared import attach, written


def value_range(field: DataFrame) -> DataFrame:
    """(t, lo, hi, n); NaN and null values don't count toward the range."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return field.groupBy("t").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count("*").alias("n"))


def binned(field: DataFrame, cfg: GridConfig) -> DataFrame:
    """field with lo, hi, n of its timestep and the bin of each value over that range."""
    return attach(field, value_range(field), ["t"]).withColumn("bin", g.bin_id(F.col("value"), F.col("lo"), F.col("hi"), cfg.num_bins))


def every_bin(keys: DataFrame, bins: int) -> DataFrame:
    return keys.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))


def histogram(field: DataFrame, cfg: GridConfig, cells: DataFrame | None = None) -> DataFrame:
    """(t, bin, n) with every bin present. cells is binned(), if it is there already."""
    counts = (binned(field, cfg) if cells is None else cells).groupBy("t", "bin").agg(F.count("*").alias("n"))
    return every_bin(counts.select("t").distinct(), cfg.num_bins).join(counts, ["t", "bin"], "left").select("t", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def block_histogram(field: DataFrame, cfg: GridConfig) -> DataFrame:
    """(t, block_id, hist): counts of the bins of each region over the lifetime range, as arrays."""
    low, high = map(F.lit, cfg.lifetime)
    cells = field.select("t", g.block_id(F.col("gid"), cfg).alias("block_id"), g.bin_id(F.col("value"), low, high, cfg.num_bins).alias("bin"))
    counts = cells.groupBy("t", "block_id", "bin").agg(F.count("*").alias("n"))
    found = counts.groupBy("t", "block_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(cfg.num_bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))
    return found.select("t", "block_id", hist.alias("hist"))


def percentiles_by_index(rows: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, n, p0, p1, ...): for each group and share the value at place int(n * share), from 0, in ascending order.

    Exact without sorting a group into one task: rows are range-partitioned, and a count by part places the wanted rows.
    """
    ordered = rows.select(F.col(by).alias("by"), F.col(value).alias("v")).where("v is not null").repartitionByRange("by", "v").sortWithinPartitions("by", "v")
    numbered = ordered.withColumn("row", F.monotonically_increasing_id())
    part, within = F.shiftright("row", 33).alias("part"), F.col("row").bitwiseAND((1 << 33) - 1).alias("within")
    numbered = written(numbered.select("by", "v", part, within), "ordered")  # parts may be cut elsewhere when computed again
    sizes = numbered.groupBy("part", "by").agg(F.count("*").alias("c"), F.min("within").alias("first"))
    group = W.partitionBy("by").orderBy("part")
    before = F.coalesce(F.sum("c").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", "by", (before - F.col("first")).alias("offset"), F.sum("c").over(W.partitionBy("by")).alias("n"))
    place = F.col("offset") + F.col("within")
    found = [F.max(F.when(place == F.floor(F.col("n") * F.lit(share)), F.col("v"))).alias(f"p{k}") for k, share in enumerate(shares)]
    return attach(numbered, offsets, ["part", "by"]).groupBy(F.col("by").alias(by)).agg(F.max("n").alias("n"), *found)


def percentile_by_index(rows: DataFrame, value: str, share: float) -> DataFrame:
    """(value): the value at place int(n * share), from 0, in ascending order; null if there is none."""
    alone = rows.select(F.lit(0).alias("one"), F.col(value).alias("v"))
    return percentiles_by_index(alone, "one", "v", [share]).agg(F.max("p0").alias("value"))


def paired_quality(pairs: DataFrame, original: Column, rebuilt: Column) -> DataFrame:
    """(t, n, max_diff, avg_diff, rmse, psnr, snr) over the pairs of each timestep; pairs with a NaN don't count but in n."""
    sound = ~(F.isnan(original) | F.isnan(rebuilt) | original.isNull() | rebuilt.isNull())
    o, d = F.when(sound, original), F.when(sound, F.abs(original - rebuilt))
    sums = pairs.groupBy("t").agg(
        F.count("*").alias("n"), F.max(d).alias("max_diff"), F.sum(d).alias("sum_abs"), F.sum(d * d).alias("sum_sq"), F.max(o).alias("hi"), F.min(o).alias("lo"), F.stddev_pop(o).alias("sd"), F.stddev_pop(d).alias("sd_noise")
    )
    rmse = F.sqrt(F.try_divide("sum_sq", F.col("n") - 1))
    ratio = F.try_divide(F.col("hi") - F.col("lo"), F.col("rmse"))
    psnr = F.when(F.col("rmse") == 0, 10000.0).otherwise(F.coalesce(F.lit(20.0) * F.log10(F.when(ratio > 0, ratio)), F.lit(-10000.0)))
    noise = F.try_divide("sd", F.col("sd_noise"))
    return sums.withColumn("rmse", rmse).select("t", "n", "max_diff", F.try_divide("sum_abs", "n").alias("avg_diff"), "rmse", psnr.alias("psnr"), (F.lit(20.0) * F.log10(F.when(noise > 0, noise))).alias("snr"))


def quality(field: DataFrame, recon: DataFrame) -> DataFrame:
    """Quality of a rebuilt field, cell by cell."""
    pairs = field.join(recon.withColumnRenamed("value", "rebuilt"), ["t", "gid"])
    return paired_quality(pairs, F.col("value"), F.col("rebuilt"))


def in_roi(x: Column, y: Column, z: Column) -> Column:
    """Half-open boxes."""
    return (x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1")) & (z >= F.col("z0")) & (z < F.col("z1"))


def roi_cells(cells: DataFrame, roi: DataFrame, cfg: GridConfig) -> DataFrame:
    """The cells inside their timestep's region of interest (t, x0, x1, y0, y1, z0, z1)."""
    return attach(cells, roi, ["t"]).where(in_roi(*g.xyz(F.col("gid"), cfg))).select(*cells.columns)


def range_statistics(pairs: DataFrame, original: Column, rebuilt: Column) -> DataFrame:
    """Ranges, means and deviations of both sides, for reports."""
    stats = lambda c, name: [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_sd")]
    return pairs.groupBy("t").agg(*stats(original, "raw"), *stats(rebuilt, "sampled"))
