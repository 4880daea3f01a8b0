"""Named queries over the given tables, and the SQL that says the same.

The events table is read as a field of 10 x 10 x 10 cells, one timestep for every 1000 rows, orders as a second variable.
Figures are rounded to six digits on both sides, as engines add floats in different orders.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRESETS, GridConfig
from ..functions import geometry as g
from ..operators import autoconf, boxes, importance, linear, recon, sampling, sketches, stats, temporal
from ..sources import names, raw, shared, tables, vtk
from ..streaming import error, fill, reuse
from . import lifecycle, sql

#: Large regions for sampling; small ones and few bins where regions shall often be alike.
GRID = GridConfig((10, 10, 10), (5, 5, 5), ratio=0.1, num_bins=20, lifetime=(0.0, 200.0), portable_hash=True)
FINE = replace(GRID, block_dims=(5, 2, 1), num_bins=3, ratio=0.3, error_threshold=60.0)
#: A grid that several region sizes divide.
WIDE = replace(GRID, dims=(12, 12, 6), block_dims=(3, 3, 3))


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events_field(spark, sf_dir, GRID.cells)


def _r(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


def cell_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    gid = F.col("gid")
    x, y, z = g.xyz(gid, GRID)
    block, local = g.block_id(gid, GRID), g.local_id(gid, GRID)
    return _field(spark, sf_dir).select("t", "gid", x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z"), block.alias("block_id"), local.alias("local_id"), g.global_id(block, local, GRID).alias("back"))


def block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region out of a table that is laid out by regions."""
    return boxes.in_block(boxes.by_region(_field(spark, sf_dir), GRID), 3, GRID).select("t", "gid", g.local_id(F.col("gid"), GRID).alias("local_id"), "value")


def timestep_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_range(_field(spark, sf_dir))


def orders_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.value_range(tables.orders_field(spark, sf_dir, GRID.cells))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_field(spark, sf_dir), GRID)


def embeddings_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(tables.embeddings_field(spark, sf_dir), GRID)


def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.block_histogram(_field(spark, sf_dir), GRID)
    return found.select("t", "block_id", F.posexplode("hist").alias("bin", "n"))


def bin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.bin_order(stats.histogram(_field(spark, sf_dir), GRID))


def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.acceptance(stats.histogram(_field(spark, sf_dir), GRID), GRID).select("t", "bin", "n", "k", _r("p"))


def importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.importance_sample(_field(spark, sf_dir), GRID)


def sample_counts_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = _field(spark, sf_dir)
    return sampling.samples_per_block(field, sampling.importance_sample(field, GRID), GRID)


def block_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.block_rmse(sampling.judged(_field(spark, sf_dir), FINE)).select("t", "block_id", "n_reference", _r("rmse"))


def reuse_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.reuse_by_histogram(_field(spark, sf_dir), FINE).select("t", "block_id", "reused")


def stream_reuse_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions from a stream over the events table, a file of timesteps a batch."""
    field = reuse.in_files(_field(spark, sf_dir), "cells", 4)
    return reuse.run_available(reuse.reuse_stream(field, FINE, first=0), "reuse").select("t", "block_id", "reused")


def stream_reuse_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error decisions from a stream of judged cells, a file of timesteps a batch."""
    error.stateful(spark)
    judged = reuse.in_files(sampling.judged(_field(spark, sf_dir), FINE), "judged", 4)
    found = reuse.run_available(error.error_stream(judged, FINE, first=0), "error")
    return found.where("complete").select("t", "block_id", "n_reference", F.when(F.col("n_reference") > 0, F.round("rmse", 6)).alias("rmse"), "reused")


def stream_error_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by error reuse with fill from a stream of timesteps."""
    folder = shared.new_path(spark, "cells")
    for k, part in enumerate(_thirds(_field(spark, sf_dir))):
        part.coalesce(1).write.parquet(f"{folder}/{k}")
    cells = spark.readStream.schema("t int, gid long, value double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    out = shared.new_path(spark, "steps")
    fill.fill_stream(cells, FINE, out, shared.new_path(spark, "steps-progress"))
    return fill.results(spark, out)[0]


def _thirds(field: DataFrame) -> list[DataFrame]:
    """The field in three parts of successive timesteps."""
    low, high = field.agg(F.min("t"), F.max("t")).first()
    edges = [low + (high + 1 - low) * k // 3 for k in range(4)]
    return [field.where((F.col("t") >= a) & (F.col("t") < b)) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def reuse_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.reuse_by_error(sampling.judged(_field(spark, sf_dir), FINE), FINE).select("t", "block_id", "reused")


def temporal_error_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.temporal_error_sample(_field(spark, sf_dir), FINE)[0].select("t", "gid", "block_id", "value")


def fill_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.temporal_histogram_sample(_field(spark, sf_dir), FINE)[0]


def coalesced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, blocks = temporal.temporal_histogram_sample(_field(spark, sf_dir), FINE, with_fill=False)
    return temporal.coalesced(samples, blocks).select("t", "gid", "block_id", "value")


def blocks_reused_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.reuse_counts(temporal.temporal_histogram_sample(_field(spark, sf_dir), FINE, with_fill=False)[1])


def _rebuilt(spark: SparkSession, sf_dir: str, k: int = 1) -> DataFrame:
    field = _field(spark, sf_dir)
    samples = sampling.importance_sample(field, GRID)
    return recon.nn_reconstruct(field, samples, GRID) if k == 1 else recon.knn_reconstruct(field, samples, GRID)


def nn_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebuilt(spark, sf_dir).select("t", "gid", "rebuilt")


def knn3_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebuilt(spark, sf_dir, 3).select("t", "gid", _r("rebuilt"))


def _hull(spark: SparkSession, field: DataFrame) -> DataFrame:
    """Samples with the grid's corners."""
    return recon.with_corners(sampling.importance_sample(field, GRID), field, GRID)


def linear_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation of samples and corners. SQL would go through all sets of four samples, so there is none."""
    field = _complete(_field(spark, sf_dir))
    return linear.linear_reconstruct(field, _hull(spark, field), GRID).select("t", "gid", _r("rebuilt"))


def linear_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that is a plane in each timestep comes back whole from the samples that its own values get."""
    x, y, z = g.xyz(F.col("gid"), GRID)
    field = _complete(_field(spark, sf_dir)).withColumn("value", 3.0 * x - 2.0 * y + 0.5 * z + F.col("t"))
    return linear.linear_reconstruct(field, _hull(spark, field), GRID).select("t", "gid", _r("rebuilt"))


def _quality(pairs: DataFrame) -> DataFrame:
    found = stats.paired_quality(pairs, F.col("value"), F.col("rebuilt"))
    return found.select("t", "n", *map(_r, ("max_diff", "avg_diff", "rmse", "psnr", "snr")))


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample, rebuild, assess."""
    return _quality(_rebuilt(spark, sf_dir))


def quality_two_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field against another on the cells both have."""
    field, other = _field(spark, sf_dir), tables.orders_field(spark, sf_dir, GRID.cells)
    found = stats.quality(field, other)
    return found.select("t", "n", *map(_r, ("max_diff", "avg_diff", "rmse", "psnr", "snr")))


def _roi(field: DataFrame) -> DataFrame:
    """A box for each timestep that moves and shrinks with it."""
    t = F.col("t")
    edges = {"x0": t % 3, "x1": 10 - t % 4, "y0": t % 2, "y1": F.lit(9), "z0": F.lit(1), "z1": 4 + t % 6}
    return field.select("t").distinct().select("t", *[c.cast("int").alias(n) for n, c in edges.items()])


def quality_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the cells of interest are rebuilt."""
    field = _field(spark, sf_dir)
    samples = sampling.importance_sample(field, GRID)
    return _quality(recon.nn_reconstruct(stats.roi_cells(field, _roi(field), GRID), samples, GRID))


def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several boxes a timestep, of many sizes, some beyond the grid: how many cells lie in each, and what they add up to."""
    field, t, k = _field(spark, sf_dir), F.col("t"), F.col("box")
    times = field.select("t").distinct().withColumn("box", F.explode(F.sequence(F.lit(0), F.lit(11))))
    edges = {"x0": (t + k) % 7 - 1, "x1": (t + k) % 7 + k % 4, "y0": k % 5, "y1": k % 5 + 1 + t % 9, "z0": t % 3, "z1": t % 3 + k}
    cut = boxes.in_boxes(field, times.select("t", "box", *[c.cast("int").alias(n) for n, c in edges.items()]), GRID)
    return cut.groupBy("t", "box").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from sketches of each timestep, of five together and of all: whether the place of each is where it is said to be."""
    field, out = _field(spark, sf_dir).where("value is not null and not isnan(value)"), None
    kept = shared.written(sketches.sketches(field, "t", "value"), "sketches")
    for width in (1, 5, None):
        found = shared.written(sketches.quantiles(sketches.merged(kept, width), [0.05, 0.25, 0.5, 0.75, 0.99]), "quantiles")
        first = F.lit(0).cast("int") if width is None else (g.div(F.col("t"), width) * width).cast("int")
        met = shared.attach(field.select(first.alias("first"), "value"), found, ["first"])
        places = met.groupBy("first", "share", "n", "q").agg(F.count_if(F.col("value") < F.col("q")).alias("below"), F.count_if(F.col("value") <= F.col("q")).alias("upto"))
        off = F.lit(2 * sketches.rank_error()) * F.col("n")
        within = (F.col("below") <= F.col("share") * F.col("n") + off) & (F.col("upto") >= F.col("share") * F.col("n") - off)
        rows = places.select(F.lit(width or 0).alias("width"), "first", "share", "n", within.alias("within"))
        out = rows if out is None else out.unionByName(rows)
    return out


def range_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.range_statistics(_rebuilt(spark, sf_dir), F.col("value"), F.col("rebuilt"))
    return found.select("t", *map(_r, found.columns[1:]))


def error_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return autoconf.error_threshold(_field(spark, sf_dir))


def bin_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = autoconf.bin_widths(_field(spark, sf_dir))
    return found.select("t", "n", *map(_r, ("sd", "span", "scott", "doane", "sturges")), "scott_bins", "doane_bins", "sturges_bins")


def bin_widths_textbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doane's width with the skewness that the other form leaves out."""
    return autoconf.bin_widths(_field(spark, sf_dir), textbook=True).select("t", "n", _r("doane"), "doane_bins")


def freedman_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return autoconf.freedman_bins(_field(spark, sf_dir)).select("t", "n", _r("iqr"), _r("width"), "bins")


def auto_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region size, number of bins and error threshold as chosen from the field, one row."""
    chosen = autoconf.auto_configure(tables.events_field(spark, sf_dir, WIDE.cells), WIDE)
    row = (*chosen.block_dims, chosen.num_bins, round(chosen.error_threshold, 6))
    return spark.createDataFrame([row], "bx int, by int, bz int, num_bins int, error_threshold double")


def config_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return autoconf.auto_bins(_field(spark, sf_dir), GRID).select("num_bins", _r("psnr"))


def bins_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return autoconf.bins_sweep(_field(spark, sf_dir), GRID).select("num_bins", _r("psnr"), "place")


def snr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal-to-noise ratio of each timestep's file, over all cells and over the region of interest."""
    field = _field(spark, sf_dir)
    found = lifecycle.snr_report(_rebuilt(spark, sf_dir), _roi(field), GRID, "Pf{t}.bin")
    return found.select("t", "filename", _r("snr"), _r("snr_roi"))


def method_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What methods 1, 4 and 7 keep and how well they rebuild, by timestep."""
    numbers, out = (1, 4, 7), None
    for number, found in zip(numbers, lifecycle.assess_each(_field(spark, sf_dir), FINE, numbers), strict=True):
        rows = found.select("t", F.lit(lifecycle.NUMBERED[number]).alias("method"), "blocks_reused", "n_samples", *map(_r, ("max_diff", "avg_diff", "psnr")))
        out = rows if out is None else out.unionByName(rows)
    return out


def _growing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GridConfig]:
    """Ten timesteps that the whole table is dealt to, and the grid of layers of 10 x 10 cells that they fill."""
    field = tables.dealt_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "value", 10)
    last = field.agg(F.max("gid")).first()[0] or 0
    return field, replace(GRID, dims=(10, 10, last // 100 + 1), block_dims=(10, 10, 1))


def growing_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error threshold where the first two timesteps are a fifth of the table."""
    return autoconf.error_threshold(_growing(spark, sf_dir)[0])


def growing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep of numbers of bins where the first timestep is a tenth of the table."""
    return autoconf.bins_sweep(*_growing(spark, sf_dir)).select("num_bins", _r("psnr"), "place")


def candidate_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the grid that orders fill: ten by twenty by as far as they go."""
    wide = GridConfig((10, 20, 1), (1, 1, 1))
    cells = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(0).alias("t"), F.col("o_orderkey").alias("gid"))
    return autoconf.candidate_regions(autoconf.grid_extent(cells, wide))


def boundary_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = _field(spark, sf_dir)
    return recon.with_corners(sampling.importance_sample(field, GRID), field, GRID)


def filename_timesteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names as a run over the field would write them, notes among them, back to timesteps in order."""
    times = _field(spark, sf_dir).select("t").distinct()
    path = F.when(F.col("t") % 5 == 3, F.concat(F.lit("/run/notes_"), F.col("t"))).otherwise(F.concat(F.lit("/run/Pf"), F.col("t"), F.lit(".bin")))
    return names.timestep_index(times.select(path.alias("path")), r"Pf([0-9]+).bin")


def sample_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of two ratios together, each cell once."""
    field = _field(spark, sf_dir)
    low, high = sampling.importance_sample(field, GRID), sampling.importance_sample(field, replace(GRID, ratio=0.2))
    both = low.select("t", "gid", "value").unionByName(high.select("t", "gid", "value"))
    return both.groupBy("t", "gid").agg(F.min("value").alias("value"), F.count("*").alias("times"))


def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run of method 4 without its times, with means over all timesteps as t = -1 and deviations as t = -2."""
    rows = lifecycle.report(_field(spark, sf_dir), FINE, 4)
    settings = ["method", "file_gb", "ratio", "region_dims", "num_bins", "reconstruction"]
    figures = ["blocks_reused", "n_samples", "max_diff", "avg_diff", "psnr", "snr"]
    return lifecycle.summaries(rows, settings, figures).select("t", *settings, *map(_r, figures))


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete timesteps written as raw float32 files, each by several tasks, and read back through the folder scan.

    The format holds whole timesteps only, so the last one is left out where the table ends within it.
    """
    folder = shared.new_path(spark, "raw")
    raw.write_raw(_complete(_field(spark, sf_dir)), folder, GRID, "Pf{t}.bin", per_task=GRID.cells // 4)
    return raw.read_raw(spark, folder, r"Pf([0-9]+)\.bin", GRID)


def _complete(field: DataFrame) -> DataFrame:
    """The timesteps that the table fills."""
    return shared.attach(field, field.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") == GRID.cells).select("t"), ["t"])


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete timesteps written as image files, each by several tasks, and read back."""
    folder = shared.new_path(spark, "images")
    vtk.write_vti(_complete(_field(spark, sf_dir)), folder, GRID, "Pf{t}.vti", per_task=GRID.cells // 4)
    return vtk.read_vti(spark, folder, r"Pf([0-9]+)\.vti")


def images_to_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files turned into raw files, with the extents that their headers state."""
    images, folder = shared.new_path(spark, "images"), shared.new_path(spark, "raw")
    vtk.write_vti(_complete(_field(spark, sf_dir)), images, GRID, "Pf{t}.vti", dtype="<f4", spacing=(0.5, 2.0, 1.25))
    raw.write_raw(vtk.read_vti(spark, images, r"Pf([0-9]+)\.vti"), folder, GRID, "Pf{t}.bin", per_task=GRID.cells // 4)
    info = vtk.vti_info(spark, images, r"Pf([0-9]+)\.vti").select("t", "x_dim", "y_dim", "z_dim", F.element_at("spacing", 2).alias("y_spacing"), F.element_at("arrays", 1).alias("array"))
    return shared.attach(raw.read_raw(spark, folder, r"Pf([0-9]+)\.bin", GRID), info, ["t"])


def rebuilt_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt timesteps written as image files and read back."""
    folder = shared.new_path(spark, "images")
    vtk.write_vti(_complete(_rebuilt(spark, sf_dir).select("t", "gid", "rebuilt")), folder, GRID, "recons_{t}.vti", value="rebuilt", per_task=GRID.cells // 4)
    return vtk.read_vti(spark, folder, r"recons_([0-9]+)\.vti").withColumnRenamed("value", "rebuilt")


def sample_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective samples and corners written as point files, each by several tasks, and read back."""
    field = _field(spark, sf_dir)
    samples, blocks = temporal.temporal_histogram_sample(field, FINE, with_fill=False)
    samples, blocks, folder = shared.written(samples, "samples"), shared.written(blocks, "blocks"), shared.new_path(spark, "cloud")
    vtk.write_vtp(lifecycle.sample_cloud(field, samples, blocks, FINE), folder, per_task=64)
    return vtk.read_vtp(spark, folder, r"cloud_([0-9]+)\.vtp")


def _sample_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    samples, blocks = temporal.temporal_histogram_sample(_field(spark, sf_dir), FINE, with_fill=False)
    folder = shared.new_path(spark, "sample-files")
    raw.write_samples(samples, blocks, folder, per_task=64)
    return raw.read_samples(spark, folder, FINE)


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples written as files of ids, values and counts, and read back with their local ids."""
    return _sample_files(spark, sf_dir)[0].select("t", "gid", "block_id", g.local_id(F.col("gid"), FINE).alias("local_id"), "value")


def sample_file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions' counts and reuse flags as the sample files have them."""
    return _sample_files(spark, sf_dir)[1]


def roi_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of interest written as lines of text, one a timestep, and read back."""
    boxes = _roi(_field(spark, sf_dir)).orderBy("t").coalesce(1)
    path = shared.new_path(spark, "roi")
    boxes.select(F.concat(F.lit("box: ["), F.concat_ws(", ", "x0", "x1", "y0", "y1", "z0", "z1"), F.lit("]"))).write.text(path)
    return raw.read_roi(spark, path)


def error_fill_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by error reuse with fill, timestep after timestep."""
    return temporal.temporal_error_sample_filled(_field(spark, sf_dir), FINE)[0]


def cell_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in the data's units and back."""
    at = g.physical(g.xyz(F.col("gid"), GRID), (0.5, 2.0, 1.25))
    back = g.cell_id(*g.logical(at, (0.5, 2.0, 1.25)), GRID)
    return _field(spark, sf_dir).select("t", "gid", *[c.cast("double").alias(n) for c, n in zip(at, ("px", "py", "pz"), strict=True)], back.alias("back"))


def preset_timesteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timesteps out of file names as each known data set has them."""
    times, out = _field(spark, sf_dir).select("t").distinct(), None
    for name, (_, pattern) in PRESETS.items():
        path = F.concat(F.lit("/run/" + pattern.split("(")[0]), F.col("t"), F.lit(pattern.split(")")[1]))
        rows = times.select(F.lit(name).alias("preset"), path.alias("path")).withColumn("timestep", names.timestep_of(F.col("path"), pattern))
        out = rows if out is None else out.unionByName(rows)
    return out


def fixed_range_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve bins over 3 to 50 for each timestep, whatever its own range."""
    whole = replace(GRID, block_dims=GRID.dims, num_bins=12, lifetime=(3.0, 50.0))
    return stats.block_histogram(_field(spark, sf_dir), whole).select("t", F.posexplode("hist").alias("bin", "n"))


QUERIES = {
    f.__name__: f
    for f in (
        cell_geometry, block_extract, timestep_range, orders_range, histogram, embeddings_histogram, block_histogram, bin_order, acceptance, importance_sample, sample_counts_per_block, block_rmse,
        reuse_histogram, stream_reuse_histogram, reuse_error, temporal_error_samples, fill_samples, coalesced_samples, blocks_reused_stats, nn_reconstruct, knn3_reconstruct, quality_metrics, quality_two_variables, quality_roi,
        range_statistics, error_threshold, bin_widths, bins_sweep, config_bins, snr_report, method_figures, candidate_regions, boundary_corners, filename_timesteps, sample_union_dedup, stats_report,
        raw_files, sample_files, sample_file_blocks, roi_file, error_fill_samples, cell_positions, preset_timesteps, fixed_range_histogram,
        bin_widths_textbook, freedman_bins, auto_configuration, image_files, images_to_raw, rebuilt_images, sample_cloud, stream_reuse_error, stream_error_fill, box_statistics, sketch_quantiles, linear_reconstruct, linear_planes, growing_threshold, growing_bins,
    )
}
ORACLES = sql.ORACLES
