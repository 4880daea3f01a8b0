"""Full fields from samples: nearest neighbour and weighted nearest neighbours.

Samples are put into cubes of cells, each cube gets lists of the samples in it and in the cubes around it, and cells meet
their cube's lists in one equi-join. A result is final if the farthest neighbour wanted is nearer than anything outside the
lists can be; the few other cells go on to cubes twice as wide, until the cubes around hold the grid. Cells are shuffled by
cube, never by timestep. A list has about LIST samples at most: where cubes are so wide that there may be more, their samples
are dealt to several lists, each cell keeps the nearest of each, and these are merged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GridConfig
from ..functions import geometry as g
from ..sources.shared import written


def _cube(at: tuple[Column, Column, Column], edge: int) -> list[Column]:
    return [g.div(c, edge).cast("int") for c in at]


#: Samples in a list, about.
LIST = 1 << 15


def _round(cells: DataFrame, samples: DataFrame, cfg: GridConfig, edge: int, k: int, first: bool, last: bool, tasks: int | None = None) -> DataFrame:
    """cells with near, the k nearest of the lists as (d2, s_gid, s_value), and whether that is final.

    The first round has all cells in small cubes of much work and few bytes: its partitions, so many as the session's or tasks, if
    these are fewer, stay as they are, where the engine would merge them by their bytes. Later rounds are left to it, since the few cells in wide cubes may be skewed.
    """
    cubes, axes = ["cx", "cy", "cz"], ["__x", "__y", "__z"]
    at = lambda df: df.withColumns(dict(zip(cubes, _cube(g.xyz(F.col("gid"), cfg), edge), strict=True)))
    parts = -(-math.prod(min(3 * edge, d) for d in cfg.dims) // LIST)
    around = lambda c, size: F.explode(F.sequence(F.greatest(F.col(c) - 1, F.lit(0)), F.least(F.col(c) + 1, F.lit((size - 1) // edge))))
    spread = at(samples.select("t", "gid", "value", *[c.cast("int").alias(a) for c, a in zip(g.xyz(F.col("gid"), cfg), axes, strict=True)])).withColumn("part", F.pmod(F.xxhash64("gid"), F.lit(parts)).cast("int"))
    for c, size in zip(cubes, cfg.dims, strict=True):
        spread = spread.withColumn(c, around(c, size))
    lists = spread.groupBy("t", *cubes, "part").agg(F.collect_list(F.struct("gid", "value", *axes)).alias("list"))
    here = g.xyz(F.col("gid"), cfg)
    # coordinates are columns on both sides, so that a pair costs a few sums and products
    scored = F.transform("list", lambda s: F.struct(g.distance2(tuple(F.col(a) for a in axes), tuple(s[a] for a in axes)).alias("d2"), s["gid"].alias("s_gid"), s["value"].alias("s_value")))
    best = lambda c: F.array(F.array_min(c)) if k == 1 else F.slice(F.array_sort(c), 1, k)
    placed = at(cells)
    if first:
        parallel = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = placed.repartition(min(parallel, tasks or parallel), "t", *cubes)
    placed = placed.withColumns({a: c.cast("long") for a, c in zip(axes, here, strict=True)})
    # each sample is in up to 27 lists, which the engine's estimate from the samples' file doesn't see: without the hint it broadcasts them
    found = placed.join(lists.hint("merge"), ["t", *cubes], "left").withColumn("near", F.when(F.col("list").isNotNull(), best(scored))).drop("list", "part", *axes)
    if parts > 1:
        found = found.groupBy(*cells.columns, *cubes).agg(F.flatten(F.collect_list("near")).alias("near")).withColumn("near", F.when(F.size("near") > 0, best(F.col("near"))))
    if last:
        final = F.lit(True)
    else:
        # the nearest cell outside the cubes around, along each axis, sides beyond the grid left out
        gaps = []
        for c, p, size in zip(cubes, here, cfg.dims, strict=True):
            low, high = (F.col(c) - 1) * edge - 1, (F.col(c) + 2) * edge
            gaps += [F.when(low >= 0, p - low), F.when(high < size, high - p)]
        outside = F.least(*gaps)
        enough = F.size("near") >= k
        final = enough & (outside.isNull() | (F.element_at("near", -1)["d2"] < outside * outside))
    return found.withColumn("final", F.coalesce(final, F.lit(False))).drop(*cubes)


def nearest(cells: DataFrame, samples: DataFrame, cfg: GridConfig, k: int = 1) -> DataFrame:
    """cells with near, the k nearest samples of the cell's timestep by distance and then id; fewer where there are fewer.

    Cells of timesteps without a sample are left out.
    """
    edge = max(1, math.ceil((k / max(cfg.ratio, 1e-6)) ** (1 / 3)))
    columns, done, first = cells.columns, None, True
    samples = written(samples.select("t", "gid", "value"), "near-samples")  # every round reads them
    # a task for every 1000 samples, whose cells are some 1000 / ratio, and no fewer than can run at once
    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, samples.count() // 1000)
    while True:
        last = 2 * edge >= max(cfg.dims)  # two cubes along each axis: those around hold the grid
        step = _round(cells, samples, cfg, edge, k, first, last, tasks)
        if not last:
            step = written(step, "nearest")
        found = step.where("near is not null" if last else "final").select(*columns, "near")
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        cells = step.where("not final").select(*columns)
        if cells.isEmpty():
            return done
        edge, first = 2 * edge, False


def nn_reconstruct(cells: DataFrame, samples: DataFrame, cfg: GridConfig) -> DataFrame:
    """cells (t, gid and more) with rebuilt, the value of the nearest sample; of equally near ones the smallest id."""
    return nearest(cells, samples, cfg, 1).withColumn("rebuilt", F.col("near")[0]["s_value"]).drop("near")


def knn_reconstruct(cells: DataFrame, samples: DataFrame, cfg: GridConfig) -> DataFrame:
    """cells with rebuilt, the mean of the nearest samples weighted by 1 / (squared distance + eps)."""
    eps = F.lit(float(cfg.weight_eps))
    weight = lambda s: F.lit(1.0) / (s["d2"] + eps)
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda a, s: a + f(s))
    return nearest(cells, samples, cfg, cfg.neighbours).withColumn("rebuilt", total(lambda s: s["s_value"] * weight(s)) / total(weight)).drop("near")


def corners(field: DataFrame, cfg: GridConfig) -> DataFrame:
    """The eight corner cells of every timestep, to complete a sample cloud's hull."""
    ends = [(0, d - 1) for d in cfg.dims]
    ids = {x + y * cfg.dims[0] + z * cfg.dims[0] * cfg.dims[1] for x in ends[0] for y in ends[1] for z in ends[2]}
    return field.where(F.col("gid").isin(sorted(ids)))


def with_corners(samples: DataFrame, field: DataFrame, cfg: GridConfig) -> DataFrame:
    """(t, gid, value): samples and corners, each cell once."""
    corner = corners(field, cfg).select("t", "gid", "value")
    return samples.select("t", "gid", "value").unionByName(corner).groupBy("t", "gid").agg(F.min("value").alias("value"))
