"""Linear interpolation over the Delaunay tetrahedra of the samples.

The tetrahedron of a cell is the four samples whose weighted mean the cell is with the least weighted mean of squared lengths:
a linear program with four conditions. It is solved for all cells of a cube together, by the simplex method on arrays, over the
samples of the cube and the cubes around. The program's dual is the sphere through the four samples: where what it covers of the
grid lies within these cubes, no other sample can be inside, and the tetrahedron is certain. Cells that are not certain go on to
cubes twice as wide, until these hold the grid. Samples on a common sphere, as a grid has many, are told apart by a small number
made from their ids, so there is one tetrahedron for each cell whatever the order of rows.

A cell outside the samples' hull has no value; recon.with_corners() closes the hull. Such cells, and cells in wide stretches
without samples, are certain only once the cubes hold the grid, where a task has all samples of their timestep: add the corners
where timesteps are large. Work is a few rounds of cells times the samples around them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GridConfig
from ..functions import geometry as g
from ..sources.shared import written

#: By how much samples are lifted apart at most, in squared cells, and rounding that is passed over.
LIFT, SLACK = 1e-4, 1e-9
#: Cells worked on at once.
CELLS = 4096


def lifts(gids: np.ndarray) -> np.ndarray:
    """A small number for each id, spread evenly."""
    x = gids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for _ in range(2):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(11)) / float(1 << 53) * LIFT


def tetrahedra(cells: np.ndarray, samples: np.ndarray, lift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners, weights, spheres): for each cell four places in samples with their weights, and the sphere's centre and squared radius.

    Cells outside the hull have a corner of -1. The cells of a call should lie together.
    """
    middle = samples.mean(0)
    points, at = samples - middle, cells - middle
    # four corners of a large tetrahedron stand in until samples take their place; using them at all costs more than anything
    far = 8.0 * (np.abs(points).max() + np.abs(at).max() + 1)
    stand = far * np.array([[-1, -1, -1], [3, -1, -1], [-1, 3, -1], [-1, -1, 3.0]])
    every = np.concatenate([stand, points])
    columns = np.concatenate([every, np.ones((len(every), 1))], 1)
    first = np.zeros(len(every))
    first[:4] = 1.0
    height = np.concatenate([np.zeros(4), (points * points).sum(1) + lift])
    scale = far * far
    # a cell on an edge or face is moved a little towards the middle, so that no weight is nothing
    wanted = np.concatenate([at * (1 - 1e-7), np.ones((len(at), 1))], 1)
    basis = np.tile(np.arange(4), (len(at), 1))
    open_ = np.arange(len(at))
    for _ in range(50 + 4 * len(every)):
        if not len(open_):
            break
        own = basis[open_]
        matrix = columns[own].transpose(0, 2, 1)
        costs = np.stack([first[own], height[own]], 2)
        dual = np.linalg.solve(matrix.transpose(0, 2, 1), costs)
        low = first - dual[:, :, 0] @ columns.T
        rest = height - dual[:, :, 1] @ columns.T
        # what brings in less of the stand-ins comes first; then, where that stays, what lowers the height
        least = low.min(1)
        enters = np.where(least < -SLACK, low.argmin(1), np.where(np.abs(low) <= SLACK, rest, np.inf).argmin(1))
        gain = np.where(least < -SLACK, True, rest[np.arange(len(open_)), enters] < -SLACK * scale * 1e-3)
        open_, matrix, enters = open_[gain], matrix[gain], enters[gain]
        if not len(open_):
            break
        both = np.linalg.solve(matrix, np.stack([wanted[open_], columns[enters]], 2))
        weight, step = both[:, :, 0], both[:, :, 1]
        ratio = np.where(step > 1e-12, np.maximum(weight, 0) / np.where(step > 1e-12, step, 1), np.inf)
        basis[open_, ratio.argmin(1)] = enters
    matrix = columns[basis].transpose(0, 2, 1)
    weights = np.linalg.solve(matrix, np.concatenate([at, np.ones((len(at), 1))], 1)[:, :, None])[:, :, 0]
    plane = np.linalg.solve(matrix.transpose(0, 2, 1), height[basis][:, :, None])[:, :, 0]
    centre = plane[:, :3] / 2
    squared = plane[:, 3] + (centre * centre).sum(1)
    return np.where(basis < 4, -1, basis - 4), weights, np.concatenate([centre + middle, squared[:, None]], 1)


def _places(gids: np.ndarray, cfg: GridConfig) -> np.ndarray:
    x, y, _ = cfg.dims
    return np.stack([gids % x, gids // x % y, gids // (x * y)], 1).astype(np.float64)


def _solver(cfg: GridConfig, edge: int, last: bool) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What interpolates the cells of a cube from the samples around, and tells which results are certain."""

    def solve(key: tuple, cell: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        value, final = np.full(len(cell), np.nan), np.full(len(cell), last)
        near = near.sort_values("gid")
        if len(near) and len(cell):
            gids, values = near["gid"].to_numpy(), near["value"].to_numpy()
            places, lift = _places(gids, cfg), lifts(gids)
            low = np.array([max(0, (c - 1) * edge) for c in key[1:]], float)
            high = np.array([min(d, (c + 2) * edge) - 1 for c, d in zip(key[1:], cfg.dims, strict=True)], float)
            top = np.array(cfg.dims, float) - 1
            for a in range(0, len(cell), CELLS):
                part = slice(a, a + CELLS)
                corners, weights, sphere = tetrahedra(_places(cell["gid"].to_numpy()[part], cfg), places, lift)
                inside = (corners >= 0).all(1)
                radius = np.sqrt(np.maximum(sphere[:, 3:], 0)) + LIFT
                reach = ((sphere[:, :3] - radius >= low) | (low == 0)) & ((sphere[:, :3] + radius <= high) | (high == top))
                value[part] = np.where(inside, (values[corners] * weights).sum(1), np.nan)
                final[part] |= inside & reach.all(1)
        return pd.DataFrame({"t": cell["t"], "gid": cell["gid"], "rebuilt": value, "final": final, "inside": ~np.isnan(value)})

    return solve


def linear_reconstruct(cells: DataFrame, samples: DataFrame, cfg: GridConfig) -> DataFrame:
    """cells (t, gid and more) with rebuilt, the value of the samples' linear interpolation; null outside their hull.

    Timesteps without samples have null throughout.
    """
    edge = max(2, math.ceil((8 / max(cfg.ratio, 1e-6)) ** (1 / 3)))
    cubes, todo, done = ["cx", "cy", "cz"], cells.select("t", "gid"), None
    samples = written(samples.select("t", "gid", F.col("value").cast("double").alias("value")), "linear-samples")
    at = lambda df, edge: df.withColumns({n: g.div(c, edge).cast("int") for n, c in zip(cubes, g.xyz(F.col("gid"), cfg), strict=True)})
    while True:
        last = 2 * edge >= max(cfg.dims)  # the cubes around hold the grid
        spread = at(samples, edge)
        for c, size in zip(cubes, cfg.dims, strict=True):
            spread = spread.withColumn(c, F.explode(F.sequence(F.greatest(F.col(c) - 1, F.lit(0)), F.least(F.col(c) + 1, F.lit((size - 1) // edge)))))

        placed, found = at(todo, edge).groupBy("t", *cubes), spread.groupBy("t", *cubes)
        step = placed.cogroup(found).applyInPandas(_solver(cfg, edge, last), "t int, gid long, rebuilt double, final boolean, inside boolean")
        step = written(step, "linear")
        ready = step.where("final").select("t", "gid", F.when(F.col("inside"), F.col("rebuilt")).alias("rebuilt"))
        done = ready if done is None else done.unionByName(ready)
        left = step.where("not final").select("t", "gid")
        if last or left.isEmpty():
            return cells.join(done, ["t", "gid"]).select(*cells.columns, "rebuilt")
        todo, edge = left, 2 * edge
