"""Linear interpolation against all tetrahedra, one by one."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxsieve.config import GridConfig
from voxsieve.operators import linear, recon
from voxsieve.plans import registry

CFG = GridConfig((6, 6, 6), (3, 3, 3), ratio=0.1)


def plain(cells, points, lift):
    """For each cell the weights of the four samples around it with the least mean of squared lengths and lifts; None outside."""
    fours = np.array(list(combinations(range(len(points)), 4)))
    matrix = np.concatenate([points[fours], np.ones((len(fours), 4, 1))], 2).transpose(0, 2, 1)
    flat = np.abs(np.linalg.det(matrix)) > 1e-9
    fours, matrix = fours[flat], matrix[flat]
    inverse = np.linalg.inv(matrix)
    height = (points * points).sum(1) + lift
    out = []
    for c in cells:
        w = inverse @ np.append(c, 1.0)
        ok = np.flatnonzero((w > -1e-9).all(1))
        if not len(ok):
            out.append(None)
            continue
        k = ok[np.argmin((w[ok] * height[fours[ok]]).sum(1))]
        out.append((fours[k], w[k]))
    return out


def sampled(seed, n, cfg=CFG):
    rng = np.random.default_rng(seed)
    gids = np.sort(rng.choice(cfg.cells, n, replace=False))
    return gids, rng.random(n) * 10


@pytest.mark.parametrize("seed,n", [(0, 18), (1, 24), (2, 5), (3, 4), (4, 3), (5, 1)])
def test_equals_all_tetrahedra(spark, seed, n):
    gids, values = sampled(seed, n)
    cells = linear._places(np.arange(CFG.cells), CFG)
    want = plain(cells, linear._places(gids, CFG), linear.lifts(gids)) if n > 3 else [None] * CFG.cells
    samples = spark.createDataFrame([(0, int(i), float(v)) for i, v in zip(gids, values)], "t int, gid long, value double")
    field = spark.range(CFG.cells).select(F.lit(0).alias("t"), F.col("id").alias("gid"), F.lit(1.0).alias("value"))
    got = {r.gid: r.rebuilt for r in linear.linear_reconstruct(field, samples, CFG).collect()}
    assert len(got) == CFG.cells
    for i, w in enumerate(want):
        assert (got[i] is None) == (w is None)
        if w:
            assert got[i] == pytest.approx(float((values[w[0]] * w[1]).sum()), abs=1e-6)
    assert all(got[int(i)] == pytest.approx(v) for i, v in zip(gids, values)) or n < 4


def test_planes_are_kept_and_corners_close_the_hull(spark):
    cfg = GridConfig((20, 12, 10), (5, 4, 5), ratio=0.05)
    x, y, z = (F.col("gid") % 20, F.expr("gid div 20 % 12"), F.expr("gid div 240"))
    field = spark.range(2 * cfg.cells).select((F.col("id") % 2).cast("int").alias("t"), F.expr("id div 2").alias("gid")).withColumn("value", 3.0 * x - 2.0 * y + 0.5 * z + F.col("t"))
    taken = field.where(F.xxhash64("t", "gid") % 20 == 0)
    samples = recon.with_corners(taken, field, cfg)
    rows = linear.linear_reconstruct(field, samples, cfg)
    off = rows.agg(F.count("*"), F.count("rebuilt"), F.max(F.abs(F.col("value") - F.col("rebuilt")))).first()
    assert off[0] == off[1] == 2 * cfg.cells and off[2] < 1e-6
    again = linear.linear_reconstruct(field.repartition(7), samples.repartition(5), cfg)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    assert linear.linear_reconstruct(field, samples.where("t = 0"), cfg).where("t = 1 and rebuilt is not null").count() == 0


def test_query_equals_tetrahedra_of_all_samples(spark, data_dir):
    """Cubes and halos make no difference: each timestep's samples at once give the same, and no sample is inside a sphere."""
    field = registry._field(spark, data_dir)
    hull = registry._hull(spark, field).toPandas().sort_values("gid")
    got = registry.linear_reconstruct(spark, data_dir).toPandas()
    assert len(got) == registry.GRID.cells * field.select("t").distinct().count()
    for t, own in hull.groupby("t"):
        rows = got[got["t"] == t].sort_values("gid")
        points, lift = linear._places(own["gid"].to_numpy(), registry.GRID), linear.lifts(own["gid"].to_numpy())
        corners, weights, spheres = linear.tetrahedra(linear._places(rows["gid"].to_numpy(), registry.GRID), points, lift)
        assert (corners >= 0).all() and (weights > -1e-6).all()
        away = ((points[None] - spheres[:, None, :3]) ** 2).sum(2) + lift - spheres[:, 3:]
        assert away.min() > -1e-6
        assert np.allclose((own["value"].to_numpy()[corners] * weights).sum(1), rows["rebuilt"], atol=2e-6)
