"""Boxes, regions and sketches against plain versions, and what a scan of them reads."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.test_engine import GRID, field_of, values
from voxsieve.config import GridConfig
from voxsieve.functions import geometry as g
from voxsieve.operators import autoconf, boxes, sketches, stats


def test_morton_keys_interleave(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(1 << 21), rng.randrange(1 << 21), rng.randrange(1 << 21)) for _ in range(50)] + [(0, 0, 0), (2**21 - 1,) * 3]
    plain = lambda p: sum((c >> b & 1) << (3 * b + k) for k, c in enumerate(p) for b in range(21))
    frame = spark.createDataFrame(rows, "x int, y int, z int")
    assert [r.k for r in frame.select(boxes.morton(F.col("x"), F.col("y"), F.col("z")).alias("k")).collect()] == [plain(p) for p in rows]


def test_boxes_of_all_sizes(spark):
    cfg, rng = GridConfig((70, 9, 40), (7, 3, 8)), random.Random(3)
    cells = spark.range(2 * cfg.cells).select((F.col("id") % 2).cast("int").alias("t"), F.expr("id div 2").alias("gid"), F.lit(1.0).alias("value"))
    rows = []
    for k in range(60):
        a = [rng.randint(-3, d) for d in cfg.dims]
        rows.append((k % 3, f"b{k}", *(x for p, d in zip(a, cfg.dims) for x in (p, p + rng.choice([0, 1, 2, 5, d, 2 * d])))))
    shape = "t int, name string, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int"
    found = boxes.in_boxes(cells, spark.createDataFrame(rows, shape), cfg)
    got = {r.name: r.n for r in found.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("gid").alias("d")).where("n = d").collect()}
    size = lambda a, b, d: max(0, min(b, d) - max(a, 0))
    want = {r[1]: n for r in rows if r[0] < 2 and (n := size(*r[2:4], 70) * size(*r[4:6], 9) * size(*r[6:8], 40))}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert boxes.in_boxes(cells, spark.createDataFrame([(0, "e", 5, 5, 0, 9, 0, 9)], shape), cfg).collect() == []
    assert boxes.in_boxes(cells, spark.createDataFrame([], shape), cfg).collect() == []


def rows_scanned(frame):
    """Rows that the plan's scans gave out once it ran."""
    frame.collect()
    plan, total = frame._jdf.queryExecution().executedPlan(), 0
    found = [plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan]
    while found:
        p = found.pop()
        if p.nodeName().startswith("Scan"):
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        found += [kids.apply(k) for k in range(kids.size())]
    return total


def test_a_region_is_a_small_part_of_a_table_laid_out_by_regions(spark, tmp_path):
    cfg = GridConfig((40, 40, 40), (8, 8, 8))
    field = spark.range(3 * cfg.cells).select((F.col("id") % 3).cast("int").alias("t"), F.expr("id div 3").alias("gid"), F.rand(1).alias("value"))
    table = boxes.by_region(field, cfg, f"file://{tmp_path}/laid", row_group_bytes=1 << 15)
    for block in (0, 37, cfg.blocks - 1):
        own = boxes.in_block(table, block, cfg)
        want = sorted(r.gid for r in field.where((g.block_id(F.col("gid"), cfg) == block) & (F.col("t") == 0)).select("gid").collect())
        assert sorted(r.gid for r in own.where("t = 0").collect()) == want and boxes.bounds(block, cfg) == (want[0], want[-1])
        assert rows_scanned(own) < 3 * cfg.cells / 5
        assert "block_id" in own._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    # without the layout at least the region's first and last cell reach the scan
    field.write.parquet(f"{tmp_path}/plain")
    own = boxes.in_block(spark.read.parquet(f"{tmp_path}/plain"), 0, cfg)
    assert own.count() == 3 * cfg.block_volume and "LessThanOrEqual(gid," in own._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["even", "skewed", "few"])
def test_sketches_are_within_their_bound(spark, kind):
    value = {"even": F.rand(3), "skewed": F.pow(F.rand(4), 9), "few": F.floor(F.rand(5) * 4).cast("double")}[kind]
    rows = spark.range(60_000).select((F.col("id") % 6).cast("int").alias("t"), value.alias("value")).checkpoint()
    kept = sketches.sketches(rows.unionByName(rows.limit(5).withColumn("value", F.lit(float("nan")))), "t", "value", 400)
    shares = [0.0, 0.1, 0.5, 0.75, 0.999]
    for width, groups in ((1, 6), (4, 2), (None, 1)):
        found = sketches.quantiles(sketches.merged(kept, width), shares).collect()
        assert len(found) == groups * len(shares) and sum(r.n for r in found) == 60_000 * len(shares)
        for r in found[::2]:
            own = rows.where(F.lit(True) if width is None else F.col("t").between(r["first"], r["first"] + width - 1))
            below, upto = own.agg(F.count_if(F.col("value") < r.q), F.count_if(F.col("value") <= r.q)).first()
            off = 2 * sketches.rank_error(400) * r.n
            assert below <= r.share * r.n + off and upto >= r.share * r.n - off
    assert sketches.sketches(rows.limit(0), "t", "value").collect() == []


def test_threshold_from_a_sketch(spark):
    field = field_of(spark, [values(k) for k in range(3)])
    exact = autoconf.error_threshold(field).first().value
    near = sketches.error_threshold(field).first().value  # so few values are all in the sketch
    gaps = sorted(abs(a - b) for a, b in zip(values(0), values(1)))
    assert abs(gaps.index(near) - gaps.index(exact)) <= 1
    assert sketches.error_threshold(field.where("t = 0")).first().value is None
    assert stats.percentile_by_index(field, "value", 0.5).first().value is not None and replace(GRID, seed=1).seed == 1
