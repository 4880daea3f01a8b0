"""Hand-checked figures, properties and edge cases of the engine's operators."""

import math
import random
import time
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxsieve.config import PRESETS, GridConfig
from voxsieve.functions import geometry as g
from voxsieve.operators import autoconf, importance, recon, sampling, stats, temporal
from voxsieve.plans import lifecycle
from voxsieve.sources import names, ranges, raw, shared, tables
from voxsieve.streaming import reuse

NAN = float("nan")
GRID = GridConfig((6, 4, 2), (3, 2, 1), ratio=0.3, num_bins=5, lifetime=(0.0, 1.0), seed=7)
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def field_of(spark, steps, cfg=GRID):
    """A field from lists of values, one for each timestep."""
    rows = [(t, k, float(v)) for t, values in enumerate(steps) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "t int, gid long, value double")


def values(seed, cfg=GRID):
    return [((k * 2654435761 + seed * 97) % 1000) / 1000 for k in range(cfg.cells)]


def test_bins(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.5, 4.99, 5.0, 9.99, 10.0, -3.0, 12.0, NAN)], "v double")
    assert [r.b for r in rows.select(g.bin_id(F.col("v"), F.lit(0.0), F.lit(10.0), 4).alias("b")).collect()] == [0, 0, 1, 1, 2, 3, 3, 0, 3, 0]
    assert rows.select(g.bin_id(F.lit(4.0), F.lit(4.0), F.lit(4.0), 9).alias("b")).first().b == 0


def test_regions(spark):
    cfg = GridConfig((4, 4, 2), (2, 2, 1))
    rows = spark.createDataFrame([(i,) for i in (0, 2, 5, 10, 15, 16, 31)], "gid long")
    assert [r.b for r in rows.select(g.block_id(F.col("gid"), cfg).alias("b")).collect()] == [0, 1, 0, 3, 3, 4, 7]
    with pytest.raises(ValueError):
        GridConfig((4, 4, 2), (3, 2, 1))
    assert all(cfg.blocks > 1 for cfg, _ in PRESETS.values())


@few
@given(st.tuples(*[st.integers(1, 4)] * 3), st.tuples(*[st.integers(1, 3)] * 3))
def test_ids_are_a_bijection(spark, block, times):
    cfg = GridConfig(tuple(b * n for b, n in zip(block, times, strict=True)), block)
    gid = F.col("id")
    rows = spark.range(cfg.cells).select("id", g.block_id(gid, cfg).alias("b"), g.local_id(gid, cfg).alias("l")).withColumn("back", g.global_id(F.col("b"), F.col("l"), cfg)).collect()
    assert all(r.back == r.id for r in rows) and len({(r.b, r.l) for r in rows}) == cfg.cells
    assert {r.b for r in rows} == set(range(cfg.blocks)) and {r.l for r in rows} == set(range(cfg.block_volume))


@pytest.mark.parametrize("counts, ratio, wanted", [([1000] * 4, 0.025, [25, 18, 19, 19]), ([1, 5, 90, 4], 0.2, [1, 5, 5, 4]), ([0, 10, 10, 980], 0.1, [0, 10, 10, 40]), ([50, 50], 0.1, [5, 2])])
def test_acceptance(spark, counts, ratio, wanted):
    hist = spark.createDataFrame([(0, b, n) for b, n in enumerate(counts)], "t int, bin int, n long")
    rows = sorted(importance.acceptance(hist, replace(GRID, ratio=ratio, num_bins=len(counts))).collect(), key=lambda r: r.bin)
    assert [r.k for r in rows] == wanted
    assert [r.p for r in rows] == [pytest.approx(k / n if n else 0) for k, n in zip(wanted, counts, strict=True)]


@few
@given(st.lists(st.integers(0, 500), min_size=1, max_size=12), st.floats(0, 1))
def test_acceptance_stays_in_budget(spark, counts, ratio):
    hist = spark.createDataFrame([(0, b, n) for b, n in enumerate(counts)], "t int, bin int, n long")
    rows = importance.acceptance(hist, replace(GRID, ratio=ratio, num_bins=len(counts))).collect()
    assert all(0 <= r.k <= r.n and 0 <= r.p <= 1 for r in rows) and sum(r.k for r in rows) <= ratio * sum(counts) + 1e-6


@pytest.mark.parametrize(
    "old, new, want",
    [
        ([1, 2, 3, 4], [1, 2, 3, 2], (2, 0.5, 1.1547005384, 8.2930377283, 2.2184874962)),
        ([0, 10, 20, 30, 40], [0, 12, 19, 30, 44], (4, 1.4, 2.2912878475, 24.8396067925, 19.5078197733)),
        ([5, 6, 7], [5, 6, 7], (0, 0, 0, 10000, None)),
        ([5, 5, 5], [5, 5, 6], (1, 1 / 3, math.sqrt(0.5), -10000, None)),
        ([1], [1], (0, 0, None, -10000, None)),
    ],
)
def test_quality(spark, old, new, want):
    r = stats.quality(field_of(spark, [old]), field_of(spark, [new])).first()
    assert (r.max_diff, r.avg_diff, r.rmse, r.psnr, r.snr) == tuple(None if w is None else pytest.approx(w) for w in want)


def test_quality_skips_nan(spark):
    r = stats.quality(field_of(spark, [[1, NAN, 3, 9]]), field_of(spark, [[1, 2, NAN, 8]])).first()
    assert (r.n, r.max_diff, r.avg_diff) == (4, 1.0, 0.25)


def test_histograms(spark):
    field = field_of(spark, [values(1), [3.0] * GRID.cells, [NAN, *values(2)[1:]]])
    rows = stats.histogram(field, GRID).collect()
    assert len(rows) == 15
    assert {t: sum(r.n for r in rows if r.t == t) for t in range(3)} == dict.fromkeys(range(3), GRID.cells)
    assert [r.n for r in sorted(rows, key=lambda r: r.bin) if r.t == 1] == [GRID.cells, 0, 0, 0, 0]
    blocks = stats.block_histogram(field, GRID).collect()
    assert len(blocks) == 3 * GRID.blocks and all(sum(r.hist) == GRID.block_volume and len(r.hist) == 5 for r in blocks)


def test_percentile_by_index(spark):
    for data, want in (([1, 2, 3, 4], 4), ([4, 3, 2, 1, 9, 8, 7], 8), ([5], 5), ([2, 2, 2, 2, 2], 2)):
        rows = spark.createDataFrame([(float(v),) for v in data], "v double").repartition(3)
        assert stats.percentile_by_index(rows, "v", 0.75).first().value == want
    assert stats.percentile_by_index(spark.createDataFrame([], "v double"), "v", 0.75).first().value is None


def test_quartiles_by_group(spark):
    rows = [(t, float(k * 7 % n)) for t, n in ((0, 1), (1, 5), (2, 300)) for k in range(n)] + [(2, None), (2, NAN), (3, NAN)]
    field = spark.createDataFrame(rows, "t int, value double")
    found = {r.t: (r.n, r.p0, r.p1) for r in stats.percentiles_by_index(field.where("not isnan(value)"), "t", "value", [0.25, 0.75]).collect()}
    assert found == {0: (1, 0.0, 0.0), 1: (5, 1.0, 3.0), 2: (300, 75.0, 225.0)}
    widths = {r.t: (r.n, r.iqr, r.bins) for r in autoconf.freedman_bins(field).collect()}
    assert widths == {0: (1, 0.0, None), 1: (5, 2.0, 3), 2: (300, 150.0, 8)}
    assert autoconf.freedman_bins(field.limit(0)).collect() == []


def test_report_has_settings_and_times(spark):
    cfg = replace(GRID, ratio=0.4, error_threshold=0.6)
    field = field_of(spark, near_steps(3))
    has = {
        1: {"histogram", "sort", "acceptance", "stencil", "gather"},
        4: set(lifecycle.STEPS),
        7: {"histogram", "sort", "acceptance", "stencil", "comparison", "fill", "gather"},
        "error_reuse": {"histogram", "sort", "acceptance", "stencil", "comparison", "gather"},
    }
    for method, nearest in ((4, 3), (1, 0), (7, 1), ("error_reuse", 1)):
        clock, began = lifecycle.Clock(), time.monotonic()
        found = lifecycle.report(field, cfg, method, nearest, clock)
        whole = time.monotonic() - began
        assert len(found.columns) == 26 and len(lifecycle.short_report(found).columns) == 19
        rows = found.orderBy("t").collect()
        assert [r.t for r in rows] == [0, 1, 2]
        assert all((r.region_dims, r.num_bins, r.reconstruction) == ("3/2/1", 5, {0: None, 1: "nearest", 3: "nearest_3"}[nearest]) for r in rows)
        assert all(r.sampling_s > 0 and math.isclose(r.sampling_gb_s * r.sampling_s, r.file_gb) and (r.recons_s is None) == (not nearest) for r in rows)
        # the steps make up the sampling, and with the rebuilding nearly all of the run
        assert {s for s in lifecycle.STEPS if rows[0][f"{s}_gb_s"] is not None} == has[method]
        assert math.isclose(sum(r.sampling_s for r in rows), clock.total(*lifecycle.STEPS)) and clock.total(*lifecycle.STEPS) > 0.5 * (whole - clock.total("recons")) > 0
        assert clock.total(*lifecycle.STEPS, "recons") <= whole
        samples, blocks = lifecycle.sample(field, cfg, method)
        assert sorted(map(tuple, lifecycle.timed_sample(field, cfg, method, lifecycle.Clock())[0].collect())) == sorted(map(tuple, samples.collect()))
        assert {(r.t, r.blocks_reused, r.n_samples) for r in rows} == set(map(tuple, temporal.reuse_counts(blocks).collect()))
    short = lifecycle.short_report(lifecycle.report(field, cfg, 1)).first()
    assert short.histogram_us > 0 and short.sample_us > 0 and short.histogram_us + short.sample_us < short.total_us
    assert lifecycle.report(field_of(spark, []), cfg, 1).collect() == []


def test_summaries_leave_the_first_timestep_out_of_reuse(spark):
    rows = spark.createDataFrame([(3, "m", 0, 10), (4, "m", 6, 20), (5, "m", 2, 30)], "t int, method string, blocks_reused long, n_samples long")
    got = {r.t: (r.blocks_reused, r.n_samples) for r in lifecycle.summaries(rows, ["method"], ["blocks_reused", "n_samples"]).collect()}
    assert got[-1] == (4.0, 20.0) and got[-2][0] == 2.0 and got[-2][1] == pytest.approx((200 / 3) ** 0.5)
    alone = lifecycle.summaries(rows.where("t = 3"), ["method"], ["blocks_reused", "n_samples"]).where("t = -1").first()
    assert alone.blocks_reused is None and alone.n_samples == 10.0


def test_samples_do_not_depend_on_partitions(spark):
    field = field_of(spark, [values(k) for k in range(3)])
    runs = [sorted(map(tuple, sampling.importance_sample(field.repartition(n), GRID).collect())) for n in (1, 4, 37)]
    assert runs[0] == runs[1] == runs[2] and 0 < len(runs[0]) < 3 * GRID.cells
    other = sorted(map(tuple, sampling.importance_sample(field, replace(GRID, seed=8)).collect()))
    assert other != runs[0]


def test_attach_beyond_the_limit(spark):
    big, small = spark.range(200).select((F.col("id") % 20).alias("k"), "id"), spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows = [sorted(map(tuple, shared.attach(big, small, ["k"], limit=n).collect())) for n in (5, 10_000)]
    assert rows[0] == rows[1] and len(rows[0]) == 200
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    salted, plain = shared.attach(big, small, ["k"], limit=5), shared.attach(big.withColumnRenamed("k", "block_id"), small.withColumnRenamed("k", "block_id"), ["block_id"], limit=5)
    # a region has a bounded number of cells, so its key isn't copied
    assert "explode" in plan(salted) and "explode" not in plan(plain) and plain.count() == 200


def decisions(flags):
    out = []
    for may in flags:
        out.append(bool(may and not (out and out[-1])))
    return out


def test_alternation(spark):
    steps = [[0.1] * 48, [0.1] * 48, [0.1] * 48, [0.1] * 48, [0.5] * 48, [0.5] * 48, [0.1] * 48]
    rows = temporal.reuse_by_histogram(field_of(spark, steps), GRID).where("block_id = 0").orderBy("t").collect()
    assert [r.reused for r in rows] == [False, True, False, True, False, True, False]
    gap = field_of(spark, steps).where("t <> 1")
    assert [r.reused for r in temporal.reuse_by_histogram(gap, GRID).where("block_id = 0").orderBy("t").collect()] == [False, False, True, False, True, False]


def plain_error_reuse(cells, cfg, filled=None):
    """The recurrence timestep by timestep; filled gives the extra samples of a timestep."""
    by_t = {}
    for r in cells:
        by_t.setdefault(r.t, []).append(r)
    out, last, was = {}, {}, {}
    for t in sorted(by_t):
        gaps = {}
        for r in by_t[t]:
            if r.gid in last:
                gaps.setdefault(r.block_id, []).append((r.value - last[r.gid]) ** 2)
        flags = {b: b in gaps and not was.get(b) and math.sqrt(sum(gaps[b]) / len(gaps[b])) <= cfg.error_threshold for b in {r.block_id for r in by_t[t]}}
        out[t] = flags
        last = {r.gid: r.value for r in by_t[t] if r.taken and not flags[r.block_id]} | (filled(t) if filled else {})
        was = flags
    return out


def near_steps(n):
    base = values(3)
    return [[v + 0.02 * ((k * 7 + t * 3) % 5 if (k // 3 + t) % 4 else 40) for k, v in enumerate(base)] for t in range(n)]


def test_error_reuse_is_the_recurrence(spark):
    cfg = replace(GRID, error_threshold=0.05)
    cells = shared.written(sampling.judged(field_of(spark, near_steps(9)), cfg), "t")
    want = plain_error_reuse(cells.collect(), cfg)
    rows = temporal.reuse_by_error(cells, cfg).collect()
    # without a sample taken anew a reused region has no reference, so the window form and the loop agree
    assert {(r.t, r.block_id): r.reused for r in rows} == {(t, b): f for t, flags in want.items() for b, f in flags.items()}
    assert any(r.reused for r in rows)


def test_error_reuse_with_fill(spark):
    cfg = replace(GRID, error_threshold=0.6, ratio=0.5)
    field = field_of(spark, near_steps(5))
    samples, blocks = temporal.temporal_error_sample_filled(field, cfg)
    own = samples.collect()
    filled = lambda t: {r.gid: r.value for r in own if r.t == t and r.kind == "fill"}
    want = plain_error_reuse(sampling.judged(field, cfg).collect(), cfg, filled)
    got = {(r.t, r.block_id): r.reused for r in blocks.collect()}
    assert got == {(t, b): f for t, flags in want.items() for b, f in flags.items()} and any(got.values())
    assert len({(r.t, r.gid) for r in own}) == len(own)
    for t in range(5):
        assert sum(r.t == t for r in own) <= int(cfg.ratio * cfg.cells) or not any(r.kind == "fill" and r.t == t for r in own)
    empty = temporal.temporal_error_sample_filled(field.limit(0), cfg)
    assert empty[0].count() == empty[1].count() == 0


def test_histogram_fill_and_coalesce(spark):
    cfg = replace(GRID, ratio=0.6, num_bins=2)
    field = field_of(spark, [values(1), values(1), values(1), values(4)])
    samples, blocks = temporal.temporal_histogram_sample(field, cfg)
    rows, flags = samples.collect(), {(r.t, r.block_id): r for r in blocks.collect()}
    assert len({(r.t, r.gid) for r in rows}) == len(rows)
    assert not any(flags[r.t, r.block_id].reused for r in rows)
    assert all(f.n_samples == sum((r.t, r.block_id) == k for r in rows) for k, f in flags.items())
    effective = {(r.t, r.gid) for r in temporal.coalesced(samples, blocks).collect()}
    for (t, b), f in flags.items():
        own = {r.gid for r in rows if (r.t, r.block_id) == (t, b)}
        before = {r.gid for r in rows if (r.t, r.block_id) == (t - 1, b)}
        cells = {gid for s, gid in effective if s == t and gid in (before if f.reused else own)}
        assert cells == (before if f.reused else own)


def test_coalesce_takes_the_last_timestep(spark):
    samples = spark.createDataFrame([(0, 1, 0, 1.0), (0, 2, 0, 2.0), (0, 9, 1, 9.0), (1, 8, 1, 8.0)], "t int, gid long, block_id int, value double")
    blocks = spark.createDataFrame([(0, 0, 2, False), (0, 1, 1, False), (1, 0, 0, True), (1, 1, 1, False)], "t int, block_id int, n_samples long, reused boolean")
    assert sorted(r.gid for r in temporal.coalesced(samples, blocks).where("t = 1").collect()) == [1, 2, 8]


def near_by_force(cells, samples, cfg, k):
    at = lambda i: (i % cfg.dims[0], i // cfg.dims[0] % cfg.dims[1], i // (cfg.dims[0] * cfg.dims[1]))
    out = {}
    for t, gid in cells:
        own = sorted((sum((a - b) ** 2 for a, b in zip(at(gid), at(i), strict=True)), i) for s, i, _ in samples if s == t)
        if own:
            out[t, gid] = own[:k]
    return out


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("ratio, share", [(0.3, 3), (0.9, 17), (0.01, 60)])
def test_nearest_is_exact(spark, k, ratio, share):
    cfg = GridConfig((12, 10, 6), (3, 2, 1), ratio=ratio)
    cells = [(t, i) for t in range(3) for i in range(cfg.cells)]
    samples = [(t, i, float(i)) for t in range(2) for i in range(cfg.cells) if (i * 2654435761 + t) % 1009 % share == 0 and (t == 0 or i < 200)]
    rows = recon.nearest(spark.createDataFrame(cells, "t int, gid long"), spark.createDataFrame(samples, "t int, gid long, value double"), cfg, k).collect()
    assert {(r.t, r.gid): [(n.d2, n.s_gid) for n in r.near] for r in rows} == near_by_force(cells, samples, cfg, k)


def test_sampled_cells_are_their_own_neighbours(spark):
    field = field_of(spark, [values(5), values(6)])
    samples = sampling.importance_sample(field, GRID)
    rebuilt = recon.nn_reconstruct(field, samples, GRID).join(samples.select("t", "gid"), ["t", "gid"]).collect()
    assert rebuilt and all(r.rebuilt == r.value for r in rebuilt)
    assert recon.nn_reconstruct(field, samples.limit(0), GRID).count() == 0


def test_weighted_neighbours(spark):
    cfg = GridConfig((5, 1, 1), (1, 1, 1), neighbours=3)
    samples = spark.createDataFrame([(0, i, float(i * 10)) for i in (1, 2, 3, 4)], "t int, gid long, value double")
    cell = spark.createDataFrame([(0, 0)], "t int, gid long")
    weights = [1 / 2, 1 / 5, 1 / 10]
    assert recon.knn_reconstruct(cell, samples, cfg).first().rebuilt == pytest.approx(sum(w * v for w, v in zip(weights, (10, 20, 30), strict=True)) / sum(weights))


def test_corners(spark):
    field = field_of(spark, [values(1)])
    assert sorted(r.gid for r in recon.corners(field, GRID).collect()) == [0, 5, 18, 23, 24, 29, 42, 47]
    flat = GridConfig((6, 4, 1), (3, 2, 1))
    assert recon.corners(field, flat).count() == 4


def test_widths_and_regions(spark):
    row = spark.range(1).select(autoconf.scott(F.lit(10000.0), F.lit(2.0)).alias("s"), autoconf.doane(F.lit(10000.0), F.lit(10.0), F.lit(0.0)).alias("d")).first()
    assert (row.s, row.d) == (pytest.approx(0.3240599707), pytest.approx(0.6999021071))
    extent = spark.createDataFrame([(20, 200, 50)], "x_dim int, y_dim int, z_dim int")
    rows = autoconf.candidate_regions(extent).orderBy("place").collect()
    assert len(rows) == 23
    assert [(r.bx, r.by, r.bz, r.regions) for r in rows[:5]] == [(4, 4, 5, 2500), (4, 4, 10, 1250), (4, 4, 25, 500), (4, 5, 5, 2000), (4, 5, 10, 1000)]
    assert tuple(autoconf.auto_regions(extent).first())[1:4] == (4, 5, 5)


def test_auto_configuration(spark):
    cfg = GridConfig((12, 12, 8), (1, 1, 1), ratio=0.2)
    field = field_of(spark, [[math.sin(k / 9) + 0.01 * t for k in range(cfg.cells)] for t in range(2)])
    found = autoconf.auto_configure(field, cfg)
    assert found.block_dims != (1, 1, 1) and found.num_bins > 2 and found.error_threshold == pytest.approx(0.01)
    assert autoconf.auto_bins(field, cfg).first().psnr is None


def test_file_names(spark):
    files = spark.createDataFrame([("/a/Pf10.bin",), ("/a/Pf9.bin",), ("/a/note.txt",), ("/b/Pf10.bin",)], "path string")
    rows = names.timestep_index(files, r"Pf([0-9]+).bin").collect()
    assert sorted((r.path, r.timestep, r["index"]) for r in rows) == [("/a/Pf10.bin", 10, 1), ("/a/Pf9.bin", 9, 0), ("/b/Pf10.bin", 10, 1)]


@pytest.fixture
def many_tasks(spark):
    """Shuffles keep their partitions, however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_raw_files(spark, tmp_path, monkeypatch, many_tasks):
    field = field_of(spark, [values(k) for k in range(3)]).withColumn("value", F.col("value").cast("float").cast("double")).repartition(5)
    for layout in ("files", "parts"):
        folder = f"file://{tmp_path}/{layout}"
        raw.write_raw(field, folder, GRID, "plt_temperature_{t}.bin", per_task=10, layout=layout)
        assert sorted(p.name for p in tmp_path.iterdir()) == sorted({"files", layout})
        assert {p.name for p in (tmp_path / layout).iterdir()} == {f"plt_temperature_{t}.bin" for t in range(3)}
        parts = len(list((tmp_path / layout).rglob("part-*")))
        assert parts == 0 if layout == "files" else parts > 3
        monkeypatch.setattr(raw, "CELLS_PER_TASK", 20)
        again = raw.read_raw(spark, folder, r"plt_temperature_([0-9]+).bin", GRID)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, field.collect()))
        some = raw.read_raw(spark, folder, r"plt_temperature_([0-9]+).bin", GRID, times=(1, 1), cells=(7, 29))
        assert sorted(map(tuple, some.collect())) == sorted(tuple(r) for r in field.collect() if r.t == 1 and 7 <= r.gid < 30)
        with pytest.raises(Exception, match="bytes"):
            raw.read_raw(spark, folder, r"plt_temperature_([0-9]+).bin", GridConfig((7, 4, 2), (7, 2, 1))).collect()


@pytest.mark.parametrize("bad", ["gid <> 3", "gid < 30", "gid > 0"])
def test_a_writer_that_fails_leaves_nothing(spark, tmp_path, bad, many_tasks):
    field = field_of(spark, [values(k) for k in range(2)])
    folder = f"file://{tmp_path}/raw"
    for rows in (field.where(f"t = 0 or ({bad})"), field.unionByName(field.where("t = 1 and gid = 5")), field.withColumn("value", F.when(F.col("gid") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))):
        with pytest.raises(Exception, match="missing|repeated|lost"):
            raw.write_raw(rows, folder, GRID, per_task=10)
        assert list(tmp_path.iterdir()) == []
    raw.write_raw(field, folder, GRID)
    raw.write_raw(field.withColumn("value", F.col("value") + 1), folder, GRID, per_task=7)  # takes the place of the first
    assert sorted(p.name for p in tmp_path.iterdir()) == ["raw"]
    assert raw.read_raw(spark, folder, r"field_([0-9]+).bin", GRID).agg(F.sum("value")).first()[0] == pytest.approx(field.agg(F.sum(F.col("value") + 1)).first()[0], rel=1e-5)


def test_offsets_of_variable_parts(spark):
    rng = random.Random(2)
    rows = [(t, k, rng.randint(0, 9)) for t in range(3) for k in range(0, 40, t + 1)]
    got = ranges.offsets(spark.createDataFrame(rows, "t int, k int, n long"), "t", "k", "n", chunk=7).collect()
    assert sorted((r.t, r.k, r.offset) for r in got) == sorted((t, k, sum(n for u, j, n in rows if u == t and j < k)) for t, k, _ in rows)


def test_sample_files(spark, tmp_path, many_tasks):
    field = field_of(spark, [[round(v, 1) for v in values(1)]] * 3).withColumn("value", F.col("value").cast("float").cast("double"))
    samples, blocks = temporal.temporal_histogram_sample(field, GRID)
    samples, blocks = shared.written(samples, "s"), shared.written(blocks, "b")
    for layout, some in (("files", samples), ("parts", samples), ("none", samples.where("t <> 1"))):
        folder = f"file://{tmp_path}/{layout}"
        raw.write_samples(some, blocks, folder, per_task=5, layout=layout)
        assert {p.name for p in (tmp_path / layout).iterdir()} == {f"sampled_{k}_{t}.bin" for k in ("id", "data", "total") for t in range(3)}
        back, flags = raw.read_samples(spark, folder, GRID)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, some.select("t", "gid", "block_id", "value").collect()))
        assert sorted(map(tuple, flags.collect())) == sorted(map(tuple, blocks.collect()))
        ids = raw.read_samples(spark, folder, GRID, times=(2, 5))[0].collect()
        assert {r.t for r in ids} == {2} and len(ids) == some.where("t = 2").count()


def test_roi_and_report(spark, tmp_path):
    (tmp_path / "roi.txt").write_text("(0, 3, 1, 4, 0, 2)\nx0=2,5,0,4,1,2\r\n")
    roi = raw.read_roi(spark, f"{tmp_path}/roi.txt")
    assert sorted(map(tuple, roi.collect())) == [(0, 0, 3, 1, 4, 0, 2), (1, 2, 5, 0, 4, 1, 2)]
    field = field_of(spark, [values(1), values(2)])
    counts = stats.roi_cells(field, roi, GRID).groupBy("t").count().collect()
    assert sorted(map(tuple, counts)) == [(0, 18), (1, 12)]
    raw.write_stats(stats.value_range(field), f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    steps = [[round(v, 0) for v in values(k // 2)] for k in range(6)]
    field = field_of(spark, steps)
    for n, part in enumerate([field.where("t < 2"), field.where("t = 2 and gid % 2 = 0 or t = 3"), field.where("t = 2 and gid % 2 = 1"), field.where("t > 3"), field.where("t = 0")]):
        part.coalesce(1).write.parquet(f"{tmp_path}/{n}")
        file = next((tmp_path / str(n)).glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        file.rename(tmp_path / "in" / f"{n}.parquet")
    stream = reuse.field_stream(spark, f"{tmp_path}/in", "*.parquet", field.schema)
    got = reuse.run_available(reuse.reuse_stream(stream, GRID), "reuse").collect()
    want = temporal.reuse_by_histogram(field, GRID).collect()
    assert sorted((r.t, r.block_id, r.reused) for r in got) == sorted((r.t, r.block_id, r.reused) for r in want)
    assert any(r.reused for r in want)


def test_tables(spark, data_dir):
    assert tables.events_field(spark, data_dir, 1000).agg(F.max("gid")).first()[0] == 999
    assert tables.embeddings_field(spark, data_dir).count() == 64 * spark.read.parquet(f"{data_dir}/embeddings.parquet").count()


def test_methods_and_views(spark):
    cfg = replace(GRID, ratio=0.4, error_threshold=0.6)
    field = field_of(spark, near_steps(3))
    for number, name in ((1, "importance"), (5, "histogram_reuse_filled"), (9, "error_reuse_filled")):
        assert lifecycle.NUMBERED[number] == name
    for method in ("importance", 4, "error_reuse"):
        rows = lifecycle.assess(field, cfg, method, nearest=3).orderBy("t").collect()
        assert [r.t for r in rows] == [0, 1, 2] and all(r.n == cfg.cells for r in rows)
    samples, blocks = lifecycle.sample(field, cfg, "importance")
    lifecycle.register_views(field, samples, blocks, lifecycle.rebuild(field, samples, blocks, cfg))
    assert spark.sql("select count(*) from recon join field using (t, gid) left anti join samples using (t, gid)").first()[0] == 3 * cfg.cells - samples.count()


def test_spacing(spark):
    at = tuple(F.lit(v) for v in (3, 4, 5))
    there = g.physical(at, (0.5, 2.0, 10.0))
    row = spark.range(1).select(*there, *g.logical(there, (0.5, 2.0, 10.0))).first()
    assert tuple(row) == (1.5, 8.0, 50.0, 3, 4, 5)


def test_nearest_by_several_lists_of_a_wide_cube(spark, monkeypatch):
    """Clustered samples with one in a far corner, lists of a few samples each."""
    cfg = GridConfig((24, 16, 8), (4, 4, 4), ratio=0.05)
    gids = [x + 24 * y + 384 * z for x in range(4) for y in range(5) for z in range(2)] + [24 * 16 * 8 - 1]
    samples = spark.createDataFrame([(0, i, float(i)) for i in gids], "t int, gid long, value double")
    cells = spark.range(cfg.cells).select(F.lit(0).alias("t"), F.col("id").alias("gid"))
    place = lambda i: (i % 24, i // 24 % 16, i // 384)
    apart = lambda i, j: sum((a - b) ** 2 for a, b in zip(place(i), place(j), strict=True))
    for most in (1 << 15, 64):
        monkeypatch.setattr(recon, "LIST", most)
        for k in (1, 3):
            got = {r.gid: [(n.d2, n.s_gid) for n in r.near] for r in recon.nearest(cells, samples, cfg, k).collect()}
            assert got == {i: sorted((apart(i, j), j) for j in gids)[:k] for i in range(cfg.cells)}
