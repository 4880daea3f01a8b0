"""Many small timesteps: decided by runs, with as many jobs however many there are."""

from dataclasses import replace
from unittest import mock

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_engine import GRID, field_of, near_steps
from voxsieve.operators import recon, sampling, temporal
from voxsieve.plans import lifecycle
from voxsieve.sources import raw, shared
from voxsieve.streaming import error, fill

CFG = replace(GRID, error_threshold=0.6, ratio=0.5)


def rows_of(frames):
    return [sorted(map(tuple, f.collect())) for f in frames]


def jobs_of(spark, work):
    """How many jobs the work starts."""
    spark.sparkContext.setJobGroup(group := shared.new_path(spark, "group"), "")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture
def odd_field(spark):
    """Twelve timesteps with a gap, a repeated cell, missing cells, a null and a NaN."""
    field = field_of(spark, near_steps(13)).where("t <> 6 and not (t = 4 and gid % 5 = 1)")
    value = F.when((F.col("t") == 2) & (F.col("gid") < 6), None).when((F.col("t") == 9) & (F.col("gid") == 20), float("nan")).otherwise(F.col("value"))
    return shared.written(field.unionByName(field.where("t in (7, 8) and gid = 11")).withColumn("value", value), "field")


def test_runs_decide_as_single_timesteps_do(spark, odd_field, monkeypatch):
    monkeypatch.setattr(temporal, "FEW", 99)
    want = rows_of(temporal.temporal_error_sample_filled(odd_field, CFG))
    assert any(r[-1] for r in want[1]) and any(r[-1] == "fill" for r in want[0])
    monkeypatch.setattr(temporal, "FEW", 0)
    for run_cells in (2 * CFG.cells, 5 * CFG.cells):
        monkeypatch.setattr(temporal, "RUN_CELLS", run_cells)
        assert rows_of(temporal.temporal_error_sample_filled(odd_field, CFG)) == want


def test_jobs_do_not_grow_with_timesteps(spark):
    counts = [jobs_of(spark, lambda n=n: temporal.temporal_error_sample_filled(field_of(spark, near_steps(n)), CFG)) for n in (12, 24)]
    assert 0 < counts[1] < counts[0] + 12


def test_stream_goes_on_by_runs(spark, odd_field):
    want = rows_of(temporal.temporal_error_sample_filled(odd_field, CFG))
    folder, out, marks = (shared.new_path(spark, n) for n in ("in", "out", "marks"))
    for k, part in enumerate(("t < 10", "t >= 10")):
        odd_field.where(part).coalesce(1).write.parquet(f"{folder}/{k}")
        stream = spark.readStream.schema(odd_field.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
        fill.fill_stream(stream, CFG, out, marks)
    assert rows_of(fill.results(spark, out)) == want
    # a batch by runs after a single one, and one that comes again
    steps = shared.new_path(spark, "steps")
    for number, part in ((0, "t < 3"), (1, "t >= 3"), (1, "t >= 3")):
        fill.take(odd_field.where(part), number, CFG, steps)
    assert rows_of(fill.results(spark, steps)) == want
    with pytest.raises(ValueError, match="came before"):
        fill.take(odd_field.where("t = 9"), 2, CFG, steps)


def test_a_single_run_takes_few_jobs(spark):
    cells = shared.written(sampling.judged(field_of(spark, near_steps(12)), CFG), "judged")
    assert 0 < jobs_of(spark, lambda: temporal.temporal_error_sample_filled(cells, CFG, cells)) < 30


def test_methods_share_judged_cells(spark, monkeypatch):
    field = field_of(spark, near_steps(3))
    want = rows_of([lifecycle.assess(field, CFG, m) for m in (1, 4)])
    monkeypatch.setattr(temporal, "judged", None)
    assert rows_of(lifecycle.assess_each(field, CFG, [1, 4])) == want


def test_beyond_the_limit_nothing_is_broadcast(spark):
    big, small = spark.range(200).select((F.col("id") % 20).alias("t"), (F.col("id") % 7).alias("block_id")), spark.range(20).select(F.col("id").alias("t"))
    for on, part in ((["t"], small), (["t", "block_id"], small.withColumn("block_id", F.lit(3).cast("long")))):
        plan = shared.attach(big, part, on, limit=5)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_lists_of_samples_are_not_broadcast(spark):
    field = field_of(spark, near_steps(3))
    step = recon._round(field, shared.written(field.where("gid % 3 = 0"), "samples"), CFG, 2, 1, True, False)
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_small_files_share_tasks(spark, tmp_path):
    cfg, n = replace(GRID, dims=(2, 2, 1), block_dims=(1, 1, 1)), 300
    for t in range(n):
        np.arange(t, t + 4, dtype="<f4").tofile(tmp_path / f"x{t}.bin")
    found = raw.read_raw(spark, f"file://{tmp_path}", r"x([0-9]+)\.bin", cfg)
    assert 60 <= found.rdd.getNumPartitions() <= 75
    assert sorted(map(tuple, found.collect())) == [(t, k, float(t + k)) for t in range(n) for k in range(4)]


def test_what_is_complete_at_once_stays_out_of_the_state():
    last, opened, calls = mock.Mock(), mock.Mock(), []
    last.exists.return_value = False
    opened.keys.return_value = iter(())
    opened.updateValue.side_effect = lambda k, v: calls.append(k)
    decisions = error.ErrorDecisions(2, 1.0, None, 0)
    decisions.last, decisions.open = last, opened
    cells = pd.DataFrame({"t": [0, 0, 1, 1, 2], "gid": [0, 1, 1, 0, 0], "value": [1.0, 2.0, 2.5, 1.0, 0.0], "taken": [True] * 5})
    (got,) = decisions.handleInputRows((7,), iter([cells[:3], cells[3:]]), None)
    assert got[["t", "block_id", "n_reference", "reused"]].values.tolist() == [[0, 7, 0, False], [1, 7, 2, True]]
    assert calls == [(2,)]  # the one that is still arriving
