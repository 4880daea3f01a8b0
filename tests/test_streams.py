"""Streams: restarts, late cells, timesteps that never complete."""

import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.test_engine import GRID, field_of, near_steps
from voxsieve.operators import sampling, temporal
from voxsieve.sources import shared
from voxsieve.streaming import error, fill, reuse

CFG = replace(GRID, error_threshold=0.6, ratio=0.5)
KEY = ["t", "block_id", "n_reference", "reused"]


def rows_of(frame, names=KEY):
    return sorted(tuple(r[n] for n in names) for r in frame.select(*names).collect())


@pytest.fixture
def errors(spark):
    """A runner of the error stream that goes on from its checkpoint at each call; the calls' files are its batches."""
    error.stateful(spark)
    folder, out, marks = (shared.new_path(spark, n) for n in ("in", "out", "marks"))
    count = iter(range(99))

    def run(cells, **options):
        cells.coalesce(1).write.parquet(f"{folder}/{next(count)}")
        stream = spark.readStream.schema(cells.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
        decisions = error.error_stream(stream, CFG, **options)
        if not options.get("limit_ms"):
            return reuse.run_available(decisions, "e", out, marks)
        query = decisions.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(once=True).start()
        assert query.awaitTermination(120)
        return spark.read.schema(decisions.schema).parquet(out)

    return run


def test_error_stream_restarts_and_equals_batch(spark, errors):
    cells = shared.written(sampling.judged(field_of(spark, near_steps(6)), CFG), "cells")
    want = rows_of(temporal.reuse_by_error(cells, CFG))
    # timesteps split over runs and out of order: 2 before 1, a part of 3 late
    parts = ["t = 0 or (t = 1 and gid % 2 = 0)", "t = 2 or (t = 3 and gid % 2 = 0)", "t = 1 and gid % 2 = 1", "(t = 3 and gid % 2 = 1) or t = 5", "t = 4"]
    for part in parts[:2]:
        found = errors(cells.where(part), first=0)
    assert {r.t for r in found.collect()} == {0}
    for part in parts[2:]:
        found = errors(cells.where(part), first=0)
    assert rows_of(found) == want and any(r[3] for r in want)
    found = errors(cells.where("t = 3"), first=0)  # all of it late: nothing changes
    assert rows_of(found) == want


def test_timesteps_that_never_complete_are_given_up(spark, errors):
    cells = shared.written(sampling.judged(field_of(spark, near_steps(4)), CFG), "cells")
    errors(cells.where("t = 0 or (t = 1 and gid <> 5)"), limit_ms=1)
    time.sleep(0.2)
    found = errors(cells.where("t >= 2"), limit_ms=1)
    time.sleep(0.2)
    found = errors(cells.where("t = 3 or (t = 1 and gid = 5)"), limit_ms=1)
    lost = cells.where("gid = 5").first().block_id
    got = {(r.t, r.block_id): r for r in found.collect()}
    assert len(got) == 4 * CFG.blocks and not got[1, lost].complete and not got[1, lost].reused
    assert all(r.complete for k, r in got.items() if k != (1, lost))
    assert got[2, lost].n_reference == 0 and not got[2, lost].reused  # after a gap
    want = {(r.t, r.block_id): r for r in temporal.reuse_by_error(cells.where(f"block_id <> {lost}"), CFG).collect()}
    assert all(got[k].reused == r.reused and got[k].n_reference == r.n_reference for k, r in want.items())


def test_fill_stream_resumes_where_it_was_stopped(spark, monkeypatch):
    field = field_of(spark, near_steps(5))
    samples, blocks = temporal.temporal_error_sample_filled(field, CFG)
    folder, out, marks = (shared.new_path(spark, n) for n in ("in", "out", "marks"))
    stream = lambda: spark.readStream.schema(field.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    field.where("t < 2").coalesce(1).write.parquet(f"{folder}/0")
    fill.fill_stream(stream(), CFG, out, marks)
    assert {r.t for r in fill.results(spark, out)[0].select("t").distinct().collect()} == {0, 1}
    field.where("t in (2, 3)").coalesce(1).write.parquet(f"{folder}/1")
    plain = sampling.fill

    def stopped(now, flags, cfg):
        if now.first().t == 3:
            raise RuntimeError("stopped here")
        return plain(now, flags, cfg)

    monkeypatch.setattr(sampling, "fill", stopped)  # once the flags of timestep 3 are there
    with pytest.raises(Exception, match="stopped here"):
        fill.fill_stream(stream(), CFG, out, marks)
    monkeypatch.setattr(sampling, "fill", plain)
    assert fill.results(spark, out)[0].where("t = 3").count() == 0
    fill.fill_stream(stream(), CFG, out, marks)
    field.where("t = 4").coalesce(1).write.parquet(f"{folder}/2")
    fill.fill_stream(stream(), CFG, out, marks)
    got, flags = fill.results(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, samples.collect()))
    assert sorted(map(tuple, flags.collect())) == sorted(map(tuple, blocks.collect()))
    assert got.where(F.col("kind") == "fill").count()
    field.where("t = 1").coalesce(1).write.parquet(f"{folder}/3")
    with pytest.raises(Exception, match="came before"):
        fill.fill_stream(stream(), CFG, out, marks)
