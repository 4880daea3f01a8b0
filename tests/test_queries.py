"""Every registered query of the engine against its SQL."""

import pytest

from tests.oracle import duck, sorted_rows
from voxsieve.plans.registry import ORACLES, QUERIES

MIDDLE = "/root/testdata/sf0.01"
#: Queries that compare timesteps need the table with ten of them.
OVER_TIME = ["reuse_histogram", "stream_reuse_histogram", "reuse_error", "coalesced_samples", "fill_samples", "error_threshold", "stats_report", "block_rmse", "sample_files", "sample_file_blocks", "error_fill_samples", "method_figures", "sample_cloud", "image_files", "stream_reuse_error", "stream_error_fill"]


def test_every_query_has_sql():
    # that one has a test of its own in test_linear
    assert QUERIES.keys() - ORACLES.keys() == {"linear_reconstruct"} and ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data_dir, name):
    sf_dir = MIDDLE if name in OVER_TIME else data_dir
    frame = QUERIES[name](spark, sf_dir)
    got = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert got == sorted_rows(*duck(sf_dir, ORACLES[name]))
    assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
