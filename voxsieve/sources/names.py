"""Timesteps from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def timestep_of(path: Column, pattern: str) -> Column:
    """The pattern's first group as a number; null where it doesn't match."""
    return F.try_to_number(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), F.lit("999999999")).cast("int")


def timestep_index(files: DataFrame, pattern: str) -> DataFrame:
    """files (path) with timestep and index: the place of the timestep in ascending order, from 0. Files that don't match go."""
    found = files.withColumn("timestep", timestep_of(F.col("path"), pattern)).where("timestep is not null")
    # files are few beside the cells in them
    return found.withColumn("index", F.dense_rank().over(W.orderBy("timestep")) - 1)
