"""Fields as rows (t, gid, value) over tables of numbered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import div


def numbered_rows(rows: DataFrame, number: str, value: str, cells: int) -> DataFrame:
    """Row n is cell n % cells of timestep n div cells."""
    n = F.col(number)
    return rows.select(div(n, cells).cast("int").alias("t"), (n % cells).cast("long").alias("gid"), F.col(value).cast("double").alias("value"))


def dealt_rows(rows: DataFrame, number: str, value: str, times: int) -> DataFrame:
    """Row n is cell n div times of timestep n % times: so many timesteps, which grow with the table."""
    n = F.col(number)
    return rows.select((n % times).cast("int").alias("t"), div(n, times).cast("long").alias("gid"), F.col(value).cast("double").alias("value"))


def events_field(spark: SparkSession, sf_dir: str, cells: int) -> DataFrame:
    return numbered_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "value", cells)


def orders_field(spark: SparkSession, sf_dir: str, cells: int) -> DataFrame:
    return numbered_rows(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", "o_totalprice", cells)


def embeddings_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One two-dimensional field: component along x, vector along y."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.posexplode("embedding").alias("x", "v")).select(F.lit(0).alias("t"), (F.col("vec_id") * 64 + F.col("x")).alias("gid"), F.col("v").cast("double").alias("value"))
