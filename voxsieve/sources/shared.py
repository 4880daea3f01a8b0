"""Tables in the folder that driver and executors share, and joins with small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a small side is broadcast, and copies of it beyond that where its keys may be hot.
SMALL_BYTES, SALTS = 8 << 20, 64


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; a temporary folder only where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/voxsieve-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read back."""
    path, schema = new_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = SMALL_BYTES) -> DataFrame:
    """Join a small table, such as one row per timestep, to a large one without shuffling the large one.

    The small side is computed and written once, and broadcast if its rows take no more bytes than the limit. Beyond that both
    sides are shuffled on the keys; the hint keeps the engine, which sees the file's bytes and not the copies, from broadcasting it. A region of a timestep has a bounded number of cells, so keys with block_id in them are joined
    as they are; others, such as a timestep alone or a timestep's bin, may each hold any number of cells, which are spread over
    salts.
    """
    small = written(small, "small")
    if small.count() * row_bytes(small) <= limit:
        return big.join(F.broadcast(small), on, how)
    if "block_id" in on:
        return big.join(small.hint("merge"), on, how)
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    return salted.join(spread.hint("merge"), [*on, "__salt"], how).drop("__salt")


def row_bytes(df: DataFrame) -> int:
    """What a row takes in memory, about: the columns' default sizes and what a hash table adds."""
    return df._jdf.schema().defaultSize() + 32
