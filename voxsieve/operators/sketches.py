"""Approximate percentiles from mergeable sketches: one kept for each timestep, merged over ranges of them, never a sort.

The exact form is stats.percentile_by_index(). A sketch is of the KLL kind with so many items as SIZE says; a value taken from
it at some share stands, with 99 % certainty, at a place within rank_error() of that share. Merging doesn't add to that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import div

SIZE = 1024


def rank_error(size: int = SIZE) -> float:
    """By how much of all values the place of a value from a sketch may be off."""
    return 2.3 / size**0.9


def sketches(rows: DataFrame, by: str, value: str, size: int = SIZE) -> DataFrame:
    """(by, sketch): of each group's values; nulls and NaN don't count. Groups of none of these have no row."""
    sound = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    return sound.groupBy(by).agg(F.kll_sketch_agg_double(F.col(value), size).alias("sketch"))


def merged(found: DataFrame, width: int | None) -> DataFrame:
    """(first, sketch): the sketches of so many successive timesteps as one, named by the first; of all of them if width is None."""
    first = F.lit(0).cast("int") if width is None else (div(F.col("t"), width) * width).cast("int")
    return found.groupBy(first.alias("first")).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(found: DataFrame, shares: list[float]) -> DataFrame:
    """found with share, n and q for each share: about int(n * share) of the n values are below q."""
    each = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("q")) for s in shares]))
    return found.withColumn("n", F.kll_sketch_get_n_double("sketch")).withColumn("e", each).select(*found.drop("sketch").columns, "n", "e.share", "e.q")


def error_threshold(field: DataFrame, share: float = 0.75, size: int = SIZE) -> DataFrame:
    """(value): autoconf.error_threshold() from a sketch of the differences."""
    times = [r.t for r in field.select("t").distinct().orderBy("t").limit(2).collect()]
    if len(times) < 2:
        return field.sparkSession.createDataFrame([(None,)], "value double")
    side = lambda t, name: field.where(F.col("t") == t).select("gid", F.col("value").alias(name))
    gaps = side(times[0], "a").join(side(times[1], "b"), "gid").select(F.lit(0).alias("t"), F.abs(F.col("b") - F.col("a")).alias("gap"))
    return quantiles(sketches(gaps, "t", "gap", size), [share]).agg(F.max("q").alias("value"))
