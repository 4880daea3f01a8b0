"""The acceptance function: how likely a cell is kept, by the bin of its value; rare values first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GridConfig


def bin_order(hist: DataFrame) -> DataFrame:
    """(t, place, bin, n): bins by ascending count, equal counts by bin."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "bin")))
    return hist.groupBy("t").agg(ordered.alias("b")).select("t", F.posexplode("b").alias("place", "e")).select("t", "place", "e.bin", "e.n")


def acceptance(hist: DataFrame, cfg: GridConfig) -> DataFrame:
    """(t, bin, n, k, p): of bin's n cells k are wanted, p = k / n.

    The budget int(ratio * cells) is dealt in ascending order of counts. Each bin gets at most the target; what remains is
    divided anew among so many bins as are left, the one just served counted in. Bins are few, so a timestep's fold is one
    row's work.
    """
    per_t = hist.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("n", "bin"))).alias("b"), F.sum("n").alias("total"))
    budget = F.expr(f"cast(total * cast({cfg.ratio!r} as double) as bigint)")
    fold = """
      aggregate(b,
        named_struct('i', 0L, 'remaining', budget, 'target', budget div cast(size(b) as bigint), 'out', cast(array() as array<struct<bin:int,n:bigint,k:bigint>>)),
        (s, e) -> named_struct(
          'i', s.i + 1L,
          'remaining', s.remaining - least(e.n, s.target),
          'target', (s.remaining - least(e.n, s.target)) div (cast(size(b) as bigint) - s.i),
          'out', concat(s.out, array(named_struct('bin', e.bin, 'n', e.n, 'k', least(e.n, s.target))))),
        s -> s.out)
    """
    return per_t.withColumn("budget", budget).select("t", F.explode(F.expr(fold)).alias("e")).select("t", "e.bin", "e.n", "e.k", F.coalesce(F.try_divide("e.k", "e.n"), F.lit(0.0)).alias("p"))
