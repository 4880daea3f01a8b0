"""Boxes and regions as ranges of keys: any number of boxes a timestep, and tables laid out so that a region is a part of them.

A cell's Morton key has the bits of its coordinates in turn, so a cube whose edge is a power of two is one interval of keys, and
its number is what stays of them without their last bits. A box is cut into the few cubes of its own size that meet it, and a
cell meets the boxes of the cube that it is in, by an equi-join for each size of cube that is in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GridConfig
from ..functions import geometry as g
from ..sources.shared import new_path
from .stats import in_roi

#: Bits of a cube's edge at most, so that a cube has a bounded number of cells; larger boxes have more cubes.
WIDEST = 5
#: Shifts and masks that set the bits of a number three places apart.
_SPREAD = [(32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)]
ROW_GROUP_BYTES = 1 << 20


def _apart(x: Column) -> Column:
    x = x.cast("long")
    for shift, mask in _SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(x: Column, y: Column, z: Column) -> Column:
    """The key of a cell or cube; coordinates up to 21 bits."""
    return _apart(x).bitwiseOR(F.shiftleft(_apart(y), 1)).bitwiseOR(F.shiftleft(_apart(z), 2))


def in_boxes(cells: DataFrame, boxes: DataFrame, cfg: GridConfig) -> DataFrame:
    """cells with the columns of each box (t, x0, x1, y0, y1, z0, z1, and more) of their timestep that they lie in; half-open.

    Boxes may reach beyond the grid and overlap; an empty one has no cells.
    """
    edges = list(zip("xyz", cfg.dims, strict=True))
    inside = boxes.select("*", *[F.greatest(F.col(f"{c}0"), F.lit(0)).alias(f"__{c}0") for c, _ in edges], *[F.least(F.col(f"{c}1"), F.lit(d)).alias(f"__{c}1") for c, d in edges])
    inside = inside.where(" and ".join(f"__{c}0 < __{c}1" for c, _ in edges))
    longest = F.greatest(*[F.col(f"__{c}1") - F.col(f"__{c}0") for c, _ in edges])
    inside = inside.withColumn("__level", F.least(F.ceil(F.log2(longest)), F.lit(WIDEST)).cast("int"))
    levels = [r[0] for r in inside.select("__level").distinct().collect()]  # WIDEST + 1 at most
    for c, _ in edges:
        inside = inside.withColumn(f"__{c}", F.explode(F.sequence(F.call_function("shiftright", F.col(f"__{c}0"), F.col("__level")), F.call_function("shiftright", F.col(f"__{c}1") - 1, F.col("__level")))))
    cut = inside.withColumn("__cube", morton(*[F.col(f"__{c}") for c, _ in edges])).drop(*[f"__{c}{k}" for c, _ in edges for k in ("", "0", "1")])
    if not levels:
        return cells.join(cut.drop("__level", "__cube"), "t").limit(0)
    at = F.explode(F.array(*map(F.lit, sorted(levels))))
    keyed = cells.withColumn("__key", morton(*g.xyz(F.col("gid"), cfg))).withColumn("__level", at)
    keyed = keyed.withColumn("__cube", F.call_function("shiftright", F.col("__key"), 3 * F.col("__level"))).drop("__key")
    return keyed.join(cut, ["t", "__level", "__cube"]).where(in_roi(*g.xyz(F.col("gid"), cfg))).drop("__level", "__cube")


def bounds(block: int, cfg: GridConfig) -> tuple[int, int]:
    """The first and the last cell of a region."""
    (bx, by, bz), (nx, ny) = cfg.block_dims, (cfg.dims[0] // cfg.block_dims[0], cfg.dims[1] // cfg.block_dims[1])
    x, y, z = block % nx * bx, block // nx % ny * by, block // (nx * ny) * bz
    first = x + cfg.dims[0] * (y + cfg.dims[1] * z)
    return first, first + bx - 1 + cfg.dims[0] * (by - 1 + cfg.dims[1] * (bz - 1))


def in_block(cells: DataFrame, block: int, cfg: GridConfig) -> DataFrame:
    """The cells or samples of one region. A scan is told the region's first and last cell, and its number where the table has it."""
    first, last = bounds(block, cfg)
    near = cells.where(F.col("gid").between(first, last))
    return near.where(F.col("block_id") == block) if "block_id" in cells.columns else near.where(g.block_id(F.col("gid"), cfg) == block)


def by_region(field: DataFrame, cfg: GridConfig, path: str | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """A table of the field with block_id in which a region of a timestep lies together, read back; in_block() reads that part of it only."""
    spark, path = field.sparkSession, path or new_path(field.sparkSession, "regions")
    rows = field if "block_id" in field.columns else field.withColumn("block_id", g.block_id(F.col("gid"), cfg))
    laid = rows.repartitionByRange("block_id", "t").sortWithinPartitions("block_id", "t", "gid")
    laid.write.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", 5000).parquet(path)
    return spark.read.schema(laid.schema).parquet(path)
