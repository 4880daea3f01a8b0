"""Column expressions over cell ids: coordinates, regions, bins, distances and reproducible random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GridConfig


def div(a: Column, b: int | Column) -> Column:
    """Whole-number division."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def xyz(gid: Column, cfg: GridConfig) -> tuple[Column, Column, Column]:
    x_dim, y_dim, _ = cfg.dims
    return gid % x_dim, div(gid, x_dim) % y_dim, div(gid, x_dim * y_dim)


def cell_id(x: Column, y: Column, z: Column, cfg: GridConfig) -> Column:
    x_dim, y_dim, _ = cfg.dims
    return (x + y * x_dim + z * (x_dim * y_dim)).cast("long")


def block_id(gid: Column, cfg: GridConfig) -> Column:
    """Regions are numbered as cells are, x fastest."""
    (x, y, z), (bx, by, bz) = xyz(gid, cfg), cfg.block_dims
    nx, ny = cfg.dims[0] // bx, cfg.dims[1] // by
    return (div(x, bx) + div(y, by) * nx + div(z, bz) * (nx * ny)).cast("int")


def local_id(gid: Column, cfg: GridConfig) -> Column:
    """A cell's number inside its region, x fastest."""
    (x, y, z), (bx, by, bz) = xyz(gid, cfg), cfg.block_dims
    return (x % bx + y % by * bx + z % bz * (bx * by)).cast("int")


def global_id(block: Column, local: Column, cfg: GridConfig) -> Column:
    """The inverse of block_id and local_id."""
    bx, by, bz = cfg.block_dims
    nx, ny = cfg.dims[0] // bx, cfg.dims[1] // by
    x = block % nx * bx + local % bx
    y = div(block, nx) % ny * by + div(local, bx) % by
    z = div(block, nx * ny) * bz + div(local, bx * by)
    return cell_id(x, y, z, cfg)


def bin_id(value: Column, low: Column, high: Column, bins: int | Column) -> Column:
    """Equal-width bins, truncated toward zero and kept within 0 and bins - 1; bin 0 where the range is empty."""
    bins = bins if isinstance(bins, Column) else F.lit(bins)
    width = (high - low) / bins
    at = F.try_divide(value - low, width)
    capped = F.least(F.greatest(at, F.lit(0.0)), (bins - 1).cast("double"))
    return F.when(at.isNull() | F.isnan(at), 0).otherwise(capped.cast("int"))


def distance2(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Squared distance in cells."""
    return sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0)).cast("long")


def uniform(stage: str, t: Column, gid: Column, cfg: GridConfig) -> Column:
    """A number from 0 up to 1 that depends on the stage, the cell and the seed only, never on partitioning.

    The portable form can be computed by other engines; the other one is faster.
    """
    if cfg.portable_hash:
        key = F.concat_ws(":", F.lit(stage), t, gid, F.lit(cfg.seed))
        return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    mixed = F.xxhash64(F.lit(stage), t, gid, F.lit(cfg.seed))
    return F.shiftrightunsigned(mixed, 11).cast("double") / F.lit(float(1 << 53))


def physical(at: tuple[Column, Column, Column], spacing: tuple[float, float, float]) -> tuple[Column, ...]:
    """Coordinates in the data's units from coordinates in cells."""
    return tuple(c * F.lit(float(s)) for c, s in zip(at, spacing, strict=True))


def logical(at: tuple[Column, Column, Column], spacing: tuple[float, float, float]) -> tuple[Column, ...]:
    """Coordinates in cells from coordinates in the data's units."""
    return tuple(F.round(c / F.lit(float(s))).cast("long") for c, s in zip(at, spacing, strict=True))
