"""Settings of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GridConfig:
    """A regular 3-D grid, its regions, and how it is sampled and rebuilt.

    dims and block_dims are cells along x, y and z; every dimension must be a multiple of its region's. lifetime is the value
    range over all timesteps, for histograms that are compared across them.
    """

    dims: tuple[int, int, int]
    block_dims: tuple[int, int, int]
    ratio: float = 0.1
    num_bins: int = 20
    lifetime: tuple[float, float] = (0.0, 1.0)
    error_threshold: float = 0.0
    seed: int = 42
    neighbours: int = 3
    weight_eps: float = 1.0
    portable_hash: bool = False

    def __post_init__(self) -> None:
        if any(d < 1 or b < 1 or d % b for d, b in zip(self.dims, self.block_dims, strict=True)):
            raise ValueError(f"region dims {self.block_dims} don't divide dims {self.dims}")
        if not 0 <= self.ratio <= 1 or self.num_bins < 1:
            raise ValueError("ratio must be from 0 to 1 and num_bins at least 1")

    @property
    def cells(self) -> int:
        x, y, z = self.dims
        return x * y * z

    @property
    def block_volume(self) -> int:
        x, y, z = self.block_dims
        return x * y * z

    @property
    def blocks(self) -> int:
        return self.cells // self.block_volume


#: Known data sets with dims, region dims, bins, lifetime range, and the pattern whose first group is a file's timestep.
PRESETS = {
    "exaam": (GridConfig((20, 200, 50), (4, 20, 10), num_bins=20, lifetime=(300.271, 927.426)), r"plt_temperature_([0-9]+).bin"),
    "isabel_subsampled": (GridConfig((250, 250, 50), (25, 25, 25), num_bins=29, lifetime=(-5471.85791, 3225.42578)), r"Pf([0-9]+).binLE.raw_corrected_2_subsampled.vti.bin"),
    "isabel": (GridConfig((500, 500, 100), (25, 25, 25), num_bins=29, lifetime=(-5471.85791, 3225.42578)), r"Pf([0-9]+).bin"),
    "asteroid": (GridConfig((300, 300, 300), (50, 50, 50), num_bins=27, lifetime=(0.0, 1.0)), r"pv_insitu_300x300x300_([0-9]+).bin"),
}
