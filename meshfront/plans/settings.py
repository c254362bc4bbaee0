"""Settings of detection, checked on the driver."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from meshfront.plans.ranges import Range, check_choice, check_ranges

RANGES = {
    "center_plateau_tolerance": Range(0),
    "center_normal_cosine": Range(0, 1),
    "max_center_steps": Range(1, whole=True),
    "max_steps": Range(0, whole=True),
    "progress_interval": Range(0, whole=True),
    "min_mach": Range(1),
    "temperature_floor": Range(0, above=True),
    "gamma": Range(1, above=True),
    "min_temperature": Range(),
    "min_density": Range(),
    "max_density": Range(),
}


@dataclass
class Settings:
    minlevel: int = 0
    maxlevel: int = 20
    gamma: float = 5.0 / 3.0
    temperature_floor: float = 1.0e4
    min_temperature: float | None = None
    min_density: float | None = None
    max_density: float | None = None
    min_mach: float = 1.0
    max_steps: int = 50
    max_center_steps: int = 50
    center_normal_cosine: float = 0.7
    center_plateau_tolerance: float = 1.0e-12
    position_unit: str = "km"
    velocity_unit: str = "km/s"
    temperature_unit: str = "K"
    density_unit: str = "Msol/kpc3"
    boundary: str = "open"
    show_progress: bool = False
    progress_interval: int = 0
    neighbor_cache_dir: str | None = None

    def check(self) -> None:
        check_ranges(self, RANGES)
        check_choice("boundary", self.boundary, {"open"})
        if self.minlevel > self.maxlevel:
            raise ValueError(f"no level lies between minlevel {self.minlevel} and maxlevel {self.maxlevel}")
        if self.max_steps > 50:
            warnings.warn("walks of more than 50 steps can run far out of a shock zone", RuntimeWarning, stacklevel=2)
