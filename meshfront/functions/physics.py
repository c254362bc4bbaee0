"""Column expressions for gas physics, geometry and image scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshfront.plans.ranges import check_choice

#: Cgs constants, and kiloparsecs in cm and km.
K_BOLTZMANN, PROTON_MASS, MSUN, KPC = 1.380649e-16, 1.67262192369e-24, 1.98847e33, 3.0856775814913673e21
KPC_IN_KM = KPC / 1.0e5
GAMMA = 5.0 / 3.0
PLANES = {"xy": ("x", "y", "z"), "xz": ("x", "z", "y"), "yz": ("y", "z", "x")}


def _col(value: Column | str | float) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(float(value))


def entropy(temperature, density, gamma: float = GAMMA) -> Column:
    """T / rho^(gamma - 1), and 0 unless both are positive."""
    t, r = _col(temperature), _col(density)
    return F.when((t > 0) & (r > 0), t / F.pow(r, F.lit(gamma - 1))).otherwise(0.0)


def mach_from_temperature_jump(ratio, gamma: float = GAMMA) -> Column:
    """Mach number of a Rankine-Hugoniot temperature ratio: the positive root of a quadratic in its square; 1 for no rise."""
    r = _col(ratio)
    a, c = 2 * gamma * (gamma - 1), -2 * (gamma - 1)
    b = F.lit(4 * gamma - (gamma - 1) ** 2) - r * ((gamma + 1) ** 2)
    square = (F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0))) - b) / (2 * a)
    return F.when(r <= 1, 1.0).otherwise(F.sqrt(F.greatest(square, F.lit(1.0))))


def temperature_jump(mach, gamma: float = GAMMA) -> Column:
    m2 = _col(mach) * _col(mach)
    return (m2 * (2 * gamma) - (gamma - 1)) * (m2 * (gamma - 1) + 2) / (m2 * (gamma + 1) ** 2)


def density_jump(mach, gamma: float = GAMMA) -> Column:
    m2 = _col(mach) * _col(mach)
    return m2 * (gamma + 1) / (m2 * (gamma - 1) + 2)


def mach_from_jump_monatomic(ratio) -> Column:
    """The inverse for gamma = 5/3 in closed form."""
    r = _col(ratio) * 16 - 14
    return F.sqrt(F.greatest((r + F.sqrt(r * r + 60)) / 10, F.lit(1.0)))


def thermalization_efficiency(mach, gamma: float = GAMMA) -> Column:
    """Share of the kinetic energy flux that becomes heat; 0 up to Mach 1, never negative."""
    m2, c = _col(mach) * _col(mach), density_jump(mach, gamma)
    pressure = (m2 * (2 * gamma) - (gamma - 1)) / (gamma + 1)
    share = F.lit(2.0) / (m2 * c * (gamma * (gamma - 1))) * (pressure - F.pow(c, F.lit(gamma)))
    return F.when(_col(mach) > 1, F.greatest(share, F.lit(0.0))).otherwise(0.0)


def sound_speed_cgs(temperature, gamma: float = GAMMA, mu: float = 0.59, floor: float = 1.0e4) -> Column:
    return F.sqrt(F.greatest(_col(temperature), F.lit(floor)) * (gamma * K_BOLTZMANN / (mu * PROTON_MASS)))


def dissipation_flux(density, mach, sound_cgs, efficiency) -> Column:
    """erg / s / kpc^2 from density in solar masses per cubic kpc."""
    speed = _col(mach) * _col(sound_cgs)
    return _col(density) * (0.5 * MSUN / KPC**3) * speed * speed * speed * _col(efficiency) * KPC**2


def norm(x, y, z) -> Column:
    x, y, z = _col(x), _col(y), _col(z)
    return F.sqrt(x * x + y * y + z * z)


def dot(a: tuple, b: tuple) -> Column:
    (ax, ay, az), (bx, by, bz) = (tuple(_col(v) for v in u) for u in (a, b))
    return ax * bx + ay * by + az * bz


def surface_area(base, normal: tuple, mode: str = "normal") -> Column:
    """A front's area in its cell: the face, or the face over the largest direction cosine (at least 1/sqrt 3). A zero normal leaves the face."""
    check_choice("area_mode", mode, {"cell", "normal"})
    if mode == "cell":
        return _col(base)
    largest = F.greatest(*(F.abs(_col(c)) for c in normal))
    return F.when(largest > 0, _col(base) / F.least(F.greatest(largest, F.lit(1 / math.sqrt(3))), F.lit(1.0))).otherwise(_col(base))


def inferred_level(widest, dx) -> Column:
    return F.rint(F.log2(_col(widest) / _col(dx))).cast("int")


def normalized(value, low: float, high: float, log: bool = False, stretch: float = 1.0) -> Column:
    """A pixel's value in 0..1 between the limits (log10 limits with ``log``); null where it isn't finite. stretch above 1 is an asinh contrast."""
    v = _col(value)
    v = F.when(v > 0, F.log10(v)) if log else v
    high = low + 1 if high <= low else high
    unit = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    if stretch and stretch > 1:
        unit = F.asinh(unit * stretch) / math.asinh(stretch)
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), unit)


def projected(plane: str) -> tuple[str, str, str]:
    check_choice("plane", plane, PLANES)
    return PLANES[plane]
