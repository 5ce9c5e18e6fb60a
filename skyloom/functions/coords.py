"""Sky coordinates and distances as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Speed of light, km/s.
C_KM_S = 299792.458


@dataclass(frozen=True)
class Cosmology:
    """A flat universe; the defaults are the Planck 2018 parameters (TT,TE,EE+lowE+lensing+BAO)."""

    h0: float = 67.66
    omega_m: float = 0.30966
    omega_r: float = 9.1e-5

    @property
    def omega_l(self) -> float:
        return 1.0 - self.omega_m - self.omega_r


PLANCK18 = Cosmology()


def gauss_legendre(n: int) -> list[tuple[float, float]]:
    """Nodes and weights on [0, 1]."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(n)
    return [((float(a) + 1) / 2, float(b) / 2) for a, b in zip(x, w)]


def comoving_distance(z: Column, cosmology: Cosmology = PLANCK18, nodes: int = 16) -> Column:
    """Line-of-sight comoving distance in Mpc: c/H0 times the integral of 1/E, by unrolled quadrature."""
    total = F.lit(0.0)
    for x, w in gauss_legendre(nodes):
        a = 1 + z * x
        e = F.sqrt(cosmology.omega_m * a * a * a + cosmology.omega_r * a * a * a * a + cosmology.omega_l)
        total = total + w / e
    return z * total * (C_KM_S / cosmology.h0)


def hubble_distance(z: Column, h0: float = 70.0) -> Column:
    """Distance of the linear law, c z / H0."""
    return z * (C_KM_S / h0)


def to_cartesian(ra_deg: Column, dec_deg: Column, distance: Column | float = 1.0) -> tuple[Column, Column, Column]:
    """x, y, z of a direction at a distance; the unit sphere by default. Nulls propagate."""
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    ra, dec = F.radians(ra_deg), F.radians(dec_deg)
    return d * F.cos(dec) * F.cos(ra), d * F.cos(dec) * F.sin(ra), d * F.sin(dec)


def add_cartesian(
    df: DataFrame, ra: str = "ra_deg", dec: str = "dec_deg", z: str = "z", names=("x_mpc", "y_mpc", "z_mpc"), law=comoving_distance
) -> DataFrame:
    """``df`` with Cartesian columns; ``law`` maps the redshift column to a distance."""
    xyz = to_cartesian(F.col(ra), F.col(dec), law(F.col(z)))
    return df.withColumns(dict(zip(names, xyz)))


def add_proxy_cartesian(df: DataFrame, ra: str = "ra", dec: str = "dec", z: str = "redshift", names=("X", "Y", "Z")) -> DataFrame:
    """Cartesian columns at a distance of 1000 times the redshift, an old convention without physics; null without all three."""
    if not {ra, dec, z} <= set(df.columns):
        return df.withColumns({n: F.lit(None).cast("double") for n in names})
    return add_cartesian(df, ra, dec, z, names, lambda c: c * 1000.0)


def angular_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Degrees between two directions (haversine)."""
    h = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(
        F.sin(F.radians(ra2 - ra1) / 2), 2
    )
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))
