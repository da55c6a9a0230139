"""Kinematic expressions. All are Catalyst columns, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 6.283185307179586
PI = 3.141592653589793
INF = float("inf")


def confine_angle(x: Column) -> Column:
    """An angle wrapped to [-pi, pi)."""
    return F.pmod(x + PI, F.lit(TWO_PI)) - PI


def angular_distance(a: Column, b: Column) -> Column:
    """Distance on the circle, 0 to pi."""
    r = a - b
    return F.least(F.pmod(r, F.lit(TWO_PI)), F.pmod(-r, F.lit(TWO_PI)))


def phi(px: Column, py: Column) -> Column:
    return F.atan2(py, px)


def pt(px: Column, py: Column) -> Column:
    return F.sqrt(px * px + py * py)


def theta(pt_: Column, pz: Column) -> Column:
    return F.atan2(pt_, pz)


def pseudorapidity(theta_: Column) -> Column:
    """-ln tan(theta/2), odd about pi/2; infinite along the beam."""
    t = F.pmod(theta_, F.lit(TWO_PI))
    folded = F.least(t, F.lit(PI) - t)
    size = -F.ln(F.tan(F.abs(folded) / 2))
    return F.when(theta_ == 0, F.lit(INF)).when(theta_ == PI, F.lit(-INF)).when(theta_ > PI / 2, -size).otherwise(size)


def rapidity(pt_: Column, pz: Column, e: Column) -> Column:
    """Sign of pz; 0 for pz = 0, infinite when all energy runs along the beam, NaN without any momentum."""
    mass2 = F.greatest(e * e - pz * pz - pt_ * pt_, F.lit(0.0))
    gap = e - F.abs(pz)
    size = 0.5 * F.ln((pt_ * pt_ + mass2) / F.when(gap == 0, None).otherwise(gap * gap))
    along = (pt_ == 0) & (gap == 0)
    return (
        F.when(along & (e == 0), F.lit(float("nan"))).when(along, F.signum(pz) * INF).when(gap == 0, F.signum(pz) * INF).when(pz == 0, F.lit(0.0)).otherwise(F.signum(pz) * size)
    )


def mass2(e: Column, px: Column, py: Column, pz: Column) -> Column:
    return e * e - px * px - py * py - pz * pz


def mass(e: Column, px: Column, py: Column, pz: Column) -> Column:
    """NaN where negative."""
    return F.sqrt(mass2(e, px, py, pz))


def clipped_mass(e: Column, px: Column, py: Column, pz: Column) -> Column:
    return F.sqrt(F.greatest(mass2(e, px, py, pz), F.lit(0.0)))


def momentum(px: Column, py: Column, pz: Column) -> Column:
    return F.sqrt(px * px + py * py + pz * pz)


def polyval2d(x: Column, y: Column, coefficients: list[float], order: int) -> Column:
    """Sum of c[k] x^i y^j over (i, j) in product order."""
    total = F.lit(0.0)
    for k, c in enumerate(coefficients):
        i, j = divmod(k, order + 1)
        total = total + F.lit(float(c)) * F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j)))
    return total


def event_mass(e: Column, px: Column, py: Column, pz: Column) -> Column:
    """Mass of summed momenta: rounding below zero counts as one, clearly negative is an error."""
    m2 = mass2(e, px, py, pz)
    return F.when(m2 > 0, F.sqrt(m2)).when(m2 > -1e-4, F.lit(1.0)).otherwise(F.raise_error(F.lit("event mass squared is negative")).cast("double"))


def add_all(df, prefix: str = ""):
    """phi, pt, theta, pseudorapidity, rapidity and mass from px, py, pz, energy columns, in one projection."""
    c = lambda n: F.col(prefix + n)
    df = df.withColumns({f"{prefix}phi": phi(c("px"), c("py")), f"{prefix}pt": pt(c("px"), c("py"))})
    df = df.withColumns({f"{prefix}theta": theta(c("pt"), c("pz")), f"{prefix}rapidity": rapidity(c("pt"), c("pz"), c("energy")), f"{prefix}mass": mass(c("energy"), c("px"), c("py"), c("pz"))})
    return df.withColumn(f"{prefix}pseudorapidity", pseudorapidity(c("theta")))


def chosen_theta(columns: list[str], prefix: str = ""):
    """The polar angle from what there is: total momentum (birr) and pz, else pt and pz, else px, py and pz; None without these."""
    c = lambda n: F.col(prefix + n)
    have = {name.removeprefix(prefix) for name in columns if name.startswith(prefix)}
    if {"birr", "pz"} <= have:
        return F.acos(c("pz") / c("birr"))
    if {"pt", "pz"} <= have:
        return theta(c("pt"), c("pz"))
    if {"px", "py", "pz"} <= have:
        return theta(pt(c("px"), c("py")), c("pz"))
    return None


def flat_jet_mass(e: Column, pt_: Column, pz: Column) -> Column:
    """Mass of a jet's root from its energy, transverse and longitudinal momentum; NaN where negative."""
    return F.sqrt(e * e - pt_ * pt_ - pz * pz)
