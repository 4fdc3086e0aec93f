"""Column expressions of scan geometry; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = 3.141592653589793


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def azimuth(x: Column, y: Column) -> Column:
    """Degrees in [0, 360)."""
    raw = F.degrees(F.atan2(y, x))
    return F.when(raw < 0, raw + 360).otherwise(raw)


def zenith(z: Column, rng: Column) -> Column:
    """Degrees from +Z; 0 at the origin."""
    return F.when(rng > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / F.nullif(rng, F.lit(0.0))))))).otherwise(F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def pixel_x(azimuth_deg: Column, h_res: float, width: int) -> Column:
    """Truncated towards zero, clipped to the canvas."""
    return clip((azimuth_deg / h_res).cast("int"), 0, width - 1)


def pixel_y(elevation: Column, lowest: Column, v_res: float, height: int) -> Column:
    """Row 0 on top; the lowest elevation falls on row ``height`` and is clipped into the last one."""
    return clip(F.lit(height) - ((elevation - lowest) / v_res).cast("int"), 0, height - 1)


def min_max(value: Column, low: Column, high: Column) -> Column:
    return (value - low) / F.nullif(high - low, F.lit(0.0))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """The sextant formula."""
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    k = F.pmod(i, F.lit(6))
    pick = lambda *c: F.when(k == 0, c[0]).when(k == 1, c[1]).when(k == 2, c[2]).when(k == 3, c[3]).when(k == 4, c[4]).otherwise(c[5])
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def eigenvalues(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> tuple[Column, Column, Column]:
    """Ascending eigenvalues of [[a, d, f], [d, b, e], [f, e, c]] in closed form; NULL in, NULL out."""
    m = (a + b + c) / 3
    spread = (a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m) + 2 * (d * d + e * e + f * f)
    s = F.sqrt(spread / 6)
    det = (a - m) * ((b - m) * (c - m) - e * e) - d * (d * (c - m) - e * f) + f * (d * e - (b - m) * f)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / F.nullif(2 * s * s * s, F.lit(0.0))))
    phi = F.acos(r) / 3
    top = F.when(s > 0, m + 2 * s * F.cos(phi)).otherwise(m)
    low = F.when(s > 0, m + 2 * s * F.cos(phi + 2 * PI / 3)).otherwise(m)
    return low, 3 * m - low - top, top


def smallest_eigenvector(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, low: Column) -> tuple[Column, Column, Column]:
    """Unit vector of the smallest eigenvalue: the longest cross product of two rows of A - low * I."""
    rows = ((a - low, d, f), (d, b - low, e), (f, e, c - low))
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    made = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    size = [x * x + y * y + z * z for x, y, z in made]
    pick = lambda k: F.when((size[0] >= size[1]) & (size[0] >= size[2]), made[0][k]).when(size[1] >= size[2], made[1][k]).otherwise(made[2][k])
    longest = F.sqrt(F.greatest(*size))
    return tuple(pick(k) / F.nullif(longest, F.lit(0.0)) for k in range(3))


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin, the last one closed; bin 0 if all values are equal."""
    width = F.nullif((high - low) / bins, F.lit(0.0))
    return F.when(width.isNull(), 0).otherwise(F.least(F.floor((value - low) / width), F.lit(bins - 1))).cast("int")
