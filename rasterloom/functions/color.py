"""Colour maths as Column expressions.

Every helper takes and returns Columns, so a chain of per-pixel steps stays in
one whole-stage-codegen span.  Channels are ints in 0..255, `unit` values are
doubles in 0..1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = ("r", "g", "b")

# Rec.709 and BT.601 luma weights.
REC709 = (0.2126, 0.7152, 0.0722)
BT601 = (0.299, 0.587, 0.114)

# CIE 1931 2-degree D65 white point.
D65 = (95.047, 100.0, 108.883)


def num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def col(v) -> Column:
    return v if isinstance(v, Column) else F.col(v)


def jr(x: Column) -> Column:
    """Round half up towards +infinity, as an int."""
    return F.floor(x + F.lit(0.5)).cast("int")


def clamp(lo, hi, v: Column) -> Column:
    return F.greatest(num(lo), F.least(num(hi), v))


def u8(x: Column) -> Column:
    """Clamp to 0..255, then round half up."""
    return jr(clamp(0, 255, x))


def u8_soft(x: Column) -> Column:
    """`u8` for values that went through a recurrence or a long float sum.

    The tolerance keeps exact halves on the upper side whatever the last bits are.
    """
    return u8(x + F.lit(1e-9))


def unit(c) -> Column:
    return col(c) / F.lit(255.0)


def from_unit(x: Column) -> Column:
    return jr(clamp(0, 1, x) * F.lit(255.0))


def mix(a, b, t) -> Column:
    a, b, t = num(a), num(b), num(t)
    return a * (F.lit(1.0) - t) + b * t


def smoothstep(lo, hi, x: Column) -> Column:
    t = clamp(0, 1, (x - num(lo)) / (num(hi) - num(lo)))
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def weighted(r: Column, g: Column, b: Column, w=REC709) -> Column:
    return F.lit(w[0]) * r + F.lit(w[1]) * g + F.lit(w[2]) * b


def luma(r="r", g="g", b="b", weights=REC709) -> Column:
    """Unnormalised luma, 0..255."""
    return weighted(col(r), col(g), col(b), weights)


def luma_unit(r="r", g="g", b="b", weights=REC709) -> Column:
    return weighted(unit(r), unit(g), unit(b), weights)


def quantize_levels(c: Column, levels: int) -> Column:
    """Nearest of `levels` evenly spaced values in 0..255."""
    if levels >= 256:
        return jr(c)
    if levels <= 1:
        return F.lit(0)
    step = 255.0 / (levels - 1)
    return jr(F.floor(c / F.lit(step) + F.lit(0.5)) * F.lit(step))


def srgb_to_linear(c: Column) -> Column:
    """`c` and result in 0..1."""
    return F.when(c <= 0.04045, c / F.lit(12.92)).otherwise(
        F.pow((c + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * F.lit(12.92)).otherwise(
        F.lit(1.055) * F.pow(c, F.lit(1.0 / 2.4)) - F.lit(0.055))


def with_hsv(df: DataFrame, r: Column, g: Column, b: Column, *, h="_h", s="_s", v="_v") -> DataFrame:
    """Add hue 0..360, saturation 0..1 and value 0..1 of unit RGB.

    Staged over several projections: each intermediate is used more than once,
    so Catalyst keeps the stages apart and codegen evaluates each value once.
    """
    tmp = ["_cr", "_cg", "_cb", "_mn", "_cd", "_raw"]
    cr, cg, cb, mn, d, raw = (F.col(c) for c in tmp)
    return (df.withColumns({"_cr": r, "_cg": g, "_cb": b})
            .withColumns({v: F.greatest(cr, cg, cb), "_mn": F.least(cr, cg, cb)})
            .withColumn("_cd", F.col(v) - mn)
            .withColumn("_raw", (F.when(d <= 0, F.lit(0.0))
                                 .when(cr == F.col(v), (cg - cb) / d)
                                 .when(cg == F.col(v), F.lit(2.0) + (cb - cr) / d)
                                 .otherwise(F.lit(4.0) + (cr - cg) / d)) * F.lit(60.0))
            .withColumns({h: F.when(raw < 0, raw + F.lit(360.0)).otherwise(raw),
                          s: F.when(d > 0, d / F.col(v)).otherwise(F.lit(0.0))})
            .drop(*tmp))


def with_hsv_as_rgb(df: DataFrame, *, h="_h", s="_s", v="_v", out=RGB) -> DataFrame:
    """Write the 8-bit colour of HSV columns into `out` (staged like `with_hsv`)."""
    tmp = ["_hh", "_sec", "_fr", "_p", "_q", "_u"]
    hh, sec, fr, p, q, u = (F.col(c) for c in tmp)
    one, sat, val = F.lit(1.0), F.col(s), F.col(v)
    d = (df.withColumn("_hh", F.pmod(F.col(h), F.lit(360.0)) / F.lit(60.0))
         .withColumn("_sec", F.floor(hh)).withColumn("_fr", hh - sec)
         .withColumns({"_p": val * (one - sat), "_q": val * (one - sat * fr),
                       "_u": val * (one - sat * (one - fr))}))

    def pick(*six: Column) -> Column:
        e = F.when(sec < 1, six[0])
        for k in range(1, 5):
            e = e.when(sec < k + 1, six[k])
        return from_unit(e.otherwise(six[5]))

    return d.withColumns({out[0]: pick(val, q, p, p, u, val), out[1]: pick(u, val, val, q, p, p),
                          out[2]: pick(p, p, u, val, val, q)}).drop(*tmp)


def _xyz_curve(t: Column) -> Column:
    return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(
        t * F.lit(7.787) + F.lit(16.0 / 116.0))


def lab(r, g, b) -> dict[str, Column]:
    """8-bit sRGB to CIE Lab (D65)."""
    lr, lg, lb = (srgb_to_linear(unit(c)) * F.lit(100.0) for c in (r, g, b))
    x = _xyz_curve((lr * 0.4124 + lg * 0.3576 + lb * 0.1805) / F.lit(D65[0]))
    y = _xyz_curve((lr * 0.2126 + lg * 0.7152 + lb * 0.0722) / F.lit(D65[1]))
    z = _xyz_curve((lr * 0.0193 + lg * 0.1192 + lb * 0.9505) / F.lit(D65[2]))
    return {"l": F.lit(116.0) * y - F.lit(16.0),
            "a": F.lit(500.0) * (x - y),
            "b": F.lit(200.0) * (y - z)}


def lab_to_rgb(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    fy = (l + F.lit(16.0)) / F.lit(116.0)
    fx = a / F.lit(500.0) + fy
    fz = fy - b / F.lit(200.0)

    def inv(t: Column, white: float) -> Column:
        cube = t * t * t
        lin = F.when(cube > 0.008856, cube).otherwise(
            (t - F.lit(16.0 / 116.0)) / F.lit(7.787))
        return lin * F.lit(white / 100.0)

    x, y, z = inv(fx, D65[0]), inv(fy, D65[1]), inv(fz, D65[2])
    lin = (x * 3.2406 + y * -1.5372 + z * -0.4986,
           x * -0.9689 + y * 1.8758 + z * 0.0415,
           x * 0.0557 + y * -0.204 + z * 1.057)
    return tuple(u8(linear_to_srgb(c) * F.lit(255.0)) for c in lin)


def python_hsv(rgb) -> tuple[float, float, float]:
    r, g, b = (c / 255.0 for c in rgb[:3])
    mx, mn = max(r, g, b), min(r, g, b)
    d = mx - mn
    if d <= 0:
        return 0.0, 0.0, mx
    h = 60 * ((g - b) / d if r == mx else 2 + (b - r) / d if g == mx else 4 + (r - g) / d)
    return (h + 360 if h < 0 else h), d / mx, mx


def python_lab(rgb) -> tuple[float, float, float]:
    lin = []
    for c in rgb[:3]:
        s = c / 255.0
        lin.append(100 * (s / 12.92 if s <= 0.04045 else ((s + 0.055) / 1.055) ** 2.4))
    r, g, b = lin
    f = []
    for t in ((r * 0.4124 + g * 0.3576 + b * 0.1805) / D65[0],
              (r * 0.2126 + g * 0.7152 + b * 0.0722) / D65[1],
              (r * 0.0193 + g * 0.1192 + b * 0.9505) / D65[2]):
        f.append(t ** (1 / 3) if t > 0.008856 else t * 7.787 + 16 / 116)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def literal_features(c, algorithm: str) -> list[Column]:
    """Distance features of a constant colour."""
    vals = {"HSV": python_hsv, "LAB": python_lab}.get(algorithm, lambda v: v[:3])(c)
    return [F.lit(float(v)) for v in vals]


def with_features(df: DataFrame, algorithm: str, channels=RGB, prefix="_f") -> tuple[DataFrame, list[Column]]:
    """Add the columns `feature_distance` compares for an algorithm."""
    names = [f"{prefix}{k}" for k in range(3)]
    if algorithm == "HSV":
        df = with_hsv(df, *(unit(c) for c in channels), h=names[0], s=names[1], v=names[2])
    elif algorithm == "LAB":
        df = df.withColumns(dict(zip(names, lab(*channels).values())))
    else:
        df = df.withColumns({n: col(c).cast("double") for n, c in zip(names, channels)})
    return df, [F.col(n) for n in names]


def feature_distance(fa, fb, algorithm: str, *, hsv_legacy: bool = False) -> Column:
    d = [x - y for x, y in zip(fa, fb)]
    if algorithm == "HSV":
        dh = F.least(F.abs(d[0]), F.lit(360.0) - F.abs(d[0])) / F.lit(180.0)
        dv = d[2] / F.lit(255.0) if hsv_legacy else d[2]
        return dh * dh + d[1] * d[1] + dv * dv
    if algorithm == "RGB_APPROX":
        mean = (fa[0] + fb[0]) / F.lit(2.0)
        return ((F.lit(2.0) + mean / F.lit(256.0)) * d[0] * d[0]
                + F.lit(4.0) * d[1] * d[1]
                + (F.lit(2.0) + (F.lit(255.0) - mean) / F.lit(256.0)) * d[2] * d[2])
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def gradient(t: Column, stops) -> tuple[Column, Column, Column]:
    """Piecewise-linear colour ramp over evenly spaced stops, `t` in 0..1."""
    n = len(stops)
    pos = clamp(0, 1, t) * F.lit(float(n - 1))
    idx = F.floor(pos)
    frac = pos - idx
    out = []
    for k in range(3):
        e = None
        for i in range(n - 1):
            seg = F.lit(float(stops[i][k])) + F.lit(float(stops[i + 1][k] - stops[i][k])) * frac
            e = F.when(idx == i, seg) if e is None else e.when(idx == i, seg)
        out.append(e.otherwise(F.lit(float(stops[-1][k]))))
    return tuple(out)


def blend_unit(a: Column, b, mode: str) -> Column:
    """Blend two unit-range channels; the caller clamps."""
    b, one, two = num(b), F.lit(1.0), F.lit(2.0)
    multiply = two * a * b
    screen = one - two * (one - a) * (one - b)
    if mode == "MULTIPLY":
        return a * b
    if mode == "SCREEN":
        return one - (one - a) * (one - b)
    if mode == "OVERLAY":
        return F.when(a < 0.5, multiply).otherwise(screen)
    if mode == "SOFT_LIGHT":
        return F.when(b < 0.5, a - (one - two * b) * a * (one - a)).otherwise(
            a + (two * b - one) * (F.sqrt(a) - a))
    if mode == "HARD_LIGHT":
        return F.when(b < 0.5, multiply).otherwise(screen)
    if mode == "DIFFERENCE":
        return F.abs(a - b)
    if mode == "EXCLUSION":
        return a + b - two * a * b
    raise ValueError(f"unknown blend mode {mode!r}")
