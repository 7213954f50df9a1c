"""Coordinate remaps: compute a source position per pixel, then gather by equi-join.

The join key is `(clip_id, frame, x, y)` on both sides, so it spreads evenly
however large one clip is; a bilinear read explodes its (at most four) taps and
sums them back in one aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.operators.ordered import shuffled_join

FRAME = ("clip_id", "frame")
RGBA = ("r", "g", "b", "a")


def _source(df: DataFrame) -> DataFrame:
    return df.select(*FRAME, F.col("x").alias("_sx"), F.col("y").alias("_sy"),
                     *[F.col(c).alias(f"_{c}") for c in RGBA])


def gather(df: DataFrame, sx: Column, sy: Column, *, width: int, height: int, border="clamp",
           fill=(0, 0, 0, 255), inside: Column | None = None) -> DataFrame:
    """Nearest sampling at integer source positions.

    `border`: "clamp", "wrap", or "fill" (outside, or `inside` false, shows `fill`).
    """
    sx, sy = sx.cast("int"), sy.cast("int")
    if border == "wrap":
        sx, sy = F.pmod(sx, F.lit(width)), F.pmod(sy, F.lit(height))
    elif border == "clamp":
        sx = F.least(F.lit(width - 1), F.greatest(F.lit(0), sx))
        sy = F.least(F.lit(height - 1), F.greatest(F.lit(0), sy))
    ok = sx.between(0, width - 1) & sy.between(0, height - 1)
    if inside is not None:
        ok = ok & inside
    d = df.select(*FRAME, "x", "y", F.when(ok, sx).alias("_sx"), F.when(ok, sy).alias("_sy"))
    j = shuffled_join(d, _source(df), [*FRAME, "_sx", "_sy"], "left")
    return j.select(*FRAME, "x", "y", *[F.coalesce(F.col(f"_{c}"), F.lit(int(v))).alias(c)
                                        for c, v in zip(RGBA, fill)])


def gather_bilinear(df: DataFrame, sx: Column, sy: Column, *, width: int, height: int,
                    fill=(0, 0, 0, 255), inside: Column | None = None) -> DataFrame:
    """Bilinear sampling with clamped taps; pixels where `inside` is false show `fill`."""
    d = df.select(*FRAME, "x", "y", sx.alias("_fx"), sy.alias("_fy"),
                  (inside if inside is not None else F.lit(True)).alias("_in"))
    d = d.withColumns({"_x0": F.floor("_fx"), "_y0": F.floor("_fy")})
    d = d.withColumns({"_tx": F.col("_fx") - F.col("_x0"), "_ty": F.col("_fy") - F.col("_y0")})

    def at(base: str, k: int, n: int) -> Column:
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.col(base) + k)).cast("int")
    corners = F.array(*[F.struct(
        at("_x0", i, width).alias("_sx"), at("_y0", j, height).alias("_sy"),
        ((F.col("_tx") if i else F.lit(1.0) - F.col("_tx"))
         * (F.col("_ty") if j else F.lit(1.0) - F.col("_ty"))).alias("w")) for j in (0, 1) for i in (0, 1)])
    # zero-weight corners are not needed; an outside pixel keeps one empty tap
    tap = F.when(F.col("_in"), F.filter(corners, lambda t: t["w"] > 0))
    t = d.select(*FRAME, "x", "y", F.inline_outer(tap))
    j = shuffled_join(t, _source(df), [*FRAME, "_sx", "_sy"], "left")
    s = j.groupBy(*FRAME, "x", "y").agg(*[F.sum(F.col(f"_{c}") * F.col("w")).alias(c) for c in RGBA])
    return s.withColumns({c: F.coalesce(C.jr(F.col(c) + 1e-9), F.lit(int(v))) for c, v in zip(RGBA, fill)})


def flip(df: DataFrame, *, width: int, height: int, mode="HORIZONTAL") -> DataFrame:
    """Rename coordinates only; no join."""
    cols = {}
    if mode in ("HORIZONTAL", "BOTH"):
        cols["x"] = F.lit(width - 1) - F.col("x")
    if mode in ("VERTICAL", "BOTH"):
        cols["y"] = F.lit(height - 1) - F.col("y")
    return df.withColumns(cols)


def rotate(df: DataFrame, *, width: int, height: int, angle=15.0, spinPerFrame=0.0,
           bgColor=(0, 0, 0)) -> DataFrame:
    """Inverse rotation about the centre, bilinear, background outside."""
    rad = F.radians(-(F.lit(float(angle)) + F.col("frame") * float(spinPerFrame)))
    cx, cy = width * 0.5, height * 0.5
    dx, dy = F.col("x") - cx, F.col("y") - cy
    sx = F.round(dx * F.cos(rad) - dy * F.sin(rad) + cx, 9)
    sy = F.round(dx * F.sin(rad) + dy * F.cos(rad) + cy, 9)
    inside = (sx >= 0) & (sx < width - 1) & (sy >= 0) & (sy < height - 1)
    return gather_bilinear(df, sx, sy, width=width, height=height, fill=(*bgColor, 255), inside=inside)


def stretch(df: DataFrame, *, width: int, height: int, scaleX=1.5, scaleY=1.0, centerX=0.5,
            centerY=0.5) -> DataFrame:
    cx, cy = width * centerX, height * centerY
    sx = (F.col("x") - cx) * (1.0 / scaleX) + cx
    sy = (F.col("y") - cy) * (1.0 / scaleY) + cy
    inside = (sx >= 0) & (sx < width) & (sy >= 0) & (sy < height)
    return gather_bilinear(df, sx, sy, width=width, height=height, inside=inside)


def lens_distortion(df: DataFrame, *, width: int, height: int, k1=0.3, k2=0.0, zoom=1.0) -> DataFrame:
    """Radial model; the source radius is found by eight Newton steps."""
    cx, cy = width * 0.5, height * 0.5
    norm = 1.0 / max(cx, cy)
    d = df.withColumns({"_dx": (F.col("x") - cx) * norm / float(zoom), "_dy": (F.col("y") - cy) * norm / float(zoom)})
    d = d.withColumn("_rd", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))

    def newton(r: Column, _: Column) -> Column:
        f = r * (r * r * float(k1) + r * r * r * r * float(k2) + 1.0) - F.col("_rd")
        fp = r * r * (3.0 * k1) + r * r * r * r * (5.0 * k2) + 1.0
        return F.when(fp == 0, r).otherwise(r - f / F.nullif(fp, F.lit(0.0)))
    # a fold, not eight stacked projections: the plan stays small
    d = d.withColumn("_r", F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.col("_rd"), newton))
    d = d.withColumn("_k", F.when(F.col("_rd") > 0, F.col("_r") / F.nullif(F.col("_rd"), F.lit(0.0))).otherwise(1.0))
    sx = F.round(F.col("_dx") * F.col("_k") / norm + cx, 9)
    sy = F.round(F.col("_dy") * F.col("_k") / norm + cy, 9)
    inside = (sx >= 0) & (sx <= width - 1) & (sy >= 0) & (sy <= height - 1)
    return gather(d, F.floor(sx), F.floor(sy), width=width, height=height, border="fill", inside=inside)


TAU = 6.28318530718


def polar_transform(df: DataFrame, *, width: int, height: int, mode="RECT_TO_POLAR", centerX=0.5,
                    centerY=0.5, angle=0.0, interpolation="BILINEAR") -> DataFrame:
    cx, cy = width * centerX, height * centerY
    off = math.radians(angle)
    rmax = max(1.0, min(width, height) * 0.5)
    inside = None
    if mode == "RECT_TO_POLAR":
        dx, dy = F.col("x") - cx, F.col("y") - cy
        radius = F.sqrt(dx * dx + dy * dy)
        theta = F.atan2(dy, dx) - off
        theta = F.when(theta < 0, theta + TAU).otherwise(theta)
        sx, sy = theta / TAU * (width - 1.0), radius / rmax * (height - 1.0)
        inside = radius <= rmax
    else:
        theta = F.col("x") / max(1.0, width - 1.0) * TAU + off
        radius = F.col("y") / max(1.0, height - 1.0) * rmax
        sx, sy = F.cos(theta) * radius + cx, F.sin(theta) * radius + cy
    sx, sy = F.round(sx, 9), F.round(sy, 9)
    if interpolation == "NEAREST":
        return gather(df, F.floor(sx + 0.5), F.floor(sy + 0.5), width=width, height=height,
                      border="fill" if inside is not None else "clamp", inside=inside)
    return gather_bilinear(df, sx, sy, width=width, height=height, inside=inside)


def mirror(df: DataFrame, *, width: int, height: int, mode="KALEIDOSCOPE", segments=6, offsetX=0.0,
           offsetY=0.0) -> DataFrame:
    """Fold across an axis, or fold the angle into one slice."""
    cx, cy = width * (0.5 + offsetX * 0.5), height * (0.5 + offsetY * 0.5)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    if mode == "KALEIDOSCOPE":
        dx, dy = x - cx, y - cy
        piece = TAU / segments
        a = F.round(F.pmod(F.atan2(dy, dx), F.lit(piece)), 12)
        a = F.when(a > piece * 0.5, F.lit(piece) - a).otherwise(a)
        dist = F.sqrt(dx * dx + dy * dy)
        sx, sy = F.round(F.cos(a) * dist + cx, 9), F.round(F.sin(a) * dist + cy, 9)
    else:
        sx = F.when(x > cx, F.lit(2.0 * cx) - x).otherwise(x) if mode in ("HORIZONTAL", "BOTH") else x
        sy = F.when(y > cy, F.lit(2.0 * cy) - y).otherwise(y) if mode in ("VERTICAL", "BOTH") else y
    return gather(df, F.floor(sx + 0.5), F.floor(sy + 0.5), width=width, height=height)


def displacement_map_xy(df: DataFrame, *, width: int, height: int, strength=30.0, blurRadius=0,
                        channelX="R", channelY="G") -> DataFrame:
    """Two (optionally box-blurred) channels act as x and y displacement."""
    d = df
    names = {c: c for c in C.RGB}
    n = 1.0
    if blurRadius:
        from rasterloom.operators.stencil import box_sums
        d = box_sums(df, blurRadius, width=width, height=height, prefix="_m", keep=list(RGBA))
        names, n = {c: f"_m{c}" for c in C.RGB}, float((2 * blurRadius + 1) ** 2)

    def shift(ch: str) -> Column:
        return (F.col(names[ch.lower()]) / n / 255.0 - 0.5) * float(strength) * 2.0
    return gather_bilinear(d, F.round(F.col("x") + shift(channelX), 9), F.round(F.col("y") + shift(channelY), 9),
                           width=width, height=height)


def channel_separation(df: DataFrame, *, width: int, height: int, r=(10, 0, 1.0), g=(0, 5, 1.0),
                       b=(8, 4, 1.0), a=(0, 0, 1.0)) -> DataFrame:
    """Each channel shifted and faded on its own; outside reads as zero.

    A scatter: every source pixel sends one channel to the target it serves,
    and one aggregate puts the channels back together.
    """
    specs = dict(zip(RGBA, (r, g, b, a)))
    parts = F.array(*[F.struct((F.col("x") - ox).alias("x"), (F.col("y") - oy).alias("y"),
                               *[(F.col(c) * float(op) if k == c else F.lit(0.0)).alias(k) for k in RGBA])
                      for c, (ox, oy, op) in specs.items()])
    here = F.array(F.struct(F.col("x"), F.col("y"), *[F.lit(0.0).alias(k) for k in RGBA]))
    t = df.select(*FRAME, F.inline(F.concat(parts, here)))
    t = t.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    s = t.groupBy(*FRAME, "x", "y").agg(*[F.sum(k).alias(k) for k in RGBA])
    return s.withColumns({k: C.u8(F.col(k)) for k in RGBA})


def region_join(df: DataFrame, regions: list[tuple], *, width: int, height: int) -> DataFrame:
    """Pixels inside a rectangle show another place; the last matching rectangle wins.

    `regions` holds `(dst_x, dst_y, w, h, src_x, src_y, shift)`.  The list is a
    parameter (at most 256 entries), so matching is a projection; the content
    then comes from one gather.
    """
    if len(regions) > 256:
        raise ValueError("at most 256 regions")
    sx, sy, shift = F.col("x"), F.col("y"), F.lit(0)
    label = F.lit(-1)
    for k, (dx, dy, w, h, ox, oy, off) in enumerate(regions):
        hit = F.col("x").between(dx, dx + w - 1) & F.col("y").between(dy, dy + h - 1)
        sx = F.when(hit, F.col("x") - dx + ox).otherwise(sx)
        sy = F.when(hit, F.col("y") - dy + oy).otherwise(sy)
        shift = F.when(hit, F.lit(int(off))).otherwise(shift)
        label = F.when(hit, F.lit(k)).otherwise(label)
    d = gather(df, sx, sy, width=width, height=height).withColumns({"region": label, "_o": shift})
    return d.withColumns({c: F.least(F.lit(255), F.greatest(F.lit(0), F.col(c) + F.col("_o"))) for c in C.RGB}).drop("_o")


def register_frames(df: DataFrame, moves: DataFrame, *, width: int, height: int) -> DataFrame:
    """Per-frame shift, rotation and zoom from a motion table `(clip_id, frame, ox, oy, rot, zoom)`.

    Frames without an entry stay as they are.  Both sides hash on
    `(clip_id, frame)`; the table has one row per frame.
    """
    d = df.join(moves, list(FRAME), "left")
    cx, cy = (width - 1) * 0.5, (height - 1) * 0.5
    z = F.greatest(F.lit(0.75), F.coalesce("zoom", F.lit(1.0)))
    rot = F.coalesce("rot", F.lit(0.0))
    dx, dy = (F.col("x") - cx) / z, (F.col("y") - cy) / z
    sx = F.round(dx * F.cos(rot) - dy * F.sin(rot) + cx + F.coalesce("ox", F.lit(0.0)), 9)
    sy = F.round(dx * F.sin(rot) + dy * F.cos(rot) + cy + F.coalesce("oy", F.lit(0.0)), 9)
    return gather(d, F.floor(sx + 0.5), F.floor(sy + 0.5), width=width, height=height)


def sample(df: DataFrame, sx: Column, sy: Column, *, width: int, height: int, mode="BILINEAR") -> DataFrame:
    """Border-clamped lookup at fractional positions."""
    cx, cy = C.clamp(0, width - 1, sx), C.clamp(0, height - 1, sy)
    if mode == "NEAREST":
        return gather(df, F.floor(cx + 0.5), F.floor(cy + 0.5), width=width, height=height)
    return gather_bilinear(df, cx, cy, width=width, height=height)
