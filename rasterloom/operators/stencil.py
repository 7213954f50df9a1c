"""Neighbourhood operators as one scatter and one hash aggregate.

Each source pixel is sent to the targets that read it (border pixels also stand
in for the clamped positions outside), then one aggregate per target combines
the taps.  With frames partitioned on `(clip_id, frame)` the aggregate needs no
exchange; otherwise the map-side combine folds the taps of a frame before the
shuffle.  Large separable kernels run as two one-dimensional passes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color as C

FRAME = ("clip_id", "frame")


def _reach(pos: str, n: int, r: int, border: str) -> Column:
    """Positions a source coordinate stands for, inside the padded frame."""
    p = F.col(pos)
    if r == 0 or border != "clamp":
        return F.array(p)
    low = F.when(p == 0, F.lit(-r)).otherwise(p)
    high = F.when(p == n - 1, F.lit(n - 1 + r)).otherwise(p)
    return F.sequence(low, high)


def taps(df: DataFrame, offsets: Sequence[tuple], *, width: int, height: int, border="clamp",
         keys=FRAME, fields: str = "") -> DataFrame:
    """One row per (target, tap): target `x, y`, tap fields, and the source's columns.

    `offsets` holds `(dx, dy, *fields)`; `fields` names the extra values, as in
    "w double, q int".  `border` is "clamp" or "skip" (outside taps are absent).
    """
    rx = max(abs(o[0]) for o in offsets)
    ry = max(abs(o[1]) for o in offsets)
    extra = [f.split() for f in fields.split(",")] if fields else []
    lits = F.array(*[F.struct(
        F.lit(int(o[0])).alias("dx"), F.lit(int(o[1])).alias("dy"),
        *[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(o[2:], extra)]) for o in offsets])
    d = df.withColumnsRenamed({"x": "_x", "y": "_y"})
    if rx and border == "clamp":
        d = d.withColumn("_x", F.explode(_reach("_x", width, rx, border)))
    if ry and border == "clamp":
        d = d.withColumn("_y", F.explode(_reach("_y", height, ry, border)))
    d = d.select("*", F.inline(lits))
    d = d.withColumns({"x": F.col("_x") - F.col("dx"), "y": F.col("_y") - F.col("dy")}).drop("_x", "_y")
    return d.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))


def own(c: str) -> Column:
    """The target's own value: the (0, 0) tap."""
    return F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col(c))).alias(c)


def stencil(df: DataFrame, offsets: Sequence[tuple], aggs: Sequence[Column], *, width: int,
            height: int, border="clamp", keys=FRAME, fields="") -> DataFrame:
    t = taps(df, offsets, width=width, height=height, border=border, keys=keys, fields=fields)
    return t.groupBy(*keys, "x", "y").agg(*aggs)


def square(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def disc(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx, dy in square(r) if dx * dx + dy * dy <= r * r]


def _order(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*FRAME, "x", "y", *cols)


# Kernels by name, row-major.
KERNELS = {
    "SHARPEN_3X3": [[0, -1, 0], [-1, 5, -1], [0, -1, 0]],
    "GAUSSIAN_3X3": [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]],
    "GAUSSIAN_3X3_WEAK": [[0.5 / 16, 1 / 16, 0.5 / 16], [1 / 16, 10 / 16, 1 / 16], [0.5 / 16, 1 / 16, 0.5 / 16]],
    "GAUSSIAN_5X5": [[1 / 256, 4 / 256, 6 / 256, 4 / 256, 1 / 256], [4 / 256, 16 / 256, 24 / 256, 16 / 256, 4 / 256],
                     [6 / 256, 24 / 256, 36 / 256, 24 / 256, 6 / 256], [4 / 256, 16 / 256, 24 / 256, 16 / 256, 4 / 256],
                     [1 / 256, 4 / 256, 6 / 256, 4 / 256, 1 / 256]],
    "UNSHARP_5X5": [[-1 / 256, -4 / 256, -6 / 256, -4 / 256, -1 / 256], [-4 / 256, -16 / 256, -24 / 256, -16 / 256, -4 / 256],
                    [-6 / 256, -24 / 256, 476 / 256, -24 / 256, -6 / 256], [-4 / 256, -16 / 256, -24 / 256, -16 / 256, -4 / 256],
                    [-1 / 256, -4 / 256, -6 / 256, -4 / 256, -1 / 256]],
    "EMBOSS_3X3": [[-2, -1, 0], [-1, 1, 1], [0, 1, 2]],
    "LAPLACIAN_3X3": [[1, 1, 1], [1, -8, 1], [1, 1, 1]],
    "LAPLACIAN_5X5": [[1, 1, 1, 1, 1], [1, 1, 1, 1, 1], [1, 1, -24, 1, 1], [1, 1, 1, 1, 1], [1, 1, 1, 1, 1]],
    "SOBEL_HORIZONTAL": [[-1, -2, -1], [0, 0, 0], [1, 2, 1]],
    "SOBEL_VERTICAL": [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]],
    "OUTLINE_3X3": [[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]],
    "BRIGHTEN_2X": [[2]],
    "BRIGHTEN_0_5X": [[0.5]],
}


def kernel_offsets(matrix, strength: float = 1.0) -> list[tuple[int, int, float]]:
    half = len(matrix) // 2
    out = [(kx - half, ky - half, v * strength) for ky, row in enumerate(matrix)
           for kx, v in enumerate(row) if v or (kx == half and ky == half)]
    return out


def convolve(df: DataFrame, *, width: int, height: int, kernel="GAUSSIAN_3X3", strength=1.0,
             linearize=False) -> DataFrame:
    m = KERNELS[kernel] if isinstance(kernel, str) else kernel
    src = df
    if linearize:
        src = df.withColumns({c: C.srgb_to_linear(C.unit(c)) for c in C.RGB})
    sums = [F.sum(F.col(c) * F.col("w")).alias(c) for c in C.RGB]
    d = stencil(src, kernel_offsets(m, strength), [*sums, own("a")], width=width, height=height,
                fields="w double")

    def shown(c: str) -> Column:
        if linearize:
            return C.u8_soft(C.linear_to_srgb(C.clamp(0, 1, F.col(c))) * 255.0)
        return C.u8_soft(F.col(c))
    return d.withColumns({c: shown(c) for c in C.RGB})


def gaussian_weights(sigma: float, radius: int | None = None) -> list[float]:
    r = math.ceil(sigma * 3) if radius is None else radius
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    s = sum(w)
    return [v / s for v in w]


def separable(df: DataFrame, weights: Sequence[float], cols: Sequence[str], *, width: int, height: int,
              keep: Sequence[str] = ()) -> DataFrame:
    """Two one-dimensional weighted passes over double columns."""
    r = len(weights) // 2
    for axis in (0, 1):
        offs = [((k, 0, w) if axis == 0 else (0, k, w)) for k, w in zip(range(-r, r + 1), weights)]
        sums = [F.sum(F.col(c) * F.col("w")).alias(c) for c in cols]
        df = stencil(df, offs, [*sums, *[own(c) for c in keep]], width=width, height=height,
                     fields="w double")
    return df


def gaussian_blur(df: DataFrame, *, width: int, height: int, sigma=3.0) -> DataFrame:
    d = separable(df, gaussian_weights(sigma), list(C.RGB), width=width, height=height, keep=["a"])
    return d.withColumns({c: C.u8_soft(F.col(c)) for c in C.RGB})


def blur_planes(df: DataFrame, *, width: int, height: int, sigma=1.0) -> DataFrame:
    """Float result of the separable blur, all four channels and the luma plane."""
    d = df.withColumn("luma", C.luma())
    return separable(d, gaussian_weights(sigma), ["r", "g", "b", "a", "luma"], width=width, height=height)


def box_sums(df: DataFrame, r: int, *, width: int, height: int, prefix: str, keep: Sequence[str]) -> DataFrame:
    """Exact integer box sums `prefix+c` over (2r+1)^2 clamped taps, in two passes."""
    names = [f"{prefix}{c}" for c in C.RGB]
    df = df.withColumns({n: F.col(c) for n, c in zip(names, C.RGB)})
    for axis in (0, 1):
        offs = [((k, 0) if axis == 0 else (0, k)) for k in range(-r, r + 1)]
        df = stencil(df, offs, [*[F.sum(n).alias(n) for n in names], *[own(c) for c in keep]],
                     width=width, height=height)
    return df


def sharpen(df: DataFrame, *, width: int, height: int, strength=1.5, radius=3, threshold=0.0) -> DataFrame:
    n = float((2 * radius + 1) ** 2)
    d = box_sums(df, radius, width=width, height=height, prefix="_s", keep=["r", "g", "b", "a"])
    d = d.withColumns({f"_d{c}": F.col(c) - F.col(f"_s{c}") / n for c in C.RGB})
    diff = F.abs("_dr") + F.abs("_dg") + F.abs("_db")
    d = d.withColumn("_diff", diff)
    return _order(d.withColumns({c: F.when(F.col("_diff") < threshold * 3.0, F.col(c)).otherwise(
        C.u8_soft(F.col(c) + F.col(f"_d{c}") * float(strength))) for c in C.RGB}), "r", "g", "b", "a")


def median_filter(df: DataFrame, *, width: int, height: int, radius=2) -> DataFrame:
    """Per-channel upper median over a disc; a bounded list per target."""
    offs = disc(radius)
    k = len(offs) // 2 + 1
    meds = [F.element_at(F.array_sort(F.collect_list(c)), k).alias(c) for c in C.RGB]
    return stencil(df, offs, [*meds, own("a")], width=width, height=height)


def _luma_key(sign: int, scan: Column) -> Column:
    """Exact luma, then first-in-scan order, then the colour, packed in one long."""
    lum = (F.col("r") * 2126 + F.col("g") * 7152 + F.col("b") * 722).cast("bigint")
    first = F.lit(511) - scan
    rank = lum if sign > 0 else F.lit(2_550_000) - lum
    rgb = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    return F.shiftleft(F.shiftleft(rank, 9) + first, 24) + rgb


def dilate_erode(df: DataFrame, *, width: int, height: int, mode="DILATE", radius=2) -> DataFrame:
    """Brightest (or darkest) pixel of a disc, first in scan order on a tie."""
    offs = [(dx, dy, i) for i, (dx, dy) in enumerate(disc(radius))]
    if len(offs) > 511:
        raise ValueError("radius too large")
    best = F.max(_luma_key(1 if mode == "DILATE" else -1, F.col("k"))).alias("_k")
    d = stencil(df, offs, [best, own("a")], width=width, height=height, fields="k int")
    low = F.col("_k").bitwiseAND(F.lit(0xFFFFFF))
    return _order(d.withColumns({"r": F.shiftright(low, 16).cast("int"),
                                 "g": F.shiftright(low, 8).bitwiseAND(F.lit(255)).cast("int"),
                                 "b": low.bitwiseAND(F.lit(255)).cast("int")}), "r", "g", "b", "a")


def _moments() -> list[Column]:
    return [F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{c}") for c in C.RGB],
            *[F.sum(F.col(c) * F.col(c)).alias(f"_q{c}") for c in C.RGB]]


def despeckle(df: DataFrame, *, width: int, height: int, threshold=15.0, radius=2) -> DataFrame:
    d = stencil(df, square(radius), [*_moments(), *[own(c) for c in ("r", "g", "b", "a")]],
                width=width, height=height)
    var = sum(((F.col(f"_q{c}") * F.col("_n") - F.col(f"_s{c}") * F.col(f"_s{c}")) for c in ("g", "b")),
              F.col("_qr") * F.col("_n") - F.col("_sr") * F.col("_sr")) / (F.col("_n") * F.col("_n")) / 3.0
    d = d.withColumn("_var", var)
    return _order(d.withColumns({c: F.when(F.col("_var") > threshold * threshold, C.jr(
        F.col(f"_s{c}") / F.col("_n"))).otherwise(F.col(c)) for c in C.RGB}), "r", "g", "b", "a")


def kuwahara(df: DataFrame, *, width: int, height: int, radius=3) -> DataFrame:
    """Mean of the least varied quadrant; outside taps are skipped."""
    offs = [(dx, dy, dx <= 0 and dy <= 0, dx >= 0 and dy <= 0, dx <= 0 and dy >= 0, dx >= 0 and dy >= 0)
            for dx, dy in square(radius)]
    aggs = []
    for k in range(4):
        on = F.col(f"q{k}")
        aggs.append(F.count_if(on).alias(f"n{k}"))
        for c in C.RGB:
            aggs.append(F.sum(F.when(on, F.col(c)).otherwise(0)).alias(f"s{k}{c}"))
            aggs.append(F.sum(F.when(on, F.col(c) * F.col(c)).otherwise(0)).alias(f"q{k}{c}"))
    d = stencil(df, offs, [*aggs, own("a")], width=width, height=height, border="skip",
                fields="q0 boolean, q1 boolean, q2 boolean, q3 boolean")

    def variance(k: int) -> Column:
        n = F.col(f"n{k}")
        tot = sum((F.col(f"q{k}{c}") * n - F.col(f"s{k}{c}") * F.col(f"s{k}{c}") for c in ("g", "b")),
                  F.col(f"q{k}r") * n - F.col(f"s{k}r") * F.col(f"s{k}r"))
        return tot / (n * n)
    d = d.withColumn("_b", F.least(*[F.struct(variance(k).alias("v"), F.lit(k).alias("k"))
                                     for k in range(4)])["k"])

    def mean(c: str) -> Column:
        e = F.when(F.col("_b") == 0, F.col(f"s0{c}") / F.col("n0"))
        for k in range(1, 4):
            e = e.when(F.col("_b") == k, F.col(f"s{k}{c}") / F.col(f"n{k}"))
        return C.jr(e)
    return _order(d.withColumns({c: mean(c) for c in C.RGB}), "r", "g", "b", "a")


def oil_painting(df: DataFrame, *, width: int, height: int, radius=4, levels=20) -> DataFrame:
    """Mean of the fullest luma bin around each pixel; the lowest bin wins a tie."""
    d = df.withColumn("_bin", F.least(F.lit(levels - 1), F.floor(C.luma_unit() * float(levels))).cast("int"))
    t = taps(d, square(radius), width=width, height=height)
    bins = t.groupBy(*FRAME, "x", "y", "_bin").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in C.RGB], own("a"))
    best = bins.groupBy(*FRAME, "x", "y").agg(
        F.max(F.struct("n", (-F.col("_bin")).alias("b"), "sr", "sg", "sb")).alias("m"), F.max("a").alias("a"))
    return _order(best.withColumns({c: C.jr(F.col(f"m.s{c}") / F.col("m.n")) for c in C.RGB}), "r", "g", "b", "a")


def bilateral_blur(df: DataFrame, *, width: int, height: int, sigmaSpatial=5.0, sigmaRange=30.0) -> DataFrame:
    """Spatial times range Gaussian weights; the target's colour meets a bounded tap list."""
    r = math.ceil(sigmaSpatial * 2)
    offs = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * sigmaSpatial ** 2))) for dx, dy in square(r)]
    d = stencil(df, offs, [F.collect_list(F.struct("w", "r", "g", "b")).alias("_t"),
                           *[own(c) for c in ("r", "g", "b", "a")]], width=width, height=height, fields="w double")

    def add(acc, t):
        dist = sum(((t[c] - F.col(c)) * (t[c] - F.col(c)) for c in ("g", "b")),
                   (t["r"] - F.col("r")) * (t["r"] - F.col("r")))
        w = t["w"] * F.exp(dist / (-2.0 * sigmaRange ** 2))
        return F.struct((acc["w"] + w).alias("w"), *[(acc[c] + w * t[c]).alias(c) for c in C.RGB])
    zero = F.struct(F.lit(0.0).alias("w"), *[F.lit(0.0).alias(c) for c in C.RGB])
    d = d.withColumn("_s", F.aggregate("_t", zero, add))
    return _order(d.withColumns({c: C.u8_soft(F.col(f"_s.{c}") / F.col("_s.w")) for c in C.RGB}),
                  "r", "g", "b", "a")


CROSS = [(0, 0), (0, -1), (0, 1), (-1, 0), (1, 0)]


def anisotropic_diffusion(df: DataFrame, *, width: int, height: int, iterations=10, kappa=30.0,
                          lam=0.2, conductance="EXP") -> DataFrame:
    """Perona-Malik smoothing; lineage is cut every five rounds."""
    from rasterloom.operators.lineage import cut_lineage
    d = df.withColumns({c: F.col(c).cast("double") for c in C.RGB})

    def at(c, dx, dy):
        return F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col(c)))
    for k in range(iterations):
        d = stencil(d, CROSS, [*[at(c, dx, dy).alias(f"_{c}{i}") for c in C.RGB for i, (dx, dy) in enumerate(CROSS)],
                               own("a")], width=width, height=height)

        def flow(c, i):
            g = F.col(f"_{c}{i}") - F.col(f"_{c}0")
            t = g / float(kappa)
            return (F.exp(-(t * t)) if conductance == "EXP" else F.lit(1.0) / (t * t + 1.0)) * g
        d = d.select(*FRAME, "x", "y", *[C.clamp(0, 255, F.col(f"_{c}0") + float(lam) * (
            flow(c, 1) + flow(c, 2) + flow(c, 3) + flow(c, 4))).alias(c) for c in C.RGB], "a")
        if k % 5 == 4 and k + 1 < iterations:
            d = cut_lineage(d)
    return d.withColumns({c: C.u8_soft(F.col(c)) for c in C.RGB})


def emboss(df: DataFrame, *, width: int, height: int, angle=135.0, strength=1.0, blend=0.0) -> DataFrame:
    ux, uy = math.cos(math.radians(angle)), -math.sin(math.radians(angle))
    offs = [(dx, dy, (dx * ux + dy * uy) * strength) for dx, dy in square(1)]
    rest = sum(o[2] for o in offs)
    offs = [(dx, dy, w - rest if (dx, dy) == (0, 0) else w) for dx, dy, w in offs]
    d = stencil(df, offs, [*[F.sum(F.col(c) * F.col("w")).alias(f"_e{c}") for c in C.RGB],
                           *[own(c) for c in ("r", "g", "b", "a")]], width=width, height=height, fields="w double")
    return _order(d.withColumns({c: C.u8_soft((F.col(f"_e{c}") + 128.0) * (1.0 - blend) + F.col(c) * blend)
                                 for c in C.RGB}), "r", "g", "b", "a")


SOBEL = [(dx, dy, gx, gy) for (dx, dy), gx, gy in zip(
    square(1), (-1, 0, 1, -2, 0, 2, -1, 0, 1), (-1, -2, -1, 0, 0, 0, 1, 2, 1))]


def sobel(df: DataFrame, *, width: int, height: int, keep: Sequence[str] = ()) -> DataFrame:
    """Luma gradients `gx, gy` (0..255 luma, clamped border)."""
    d = df.withColumn("_l", C.luma())
    return stencil(d, SOBEL, [F.sum(F.col("_l") * F.col("wx")).alias("gx"), F.sum(F.col("_l") * F.col("wy")).alias("gy"),
                              *[own(c) for c in keep]], width=width, height=height, fields="wx int, wy int")


def _interior(width: int, height: int) -> Column:
    return F.col("x").between(1, width - 2) & F.col("y").between(1, height - 2)


def luminance_sobel(df: DataFrame, *, width: int, height: int) -> DataFrame:
    """Luma, gradient magnitude and direction; zero on the border."""
    d = sobel(df.withColumn("luma", C.luma()), width=width, height=height, keep=["luma"])
    inside = _interior(width, height)
    return d.select(*FRAME, "x", "y", "luma",
                    F.when(inside, F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).otherwise(0.0).alias("magnitude"),
                    F.when(inside, F.atan2("gy", "gx")).otherwise(0.0).alias("direction"))


def edge_trace(df: DataFrame, *, width: int, height: int, threshold=30.0, lineWidth=1.0, lineColor=(0, 0, 0),
               renderMode="SOLID", overlayMix=0.7, bgColor=(255, 255, 255)) -> DataFrame:
    """Sobel, non-maximum suppression, then a line drawn at the kept pixels."""
    g = sobel(df, width=width, height=height, keep=["r", "g", "b", "a"])
    g = g.withColumn("mag", F.round(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), 6))
    deg = F.degrees(F.atan2("gy", "gx"))
    g = g.withColumn("_deg", F.when(deg < 0, deg + 180.0).otherwise(deg))
    sector = (F.when((F.col("_deg") < 22.5) | (F.col("_deg") >= 157.5), 0).when(F.col("_deg") < 67.5, 1)
              .when(F.col("_deg") < 112.5, 2).otherwise(3))
    pair = {(0, -1): 0, (0, 1): 0, (1, -1): 1, (-1, 1): 1, (-1, 0): 2, (1, 0): 2, (-1, -1): 3, (1, 1): 3, (0, 0): -1}
    offs = [(dx, dy, s) for (dx, dy), s in pair.items()]
    g = g.withColumn("_sec", sector)
    side = [F.max(F.when(F.col("s") == k, F.col("mag"))).alias(f"_m{k}") for k in range(4)]
    e = stencil(g, offs, [*side, *[own(c) for c in ("r", "g", "b", "a", "mag", "_sec")]],
                width=width, height=height, fields="s int")
    beside = F.when(F.col("_sec") == 0, F.col("_m0"))
    for k in range(1, 4):
        beside = beside.when(F.col("_sec") == k, F.col(f"_m{k}"))
    hit = _interior(width, height) & (F.col("mag") >= float(threshold)) & (F.col("mag") >= beside)
    e = e.withColumn("_edge", F.coalesce(hit, F.lit(False)).cast("int"))
    if lineWidth > 1:   # neighbours within reach are drawn too
        reach = (lineWidth - 1) / 2 + 0.35
        offs = [o for o in square(1) if math.hypot(*o) <= reach]
        e = stencil(e, offs, [F.max("_edge").alias("_edge"), *[own(c) for c in ("r", "g", "b", "a")]],
                    width=width, height=height, border="skip")
    alpha = min(1.0, max(0.1, lineWidth))

    def one(c, line, bg):
        base = F.col(c) if renderMode == "OVERLAY" else F.lit(int(bg))
        m = min(1.0, overlayMix * alpha) if renderMode == "OVERLAY" else alpha
        return F.when(F.col("_edge") == 1, C.u8_soft(base + (F.lit(float(line)) - base) * m)).otherwise(base)
    return _order(e.withColumns({c: one(c, li, bg) for c, li, bg in zip(C.RGB, lineColor, bgColor)}), "r", "g", "b", "a")


def contour_lines(df: DataFrame, *, width: int, height: int, levels=10, lineWidth=1.0, lineColor=(0, 0, 0),
                  fillMode="BOTH") -> DataFrame:
    """A line where the luma band differs within reach."""
    reach = max(0.0, (lineWidth - 1) / 2) + 1.0 if lineWidth >= 1 else 1.0
    r = math.ceil(reach)
    offs = [o for o in square(r) if math.hypot(*o) <= reach]
    d = df.withColumn("_b", F.least(F.lit(levels - 1), F.floor(C.luma_unit() * float(levels))).cast("int"))
    d = stencil(d, offs, [F.min("_b").alias("_lo"), F.max("_b").alias("_hi"), *[own(c) for c in ("r", "g", "b", "a", "_b")]],
                width=width, height=height)
    edge = F.col("_lo") != F.col("_hi")
    t = (F.col("_b") + 0.5) / float(levels)
    tone = t + (F.lit(1.0) - t) * 0.3
    alpha = min(1.0, max(0.1, lineWidth))

    def one(c, line):
        fill = F.col(c) * tone if fillMode != "LINES" else F.lit(255.0)
        drawn = fill + (F.lit(float(line)) - fill) * alpha
        return C.u8_soft(F.when(edge, drawn).otherwise(fill) if fillMode != "FILL" else fill)
    return _order(d.withColumns({c: one(c, li) for c, li in zip(C.RGB, lineColor)}), "r", "g", "b", "a")


def frequency_filter(df: DataFrame, *, width: int, height: int, mode="HIGH", radius=6, bandWidth=6,
                     gain=1.5) -> DataFrame:
    """Low, high or band pass as differences of box blurs."""
    keep = ["r", "g", "b", "a"]
    n = float((2 * radius + 1) ** 2)
    d = box_sums(df, radius, width=width, height=height, prefix="_p", keep=keep)
    if mode == "BAND":
        wide = radius + bandWidth
        m = float((2 * wide + 1) ** 2)
        d = box_sums(d, wide, width=width, height=height, prefix="_w", keep=[*keep, "_pr", "_pg", "_pb"])

    def one(c):
        low = F.col(f"_p{c}") / n
        if mode == "LOW":
            return C.u8_soft(low)
        ref = F.col(c) - low if mode == "HIGH" else low - F.col(f"_w{c}") / m
        return C.u8_soft(F.lit(128.0) + ref * float(gain))
    return _order(d.withColumns({c: one(c) for c in C.RGB}), "r", "g", "b", "a")


def relief_map(df: DataFrame, *, width: int, height: int, lightAngle=135.0, height_scale=2.0, specular=0.25,
               baseColorMode="ORIGINAL", tintColor=(196, 186, 170)) -> DataFrame:
    """Luma as a height field, lit from one side."""
    d = df.withColumn("_l", C.luma_unit())
    at = {n: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("_l"))).alias(n)
          for n, (dx, dy) in {"_u": (0, -1), "_d": (0, 1), "_w": (-1, 0), "_e": (1, 0)}.items()}
    d = stencil(d, CROSS, [*at.values(), *[own(c) for c in ("r", "g", "b", "a", "_l")]], width=width, height=height)
    d = d.withColumns({"_dx": (F.col("_e") - F.col("_w")) * float(height_scale),
                       "_dy": (F.col("_d") - F.col("_u")) * float(height_scale)})
    norm = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + 1.0)
    lx, ly = math.cos(math.radians(lightAngle)), -math.sin(math.radians(lightAngle))
    d = d.withColumn("_diffuse", F.greatest(F.lit(0.0), (
        F.col("_dx") * -lx + F.col("_dy") * -ly + 0.85) / norm))
    shine = F.pow("_diffuse", F.lit(18.0)) * float(specular) * 255.0

    def one(c, tint):
        base = {"ORIGINAL": F.col(c).cast("double"), "GRAYSCALE": F.col("_l") * 255.0,
                "TINT": C.clamp(0, 255, F.lit(float(tint)) * (F.col("_l") * 0.8 + 0.45))}[baseColorMode]
        return C.u8_soft(base * (F.col("_diffuse") * 0.9 + 0.35) + shine)
    return _order(d.withColumns({c: one(c, t) for c, t in zip(C.RGB, tintColor)}), "r", "g", "b", "a")
