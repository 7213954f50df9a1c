"""Frequency-domain operators.

A transform works on lines: the samples of a row are one array, log n butterfly passes turn it
into its spectrum, and after one regrouping the columns follow in the same way.  A task holds
lines, never a frame, so frames of any size take the same path; with frames partitioned on
`(clip_id, frame)` the groupings need no exchange.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.operators.ordered import shuffled_join

FRAME = ("clip_id", "frame")


def padded(n: int) -> int:
    """Next power of two."""
    p = 1
    while p < n:
        p *= 2
    return p


def padding_size(c: Column) -> Column:
    """Next power of two of a column; logarithms of powers of two are exact."""
    return F.pow(F.lit(2.0), F.ceil(F.round(F.log2(c), 9))).cast("int")


def _table(values) -> Column:
    return F.expr("array(" + ",".join(f"{float(v)!r}D" for v in values) + ")")


def _butterflies(line: Column, n: int, sign: int) -> Column:
    """Transform of an array of n (re, im), a power of two, without scaling: sum of value * exp(sign * i * 2 pi * j * k / n).

    Each pass halves the transforms and doubles their stride: sums and turned differences of both
    halves, interleaved by the stride, so the order comes out right by itself.
    """
    if n == 1:
        return line
    ang = [2 * math.pi * k / n for k in range(n // 2)]
    cos, sin = _table(map(math.cos, ang)), _table(sign * math.sin(a) for a in ang)
    strides = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1)])

    def one(z: Column, m: Column, o: Column) -> Column:
        at = F.floor(o / (m * 2)).cast("int") * m   # of the turn; the pair lies at + o mod m and half a line further
        x, y = F.get(z, at + F.pmod(o, m)), F.get(z, at + F.pmod(o, m) + n // 2)
        re, im, c, s = x["re"] - y["re"], x["im"] - y["im"], F.get(cos, at), F.get(sin, at)
        return F.when(F.pmod(o, m * 2) < m, F.struct((x["re"] + y["re"]).alias("re"), (x["im"] + y["im"]).alias("im"))).otherwise(
            F.struct((re * c - im * s).alias("re"), (re * s + im * c).alias("im")))
    places = F.sequence(F.lit(0), F.lit(n - 1))
    return F.aggregate(strides, line, lambda z, m: F.transform(places, lambda o: one(z, m, o)))


def _lines(df: DataFrame, src: str, out: str, n: int, keep: list[str], sign: int) -> DataFrame:
    """One axis: `(keep, src, re, im)` to `(keep, out, re, im)`, missing samples being zero."""
    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    lines = df.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct(F.col(src).cast("int").alias("i"), F.struct("re", "im").alias("z")))).alias("_l"))
    values = F.transform("_l", lambda x: x["z"])
    holes = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(F.filter("_l", lambda x: x["i"] == i), F.lit(0))["z"], zero))
    ends_early = F.element_at("_l", -1)["i"] == F.size("_l") - 1   # what is missing is the padding
    full = F.when(ends_early, F.concat(values, F.array_repeat(zero, (n - F.size("_l")).cast("int")))).otherwise(holes)
    return lines.select(*keep, F.posexplode(_butterflies(full, n, sign)).alias(out, "_v")).select(*keep, out, "_v.re", "_v.im")


def forward(plane: DataFrame, *, width: int, height: int, value: str = "v") -> DataFrame:
    """`(clip_id, frame, x, y, value)` to `(clip_id, frame, kx, ky, re, im)`, zero-padded."""
    w, h = padded(width), padded(height)
    d = plane.select(*FRAME, "x", "y", F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
    d = _lines(d, "x", "kx", w, [*FRAME, "y"], -1)
    return _lines(d, "y", "ky", h, [*FRAME, "kx"], -1)


def inverse(spec: DataFrame, *, width: int, height: int) -> DataFrame:
    """Back to `(clip_id, frame, x, y, re, im)` with 1/N, cropped to the source size."""
    w, h = padded(width), padded(height)
    d = _lines(spec, "kx", "x", w, [*FRAME, "ky"], 1).where(F.col("x") < width)
    d = _lines(d, "ky", "y", h, [*FRAME, "x"], 1)
    n = float(w * h)
    return d.where(F.col("y") < height).withColumns({"re": F.col("re") / n, "im": F.col("im") / n})


def luma_plane(df: DataFrame) -> DataFrame:
    return df.select(*FRAME, "x", "y", C.luma_unit().alias("v"))


def luma_spectrum(df: DataFrame, *, width: int, height: int) -> DataFrame:
    return forward(luma_plane(df), width=width, height=height)


def snapped(c: str) -> Column:
    """Drop last-bit noise and negative zero, so phases are repeatable."""
    return F.round(F.col(c), 9) + F.lit(0.0)


def magnitude() -> Column:
    return F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def phase() -> Column:
    return F.atan2(snapped("im"), snapped("re"))


def signed(k: str, n: int) -> Column:
    return F.when(F.col(k) > n // 2, F.col(k) - n).otherwise(F.col(k))


def radius(w: int, h: int) -> Column:
    """0 at DC, 1 at the corner of the spectrum."""
    fx = F.least(F.col("kx"), F.lit(w) - F.col("kx")) / (w * 0.5)
    fy = F.least(F.col("ky"), F.lit(h) - F.col("ky")) / (h * 0.5)
    return F.sqrt(fx * fx + fy * fy) / math.sqrt(2.0)


def relight(df: DataFrame, out_luma: DataFrame) -> DataFrame:
    """Scale each colour so that its luma becomes `v` of the joined plane."""
    d = shuffled_join(df, out_luma.select(*FRAME, "x", "y", F.col("re").alias("_o")), [*FRAME, "x", "y"])
    d = d.withColumn("_l", C.luma_unit())
    k = F.when(F.col("_l") > 1e-4, F.col("_o") / F.col("_l")).otherwise(F.col("_o"))
    return d.withColumn("_k", k).select(*FRAME, "x", "y", *[
        C.u8_soft(F.col(c) * F.col("_k")).alias(c) for c in C.RGB], "a")


def masked(df: DataFrame, gain: Column, *, width: int, height: int) -> DataFrame:
    """Multiply the luma spectrum by a real mask and rebuild the frames."""
    s = luma_spectrum(df, width=width, height=height).withColumn("_g", gain)
    s = s.withColumns({"re": F.col("re") * F.col("_g"), "im": F.col("im") * F.col("_g")}).drop("_g")
    return relight(df, inverse(s, width=width, height=height))


def fft_bandpass(df: DataFrame, *, width: int, height: int, mode="HIGH", cutoff=0.15, bandWidth=0.15,
                 softness=0.1, gain=1.0) -> DataFrame:
    r = radius(padded(width), padded(height))
    s = max(softness, 0.001) * 0.5
    rise = C.smoothstep(cutoff - s, cutoff + s, r)
    if mode == "LOW":
        m = F.lit(1.0) - rise
    elif mode == "HIGH":
        m = rise
    else:
        top = cutoff + bandWidth
        m = rise * (F.lit(1.0) - C.smoothstep(top - s, top + s, r))
    return masked(df, m * float(gain), width=width, height=height)


def fft_radial_notch(df: DataFrame, *, width: int, height: int, ring=0.3, ring_width=0.06, depth=0.0) -> DataFrame:
    r, hw = radius(padded(width), padded(height)), ring_width * 0.5
    inside = C.smoothstep(ring - hw, ring, r) * (F.lit(1.0) - C.smoothstep(ring, ring + hw, r))
    return masked(df, F.lit(1.0) - inside * (1.0 - depth), width=width, height=height)


def fft_angular_wedge(df: DataFrame, *, width: int, height: int, angle=0.0, wedge=20.0, softness=5.0,
                      invert=False, gain=1.0) -> DataFrame:
    w, h = padded(width), padded(height)
    kx, ky = signed("kx", w), signed("ky", h)
    away = F.pmod(F.degrees(F.atan2(ky.cast("double"), kx.cast("double"))) - float(angle), F.lit(180.0))
    away = F.round(F.least(away, F.lit(180.0) - away), 9)
    m = F.lit(1.0) - C.smoothstep(wedge - softness * 0.5, wedge + softness * 0.5, away)
    m = (F.lit(1.0) - m if invert else m) * float(gain)
    dc = (F.col("kx") == 0) & (F.col("ky") == 0)
    return masked(df, F.when(dc, F.lit(1.0)).otherwise(m), width=width, height=height)


def fft_spectral_gate(df: DataFrame, *, width: int, height: int, threshold=0.02, softness=0.005) -> DataFrame:
    """Keep bins that are strong relative to their frame's DC."""
    s = luma_spectrum(df, width=width, height=height)
    dc = s.where("kx = 0 and ky = 0").select(*FRAME, magnitude().alias("_dc"))
    s = shuffled_join(s, dc, list(FRAME))
    rel = magnitude() / F.greatest(F.col("_dc"), F.lit(1e-6))
    keep = C.smoothstep(threshold - softness * 0.5, threshold + softness * 0.5, rel)
    s = s.withColumn("_g", F.when((F.col("kx") == 0) & (F.col("ky") == 0), F.lit(1.0)).otherwise(keep))
    s = s.withColumns({"re": F.col("re") * F.col("_g"), "im": F.col("im") * F.col("_g")})
    return relight(df, inverse(s, width=width, height=height))


def fft_radial_profile(df: DataFrame, *, width: int, height: int, logScale=True) -> DataFrame:
    """Mean power by whole-number radius."""
    w, h = padded(width), padded(height)
    kx, ky = signed("kx", w), signed("ky", h)
    s = luma_spectrum(df, width=width, height=height)
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    out = s.groupBy(*FRAME, C.jr(F.sqrt((kx * kx + ky * ky).cast("double"))).alias("radius")).agg(
        F.count("*").alias("n"), F.avg(power).alias("power"))
    if logScale:
        level = C.clamp(0, 1, F.log1p("power") / math.log(1 + 1e5))
    else:
        level = C.clamp(0, 1, F.col("power") / 1e4)
    return out.withColumn("level", level)


def _plot(df: DataFrame, value: dict[str, Column], *, width: int, height: int, centred: bool) -> DataFrame:
    w, h = padded(width), padded(height)
    s = luma_spectrum(df, width=width, height=height)
    pos = {"kx": F.pmod(F.col("kx") + w // 2, F.lit(w)), "ky": F.pmod(F.col("ky") + h // 2, F.lit(h))} if centred else {}
    return s.select(*FRAME, *[pos.get(k, F.col(k)).cast("int").alias(k) for k in ("kx", "ky")],
                    *[(e + F.lit(0.0)).alias(n) for n, e in value.items()])


def log_level(m: Column, scale: float) -> Column:
    return F.log(m * float(scale) + 1.0) / math.log(1.0 + scale)


def fft_magnitude_plot(df: DataFrame, *, width: int, height: int, scale=1000.0, centred=True) -> DataFrame:
    return _plot(df, {"level": log_level(magnitude(), scale)}, width=width, height=height, centred=centred)


def fft_phase_plot(df: DataFrame, *, width: int, height: int, centred=True, weightByMagnitude=True) -> DataFrame:
    v = {"phase": phase()}
    if weightByMagnitude:
        v["weight"] = C.clamp(0, 1, F.log(magnitude() * 100.0 + 1.0) / math.log(101.0))
    return _plot(df, v, width=width, height=height, centred=centred)


def fft_component_plot(df: DataFrame, *, width: int, height: int, component="REAL", scale=300.0, centred=True) -> DataFrame:
    v = {"component": F.col("re" if component == "REAL" else "im") * (scale * 0.001)}
    return _plot(df, v, width=width, height=height, centred=centred)


def _polar_edit(df: DataFrame, new_mag: Column, new_phase: Column, *, width: int, height: int) -> DataFrame:
    s = luma_spectrum(df, width=width, height=height).withColumns({"_m": new_mag, "_p": new_phase})
    s = s.withColumns({"re": F.col("_m") * F.cos("_p"), "im": F.col("_m") * F.sin("_p")})
    return relight(df, inverse(s, width=width, height=height))


def fft_dephase(df: DataFrame, *, width: int, height: int, amount=1.0) -> DataFrame:
    """Pull every phase towards zero; at 1 the result is autocorrelation-like."""
    return _polar_edit(df, magnitude(), phase() * (1.0 - amount), width=width, height=height)


def fft_phase_only(df: DataFrame, *, width: int, height: int, amount=1.0, gain=10.0) -> DataFrame:
    dc = (F.col("kx") == 0) & (F.col("ky") == 0)
    m = F.when(dc, magnitude()).otherwise(C.mix(magnitude(), float(gain), float(amount)))
    return _polar_edit(df, m, phase(), width=width, height=height)


def fft_homomorphic(df: DataFrame, *, width: int, height: int, lowGain=0.3, highGain=1.8, cutoff=0.1,
                    softness=0.1, amount=1.0) -> DataFrame:
    """High emphasis on log luma."""
    logl = df.select(*FRAME, "x", "y", F.log(C.luma_unit() + 0.01).alias("v"))
    s = forward(logl, width=width, height=height)
    t = C.smoothstep(cutoff - softness * 0.5, cutoff + softness * 0.5, radius(padded(width), padded(height)))
    s = s.withColumn("_g", C.mix(float(lowGain), float(highGain), t))
    s = s.withColumns({"re": F.col("re") * F.col("_g"), "im": F.col("im") * F.col("_g")})
    back = inverse(s, width=width, height=height).select(
        *FRAME, "x", "y", C.clamp(0, 1, F.exp("re") - 0.01).alias("_o"))
    d = shuffled_join(df, back, [*FRAME, "x", "y"]).withColumn("_l", C.luma_unit())
    k = F.when(F.col("_l") > 1e-4, F.col("_o") / F.col("_l")).otherwise(F.col("_o"))
    d = d.withColumn("_k", k)
    return d.select(*FRAME, "x", "y", *[C.u8_soft(C.mix(F.col(c), C.clamp(0, 255, F.col(c) * F.col("_k")), float(amount))).alias(c)
                                        for c in C.RGB], "a")


def fft_cepstrum(df: DataFrame, *, width: int, height: int, suppressDC=True) -> DataFrame:
    """Inverse transform of log magnitude; repeats show as peaks away from the origin."""
    w, h = padded(width), padded(height)
    s = luma_spectrum(df, width=width, height=height)
    s = s.select(*FRAME, "kx", "ky", F.log(magnitude() + 1.0).alias("re"), F.lit(0.0).alias("im"))
    c = inverse(s, width=w, height=h).withColumn("cepstrum", F.abs("re"))
    if suppressDC:
        qx, qy = signed("x", w), signed("y", h)
        c = c.withColumn("cepstrum", F.col("cepstrum") * C.smoothstep(2.0, 10.0, F.sqrt((qx * qx + qy * qy).cast("double"))))
    return c.select(*FRAME, "x", "y", "cepstrum")


def fft_deconvolve(df: DataFrame, *, width: int, height: int, kernel="GAUSSIAN", sigma=3.0, motionLen=15.0,
                   motionAngle=0.0, noise=0.01, gain=1.0) -> DataFrame:
    """Wiener filter for a Gaussian or straight-motion blur."""
    w, h = padded(width), padded(height)
    fx, fy = signed("kx", w) / float(w), signed("ky", h) / float(h)
    if kernel == "GAUSSIAN":
        t = F.exp((fx * fx + fy * fy) * (-2.0 * 9.8696044 * sigma * sigma))
    else:
        a = (fx * math.cos(math.radians(motionAngle)) + fy * math.sin(math.radians(motionAngle))) * (math.pi * motionLen)
        t = F.when(F.abs(a) < 1e-5, F.lit(1.0)).otherwise(F.sin(a) / F.nullif(a, F.lit(0.0)))
    g = t / F.greatest(t * t + float(noise), F.lit(1e-6)) * float(gain)
    dc = (F.col("kx") == 0) & (F.col("ky") == 0)
    return masked(df, F.when(dc, F.lit(1.0)).otherwise(g), width=width, height=height)


def _sampled(df: DataFrame, grid: list[tuple[int, int, float, float]], *, width: int, height: int, scale: float) -> DataFrame:
    """Magnitude at listed polar positions; the grid is a parameter table of at most 65 536 cells."""
    if len(grid) > 65_536:
        raise ValueError("polar grid too large")
    w, h = padded(width), padded(height)
    rows = [(u, v, int(math.floor(round(kx % w, 9))) % w, int(math.floor(round(ky % h, 9))) % h) for u, v, kx, ky in grid]
    cells = df.sparkSession.createDataFrame(rows, "u int, v int, kx int, ky int")
    s = luma_spectrum(df, width=width, height=height)
    return s.join(F.broadcast(cells), ["kx", "ky"]).select(
        *FRAME, "u", "v", log_level(magnitude(), scale).alias("level"))


def fft_log_polar(df: DataFrame, *, width: int, height: int, scale=1000.0, rMin=0.5, rMax=256.0, fullTurn=False,
                  n_theta=16, n_radius=16) -> DataFrame:
    span = math.tau if fullTurn else math.pi
    lo, hi = math.log(rMin), math.log(rMax)
    grid = [(u, v, math.exp(lo + (hi - lo) * (1 - v / n_radius)) * math.cos(u / n_theta * span),
             math.exp(lo + (hi - lo) * (1 - v / n_radius)) * math.sin(u / n_theta * span))
            for u in range(n_theta) for v in range(n_radius)]
    return _sampled(df, grid, width=width, height=height, scale=scale)


def fft_polar_heatmap(df: DataFrame, *, width: int, height: int, scale=1000.0, logRadius=False, size=16) -> DataFrame:
    top = min(padded(width), padded(height)) * 0.5
    grid = []
    for u in range(size):
        for v in range(size):
            dx, dy = u - size / 2, v - size / 2
            rn = math.hypot(dx, dy) / (size / 2)
            if rn <= 1:
                k = math.exp(rn * math.log(top + 1)) - 1 if logRadius else rn * top
                th = math.atan2(dy, dx)
                grid.append((u, v, k * math.cos(th), k * math.sin(th)))
    return _sampled(df, grid, width=width, height=height, scale=scale)


def spectrogram(df: DataFrame, *, width: int, height: int, logScale=True, freqBins=32) -> DataFrame:
    """Per-column DFT of luma, relative to the column's strongest bin."""
    d = df.select(*FRAME, "x", "y", C.luma_unit().alias("re"), F.lit(0.0).alias("im"))
    ang = [2 * math.pi * k / height for k in range(height)]
    cos, sin = _table(map(math.cos, ang)), _table(map(math.sin, ang))
    t = d.select(*FRAME, "x", "y", "re", F.explode(F.sequence(F.lit(0), F.lit(freqBins - 1))).alias("bin"))
    at = (F.pmod(F.col("y") * F.col("bin"), F.lit(height)) + 1).cast("int")
    s = t.groupBy(*FRAME, "x", "bin").agg(F.sum(F.col("re") * F.element_at(cos, at)).alias("re"),
                                          F.sum(F.col("re") * F.element_at(sin, at)).alias("im"))
    m = magnitude() / float(height)
    if logScale:
        m = F.log10(m * 100.0 + 1.0)
    s = s.withColumn("mag", m)
    top = s.groupBy(*FRAME, "x").agg(F.max("mag").alias("_top"))
    j = s.join(top, [*FRAME, "x"])
    return j.select(*FRAME, "x", "bin", F.when(F.col("_top") > 0, F.col("mag") / F.col("_top")).otherwise(0.0).alias("level"))
