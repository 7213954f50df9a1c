"""Per-pixel projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.functions import tables as T
from rasterloom.operators import pixel as P
from rasterloom.operators import timeline as TL
from rasterloom.sources import views as V
from rasterloom.suite.registry import (CARRIER, CL, FU, J, L709, L709U, MIX, RASTER, SMOOTH, U8,
                                       carrier_sql, check, each, raster_sql)


def on_carrier(name, op, sql, **params):
    check(name, sql)(lambda spark, d: op(V.channel_carrier(spark, d), **params))


def on_raster(name, op, sql, **params):
    check(name, sql)(lambda spark, d: op(V.raster_px(spark, d), **params))


on_raster("none", P.identity, raster_sql("r", "g", "b"))
on_carrier("grayscale", P.grayscale, carrier_sql(*[J("(r + g + b) / 3.0")] * 3))


def lin(c):
    return f"(case when {c} / 255.0 <= 0.04045 then {c} / 255.0 / 12.92 else pow(({c} / 255.0 + 0.055) / 1.055, 2.4) end)"


def unlin(x):
    return f"(case when {x} <= 0.0031308 then {x} * 12.92 else 1.055 * pow({x}, 1 / 2.4) - 0.055 end)"


_y = f"(0.2126 * {lin('r')} + 0.7152 * {lin('g')} + 0.0722 * {lin('b')})"
on_carrier("grayscale_linear", P.grayscale, carrier_sql(*[FU(unlin(_y))] * 3), linearize=True)
on_carrier("invert", P.invert, carrier_sql("255 - r", "g", "255 - b"), invertG=False)
on_carrier("binarize", P.binarize, carrier_sql(
    "case when r > 100 then 255 else 0 end", "case when g > 127.5 then 255 else 0 end",
    "case when b > 60 then 255 else 0 end", "case when a > 0 then 255 else 0 end"),
    thresholdR=100, thresholdB=60)


def _bc(c):
    v = f"({c} / 255.0 * 1.2 + 20 / 255.0)"
    n = f"({v} - 0.5)"
    v = f"({n} + 4.0 * ({n} - 1.0) * {n} * ({n} - 0.5) + 0.5)"
    return FU(f"pow(greatest({v}, 0.0), 1.0 / 1.8)")


on_carrier("brightness_contrast", P.brightness_contrast, carrier_sql(*map(_bc, "rgb")),
           brightness=20, contrast=4, exposure=1.2, gamma=1.8)


def _levels(c):
    t = CL(f"({c} / 255.0 - 30 / 255.0) / (220 / 255.0 - 30 / 255.0)")
    return FU(CL(f"10 / 255.0 + pow({t}, 1 / 1.4) * (240 / 255.0 - 10 / 255.0)"))


on_carrier("levels", P.levels, carrier_sql(*map(_levels, "rgb")), blackPoint=30, whitePoint=220,
           gamma=1.4, outputBlack=10, outputWhite=240)
on_carrier("channel_mixer", P.channel_mixer, carrier_sql(
    U8("r * 0.6 + g * 0.5 + b * -0.1"), U8("r * 0.2 + g * 0.8 + b * 0.1"),
    U8("r * -0.3 + g * 0.4 + b * 1.1")),
    rr=0.6, rg=0.5, rb=-0.1, gr=0.2, gg=0.8, gb=0.1, br=-0.3, bg=0.4, bb=1.1)


def _cb(c, s, m, h):
    t = f"({L709} / 255.0)"
    sw, hw = f"greatest(0.0, 1.0 - {t} * 4.0)", f"greatest(0.0, {t} * 4.0 - 3.0)"
    return U8(f"{c} + ({sw} * {s} + (1.0 - {sw} - {hw}) * {m} + {hw} * {h}) * 2.55")


on_carrier("color_balance", P.color_balance,
           carrier_sql(_cb("r", 10, -7, 20), _cb("g", 0, 15, -30), _cb("b", 25, 3, 5)),
           shadowR=10, midtoneR=-7, highlightR=20, midtoneG=15, highlightG=-30, shadowB=25,
           midtoneB=3, highlightB=5)

HSV = f"""(select *, case when d = 0 then 0.0 when ru = mx then (case when gu < bu then (gu - bu) / d * 60 + 360
 else (gu - bu) / d * 60 end) when gu = mx then (2.0 + (bu - ru) / d) * 60 else (4.0 + (ru - gu) / d) * 60 end as h,
 case when d > 0 then d / mx else 0.0 end as s, mx as v from
 (select *, greatest(ru, gu, bu) as mx, least(ru, gu, bu) as mn, greatest(ru, gu, bu) - least(ru, gu, bu) as d
  from (select *, r / 255.0 as ru, g / 255.0 as gu, b / 255.0 as bu from {CARRIER} c0) c1) c2)"""


def from_hsv(inner):
    """`inner` yields h (any), s, v; adds the six-sector pieces."""
    return f"""(select *, v * (1 - s) as pp, v * (1 - s * f) as qq, v * (1 - s * (1 - f)) as tt from
 (select *, floor(hh) as sector, hh - floor(hh) as f from
  (select * exclude (h), (h - floor(h / 360.0) * 360.0) / 60.0 as hh from {inner} i0) i1) i2)"""


def sector_pick(*six):
    return "(case " + " ".join(f"when sector < {k + 1} then {e}" for k, e in enumerate(six[:5])) + f" else {six[5]} end)"


SECTORS = (sector_pick("v", "qq", "pp", "pp", "tt", "v"), sector_pick("tt", "v", "v", "qq", "pp", "pp"),
           sector_pick("pp", "pp", "tt", "v", "v", "qq"))
_shift = f"(select l_orderkey, l_linenumber, a, h + 75.0 as h, {CL('s + 0.2')} as s, {CL('v - 0.1')} as v from {HSV} s0)"
on_carrier("color_shift", P.color_shift, carrier_sql(*[FU(e) for e in SECTORS], pre=from_hsv(_shift)),
           hue=75, saturation=0.2, value=-0.1)

_hsl_s = """case when d = 0 then 0.0 when (mx + mn) / 2 > 0.5 then d / (2.0 - mx - mn) else d / (mx + mn) end"""
_hit = f"(least(abs(h - 40), 360 - abs(h - 40)) <= 35 and ({_hsl_s}) >= 0.25)"
on_carrier("color_threshold", P.color_threshold, carrier_sql(
    *each(f"case when {_hit} then {{c}} else {FU(L709U)} end"), pre=HSV),
    hueCenter=40, hueRange=35, saturationMin=0.25)
on_carrier("color_threshold_rows", P.color_threshold_rows,
           carrier_sql("r", "g", "b", pre=HSV) + f" where {_hit}",
           hueCenter=40, hueRange=35, saturationMin=0.25)
on_carrier("duotone", P.duotone, carrier_sql(
    *[U8(MIX(s, h, L709U)) for s, h in ((13.0, 255.0), (2.0, 107.0), (33.0, 107.0))]))


def _gm(c, a, b, e):
    lum = f"({L709} / 255.0)"
    m = f"(case when {lum} < 0.5 then {MIX(a, b, f'{lum} * 2.0')} else {MIX(b, e, f'({lum} - 0.5) * 2.0')} end)"
    return J(MIX(c, m, "0.7"))


on_carrier("gradient_map", P.gradient_map, carrier_sql(
    _gm("r", 0.0, 200.0, 255.0), _gm("g", 0.0, 50.0, 220.0), _gm("b", 40.0, 50.0, 100.0)), mix=0.7)
_m = SMOOTH("104.0", "152.0", L709)
on_carrier("luma_matte", P.luma_matte, carrier_sql(
    *each(J(f"{{c}} * {_m} + 255.0 * (1.0 - {_m})")), a="255"), feather=24, backgroundMode="WHITE")
on_carrier("luma_matte_alpha", P.luma_matte, carrier_sql("r", "g", "b", a=J(f"(1.0 - {_m}) * 255.0")),
           feather=24, invert=True, backgroundMode="TRANSPARENT")
on_carrier("matte_rows", P.matte_rows, carrier_sql("r", "g", "b") + f" where {_m} > 0", feather=24)


def QL(c, n):
    return J(f"floor({c} / (255.0 / {n - 1}) + 0.5) * (255.0 / {n - 1})")


on_carrier("posterize", P.posterize, carrier_sql(*[QL(c, 4) for c in "rgb"]))
on_carrier("chromatic_posterize", P.chromatic_posterize, carrier_sql(QL("r", 4), QL("g", 8), QL("b", 3)))
on_carrier("bit_crush", P.bit_crush, carrier_sql(*[QL(c, 8) for c in "rgb"]))
on_carrier("sepia", P.sepia, carrier_sql(*[
    J(f"{c} + (least(255.0, {w[0]} * r + {w[1]} * g + {w[2]} * b) - {c}) * 0.8")
    for c, w in zip("rgb", ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131)))]))
on_carrier("solarize", P.solarize, carrier_sql(*each("case when {c} > 96 then 255 - {c} else {c} end")))

_B = {
    "MULTIPLY": "A * B", "SCREEN": "1 - (1 - A) * (1 - B)",
    "OVERLAY": "case when A < 0.5 then 2 * A * B else 1 - 2 * (1 - A) * (1 - B) end",
    "SOFT_LIGHT": "case when B < 0.5 then A - (1 - 2 * B) * A * (1 - A) else A + (2 * B - 1) * (sqrt(A) - A) end",
    "HARD_LIGHT": "case when B < 0.5 then 2 * A * B else 1 - 2 * (1 - A) * (1 - B) end",
    "DIFFERENCE": "abs(A - B)", "EXCLUSION": "A + B - 2 * A * B"}


def blend_sql(mode, a, b):
    return "(" + _B[mode].replace("A", f"({a})").replace("B", f"({b})") + ")"


for _mode in _B:
    _name = "blend" if _mode == "MULTIPLY" else f"blend_{_mode.lower()}"
    on_carrier(_name, P.blend, carrier_sql(*[
        FU(MIX(f"{c} / 255.0", CL(blend_sql(_mode, f"{c} / 255.0", f"{v} / 255.0")), "0.5"))
        for c, v in zip("rgb", (200, 150, 100))]), mode=_mode)


@check("blend_rasters", f"""select p.clip_id, p.frame, p.x, p.y, {FU(MIX("p.r / 255.0", CL("1 - (1 - p.r / 255.0) * (1 - q.r / 255.0)"), "0.5"))} as r,
 {FU(MIX("p.g / 255.0", CL("1 - (1 - p.g / 255.0) * (1 - q.g / 255.0)"), "0.5"))} as g,
 {FU(MIX("p.b / 255.0", CL("1 - (1 - p.b / 255.0) * (1 - q.b / 255.0)"), "0.5"))} as b, p.a
 from {RASTER} p join {RASTER} q on p.clip_id = q.clip_id and p.frame = q.frame and p.x = q.x and q.y = 7 - p.y""")
def _blend_rasters(spark, d):
    px = V.raster_px(spark, d)
    flipped = px.withColumn("y", F.lit(7) - F.col("y"))
    return P.blend_rasters(px, flipped, ["clip_id", "frame", "x", "y"], mode="SCREEN")


def gradient_sql(t, stops, k):
    n = len(stops) - 1
    pos = f"({CL(t)} * {n}.0)"
    arms = " ".join(f"when floor({pos}) = {i} then {stops[i][k]}.0 + ({stops[i + 1][k] - stops[i][k]}.0) * ({pos} - floor({pos}))"
                    for i in range(n))
    return f"(case {arms} else {stops[-1][k]}.0 end)"


on_carrier("contour_map", P.contour_map, carrier_sql(*[
    U8(gradient_sql(f"floor({L709U} * 8.0) / 8.0", T.CONTOUR_RAMPS["TOPOGRAPHIC"], k)) for k in range(3)]))
on_carrier("thermal_camera", P.thermal_camera, carrier_sql(*[
    U8(gradient_sql(CL(f"({L709U} - 0.5) * 1.2 + 0.5"), T.WHITE_HOT[::-1], k)) for k in range(3)]),
    colormap="BLACK_HOT")
for _name, _stops in (
        ("IRONBOW", [(0, 0, 0), (20, 0, 80), (80, 0, 120), (160, 0, 100), (220, 60, 20), (255, 180, 0), (255, 255, 100), (255, 255, 255)]),
        ("RAINBOW", [(0, 0, 40), (0, 0, 200), (0, 180, 255), (0, 220, 80), (200, 220, 0), (255, 120, 0), (255, 0, 0), (255, 255, 255)])):
    on_carrier(f"thermal_camera_{_name.lower()}", P.thermal_camera, carrier_sql(*[
        U8(gradient_sql(CL(f"({L709U} - 0.5) * 1.2 + 0.5"), _stops, k)) for k in range(3)]), colormap=_name)


def hable(x):
    return f"(({x} * ({x} * 0.15 + 0.05) + 0.004) / ({x} * ({x} * 0.15 + 0.5) + 0.06) - 0.02 / 0.3)"


_curves = {"ACES": lambda x: CL(f"({x} * ({x} * 2.51 + 0.03)) / ({x} * ({x} * 2.43 + 0.59) + 0.14)"),
           "REINHARD": lambda x: f"({x} / ({x} + 1.0))",
           "UNCHARTED2": lambda x: f"({hable(f'({x} * 2.0)')} / {hable('11.2')})"}
for _preset, _fn in _curves.items():
    on_carrier("lut" if _preset == "ACES" else f"lut_{_preset.lower()}", P.lut, carrier_sql(*[
        FU(MIX(f"{c} / 255.0", _fn(f"({c} / 255.0 * {2.0 ** 0.5!r})"), "0.9")) for c in "rgb"]),
        preset=_preset, strength=0.9, exposure=0.5)

_POINTS = "[[0, 10], [64, 40], [128, 170], [200, 190]]"


def curve_sql(v):
    """The segment table of the control points, straight from the points."""
    seg = [(0, 10, 64, 40), (64, 40, 128, 170), (128, 170, 200, 190), (200, 190, 255, 190)]
    arms = " ".join(f"when {v} <= {x1} then {y0} + ({y1 - y0}) * (({v} - {x0}) / {float(x1 - x0)})"
                    for x0, y0, x1, y1 in seg)
    return U8(f"(case {arms} end)")


on_carrier("curves", P.curves, carrier_sql(*[curve_sql(c) for c in "rgb"]), points=_POINTS)
_lumidx = J(f"{L709U} * 255.0")
_k = f"(case when {L709U} < 1 / 255.0 then {curve_sql(_lumidx)} / 255.0 else {curve_sql(_lumidx)} / 255.0 / {L709U} end)"
on_carrier("curves_luma", P.curves, carrier_sql(*each(FU(f"{{c}} / 255.0 * {_k}"))), points=_POINTS, channel="LUMA")

_bands = [(230, 60, 50), (240, 200, 60), (80, 200, 90), (60, 180, 220), (70, 80, 230), (200, 70, 210)]


def _pm(k):
    band = "least(5, floor((h - 23.7183 - floor((h - 23.7183) / 360.0) * 360.0) / 360.0 * 6.0))"

    def tgt(j):
        return "(case " + " ".join(f"when {band} = {i} then {c[j]} / 255.0" for i, c in enumerate(_bands)) + " end)"
    t = [tgt(j) for j in range(3)]
    kk = f"({L709U} / greatest(0.2126 * {t[0]} + 0.7152 * {t[1]} + 0.0722 * {t[2]}, 1 / 255.0))"
    o = [f"({x} * {kk})" for x in t]
    return FU(MIX(f"(({o[0]} + {o[1]} + {o[2]}) / 3.0)", o[k], "(s * 1.1)"))


on_carrier("palette_mapper_by_hue_bands", P.palette_mapper,
           carrier_sql(*[_pm(k) for k in range(3)], pre=HSV),
           bands=_bands, hueOffset=23.7183, saturationBoost=1.1)
_dist = "sqrt(pow((x / 8.0 - 0.5) * 2.0, 2) + pow((y / 8.0 - 0.5) * 2.0, 2))"
on_raster("vignette", P.vignette, raster_sql(*each(
    FU(f"{{c}} / 255.0 * (1.0 - {SMOOTH('0.8 - 0.4', '0.8 + 0.4', _dist)} * 0.5)"))), width=8, height=8)

_ycc = f"""(select *, coalesce(lag(cb0) over w, cb0) as cb1, coalesce(lag(cr0) over w, cr0) as cr1 from
 (select *, r * 0.299 + g * 0.587 + b * 0.114 as y0, 128 - r * 0.168736 - g * 0.331264 + b * 0.5 as cb0,
  128 + r * 0.5 - g * 0.418688 - b * 0.081312 as cr0 from {RASTER} p0) p1
 window w as (partition by clip_id, frame, y order by x))"""
_ycc = f"(select *, (y0 - 16) * (255.0 / 219) as yy, (cb1 - 128) * (255.0 / 224) as u, (cr1 - 128) * (255.0 / 224) as v from {_ycc} p2)"
_dec = ("yy + v * 1.5748", "yy - u * 0.187324 - v * 0.468124", "yy + u * 1.8556")
on_raster("metadata_mismatch_decode", P.metadata_mismatch_decode, raster_sql(*[
    U8(MIX(f"pow({CL(e, '0.0', '255.0')} / 255.0, 1 / 1.35) * 255.0", c, "0.25"))
    for c, e in zip("rgb", _dec)], pre=_ycc))


# ---- threshold maps ---------------------------------------------------------------------

def tmap_sql(name, sx=1, sy=1):
    m = T.threshold_map(name)
    flat = ", ".join(repr(v) for row in m for v in row)
    w, h = len(m[0]), len(m)
    return f"[{flat}][((y % {h * sy}) // {sy}) * {w} + (x % {w * sx}) // {sx} + 1]"


def with_threshold(name, polarity="SHADOW", **kw):
    t = tmap_sql(name, **kw)
    return f"(select *, {'1.0 - ' + t if polarity == 'CLASSIC' else t} as t from {RASTER} t0)"


def quant_sql(c, levels):
    step = f"(255.0 / {levels - 1})"
    return U8(f"floor(floor(({c} + (t - 0.5) * {step}) / {step} + 0.5) * {step} + 0.5)")


def nearest_sql(pal, inner, keys="clip_id, frame, x, y", extra="a", dist=None):
    """First-index argmin over a palette written out as a list."""
    dist = dist or "(r - p.r) * (r - p.r) + (g - p.g) * (g - p.g) + (b - p.b) * (b - p.b)"
    cands = ", ".join(
        f"{{'d': {dist.replace('p.r', f'{c[0]}.0').replace('p.g', f'{c[1]}.0').replace('p.b', f'{c[2]}.0')}, 'i': {i}}}"
        for i, c in enumerate(pal))
    picks = ", ".join("[" + ", ".join(str(int(c[k])) for c in pal) + f"][best.i + 1] as {n}"
                      for k, n in enumerate("rgb"))
    return f"select {keys}, {picks}, {extra} from (select *, list_min([{cands}]) as best from {inner} n0) n1"


def ordered_check(name, **p):
    m = p.get("thresholdMap", "HATCH_2X2")
    n = p.get("levels") or T.map_levels(m)
    body = raster_sql(*[quant_sql(c, n) for c in "rgb"], pre=with_threshold(
        m, p.get("thresholdPolarity", "SHADOW"), sx=p.get("thresholdMapScaleX", 1), sy=p.get("thresholdMapScaleY", 1)))
    sql = nearest_sql(p["palette"], f"({body})") if p.get("palette") else body
    on_raster(name, P.ordered, sql, **p)


ordered_check("ordered", thresholdMap="BAYER_4X4", levels=4)
ordered_check("ordered_scaled", thresholdMap="HATCH_3X3", thresholdMapScaleX=2)
for _n, _p in P.ORDERED_PRESETS.items():
    ordered_check(_n, **_p)
_v = f"case when {L709U} > t then 255 else 0 end"
on_raster("threshold_map", P.threshold_map, raster_sql(_v, _v, _v, pre=with_threshold("BAYER_8X8")))
on_raster("posterize_dither", P.posterize_dither, raster_sql(*[
    FU(f"floor(({c} / 255.0 + (t - 0.5) / {n}.0) * {n - 1}.0 + 0.5) / {n - 1}.0")
    for c, n in zip("rgb", (4, 5, 3))], pre=with_threshold("BAYER_8X8")), levelsG=5, levelsB=3)


# ---- plain column helpers ---------------------------------------------------------------

@check("nearest_levels_quantiser", f"""select l_orderkey, l_linenumber, {QL('l_quantity', 6)} as qty_level,
 {QL('l_suppkey', 12)} as supp_level, {J('l_quantity')} as qty_same, 0 as qty_one from lineitem""")
def _quantiser(spark, d):
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", C.quantize_levels(F.col("l_quantity"), 6).alias("qty_level"),
        C.quantize_levels(F.col("l_suppkey"), 12).alias("supp_level"),
        C.quantize_levels(F.col("l_quantity"), 256).alias("qty_same"),
        C.quantize_levels(F.col("l_quantity"), 1).alias("qty_one"))


_TABLE = [(i * i) // 255 for i in range(256)]
on_carrier("per_channel_lut_apply", P.channel_lut,
           carrier_sql(*each("cast({c} * {c} // 255 as int)")), table=_TABLE)


@check("luminance_bt_601_bt_709_linear_or_not", f"""select l_orderkey, l_linenumber,
 round(a * {L709U}, 6) as y709, round(a * {_y}, 6) as y709_linear,
 round(a * (0.299 * (r / 255.0) + 0.587 * (g / 255.0) + 0.114 * (b / 255.0)), 6) as y601,
 round(a * (0.299 * {lin('r')} + 0.587 * {lin('g')} + 0.114 * {lin('b')}), 6) as y601_linear from {CARRIER} p""")
def _luminance(spark, d):
    rgb = [C.unit(c) for c in C.RGB]
    lin_rgb = [C.srgb_to_linear(c) for c in rgb]
    return V.channel_carrier(spark, d).select(
        "l_orderkey", "l_linenumber",
        *[F.round(F.col("a") * C.weighted(*v, w), 6).alias(n) for n, v, w in (
            ("y709", rgb, C.REC709), ("y709_linear", lin_rgb, C.REC709),
            ("y601", rgb, C.BT601), ("y601_linear", lin_rgb, C.BT601))])


@check("quantizevalue", f"select l_orderkey, l_linenumber, {QL('r', 5)} as q5, {QL('g', 9)} as q9 from {CARRIER} p")
def _quantize_value(spark, d):
    return V.channel_carrier(spark, d).select(
        "l_orderkey", "l_linenumber", C.quantize_levels(F.col("r"), 5).alias("q5"),
        C.quantize_levels(F.col("g"), 9).alias("q9"))


@check("option_modulation", """with conn(metric, target, weight) as (values ('click', 'gain', 0.6), ('view', 'gain', -0.2),
 ('error', 'mix', 0.9), ('purchase', 'angle', 0.5), ('signup', 'angle', 0.25)),
 opt(target, value, lo, hi, step) as (values ('gain', 1.0, 0.5, 5.0, 0.1), ('mix', 0.25, 0.0, 1.0, 0.05), ('angle', 90.0, 0.0, 360.0, 0.0)),
 m as (select user_id, event_type as metric, least(1.0, sum(cast(round(value * 100) as bigint)) / 100.0 / 1000.0) as v from events group by 1, 2),
 s as (select user_id, target, sum(v * weight) as total from m join conn using (metric) group by 1, 2)
 select user_id, target, round(case when step > 0 then floor(least(hi, greatest(lo, value + total * (hi - lo))) / step + 0.5) * step
  else least(hi, greatest(lo, value + total * (hi - lo))) end, 6) as value from s join opt using (target)""")
def _option_modulation(spark, d):
    metrics = V.table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("metric")).agg(
        F.least(F.lit(1.0), F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0 / 1000.0).alias("v"))
    conns = spark.createDataFrame(
        [("click", "gain", 0.6), ("view", "gain", -0.2), ("error", "mix", 0.9), ("purchase", "angle", 0.5),
         ("signup", "angle", 0.25)], "metric string, target string, weight double")
    opts = spark.createDataFrame(
        [("gain", 1.0, 0.5, 5.0, 0.1), ("mix", 0.25, 0.0, 1.0, 0.05), ("angle", 90.0, 0.0, 360.0, 0.0)],
        "target string, value double, lo double, hi double, step double")
    return TL.modulate_options(metrics, conns, opts, ["user_id"])


_prog = {"r": "r * 0.5 + x * 16", "g": "abs(g - y * 10)", "b": "if(x > y, b, 255 - b)"}
on_raster("program", P.program, raster_sql(
    U8("r * 0.5 + x * 16"), U8("abs(g - y * 10)"), U8("case when x > y then b else 255 - b end"), U8("a")), **_prog)
