"""Neighbourhood operators and coordinate remaps.  The SQL reads each target's taps by a self-join."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.operators import remap as R
from rasterloom.operators import stencil as S
from rasterloom.sources import views as V
from rasterloom.suite.checks_a_pixel import lin, unlin
from rasterloom.suite.checks_b_joins_aggs import on_frames
from rasterloom.suite.registry import CL, J, L709, L709U, RASTER, U8S, check

ID = "p.clip_id, p.frame, p.x, p.y"
RGBA_OF = "{0}.r, {0}.g, {0}.b, {0}.a"


def offsets_sql(offs, names="dx, dy"):
    n = names.count(",") + 1
    vals = ", ".join("(" + ", ".join(repr(float(v)) if isinstance(v, float) else str(v).lower() for v in o[:n]) + ")" for o in offs)
    return f"(values {vals}) o({names})"


def taps_sql(offs, names="dx, dy", src=RASTER, clamp=True):
    sx, sy = ("least(7, greatest(0, p.x + o.dx))", "least(7, greatest(0, p.y + o.dy))") if clamp else ("p.x + o.dx", "p.y + o.dy")
    return f"""{src} p cross join {offsets_sql(offs, names)} join {src} h
 on h.clip_id = p.clip_id and h.frame = p.frame and h.x = {sx} and h.y = {sy}"""


def chans(fmt):
    return ", ".join(f"{fmt.replace('{c}', c)} as {c}" for c in "rgb")


def conv_sql(kernel, strength=1.0):
    return f"select {ID}, {chans(U8S('sum(h.{c} * o.w)'))}, p.a from {taps_sql(S.kernel_offsets(S.KERNELS[kernel], strength), 'dx, dy, w')} group by {ID}, p.a"


SIZE = {"width": 8, "height": 8}
on_frames("convolve", S.convolve, conv_sql("GAUSSIAN_3X3"), **SIZE)
on_frames("convolve_edge_detection", S.convolve, conv_sql("LAPLACIAN_3X3", 2.0), kernel="LAPLACIAN_3X3", strength=2.0, **SIZE)
on_frames("convolve_sharpen", S.convolve, conv_sql("SHARPEN_3X3"), kernel="SHARPEN_3X3", **SIZE)
on_frames("convolve_sobel", S.convolve, conv_sql("SOBEL_VERTICAL"), kernel="SOBEL_VERTICAL", **SIZE)
for _kernel in ("GAUSSIAN_3X3_WEAK", "GAUSSIAN_5X5", "UNSHARP_5X5"):
    on_frames(f"convolve_{_kernel.lower()}", S.convolve, conv_sql(_kernel), kernel=_kernel, **SIZE)
_ls = f"(select *, {lin('r')} as lr, {lin('g')} as lg, {lin('b')} as lb from {RASTER} z)"
_gk = S.kernel_offsets(S.KERNELS["GAUSSIAN_3X3"])
on_frames("convolve_linear", S.convolve, f"""select clip_id, frame, x, y, {chans(U8S(unlin('l{c}') + ' * 255.0'))}, a from
 (select {ID}, {', '.join(f'least(1.0, greatest(0.0, sum(h.l{c} * o.w))) as l{c}' for c in 'rgb')}, p.a from {taps_sql(_gk, 'dx, dy, w', _ls)} group by {ID}, p.a) q""",
          linearize=True, **SIZE)


def sep_sql(weights, cols, extra=""):
    r = len(weights) // 2
    h = [(k, 0, w) for k, w in zip(range(-r, r + 1), weights)]
    v = [(0, k, w) for k, w in zip(range(-r, r + 1), weights)]
    src = f"(select *, {L709} as luma from {RASTER} z)"
    one = f"(select {ID}, p.a as a0, {', '.join(f'sum(h.{c} * o.w) as {c}' for c in cols)} from {taps_sql(h, 'dx, dy, w', src)} group by {ID}, p.a)"
    return f"(select {ID}, p.a0, {', '.join(f'sum(h.{c} * o.w) as {c}' for c in cols)} from {taps_sql(v, 'dx, dy, w', one)} group by {ID}, p.a0)"


on_frames("gaussian_blur", S.gaussian_blur,
          f"select clip_id, frame, x, y, {chans(U8S('{c}'))}, a0 as a from {sep_sql(S.gaussian_weights(1.2), 'rgb')} q", sigma=1.2, **SIZE)


@check("gaussian_blur_helpers_rgba_plane", f"""select clip_id, frame, x, y, {', '.join(f'round({c}, 5) as {c}' for c in ('r', 'g', 'b', 'a', 'luma'))}
 from {sep_sql(S.gaussian_weights(0.8), ('r', 'g', 'b', 'a', 'luma'))} q""")
def _planes(spark, d):
    out = S.blur_planes(V.raster_px(spark, d), sigma=0.8, **SIZE)
    return out.select("clip_id", "frame", "x", "y", *[F.round(c, 5).alias(c) for c in ("r", "g", "b", "a", "luma")])


def box_sql(r):
    return f"""(select {ID}, p.r, p.g, p.b, p.a, {', '.join(f'avg(h.{c}) as m{c}' for c in 'rgb')} from {taps_sql(S.square(r))} group by {ID}, p.r, p.g, p.b, p.a)"""


_dd = "(abs(r - mr) + abs(g - mg) + abs(b - mb))"
on_frames("sharpen", S.sharpen, f"select clip_id, frame, x, y, {chans('case when ' + _dd + ' < 18 then {c} else ' + U8S('{c} + ({c} - m{c}) * 1.5') + ' end')}, a from {box_sql(2)} q",
          radius=2, threshold=6.0, **SIZE)
_nd = len(S.disc(2))
on_frames("median_filter", S.median_filter,
          f"select {ID}, {chans(f'list_sort(list(h.{{c}}))[{_nd // 2 + 1}]')}, p.a from {taps_sql(S.disc(2))} group by {ID}, p.a", radius=2, **SIZE)
_lumi = "(2126 * h.r + 7152 * h.g + 722 * h.b)"
_dk = [(dx, dy, i) for i, (dx, dy) in enumerate(S.disc(2))]
for _mode, _sign in (("DILATE", "-"), ("ERODE", "")):
    on_frames("dilate_erode" if _mode == "DILATE" else "erode", S.dilate_erode, f"""select clip_id, frame, x, y, v.r, v.g, v.b, a from
 (select {ID}, p.a, arg_min({{'r': h.r, 'g': h.g, 'b': h.b}}, {{'l': {_sign}{_lumi}, 'k': o.k}}) as v from {taps_sql(_dk, 'dx, dy, k')} group by {ID}, p.a) q""",
              mode=_mode, radius=2, **SIZE)
_var = "((var_pop(h.r) + var_pop(h.g) + var_pop(h.b)) / 3.0)"
on_frames("despeckle", S.despeckle, f"""select clip_id, frame, x, y, {chans('case when v > 225 then ' + J('m{c}') + ' else {c} end')}, a from
 (select {ID}, p.r, p.g, p.b, p.a, {_var} as v, {', '.join(f'avg(h.{c}) as m{c}' for c in 'rgb')} from {taps_sql(S.square(1))} group by {ID}, p.r, p.g, p.b, p.a) q""",
          radius=1, threshold=15.0, **SIZE)
_quad = [(dx, dy, k) for dx, dy in S.square(2) for k, hit in enumerate(
    (dx <= 0 and dy <= 0, dx >= 0 and dy <= 0, dx <= 0 and dy >= 0, dx >= 0 and dy >= 0)) if hit]
_q2 = " + ".join(f"(sum(h.{c} * h.{c}) * count(*) - sum(h.{c}) * sum(h.{c}))" for c in "rgb")
on_frames("kuwahara", S.kuwahara, f"""select clip_id, frame, x, y, m.r, m.g, m.b, a from (select clip_id, frame, x, y, a,
 arg_min({{'r': mr, 'g': mg, 'b': mb}}, {{'v': v, 'k': k}}) as m from
 (select {ID}, p.a, o.k, cast({_q2} as double) / cast(count(*) * count(*) as double) as v, {', '.join(J(f'avg(h.{c})') + f' as m{c}' for c in 'rgb')} from {taps_sql(_quad, 'dx, dy, k', clamp=False)} group by {ID}, p.a, o.k) q
 group by clip_id, frame, x, y, a) z""", radius=2, **SIZE)
_bin = "cast(least(19, floor((0.2126 * (h.r / 255.0) + 0.7152 * (h.g / 255.0) + 0.0722 * (h.b / 255.0)) * 20)) as int)"
on_frames("oil_painting", S.oil_painting, f"""select clip_id, frame, x, y, m.r, m.g, m.b, a from (select clip_id, frame, x, y, a,
 arg_max({{'r': mr, 'g': mg, 'b': mb}}, {{'n': n, 'k': -k}}) as m from
 (select {ID}, p.a, {_bin} as k, count(*) as n, {', '.join(J(f'avg(h.{c})') + f' as m{c}' for c in 'rgb')} from {taps_sql(S.square(2))} group by {ID}, p.a, 6) q
 group by clip_id, frame, x, y, a) z""".replace("group by p.clip_id, p.frame, p.x, p.y, p.a, 6", f"group by {ID}, p.a, {_bin}"), radius=2, **SIZE)
_bw = "(exp(-(o.dx * o.dx + o.dy * o.dy) / 2.0) * exp(-((h.r - p.r) * (h.r - p.r) + (h.g - p.g) * (h.g - p.g) + (h.b - p.b) * (h.b - p.b)) / 1800.0))"
on_frames("bilateral_blur", S.bilateral_blur, f"select {ID}, {chans(U8S(f'sum({_bw} * h.{{c}}) / sum({_bw})'))}, p.a from {taps_sql(S.square(2))} group by {ID}, p.a",
          sigmaSpatial=1.0, sigmaRange=30.0, **SIZE)


def diffuse_sql(src):
    def at(c, o):
        return f"max(h.{c}) filter (where o.k = {o})"

    def flow(c, o):
        g = f"({at(c, o)} - {at(c, 0)})"
        return f"exp(-({g} / 30.0 * ({g} / 30.0))) * {g}"
    offs = [(dx, dy, i) for i, (dx, dy) in enumerate(S.CROSS)]
    vals = ", ".join(f"{CL(f'{at(c, 0)} + 0.2 * ({flow(c, 1)} + {flow(c, 2)} + {flow(c, 3)} + {flow(c, 4)})', '0.0', '255.0')} as {c}" for c in "rgb")
    return f"(select {ID}, {vals}, p.a from {taps_sql(offs, 'dx, dy, k', src)} group by {ID}, p.a)"


_d0 = f"(select clip_id, frame, x, y, cast(r as double) as r, cast(g as double) as g, cast(b as double) as b, a from {RASTER} z)"
on_frames("anisotropic_diffusion", S.anisotropic_diffusion,
          f"with s1 as materialized {diffuse_sql(_d0)}, s2 as materialized {diffuse_sql('s1')} select clip_id, frame, x, y, {chans(U8S('{c}'))}, a from s2",
          iterations=2, **SIZE)
_ux, _uy = math.cos(math.radians(135)), -math.sin(math.radians(135))
_em = [(dx, dy, (dx * _ux + dy * _uy) * 1.5) for dx, dy in S.square(1)]
_rest = sum(o[2] for o in _em)
_em = [(dx, dy, w - _rest if (dx, dy) == (0, 0) else w) for dx, dy, w in _em]
on_frames("emboss", S.emboss, f"select {ID}, {chans(U8S('(sum(h.{c} * o.w) + 128) * 0.7 + p.{c} * 0.3'))}, p.a from {taps_sql(_em, 'dx, dy, w')} group by {ID}, p.a, p.r, p.g, p.b",
          strength=1.5, blend=0.3, **SIZE)
_hl = "(0.2126 * h.r + 0.7152 * h.g + 0.0722 * h.b)"
SOB = f"""(select {ID}, p.r, p.g, p.b, p.a, sum({_hl} * o.wx) as gx, sum({_hl} * o.wy) as gy from {taps_sql(S.SOBEL, 'dx, dy, wx, wy')} group by {ID}, p.r, p.g, p.b, p.a)"""
_in = "(x between 1 and 6 and y between 1 and 6)"


@check("luminance_plane_sobel", f"""select clip_id, frame, x, y, round({L709}, 5) as luma, round(case when {_in} then sqrt(gx * gx + gy * gy) else 0.0 end, 5) as magnitude,
 round(case when {_in} then atan2(gy, gx) else 0.0 end, 5) as direction from {SOB} q""")
def _sobel(spark, d):
    out = S.luminance_sobel(V.raster_px(spark, d), **SIZE)
    return out.withColumns({c: F.round(c, 5) for c in ("luma", "magnitude", "direction")})


_mag = f"(select *, round(sqrt(gx * gx + gy * gy), 6) as mag, case when degrees(atan2(gy, gx)) < 0 then degrees(atan2(gy, gx)) + 180 else degrees(atan2(gy, gx)) end as deg from {SOB} m0)"
_mag = f"(select *, case when deg < 22.5 or deg >= 157.5 then 0 when deg < 67.5 then 1 when deg < 112.5 then 2 else 3 end as sec from {_mag} m1)"
_pairs = [(0, -1, 0), (0, 1, 0), (1, -1, 1), (-1, 1, 1), (-1, 0, 2), (1, 0, 2), (-1, -1, 3), (1, 1, 3)]
on_frames("edge_trace", S.edge_trace, f"""with m as materialized {_mag}, e as (select {ID}, p.r, p.g, p.b, p.a, p.x between 1 and 6 and p.y between 1 and 6 and p.mag >= 40 and p.mag >= max(h.mag) filter (where o.s = p.sec) as edge
  from {taps_sql(_pairs, 'dx, dy, s', 'm')} group by {ID}, p.r, p.g, p.b, p.a, p.mag)
 select clip_id, frame, x, y, {', '.join(f'case when edge then {U8S(f"{c} + ({v} - {c}) * 0.7")} else {c} end as {c}' for c, v in zip('rgb', (10.0, 20.0, 30.0)))}, a from e""",
          threshold=40.0, renderMode="OVERLAY", lineColor=(10, 20, 30), **SIZE)
_band = "least(9, floor((0.2126 * ({0}.r / 255.0) + 0.7152 * ({0}.g / 255.0) + 0.0722 * ({0}.b / 255.0)) * 10))"
_bsrc = f"(select *, {_band.format('z')} as band from {RASTER} z)"
_tone = "((p.band + 0.5) / 10.0 + (1 - (p.band + 0.5) / 10.0) * 0.3)"
on_frames("contour_lines", S.contour_lines, f"""select {ID}, {chans('case when max(h.band) <> min(h.band) then 0 else ' + U8S(f'p.{{c}} * {_tone}') + ' end')}, p.a
 from {taps_sql(S.CROSS, src=_bsrc)} group by {ID}, p.r, p.g, p.b, p.a, p.band""", **SIZE)
for _mode, _expr in (("HIGH", "128 + ({c} - m{c}) * 1.5"), ("LOW", "m{c}")):
    on_frames("frequency_filter" if _mode == "HIGH" else "frequency_filter_low", S.frequency_filter,
              f"select clip_id, frame, x, y, {chans(U8S(_expr))}, a from {box_sql(2)} q", mode=_mode, radius=2, **SIZE)
on_frames("frequency_filter_band", S.frequency_filter,
          f"select n.clip_id, n.frame, n.x, n.y, {chans(U8S('128 + (n.m{c} - w.m{c}) * 1.5'))}, n.a from {box_sql(1)} n join {box_sql(3)} w using (clip_id, frame, x, y)",
          mode="BAND", radius=1, bandWidth=2, **SIZE)


def _at(k):
    return f"max(h.l) filter (where o.k = {k})"


_lsrc = f"(select *, {L709U} as l from {RASTER} z)"
_rel = f"""(select *, greatest(0.0, (dx * {-math.cos(math.radians(135))!r} + dy * {math.sin(math.radians(135))!r} + 0.85) / sqrt(dx * dx + dy * dy + 1)) as diffuse from
 (select {ID}, p.r, p.g, p.b, p.a, ({_at(4)} - {_at(3)}) * 2.0 as dx, ({_at(2)} - {_at(1)}) * 2.0 as dy from {taps_sql([(dx, dy, i) for i, (dx, dy) in enumerate(S.CROSS)], 'dx, dy, k', _lsrc)} group by {ID}, p.r, p.g, p.b, p.a) r0)"""
on_frames("relief_map_faux_normal_lighting", S.relief_map,
          f"select clip_id, frame, x, y, {chans(U8S('{c} * (0.35 + diffuse * 0.9) + pow(diffuse, 18.0) * 0.25 * 255'))}, a from {_rel} q", **SIZE)

# ---- remaps -----------------------------------------------------------------------------


def look(sx, sy, *, inside="true", fill=(0, 0, 0, 255), src=RASTER, how="left"):
    """Nearest gather of a target list with source columns."""
    vals = ", ".join(f"coalesce(h.{c}, {v}) as {c}" for c, v in zip("rgba", fill))
    return f"""select {ID}, {vals} from (select *, case when {inside} then cast({sx} as int) end as sx, case when {inside} then cast({sy} as int) end as sy from {src} t0) p
 {how} join {RASTER} h on h.clip_id = p.clip_id and h.frame = p.frame and h.x = p.sx and h.y = p.sy"""


def bilinear(src, fill=(0, 0, 0, 255)):
    """`src` yields the pixel id with fx, fy and a boolean `ok`."""
    vals = ", ".join(f"case when p.ok then {J(f'sum(h.{c} * w) + 0.000000001')} else {v} end as {c}" for c, v in zip("rgba", fill))
    w = "(case when o.dx = 1 then p.fx - floor(p.fx) else 1 - (p.fx - floor(p.fx)) end) * (case when o.dy = 1 then p.fy - floor(p.fy) else 1 - (p.fy - floor(p.fy)) end)"
    return f"""select clip_id, frame, x, y, {vals.replace('p.ok', 'ok').replace('h.', 's')} from (select {ID}, p.ok, {w} as w, h.r as sr, h.g as sg, h.b as sb, h.a as sa from {src} p
 cross join (values (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy) join {RASTER} h on h.clip_id = p.clip_id and h.frame = p.frame
  and h.x = least(7, greatest(0, cast(floor(p.fx) as int) + o.dx)) and h.y = least(7, greatest(0, cast(floor(p.fy) as int) + o.dy))) z group by clip_id, frame, x, y, ok"""


_clamp8 = "least(7, greatest(0, {0}))"
on_frames("flip", R.flip, f"select clip_id, frame, 7 - x as x, y, r, g, b, a from {RASTER} p", **SIZE)
on_frames("flip_both", R.flip, f"select clip_id, frame, 7 - x as x, 7 - y as y, r, g, b, a from {RASTER} p", mode="BOTH", **SIZE)
_rad = "radians(-(15.0 + 2.0 * frame))"
_rot = f"(select *, round((x - 4) * cos({_rad}) - (y - 4) * sin({_rad}) + 4, 9) as fx, round((x - 4) * sin({_rad}) + (y - 4) * cos({_rad}) + 4, 9) as fy from {RASTER} r0)"
on_frames("rotate", R.rotate, bilinear(f"(select *, fx >= 0 and fx < 7 and fy >= 0 and fy < 7 as ok from {_rot} r1)", fill=(9, 8, 7, 255)),
          spinPerFrame=2.0, bgColor=(9, 8, 7), **SIZE)
_st = f"(select *, (x - 4.0) * {1 / 1.5!r} + 4.0 as fx, (y - 4.0) * {1 / 0.8!r} + 4.0 as fy from {RASTER} s0)"
on_frames("stretch", R.stretch, bilinear(f"(select *, fx >= 0 and fx < 8 and fy >= 0 and fy < 8 as ok from {_st} s1)"), scaleX=1.5, scaleY=0.8, **SIZE)


def lens_sql(k1, k2):
    q = f"(select *, sqrt(dx * dx + dy * dy) as rd, sqrt(dx * dx + dy * dy) as rr from (select *, (x - 4.0) * 0.25 / 0.9 as dx, (y - 4.0) * 0.25 / 0.9 as dy from {RASTER} l0) l1)"
    for _ in range(8):
        fp = f"(1.0 + {3 * k1!r} * (rr * rr) + {5 * k2!r} * (rr * rr * rr * rr))"
        q = f"(select * exclude (rr), case when {fp} = 0 then rr else rr - (rr * (1.0 + {k1!r} * rr * rr + {k2!r} * rr * rr * rr * rr) - rd) / {fp} end as rr from {q} l2)"
    q = f"(select *, round(4 + dx * (case when rd > 0 then rr / rd else 1 end) / 0.25, 9) as fx, round(4 + dy * (case when rd > 0 then rr / rd else 1 end) / 0.25, 9) as fy from {q} l3)"
    return look("floor(fx)", "floor(fy)", inside="fx >= 0 and fx <= 7 and fy >= 0 and fy <= 7", src=q)


on_frames("lens_distortion", R.lens_distortion, lens_sql(0.3, 0.05), k1=0.3, k2=0.05, zoom=0.9, **SIZE)
on_frames("lens_distortion_pincushion", R.lens_distortion, lens_sql(-0.3, 0.0), k1=-0.3, zoom=0.9, **SIZE)
_th = "(case when atan2(y - 4.0, x - 4.0) < 0 then atan2(y - 4.0, x - 4.0) + 6.28318530718 else atan2(y - 4.0, x - 4.0) end)"
_po = f"(select *, round({_th} / 6.28318530718 * 7.0, 9) as fx, round(sqrt((x - 4.0) * (x - 4.0) + (y - 4.0) * (y - 4.0)) / 4.0 * 7.0, 9) as fy, sqrt((x - 4.0) * (x - 4.0) + (y - 4.0) * (y - 4.0)) <= 4 as ok from {RASTER} p0)"
on_frames("polar_transform", R.polar_transform, bilinear(_po), **SIZE)
_pi = f"(select *, round(4 + cos(x / 7.0 * 6.28318530718) * (y / 7.0 * 4), 9) as fx, round(4 + sin(x / 7.0 * 6.28318530718) * (y / 7.0 * 4), 9) as fy, true as ok from {RASTER} p0)"
on_frames("polar_transform_inverse", R.polar_transform, bilinear(_pi), mode="POLAR_TO_RECT", **SIZE)
_pc = repr(6.28318530718 / 6)
_an = f"(select *, round(a0 - floor(a0 / {_pc}) * {_pc}, 12) as a1, sqrt((x - 4.0) * (x - 4.0) + (y - 4.0) * (y - 4.0)) as dist from (select *, atan2(y - 4.0, x - 4.0) as a0 from {RASTER} k0) k1)"
_an = f"(select *, case when a1 > {_pc} * 0.5 then {_pc} - a1 else a1 end as ang from {_an} k2)"
on_frames("mirror_kaleidoscope", R.mirror, look(
    _clamp8.format("floor(round(cos(ang) * dist + 4, 9) + 0.5)"), _clamp8.format("floor(round(sin(ang) * dist + 4, 9) + 0.5)"), src=_an), **SIZE)
on_frames("mirror_axis", R.mirror, look("case when x > 4 then 8 - x else x end", "case when y > 4 then 8 - y else y end"), mode="BOTH", **SIZE)
_dm = f"(select *, round(x + (r / 255.0 - 0.5) * 12.0, 9) as fx, round(y + (g / 255.0 - 0.5) * 12.0, 9) as fy, true as ok from {RASTER} d0)"
on_frames("displacement_map_xy", R.displacement_map_xy, bilinear(_dm), strength=6.0, **SIZE)
_db = f"(select clip_id, frame, x, y, round(x + (mr / 255.0 - 0.5) * 12.0, 9) as fx, round(y + (mg / 255.0 - 0.5) * 12.0, 9) as fy, true as ok from {box_sql(1)} d0)"
on_frames("displacement_map_xy_blurred", R.displacement_map_xy, bilinear(_db), strength=6.0, blurRadius=1, **SIZE)
_sep = {"r": (2, 0, 1.0), "g": (0, 1, 0.8), "b": (-1, 2, 0.9), "a": (0, 0, 1.0)}
on_frames("channel_separation", R.channel_separation, f"""select {ID}, {', '.join(J(f'coalesce({k}.{k}, 0) * {o[2]}') + f' as {k}' for k, o in _sep.items())} from {RASTER} p
 {' '.join(f'left join {RASTER} {k} on {k}.clip_id = p.clip_id and {k}.frame = p.frame and {k}.x = p.x + {o[0]} and {k}.y = p.y + {o[1]}' for k, o in _sep.items())}""",
          **_sep, **SIZE)
_regions = [(0, 0, 4, 3, 3, 4, 5), (2, 1, 5, 5, 0, 2, -9), (6, 6, 2, 2, 0, 0, 40)]
_vals = ", ".join(f"({k}, {', '.join(map(str, r))})" for k, r in enumerate(_regions))


@check("glitch_blocks", f"""with p as (select * from {RASTER} z), m as (select p.clip_id, p.frame, p.x, p.y, max(k) as k from p join (values {_vals}) g(k, dx, dy, w, h, ox, oy, off)
  on x between dx and dx + w - 1 and y between dy and dy + h - 1 group by all),
 t as (select p.*, coalesce(m.k, -1) as region, coalesce(p.x - g.dx + g.ox, p.x) as sx, coalesce(p.y - g.dy + g.oy, p.y) as sy, coalesce(g.off, 0) as off
  from p left join m using (clip_id, frame, x, y) left join (values {_vals}) g(k, dx, dy, w, h, ox, oy, off) on g.k = m.k)
 select t.clip_id, t.frame, t.x, t.y, {', '.join(f'least(255, greatest(0, s.{c} + t.off)) as {c}' for c in 'rgb')}, s.a, t.region
 from t join p s on s.clip_id = t.clip_id and s.frame = t.frame and s.x = least(7, greatest(0, t.sx)) and s.y = least(7, greatest(0, t.sy))""")
def _glitch(spark, d):
    return R.region_join(V.raster_px(spark, d), _regions, **SIZE)


_mv = "(select clip_id, frame, (frame % 5 - 2) * 0.6 as ox, (frame % 3 - 1) * 0.7 as oy, (frame % 7 - 3) * 0.05 as rot, 1.0 + (frame % 4) * 0.1 as zoom from (select distinct clip_id, frame from " + RASTER + " m0) m1 where frame % 6 <> 5)"
_cs = f"""(select t.*, round((x - 3.5) / z * cos(rt) - (y - 3.5) / z * sin(rt) + 3.5 + dx, 9) as fx, round((x - 3.5) / z * sin(rt) + (y - 3.5) / z * cos(rt) + 3.5 + dy, 9) as fy from
 (select q.*, coalesce(ox, 0.0) as dx, coalesce(oy, 0.0) as dy, coalesce(rot, 0.0) as rt, coalesce(zoom, 1.0) as z from {RASTER} q left join {_mv} m using (clip_id, frame)) t)"""


@check("camera_shake", look(_clamp8.format("floor(fx + 0.5)"), _clamp8.format("floor(fy + 0.5)"), src=_cs))
def _shake(spark, d):
    frames = V.frame_vectors(spark, d).where("frame % 6 <> 5")
    moves = frames.select("clip_id", "frame", *[F.expr(e).cast("double").alias(n) for n, e in (
        ("ox", "(frame % 5 - 2) * 0.6D"), ("oy", "(frame % 3 - 1) * 0.7D"), ("rot", "(frame % 7 - 3) * 0.05D"),
        ("zoom", "1.0D + (frame % 4) * 0.1D"))])
    return R.register_frames(V.raster_px(spark, d), moves, **SIZE)


_bs = f"(select *, least(7.0, greatest(0.0, x + 0.25 * y - 0.6)) as fx, least(7.0, greatest(0.0, y * 0.9 + 0.3)) as fy, true as ok from {RASTER} b0)"
check("bilinear_nearest_sampling", bilinear(_bs))(lambda spark, d: R.sample(
    V.raster_px(spark, d), F.col("x") + F.col("y") * 0.25 - 0.6, F.col("y") * 0.9 + 0.3, **SIZE))
check("nearest_sampling", look("floor(fx + 0.5)", "floor(fy + 0.5)", src=_bs))(lambda spark, d: R.sample(
    V.raster_px(spark, d), F.col("x") + F.col("y") * 0.25 - 0.6, F.col("y") * 0.9 + 0.3, mode="NEAREST", **SIZE))
