"""Spectral operators and repair."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.operators import repair as RP
from rasterloom.operators import spectral as SP
from rasterloom.sources import views as V
from rasterloom.suite.checks_b_joins_aggs import RASTER_Q, on_frames
from rasterloom.suite.checks_d_space import SIZE, chans
from rasterloom.suite.registry import CL, J, L709U, MIX, RASTER, SMOOTH, U8S, check

GRID = "(select unnest(range(8)) as {0})"


def fwd(value=L709U, src=RASTER):
    """Direct double sum over all pixels of a frame."""
    ang = "(2 * pi() * (kx * x + ky * y) / 8)"
    return f"""(select clip_id, frame, kx, ky, sum(v * cos({ang})) as re, -sum(v * sin({ang})) as im from
 (select clip_id, frame, x, y, {value} as v from {src} f0) f1, {GRID.format('kx')} gx, {GRID.format('ky')} gy group by clip_id, frame, kx, ky)"""


def inv(spec):
    ang = "(2 * pi() * (kx * x + ky * y) / 8)"
    return f"""(select clip_id, frame, x, y, sum(re * cos({ang}) - im * sin({ang})) / 64 as o, sum(re * sin({ang}) + im * cos({ang})) / 64 as oi from
 {spec} i0, {GRID.format('x')} gx, {GRID.format('y')} gy group by clip_id, frame, x, y)"""


MAG = "sqrt(re * re + im * im)"
PHASE = "atan2(round(im, 9) + 0.0, round(re, 9) + 0.0)"
_L = L709U.replace("r /", "p.r /").replace("g /", "p.g /").replace("b /", "p.b /")


def relit(spec, cte=""):
    k = f"(case when {_L} > 0.0001 then o / {_L} else o end)"
    return f"""with sp as materialized {fwd()} {cte} select p.clip_id, p.frame, p.x, p.y, {chans(U8S('p.{c} * ' + k))}, p.a
 from {RASTER} p join {inv(spec)} q using (clip_id, frame, x, y)"""


def masked(mask):
    return relit(f"(select clip_id, frame, kx, ky, re * m as re, im * m as im from (select *, {mask} as m from sp) m0)")


RAD = "(sqrt(pow(least(kx, 8 - kx) / 4.0, 2) + pow(least(ky, 8 - ky) / 4.0, 2)) / sqrt(2.0))"
KX, KY = ("(case when {0} > 4 then {0} - 8 else {0} end)".format(k) for k in ("kx", "ky"))


@check("2_d_forward_transform", f"select clip_id, frame, cast(kx as int) as kx, cast(ky as int) as ky, round(re, 6) + 0.0 as re, round(im, 6) + 0.0 as im from {fwd()} q")
def _forward(spark, d):
    s = SP.luma_spectrum(V.raster_px(spark, d), **SIZE)
    return s.select("clip_id", "frame", "kx", "ky", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("re", "im")])


@check("inverse_transform", f"select clip_id, frame, x, y, round({L709U}, 6) + 0.0 as re, 0.0 as im from {RASTER} p")
def _inverse(spark, d):
    s = SP.luma_spectrum(V.raster_px(spark, d), **SIZE)
    return SP.inverse(s, **SIZE).select("clip_id", "frame", "x", "y", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("re", "im")])


@check("padding_size", "select l_orderkey, l_linenumber, cast(l_quantity as int) as n, cast(pow(2, ceil(log2(l_quantity))) as int) as padded from lineitem")
def _padding(spark, d):
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("n"), SP.padding_size(F.col("l_quantity")).alias("padded"))


def rise(lo, hi):
    return SMOOTH(repr(lo), repr(hi), RAD)


on_frames("fft_bandpass", SP.fft_bandpass, masked(rise(0.3 - 0.05, 0.3 + 0.05)), cutoff=0.3, **SIZE)
on_frames("fft_bandpass_low", SP.fft_bandpass, masked(f"(1 - {rise(0.3 - 0.05, 0.3 + 0.05)}) * 1.1"), cutoff=0.3, mode="LOW", gain=1.1, **SIZE)
on_frames("fft_bandpass_band", SP.fft_bandpass, masked(
    f"(case when kx = 0 and ky = 0 then 0.0 else {rise(0.2 - 0.05, 0.2 + 0.05)} * (1 - {rise(0.5 - 0.05, 0.5 + 0.05)}) end)"),
    cutoff=0.2, bandWidth=0.3, mode="BAND", **SIZE)
on_frames("fft_radial_notch", SP.fft_radial_notch, masked(
    f"(1 - {rise(0.4 - 0.15, 0.4)} * (1 - {rise(0.4, 0.4 + 0.15)}) * 0.9)"), ring=0.4, ring_width=0.3, depth=0.1, **SIZE)
_aw = f"(degrees(atan2({KY}, {KX})) - 30)"
_aw = f"({_aw} - floor({_aw} / 180.0) * 180.0)"
_aw = f"round(least({_aw}, 180.0 - {_aw}), 9)"
on_frames("fft_angular_wedge", SP.fft_angular_wedge, masked(
    f"(case when kx = 0 and ky = 0 then 1.0 else 1.0 - {SMOOTH('25.5', '34.5', _aw)} end)"), angle=30.0, wedge=30.0, softness=9.0, **SIZE)
on_frames("fft_spectral_gate", SP.fft_spectral_gate, relit(
    f"""(select clip_id, frame, kx, ky, re * m as re, im * m as im from (select sp.*, case when kx = 0 and ky = 0 then 1.0 else {SMOOTH('0.0175', '0.0225', f'{MAG} / greatest(dc, 0.000001)')} end as m
 from sp join (select clip_id, frame, {MAG} as dc from sp where kx = 0 and ky = 0) d0 using (clip_id, frame)) m0)"""), **SIZE)


@check("fft_radial_profile", f"""select clip_id, frame, {J(f'sqrt({KX} * {KX} + {KY} * {KY})')} as radius, count(*) as n, round(avg(re * re + im * im), 6) as power,
 round(least(1.0, greatest(0.0, ln(1 + avg(re * re + im * im)) / ln(100001.0))), 6) as level from {fwd()} q group by all""")
def _profile(spark, d):
    return SP.fft_radial_profile(V.raster_px(spark, d), **SIZE).withColumns(
        {c: F.round(c, 6) for c in ("power", "level")})


def plot(name, op, sql_cols, cols, **kw):
    sel = ", ".join(f"round({e}, 6) + 0.0 as {c}" for c, e in zip(cols, sql_cols))
    check(name, f"select clip_id, frame, cast((kx + 4) % 8 as int) as kx, cast((ky + 4) % 8 as int) as ky, {sel} from {fwd()} q")(
        lambda spark, d: op(V.raster_px(spark, d), **kw, **SIZE).withColumns(
            {c: F.round(c, 6) + F.lit(0.0) for c in cols}))


plot("fft_magnitude_plot", SP.fft_magnitude_plot, [f"ln(1 + {MAG} * 1000) / ln(1001.0)"], ["level"])
plot("fft_phase_plot", SP.fft_phase_plot, [PHASE, CL(f"ln(1 + {MAG} * 100) / ln(101.0)")], ["phase", "weight"])
plot("fft_component_plot", SP.fft_component_plot, ["re * 0.3"], ["component"])
plot("fft_component_plot_imaginary", SP.fft_component_plot, ["im * 0.3"], ["component"], component="IMAG")


def polar(m, p):
    return relit(f"(select clip_id, frame, kx, ky, ({m}) * cos({p}) as re, ({m}) * sin({p}) as im from sp)")


on_frames("fft_dephase", SP.fft_dephase, polar(MAG, f"({PHASE} * 0.4)"), amount=0.6, **SIZE)
on_frames("fft_phase_only", SP.fft_phase_only, polar(
    f"case when kx = 0 and ky = 0 then {MAG} else {MIX(MAG, '2.5', '0.8')} end", PHASE), amount=0.8, gain=2.5, **SIZE)
_hm = f"(0.7 * (1.0 - {rise(0.25, 0.35)}) + 1.4 * {rise(0.25, 0.35)})"
_o = "(least(greatest(exp(o) - 0.01, 0.0), 1.0))"
_hk = f"(case when {_L} > 0.0001 then {_o} / {_L} else {_o} end)"
on_frames("fft_homomorphic", SP.fft_homomorphic, f"""with sp as materialized {fwd(f'ln({L709U} + 0.01)')}
 select p.clip_id, p.frame, p.x, p.y, {chans(U8S('p.{c} * 0.2 + least(greatest(p.{c} * ' + _hk + ', 0.0), 255.0) * 0.8'))}, p.a from {RASTER} p
 join {inv(f'(select clip_id, frame, kx, ky, re * m as re, im * m as im from (select *, {_hm} as m from sp) m0)')} q using (clip_id, frame, x, y)""",
          lowGain=0.7, highGain=1.4, cutoff=0.3, amount=0.8, **SIZE)
_qd = "sqrt(pow(case when x > 4 then x - 8 else x end, 2) + pow(case when y > 4 then y - 8 else y end, 2))"


@check("fft_cepstrum", f"""with sp as materialized {fwd()} select clip_id, frame, cast(x as int) as x, cast(y as int) as y, round(abs(o) * {SMOOTH('2.0', '10.0', _qd)}, 6) as cepstrum
 from {inv(f'(select clip_id, frame, kx, ky, ln({MAG} + 1) as re, 0.0 as im from sp)')} q""")
def _cepstrum(spark, d):
    return SP.fft_cepstrum(V.raster_px(spark, d), **SIZE).withColumn("cepstrum", F.round("cepstrum", 6))


_gh = f"exp(-2 * 9.8696044 * 0.36 * (pow({KX} / 8.0, 2) + pow({KY} / 8.0, 2)))"
on_frames("fft_deconvolve", SP.fft_deconvolve, masked(
    f"(case when kx = 0 and ky = 0 then 1.0 else {_gh} / greatest({_gh} * {_gh} + 0.05, 0.000001) end)"), sigma=0.6, noise=0.05, **SIZE)
_ma = f"(pi() * 2.5 * ({KX} / 8.0 * cos(radians(20)) + {KY} / 8.0 * sin(radians(20))))"
_mh = f"(case when abs({_ma}) < 0.00001 then 1.0 else sin({_ma}) / {_ma} end)"
on_frames("fft_deconvolve_motion", SP.fft_deconvolve, masked(
    f"(case when kx = 0 and ky = 0 then 1.0 else {_mh} / greatest({_mh} * {_mh} + 0.05, 0.000001) end)"),
    kernel="MOTION", motionLen=2.5, motionAngle=20.0, noise=0.05, **SIZE)


def wrap(e):
    return f"(cast(floor(round({e} - floor({e} / 8.0) * 8.0, 9)) as int) % 8)"


def sampled_sql(grid):
    return f"""with sp as materialized {fwd()} select sp.clip_id, sp.frame, cast(g.u as int) as u, cast(g.v as int) as v, round(ln(1 + {MAG} * 1000) / ln(1001.0), 6) as level
 from ({grid}) g join sp on sp.kx = {wrap('g.fx')} and sp.ky = {wrap('g.fy')}"""


_lr = "exp(ln(0.5) + (ln(6.0) - ln(0.5)) * (1 - v / 12.0))"
check("fft_log_polar", sampled_sql(f"select u, v, {_lr} * cos(u / 12.0 * pi()) as fx, {_lr} * sin(u / 12.0 * pi()) as fy from (select unnest(range(12)) as u) a, (select unnest(range(12)) as v) b"))(
    lambda spark, d: SP.fft_log_polar(V.raster_px(spark, d), rMax=6.0, n_theta=12, n_radius=12, **SIZE).withColumn("level", F.round("level", 6)))
check("fft_polar_heatmap", sampled_sql("""select u, v, rn * 4 * cos(th) as fx, rn * 4 * sin(th) as fy from (select u, v, sqrt(pow(u - 8.0, 2) + pow(v - 8.0, 2)) / 8.0 as rn, atan2(v - 8.0, u - 8.0) as th
 from (select unnest(range(16)) as u) a, (select unnest(range(16)) as v) b) c where rn <= 1"""))(
    lambda spark, d: SP.fft_polar_heatmap(V.raster_px(spark, d), **SIZE).withColumn("level", F.round("level", 6)))


@check("spectrogram", f"""with s as (select clip_id, frame, x, bin, log10(1 + 100 * sqrt(pow(sum(v * cos(2 * pi() * bin * y / 8)), 2) + pow(sum(v * sin(2 * pi() * bin * y / 8)), 2)) / 8) as mag
 from (select clip_id, frame, x, y, {L709U} as v from {RASTER} q) p, (select unnest(range(6)) as bin) b group by all)
 select clip_id, frame, x, cast(bin as int) as bin, round(mag / max(mag) over (partition by clip_id, frame, x), 6) as level from s""")
def _spectrogram(spark, d):
    return SP.spectrogram(V.raster_px(spark, d), freqBins=6, **SIZE).withColumn("level", F.round("level", 6))


# ---- repair -----------------------------------------------------------------------------

_masks = "(select clip_id, frame, cast((frame * 37 + clip_id * 11) % 255 + 1 as int) as mask from (select distinct clip_id, frame from " + RASTER + " m0) m1 where frame % 4 <> 0)"


def _mask_table(spark, d):
    return V.frame_vectors(spark, d).where("frame % 4 <> 0").select(
        "clip_id", "frame", F.expr("cast((frame * 37 + clip_id * 11) % 255 + 1 as int)").alias("mask"))


_rot = {"r": "(((m << 1) | (m >> 7)) & 255)", "g": "m", "b": "(((m << 7) | (m >> 1)) & 255)"}
_bsrc = f"(select q.*, coalesce(mask, 0) as m, lag(r) over w as pr, lag(g) over w as pg, lag(b) over w as pb from {RASTER} q left join {_masks} k using (clip_id, frame) window w as (partition by clip_id, x, y order by frame))"
for _mode, _fmt in (("DROP", "{c} & (255 - {m})"), ("FLIP", "xor({c}, {m})"),
                    ("FREEZE", "({c} & (255 - {m})) | coalesce(p{c} & {m}, 0)")):
    check("bitplane_dropout" if _mode == "DROP" else f"bitplane_{_mode.lower()}",
          f"select clip_id, frame, x, y, {', '.join(f'cast({_fmt.format(c=c, m=_rot[c])} as int) as {c}' for c in 'rgb')}, a from {_bsrc} z")(
        lambda spark, d, m=_mode: RP.bitplane_dropout(V.raster_px(spark, d), _mask_table(spark, d), mode=m, chunk=16))

_bad = "((frame * 3 + clip_id + (y // 2) * 5) % 7 = 0)"


def _damaged(spark, d, conceal):
    """Expected checksums come from the sound frames; the damaged copy fails them."""
    px = V.raster_px(spark, d)
    expected = RP.stripe_checksums(px, 2)
    hit = F.expr("(frame * 3 + clip_id + floor(y / 2) * 5) % 7 = 0")
    broken = px.withColumns({c: F.when(hit, F.lit(255) - F.col(c)).otherwise(F.col(c)) for c in "rgb"})
    return RP.crc_stripe_reject(broken, expected, height=8, stripeHeight=2, conceal=conceal, chunk=16)


_psrc = f"(select *, {_bad} as bad, case when {_bad} then 255 - r else r end as r1, case when {_bad} then 255 - g else g end as g1, case when {_bad} then 255 - b else b end as b1 from {RASTER} c0)"
_hold = "(partition by clip_id, x, y order by frame rows between unbounded preceding and current row)"
_cases = {
    "HOLD": (f"coalesce(last(case when not bad then {{c}}1 end ignore nulls) over {_hold}, 0)", "crc_stripe_reject"),
    "BLACK": ("case when bad then 0 else {c}1 end", "crc_stripe_black"),
    "ABOVE": ("case when bad then coalesce(lag({c}1) over (partition by clip_id, frame, x order by y), {c}1) else {c}1 end", "crc_stripe_above")}
for _mode, (_fmt, _name) in _cases.items():
    check(_name, f"select clip_id, frame, x, y, {chans(_fmt)}, a from {_psrc} z")(
        lambda spark, d, m=_mode: _damaged(spark, d, m))
_good = "not (" + _bad.replace("y", "h") + ")"   # of row h of the frame
_from = f"list_min(list_transform(list_filter(range(0, 8), lambda h: {_good}), lambda h: abs(h - y) * 16 + h))"   # nearest, then highest row
check("crc_stripe_nearest", f"""select clip_id, frame, x, y, coalesce(case when bad then px[i + 1] else r end, 0) as r, coalesce(case when bad then px[(i + 21) % 64 + 1] else g end, 0) as g,
 coalesce(case when bad then px[(i + 42) % 64 + 1] else b end, 0) as b, a from (select *, {_bad} as bad, cast({_from} % 16 * 8 + x as int) as i from {RASTER_Q} c0) z""")(
    lambda spark, d: _damaged(spark, d, "NEAREST"))

_i = "(y * 8 + x)"
_w = "(partition by clip_id, frame order by y * 8 + x)"
on_frames("data_bend", RP.data_bend, f"select clip_id, frame, x, y, {chans('coalesce(least(255, ' + J('{c} + lag({c}, 11) over ' + _w + ' * 0.5') + '), {c})')}, a from {RASTER} p", offset=11, **SIZE)


def reverb_sql():
    src = f"(select *, {', '.join(f'lag({c}, {7 * k}) over {_w} as {c}{k}' for c in 'rgb' for k in range(1, 6))} from {RASTER} v0)"
    for k in range(1, 6):
        reps = ", ".join(f"coalesce(least(255, {J(f'{c} + {c}{k} * {0.5 * 0.6 ** k!r}')}), {c}) as {c}" for c in "rgb")
        src = f"(select * replace ({reps}) from {src} v{k})"
    return f"select clip_id, frame, x, y, r, g, b, a from {src} z"


on_frames("data_bend_reverb", RP.data_bend, reverb_sql(), effect="REVERB", offset=7, **SIZE)
on_frames("data_bend_bitcrush", RP.data_bend, f"select clip_id, frame, x, y, {chans('least(255, first(' + J('floor({c} / 8.0 + 0.5) * 8.0') + ') over (partition by clip_id, frame, ' + _i + ' // 5 order by ' + _i + '))')}, a from {RASTER} p",
          effect="BITCRUSH", intensity=0.5, offset=50, **SIZE)
_p = f"(case when ({_i} // 10) % 2 = 0 then ({_i} // 10) * 10 + least(({_i} // 10) * 10 + 10, 64) - 1 - {_i} else {_i} end)"
on_frames("data_bend_reverse", RP.data_bend, f"select clip_id, frame, cast({_p} % 8 as int) as x, cast({_p} // 8 as int) as y, r, g, b, a from {RASTER} p", effect="REVERSE", offset=10, **SIZE)
