"""Operators over ordered frames.  The SQL states each one as a plain self-join over history."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import folds as FD
from rasterloom.operators import temporal as TP
from rasterloom.sources import views as V
from rasterloom.suite.checks_a_pixel import on_raster
from rasterloom.suite.registry import CL, FU, J, L709U, RASTER, SMOOTH, U8S, check, each, raster_sql, tile_hash_sql

SAME = "h.clip_id = p.clip_id and h.x = p.x and h.y = p.y"
ID = "p.clip_id, p.frame, p.x, p.y"


def ema_pre(alpha=0.1, src=RASTER):
    """Pixels plus the EMA each frame sees (er, eg, eb; null at frame 0)."""
    rho = 1 - alpha
    w = f"case when h.frame = 0 then pow({rho!r}, p.frame - 1) else {alpha!r} * pow({rho!r}, p.frame - 1 - h.frame) end"
    sums = ", ".join(f"sum(h.{c} * ({w})) as e{c}" for c in "rgb")
    return f"""(select {ID}, p.r, p.g, p.b, p.a, {sums} from {src} p left join {src} h on {SAME} and h.frame < p.frame
 group by {ID}, p.r, p.g, p.b, p.a)"""


PREV = f"""(select *, lag(r) over w as pr, lag(g) over w as pg, lag(b) over w as pb from {RASTER} p0
 window w as (partition by clip_id, x, y order by frame))"""


@check("previous_input_previous_output_ema_contract", f"""select e.clip_id, e.frame, e.x, e.y, e.r, e.g, e.b, e.a, q.pr as prev_r, q.pg as prev_g, q.pb as prev_b,
 round(er, 6) as ema_r, round(eg, 6) as ema_g, round(eb, 6) as ema_b from {ema_pre()} e join {PREV} q using (clip_id, frame, x, y)""")
def _contract(spark, d):
    out = TP.frame_state(V.raster_px(spark, d))
    return out.withColumns({f"ema_{c}": F.round(f"ema_{c}", 6) for c in "rgb"})


DIFF = "((abs(r - er) + abs(g - eg) + abs(b - eb)) / 3.0)"
PDIFF = "((abs(r - pr) + abs(g - pg) + abs(b - pb)) / 3.0)"
_m = CL(f"({DIFF} - 4) / 80.0 * 6")


def motion_case(c, shown, bg):
    return f"case when er is null then {U8S(f'{c} * 0.3')} when {DIFF} < 4 then {bg} else {shown} end"


on_raster("motion_analysis", TP.motion_analysis, raster_sql(*[
    motion_case(c, U8S(f"{_m} * 255.0"), bg) for c, bg in zip("rgb", (1, 2, 3))], pre=ema_pre()),
    threshold=4, sensitivity=6, backgroundColor=(1, 2, 3))


def heat_sql(t, k):
    s = [f"({t} * 4.0)", f"(({t} - 0.25) * 4.0)", f"(({t} - 0.5) * 4.0)", f"(({t} - 0.75) * 4.0)"]
    four = [(f"{s[0]} * 100.0", f"{s[1]} * 155.0 + 100.0", "255.0", "255.0"),
            ("0.0", f"{s[1]} * 50.0", f"{s[2]} * 150.0 + 50.0", f"{s[3]} * 55.0 + 200.0"),
            (f"{s[0]} * 150.0", f"150.0 - {s[1]} * 100.0", f"50.0 - {s[2]} * 50.0", f"{s[3]} * 200.0")][k]
    return f"(case when {t} < 0.25 then {four[0]} when {t} < 0.5 then {four[1]} when {t} < 0.75 then {four[2]} else {four[3]} end)"


on_raster("motion_analysis_heat", TP.motion_analysis, raster_sql(*[
    motion_case(c, U8S(heat_sql(_m, k)), 0) for k, c in enumerate("rgb")], pre=ema_pre()),
    threshold=4, sensitivity=6, renderMode="HEATMAP")


def ramp_sql(m, pieces, k):
    """Pieces as (end, start, colour at the start, slope per unit) in plain numbers."""
    arms = " ".join(f"when t < {end} then {at[k]}.0 + (t - {start}) * 3.0 * ({slope[k]}.0)" for end, start, at, slope in pieces)
    return f"(select case {arms} end from (select round(least(1.0, greatest(0.0, {m})), 9) as t) tt)"


for _map, _pieces in (
        ("VIRIDIS", [(0.33, 0.0, (68, 1, 84), (-40, 120, 80)), (0.66, 0.33, (28, 121, 164), (60, 70, -80)), (1.5, 0.66, (88, 191, 84), (165, 40, -40))]),
        ("HOT", [(0.33, 0.0, (0, 0, 0), (255, 0, 0)), (0.66, 0.33, (255, 0, 0), (0, 255, 0)), (1.5, 0.66, (255, 255, 0), (0, 0, 255))])):
    on_raster(f"motion_analysis_heat_{_map.lower()}", TP.motion_analysis, raster_sql(*[
        motion_case(c, U8S(ramp_sql(_m, _pieces, k)), 0) for k, c in enumerate("rgb")], pre=ema_pre()),
        threshold=4, sensitivity=6, renderMode="HEATMAP", colorMap=_map)
on_raster("motion_analysis_previous", TP.motion_analysis, raster_sql(*[
    f"case when pr is null then {U8S(f'{c} * 0.3')} when {PDIFF} < 4 then 0 else {U8S(f'64 + {PDIFF} * 3.0')} end" for c in "rgb"], pre=PREV),
    threshold=4, renderMode="DIFFERENCE", source="PREVIOUS")


def heat_sql(accum, cool):
    return f"""with recursive q as materialized (select *, coalesce({PDIFF}, 0.0) as d from {PREV} z),
 f as (select clip_id, frame, x, y, r, g, b, a, least(1.0, d / 255.0 * {accum!r}) as heat from q where frame = 0 union all
  select q.clip_id, q.frame, q.x, q.y, q.r, q.g, q.b, q.a, least(1.0, greatest(0.0, f.heat * (1 - {cool!r}) + q.d / 255.0 * {accum!r}))
  from f join q on q.clip_id = f.clip_id and q.x = f.x and q.y = f.y and q.frame = f.frame + 1)
 select clip_id, frame, x, y, r, g, b, a, round(heat, 6) as heat from f"""


@check("motion_analysis_accumulated", heat_sql(0.05, 0.01))
def _heat(spark, d):
    out = TP.motion_analysis(V.raster_px(spark, d), source="PREVIOUS", renderMode="ACCUMULATED_HEAT")
    return out.withColumn("heat", F.round("heat", 6))


@check("motion_analysis_accumulated_full", heat_sql(6.0, 0.2))
def _full_heat(spark, d):
    """Motion that keeps reaching the ceiling and cools from there."""
    out = TP.motion_analysis(V.raster_px(spark, d), source="PREVIOUS", renderMode="ACCUMULATED_HEAT", accumRate=6.0, coolRate=0.2)
    return out.withColumn("heat", F.round("heat", 6))


_mv = SMOOTH("3.0", "13.0", DIFF)
on_raster("scene_separation", TP.scene_separation, raster_sql(
    "r", "g", "b", a=f"case when er is null then 255 else {J(f'{_mv} * 255.0 + 0.000000001')} end", pre=ema_pre()), threshold=8, feather=5)
on_raster("scene_separation_background", TP.scene_separation, raster_sql(*[
    f"case when er is null then {c} else {U8S(f'e{c} * (1 - {_mv}) + (e{c} * 0.98 + {c} * 0.02) * {_mv}')} end" for c in "rgb"], pre=ema_pre()),
    threshold=8, feather=5, mode="BACKGROUND")
_frozen = f"(select e.*, z.r as zr, z.g as zg, z.b as zb from {ema_pre()} e join {RASTER} z on z.clip_id = e.clip_id and z.x = e.x and z.y = e.y and z.frame = 0)"
on_raster("scene_separation_freeze", TP.scene_separation, raster_sql(*[
    f"case when er is null then {c} else {U8S(f'z{c} * (1 - {_mv}) + {c} * {_mv}')} end" for c in "rgb"], pre=_frozen),
    threshold=8, feather=5, mode="FREEZE")
on_raster("foreground_rows", TP.foreground_rows, raster_sql("r", "g", "b", pre=ema_pre()) + f" where er is not null and {_mv} > 0.5",
          threshold=8, feather=5)


def decay_sql(term, rho, pre):
    """max over history of term * rho^age; `term` maps a channel to SQL over alias h."""
    vals = ", ".join(f"{U8S(f'max(({term(c)}) * pow({r!r}, p.frame - h.frame))')} as {c}" for c, r in zip("rgb", rho))
    return f"select {ID}, {vals}, p.a from {pre} p join {pre} h on {SAME} and h.frame <= p.frame group by {ID}, p.a"


on_raster("temporal_edge", TP.temporal_edge, decay_sql(
    lambda c: f"coalesce(least(greatest(greatest(abs(h.{c} - h.p{c}) - 6.0, 0.0) * 3.0, 0.0), 255.0), 0.0)", (0.92,) * 3, PREV), threshold=6)
on_raster("temporal_edge_plain", TP.temporal_edge, raster_sql(*each(
    U8S("coalesce(greatest(abs({c} - p{c}) - 6.0, 0.0) * 3.0, 0.0)")), pre=PREV), threshold=6, accumulate=False)
on_raster("phosphor_decay", TP.phosphor_decay, decay_sql(lambda c: f"h.{c}", (0.85, 0.95, 0.8), RASTER))
_w = "over (partition by clip_id, x, y order by frame rows between 4 preceding and current row)"
on_raster("long_exposure_shutter", TP.long_exposure, raster_sql(*each(U8S(f"avg({{c}}) {_w}"))), mode="SHUTTER", windowSize=5, chunk=16)


def leaky_sql(retain):
    w = f"case when h.frame = 0 then pow({retain!r}, p.frame) else {1 - retain!r} * pow({retain!r}, p.frame - h.frame) end"
    vals = ", ".join(f"{U8S(f'sum(h.{c} * ({w}))')} as {c}" for c in "rgb")
    return f"select {ID}, {vals}, p.a from {RASTER} p join {RASTER} h on {SAME} and h.frame <= p.frame group by {ID}, p.a"


on_raster("long_exposure", TP.long_exposure, leaky_sql(0.7), blendFactor=0.7)
on_raster("long_exposure_running", TP.long_exposure, leaky_sql(0.95), mode="RUNNING")
on_raster("long_exposure_max", TP.long_exposure, decay_sql(
    lambda c: f"case when (h.r + h.g + h.b) / 3.0 >= 130 or h.frame = 0 then h.{c} else 0 end", (0.95,) * 3, RASTER),
    mode="MAX", brightnessThreshold=130)


def fold_sql(init, step, frames="clip_id, x, y, a"):
    """A left fold over the frame list of each pixel, by recursion on the frame number."""
    return f"""with recursive p as materialized (select * from {RASTER} q), f as (select clip_id, frame, x, y, {init} from p where frame = 0
 union all select p.clip_id, p.frame, p.x, p.y, {step} from f join p on p.clip_id = f.clip_id and p.x = f.x and p.y = f.y and p.frame = f.frame + 1)"""


_add = ", ".join(f"least(255.0, f.y{c} * 0.95 + p.{c} * (case when (p.r + p.g + p.b) / 3.0 >= 125 then 0.3 else 0.0 end)) as y{c}" for c in "rgb")
on_raster("long_exposure_additive", TP.long_exposure,
          fold_sql("cast(r as double) as yr, cast(g as double) as yg, cast(b as double) as yb, a", _add + ", p.a")
          + f" select clip_id, frame, x, y, {U8S('yr')} as r, {U8S('yg')} as g, {U8S('yb')} as b, a from f",
          mode="ADDITIVE", brightnessThreshold=125)
on_raster("echo_combiner", TP.echo_combiner, raster_sql(*each(
    f"case when er is null then {{c}} else {U8S('{c} + abs({c} - e{c}) * 2.0')} end"), pre=ema_pre()))

_cap = f"{RASTER} p join {RASTER} h on {SAME} and h.frame <= p.frame and h.frame % 3 = 0 and h.frame > p.frame - 12"
on_raster("chronophotography", TP.chronophotography, f"""select {ID}, max(h.r) as r, max(h.g) as g, max(h.b) as b, p.a from {_cap} group by {ID}, p.a""",
          exposures=4, interval=3, chunk=16)
_wt = "(h.frame // 3 - greatest(0, p.frame // 3 - 3) + 1)"
on_raster("chronophotography_average", TP.chronophotography, f"""select {ID}, {', '.join(U8S(f'sum(h.{c} * {_wt}) / sum({_wt})') + f' as {c}' for c in 'rgb')}, p.a from {_cap} group by {ID}, p.a""",
          exposures=4, interval=3, blendMode="AVERAGE", fadeMode="TAIL", chunk=16)
_far = "(e.er is null or (abs(h.r - e.er) + abs(h.g - e.eg) + abs(h.b - e.eb)) / 3.0 >= 15.0)"
on_raster("chronophotography_isolated", TP.chronophotography, f"""select {ID}, {', '.join(f'coalesce(min(h.{c}) filter (where {_far}), 255) as {c}' for c in 'rgb')}, p.a
 from {_cap} join {ema_pre()} e on e.clip_id = p.clip_id and e.x = p.x and e.y = p.y and e.frame = p.frame group by {ID}, p.a""",
          exposures=4, interval=3, blendMode="DARKEN", isolateSubject=True, chunk=16)
_med = "list_sort(list({c}) over (partition by clip_id, x, y order by frame rows between 4 preceding and current row))"
on_raster("time_median", TP.time_median, raster_sql(*each(f"{_med}[least(frame + 1, 5) // 2 + 1]")), chunk=16)


def delay_sql(off, pre=RASTER):
    return f"""select {ID}, h.r, h.g, h.b, p.a from (select *, cast({off} as int) as off from {pre} o) p join {RASTER} h on {SAME} and h.frame = p.frame - p.off"""


_have = "(least(frame + 1, 30) - 1)"
on_raster("slit_scan", TP.slit_scan, delay_sql(f"{_have} - floor(x * {_have} / 7.0)"), width=8, height=8)
on_raster("slit_scan_rows_reversed", TP.slit_scan, delay_sql(f"floor(y * {_have} / 7.0)"), width=8, height=8,
          direction="VERTICAL", reverse=True)
on_raster("pov_bands", TP.pov_bands, delay_sql("least(least(frame + 1, 10) - 1, least(3, y // 2) * 3)"), height=8, bands=4)
on_raster("time_warp_displacement", TP.time_warp_displacement, delay_sql(
    f"least(least(frame + 1, 16) - 1, floor({L709U} * (least(frame + 1, 16) - 1) + 0.5))"), width=8, height=8)
on_raster("time_mosaic", TP.time_mosaic, delay_sql(
    "least(floor(sqrt(pow(x // 2 - 2, 2) + pow(y // 2 - 2, 2)) / sqrt(8.0) * 9), least(frame + 1, 10) - 1)"),
    width=8, height=8, tileSize=2, pattern="RADIAL")
on_raster("time_mosaic_hashed", TP.time_mosaic, delay_sql(f"least(floor({tile_hash_sql('x // 2', 'y // 2')} * 10), least(frame + 1, 10) - 1)"),
          width=8, height=8, tileSize=2)
on_raster("stop_motion", TP.stop_motion, delay_sql("frame % 6"))
on_raster("keyframe_smear", TP.keyframe_smear, f"""select {ID}, {', '.join(U8S(f'h.{c} * 0.65 + p.{c} * 0.35') + f' as {c}' for c in 'rgb')}, p.a
 from {RASTER} p join {RASTER} h on {SAME} and h.frame = p.frame - p.frame % 8""")

_block = "partition by clip_id, frame, x // 4, y // 4"
on_raster("motion_pixelate", TP.motion_pixelate, raster_sql(*each(
    f"case when coalesce(avg({DIFF}) over ({_block}) > 16, false) then {J(f'avg({{c}}) over ({_block})')} else {{c}} end"), pre=ema_pre()),
    blockSize=4, threshold=16)

_t = f"{CL(f'floor({{0}} * 4.0 + 0.5)', '0.0', '4.0')}"


def _target(alias):
    lum = f"(0.2126 * ({alias}r / 255.0) + 0.7152 * ({alias}g / 255.0) + 0.0722 * ({alias}b / 255.0))"
    return "(" + _t.replace("{0}", lum) + ")"


_gap = f"(abs({_target('p.')} - f.band) / 4.0)"
_push = f"(f.pressure + (({_gap} - 2 / 255.0) / (1 - 2 / 255.0) + 0.15) * 0.6)"
_moves = f"({_target('p.')} <> f.band and {_gap} > 2 / 255.0)"
on_raster("poster_hold", FD.poster_hold, fold_sql(
    f"{_target('')} as band, cast(0 as double) as pressure, r, g, b, a",
    f"""case when {_moves} and {_push} >= 1.0 then {_target('p.')} else f.band end as band,
 case when {_target('p.')} = f.band then greatest(0.0, f.pressure - 0.3) when {_moves} then (case when {_push} >= 1.0 then 0.0 else {_push} end)
  else greatest(0.0, f.pressure - 0.15) end as pressure, p.r, p.g, p.b, p.a""")
    + f""" select clip_id, frame, x, y, {', '.join(FU(f'{c} / 255.0 * (band / 4.0 / greatest(1 / 255.0, {L709U}))') + f' as {c}' for c in 'rgb')}, a, cast(band as int) as band from f""",
    holdThreshold=2.0, releaseSpeed=0.6)


@check("time_mosaic_stabiliser", f"""with recursive q as (select clip_id, x // 4 as bx, y // 4 as by_, frame, round(coalesce(avg({PDIFF}), 255.0), 9) as m from {PREV} z group by all),
 f as (select clip_id, bx, by_, frame, frame as shown, 0 as age from q where frame = 0 union all
  select q.clip_id, q.bx, q.by_, q.frame, case when q.m > 22 or f.age >= 4 then q.frame else f.shown end,
   case when q.m > 22 or f.age >= 4 then 0 else f.age + 1 end from f join q on q.clip_id = f.clip_id and q.bx = f.bx and q.by_ = f.by_ and q.frame = f.frame + 1)
 select {ID}, h.r, h.g, h.b, p.a from {RASTER} p join f on f.clip_id = p.clip_id and f.bx = p.x // 4 and f.by_ = p.y // 4 and f.frame = p.frame
 join {RASTER} h on {SAME} and h.frame = f.shown""")
def _stabiliser(spark, d):
    return FD.tile_stabiliser(V.raster_px(spark, d), tileSize=4, motionThreshold=22, holdFrames=4)


@check("state_reset_on_timeline_restart", """with e as (select user_id, event_id, ts, event_id % 17 as idx from events),
 l as (select *, lag(idx) over (partition by user_id order by ts, event_id) as p from e)
 select user_id, event_id, cast(idx as bigint) as idx, cast(sum(case when idx < p then 1 else 0 end) over (partition by user_id order by ts, event_id) as bigint) as session from l""")
def _resets(spark, d):
    e = V.events(spark, d).select(
        "user_id", "event_id", "ts", F.pmod("event_id", F.lit(17)).alias("idx"),
        F.floor(F.col("ts_us") / 86_400_000_000).alias("_day"))
    return TP.reset_sessions(e, ["user_id"], "_day", ["ts", "event_id"], "idx").select(
        "user_id", "event_id", "idx", F.col("session").cast("bigint").alias("session"))
