"""Motion grids and frame timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import folds as FD
from rasterloom.operators import motion as M
from rasterloom.operators import ordered as O
from rasterloom.operators import timeline as TL
from rasterloom.sources import views as V
from rasterloom.suite.checks_d_space import SIZE
from rasterloom.suite.registry import J, L709, RASTER, check

PLANES = f"""(select *, case when d = 0 then 0.0 when ru = mx then (gu - bu) / d * 60 + (case when gu < bu then 360 else 0 end)
 when gu = mx then (2.0 + (bu - ru) / d) * 60 else (4.0 + (ru - gu) / d) * 60 end as hue, {L709} as luma,
 case when mx > 0 then d / mx * 255 else 0.0 end as hsv_saturation, mx * 255 as value,
 case when d > 0 and 1 - abs(mx + mn - 1) > 0 then d / (1 - abs(mx + mn - 1)) * 255 else 0.0 end as hsl_saturation, (mx + mn) * 0.5 * 255 as lightness
 from (select *, greatest(ru, gu, bu) as mx, least(ru, gu, bu) as mn, greatest(ru, gu, bu) - least(ru, gu, bu) as d
  from (select *, r / 255.0 as ru, g / 255.0 as gu, b / 255.0 as bu from {RASTER} c0) c1) c2)"""


@check("motion_scalar_planes", f"""select clip_id, frame, x, y, cast(r as double) as red, cast(g as double) as green, cast(b as double) as blue,
 {', '.join(f'round({c}, 5) as {c}' for c in ('luma', 'hue', 'hsv_saturation', 'value', 'hsl_saturation', 'lightness'))} from {PLANES} p""")
def _planes(spark, d):
    out = M.scalar_planes(V.raster_px(spark, d)).drop("r", "g", "b", "a")
    return out.withColumns({c: F.round(c, 5) for c in ("luma", "hue", "hsv_saturation", "value", "hsl_saturation", "lightness")})


def errors_sql(diff, src, offs, cell=4):
    vals = ", ".join(f"({dx}, {dy})" for dx, dy in offs)
    return f"""(select p.clip_id, p.frame, p.x // {cell} as bx, p.y // {cell} as by_, o.dx, o.dy, round(avg({diff}), 9) as err from {src} p cross join (values {vals}) o(dx, dy)
 join {src} h on h.clip_id = p.clip_id and h.frame = p.frame - 1 and h.x = least(7, greatest(0, p.x + o.dx)) and h.y = least(7, greatest(0, p.y + o.dy)) group by all)"""


_OFFS = [(dx, dy) for dy in (-2, -1, 0, 1, 2) for dx in (-2, -1, 0, 1, 2)]
_RGBD = "(abs(p.r - h.r) + abs(p.g - h.g) + abs(p.b - h.b)) / 3.0"
_HUED = "least(abs(p.hue - h.hue), 360 - abs(p.hue - h.hue))"


def vectors_sql(diff, src, threshold):
    return f"""(select clip_id, frame, bx, by_, v.dx, v.dy, v.err as error, sqrt(v.dx * v.dx + v.dy * v.dy) as magnitude, least(1.0, sqrt(v.dx * v.dx + v.dy * v.dy) / 2.0) as strength,
 least(1.0, greatest(0.0, ({threshold} - v.err) / {threshold})) as confidence from (select clip_id, frame, bx, by_, arg_min({{'dx': dx, 'dy': dy, 'err': err}}, {{'e': err, 'y': dy, 'x': dx}}) as v
 from {errors_sql(diff, src, _OFFS)} e group by all) q)"""


NUDGE = 3.3e-8   # block means are dyadic; this keeps exact decimal ties on one side


def rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c).cast("double") + NUDGE, 6) for c in cols}).withColumnRenamed("by", "by_")


def rsql(cols):
    return ", ".join(f"round({c} + {NUDGE:.12f}, 6) as {c}" for c in cols)


PARAMS = {"cellSize": 4, "searchRadius": 2, **SIZE}
_G = "cast(bx as int) as bx, cast(by_ as int) as by_"


@check("motion_vectors", f"select clip_id, frame, {_G}, cast(dx as int) as dx, cast(dy as int) as dy, {rsql(['error', 'magnitude', 'strength', 'confidence'])} from {vectors_sql(_RGBD, RASTER, 40.0)} z")
def _vectors(spark, d):
    return rounded(M.motion_vectors(V.raster_px(spark, d), mode="rgb", threshold=40.0, **PARAMS),
                   "error", "magnitude", "strength", "confidence")


@check("vector_estimate", f"select clip_id, frame, {_G}, cast(dx as int) as dx, cast(dy as int) as dy, {rsql(['error', 'magnitude', 'strength', 'confidence'])} from {vectors_sql(_HUED, PLANES, 90.0)} z")
def _estimate(spark, d):
    return rounded(M.motion_vectors(V.raster_px(spark, d), mode="hue", threshold=90.0, **PARAMS),
                   "error", "magnitude", "strength", "confidence")


@check("block_error", f"select clip_id, frame, {_G}, round(err + {NUDGE:.12f}, 6) as error from {errors_sql(_RGBD, RASTER, [(1, -1)])} z")
def _block_error(spark, d):
    return rounded(M.block_error(V.raster_px(spark, d), 1, -1, cellSize=4, **SIZE), "error")


_V = vectors_sql(_RGBD, RASTER, 40.0)


def _rgb_vectors(spark, d):
    return M.motion_vectors(V.raster_px(spark, d), mode="rgb", threshold=40.0, **PARAMS)


@check("vector_state_encode_decode", f"select clip_id, frame, {_G}, {rsql(['dx', 'dy', 'confidence', 'strength'])} from (select * replace (cast(dx as double) as dx, cast(dy as double) as dy) from {_V} z0) z")
def _codec(spark, d):
    return rounded(M.decode_state(M.encode_state(_rgb_vectors(spark, d)), cols=2, rows=2), "dx", "dy", "confidence", "strength")


_bl = ", ".join(f"p.{n} * 0.75 + sum(h.{n} * w) / sum(w) * 0.25 as {n}" for n in ("dx", "dy", "confidence", "error"))
_GB = f"""(select p.clip_id, p.frame, p.bx, p.by_, {_bl} from {_V} p join (select *, bx as hx, by_ as hy from {_V} h0) h on h.clip_id = p.clip_id and h.frame = p.frame
 and abs(h.hx - p.bx) <= 1 and abs(h.hy - p.by_) <= 1, lateral (select case when h.hx = p.bx and h.hy = p.by_ then 2 else 1 end as w) ww group by p.clip_id, p.frame, p.bx, p.by_, p.dx, p.dy, p.confidence, p.error)"""


@check("vector_grid_blur", f"select clip_id, frame, {_G}, {rsql(['dx', 'dy', 'confidence', 'error'])}, round(least(1.0, sqrt(dx * dx + dy * dy) / 2.0) + {NUDGE:.12f}, 6) as strength from {_GB} z")
def _grid_blur(spark, d):
    return rounded(M.blur_grid(_rgb_vectors(spark, d), cols=2, rows=2, searchRadius=2), "dx", "dy", "confidence", "error", "strength")


_tb = ", ".join(f"round(coalesce({n} * 0.6 + lag({n}) over w * 0.4, {n}) + {NUDGE:.12f}, 6) as {n}" for n in ("dx", "dy", "strength", "confidence", "error"))


@check("vector_temporal_blend", f"select clip_id, frame, {_G}, {_tb} from (select * replace (cast(dx as double) as dx, cast(dy as double) as dy) from {_V} z0) z window w as (partition by clip_id, bx, by_ order by frame)")
def _temporal_blend(spark, d):
    return rounded(M.blend_temporal(_rgb_vectors(spark, d), chunk=16), "dx", "dy", "strength", "confidence", "error")


@check("flip_dot_display")
def _flip_dots(spark, d):
    return M.flip_dots(V.raster_px(spark, d), cellSize=2, hysteresis=2.0, **SIZE)


# ---- frame timing -----------------------------------------------------------------------

FR = "(select user_id as clip_id, event_id, epoch_us(ts) as ts_us, nullif(cast(floor(value) as bigint) * 1000, 0) as dur_us from events)"
T0 = 1_704_067_200_000_000   # 2024-01-01 UTC


@check("decoded_frame_duration", f"""select clip_id, event_id, ts_us, dur_us, case when dur_us > 0 then least(greatest(1, {T0 + 30 * 86_400_000_000} - ts_us), dur_us)
 when nx is not null then greatest(1, nx - ts_us) else greatest(greatest(1, {T0 + 30 * 86_400_000_000} - ts_us), 40000) end as duration_us
 from (select *, lead(ts_us) over (partition by clip_id order by ts_us, event_id) as nx from {FR} f) q""")
def _durations(spark, d):
    return TL.frame_durations(V.decoded_frames(spark, d), fallback_us=40_000, end_us=T0 + 30 * 86_400_000_000)


@check("drop_trailing_frame", f"""select clip_id, event_id, ts_us, dur_us from (select *, row_number() over (partition by clip_id order by ts_us desc, event_id desc) as rn, count(*) over (partition by clip_id) as n from {FR} f) q where rn > 1 or n = 1""")
def _drop(spark, d):
    return TL.drop_trailing(V.decoded_frames(spark, d))


@check("delay_quantise", f"select event_id, greatest(10, {J('greatest(10, value) / 10')} * 10) as delay_ms from events")
def _delay(spark, d):
    return V.table(spark, d, "events").select("event_id", TL.quantise_delay(F.col("value")).alias("delay_ms"))


@check("identical_run_collapse", f"""with e as (select user_id as clip_id, event_id, epoch_us(ts) as ts_us, event_type as content, value from events),
 c as (select *, case when content = lag(content) over (partition by clip_id order by ts_us, event_id) then 0 else 1 end as fl from e),
 r as (select *, sum(fl) over (partition by clip_id order by ts_us, event_id) as run from c)
 select clip_id, cast(run as bigint) as run, max(content) as content, min(ts_us) as ts_us, count(*) as n, cast(sum(greatest(10, {J('greatest(10, value) / 10')} * 10)) as bigint) as delay_ms from r group by clip_id, run""")
def _runs(spark, d):
    e = V.events(spark, d).select(F.col("user_id").alias("clip_id"), "event_id", "ts_us",
                                  F.col("event_type").alias("content"), "value")
    return TL.collapse_runs(e, "content", "value")


MEDIAN = """(case when count(*) % 2 = 0 then cast(floor((list_sort(list({0}))[count(*) // 2] + list_sort(list({0}))[count(*) // 2 + 1]) / 2.0 + 0.5) as bigint) else list_sort(list({0}))[count(*) // 2 + 1] end)"""
CAD = f"""(select c.clip_id, coalesce(s.m, g.m, 40000) as cadence_us from (select distinct clip_id from {FR} f) c
 left join (select clip_id, {MEDIAN.format('dur_us')} as m from {FR} f where dur_us > 0 and clip_id % 5 <> 0 group by 1) s using (clip_id)
 left join (select clip_id, {MEDIAN.format('gap')} as m from (select clip_id, lead(ts_us) over (partition by clip_id order by ts_us, event_id) - ts_us as gap from {FR} f) q where gap > 0 group by 1) g using (clip_id))"""


def _undated(spark, d):
    """Every fifth clip states no durations."""
    return V.decoded_frames(spark, d).withColumn("dur_us", F.when(F.col("clip_id") % 5 != 0, F.col("dur_us")))


@check("cadence_inference", f"select clip_id, cadence_us from {CAD} q")
def _cadence(spark, d):
    return TL.cadence(_undated(spark, d), fallback_us=40_000)


@check("cadence_thinning", f"""with recursive f as materialized (select *, row_number() over (partition by clip_id order by ts_us, event_id) as rn, count(*) over (partition by clip_id) as n from {FR} q),
 k as (select clip_id, rn, event_id, ts_us, ts_us as kept, true as keep from f where rn = 1 union all
  select f.clip_id, f.rn, f.event_id, f.ts_us, case when f.ts_us - k.kept >= 10800000000 then f.ts_us else k.kept end, f.ts_us - k.kept >= 10800000000 from k join f on f.clip_id = k.clip_id and f.rn = k.rn + 1)
 select k.clip_id, k.event_id, k.ts_us, f.dur_us from k join f using (clip_id, rn) where k.keep or f.rn = f.n""")
def _thin(spark, d):
    fr = V.decoded_frames(spark, d)
    spacing = fr.select("clip_id").distinct().withColumn("min_us", F.lit(10_800_000_000))
    return FD.cadence_thinning(fr, spacing)


RANGES = "(select user_id as clip_id, 0.0 as start_sec, 1 + (user_id % 9) * 0.37 as end_sec from (select distinct user_id from events) u)"


@check("offline_timeline", f"""select clip_id, cast(i as int) as index, cast(floor(round(i / 12.0 * 1000000, 3) + 0.5) as bigint) as timestamp_us,
 greatest(1, cast(floor(round((case when i = n - 1 then greatest(case when rest > 0 then rest else 1 / 12.0 end, 0.000001) else 1 / 12.0 end) * 1000000, 3) + 0.5) as bigint)) as duration_us
 from (select *, greatest(0.0, end_sec - i / 12.0) as rest from (select *, unnest(range(n)) as i from (select *, greatest(1, cast(ceil(round(end_sec * 12, 9)) as int)) as n from {RANGES} r) a) b) c""")
def _timeline(spark, d):
    users = V.table(spark, d, "events").select(F.col("user_id").alias("clip_id")).distinct()
    return TL.offline_timeline(users.select("clip_id", F.lit(0.0).alias("start_sec"), (
        (F.col("clip_id") % 9) * 0.37 + 1).alias("end_sec")), fps=12)


@check("as_of_frame_selection", f"""with t as (select clip_id, i as tick, {T0} + i * 21600000000 + clip_id * 1000000 as tick_us from (select clip_id, unnest(range((min(ts_us) - {T0}) // 21600000000 - 1, (max(ts_us) - {T0}) // 21600000000 + 2)) as i from {FR} f group by 1) c)
 select clip_id, cast(tick as int) as tick, tick_us, coalesce(a.ts_us, z.ts_us) as ts_us, coalesce(a.event_id, z.event_id) as event_id from t
 asof left join (select * from {FR} f) a using (clip_id) join (select clip_id as zc, min(ts_us) as ts_us, arg_min(event_id, ts_us) as event_id from {FR} f group by 1) z on z.zc = clip_id
""".replace("asof left join (select * from", "left join lateral (select ts_us, event_id from (select * from").replace(" a using (clip_id) join", " s where s.clip_id = t.clip_id and s.ts_us <= t.tick_us order by ts_us desc, event_id desc limit 1) a on true join"))
def _asof(spark, d):
    fr = V.decoded_frames(spark, d)
    def tick(ts):
        return F.floor((ts - T0) / 21_600_000_000).cast("int")
    # from one tick before a clip's first frame to one after its last
    ends = fr.groupBy("clip_id").agg(tick(F.min("ts_us")).alias("a"), tick(F.max("ts_us")).alias("z"))
    ticks = ends.select("clip_id", F.explode(F.sequence(F.col("a") - 1, F.col("z") + 1)).alias("tick")).withColumn(
        "tick_us", F.lit(T0) + F.col("tick").cast("bigint") * 21_600_000_000 + F.col("clip_id") * 1_000_000)
    return O.asof_join(ticks, fr, ["clip_id"], left_ts="tick_us", right_ts="ts_us", payload=["event_id"],
                       width=TL.HOUR_US * 24, tie=["event_id"])


_lo, _hi = T0 + 5 * 86_400_000_000, T0 + 5 * 86_400_000_000 + 14_400_000_000
_RANGE = f"""with h as (select * from {FR} f where ts_us >= {_lo} and ts_us < {_hi})
 select * from h union all select * from {FR} f where clip_id not in (select clip_id from h)"""
check("frame_range_selection", _RANGE)(lambda spark, d: TL.select_range(V.decoded_frames(spark, d), _lo, _hi))


@check("range_fallback", """with o as (select o_custkey, o_orderkey, o_totalprice from orders), h as (select * from o where o_totalprice > 300000)
 select * from h union all select * from o where o_custkey not in (select o_custkey from h)""")
def _fallback(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return TL.with_fallback(o, o.where("o_totalprice > 300000"), ["o_custkey"])


@check("contact_sheet_layout", f"""with f as (select distinct clip_id, frame from {RASTER} p), n as (select clip_id, count(*) as n, cast(least(count(*), 6) as int) as columns from f group by 1)
 select clip_id, frame, columns, cast(ceil(n / columns) as int) as rows, frame % columns as col, frame // columns as row, (frame % columns) * 18 + 12 as left, (frame // columns) * 18 + 12 as top,
 columns * 8 + (columns - 1) * 10 + 24 as width, cast(ceil(n / columns) as int) * 8 + (cast(ceil(n / columns) as int) - 1) * 10 + 24 as height from f join n using (clip_id)""")
def _sheet(spark, d):
    return TL.contact_sheet(V.frame_vectors(spark, d).select("clip_id", "frame"), columns=6, frameWidth=8, frameHeight=8)
