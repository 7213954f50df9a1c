"""Signal metrics in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import folds as FD
from rasterloom.operators import ordered as O
from rasterloom.operators import signals as S
from rasterloom.operators import timeline as TL
from rasterloom.operators.lineage import cut_lineage
from rasterloom.sources import views as V
from rasterloom.suite.registry import check

HOP = 3_600_000_000
SIG = """(select event_id, epoch_us(ts) as ts_us, cast(user_id % 2 as int) as channel, value as sample, epoch_us(ts) // 3600000000 as hop,
 case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as bin from events)"""
SPEC = f"""(select g.channel, g.hop, g.bin, least(1.0, coalesce(c.n, 0) / 4.0) as mag from
 (select channel, unnest(range(a, b + 1)) as hop, bin from (select channel, min(hop) as a, max(hop) as b from {SIG} s group by 1) e, (select unnest(range(5)) as bin) t) g
 left join (select channel, hop, bin, count(*) as n from {SIG} s group by all) c using (channel, hop, bin))"""


def slots(spark, d):
    return S.slots(V.signal(spark, d), HOP, mid=50, scale=100)


def series(spark, d):
    return S.series(slots(spark, d), full_scale=4.0)


def rnd(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def soft(df, *cols):
    """Rounded with an upward tolerance, so that an exact half does not depend on the last bit."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in cols})


def r6(*cols):
    return ", ".join(f"round({e}, 6) as {n}" for e, n in cols)


def ema_sql(src, col, keep, keys="channel"):
    """Unrolled recurrence from zero: sum of (1 - keep) * keep^age * x."""
    on = " and ".join(f"h.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    sel = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"(select {sel}, p.hop, sum(h.{col} * {1 - keep!r} * pow({keep!r}, p.hop - h.hop)) as e from {src} p join {src} h on {on} and h.hop <= p.hop group by {sel}, p.hop)"


@check("spectrum_smoothing", f"select channel, bin, hop, round(e, 6) as smooth from {ema_sql(SPEC, 'mag', 0.82, 'channel, bin')} q")
def _smooth(spark, d):
    out = S.dense(S.smoothed_spectrum(series(spark, d)), {"smooth": 0.82}).withColumn("bin", F.col("bin").cast("bigint"))
    return rnd(out, "smooth").select("channel", "bin", "hop", "smooth")


@check("level_rms", f"select channel, hop, round(least(1.0, sqrt(avg((sample - 50) / 100.0 * ((sample - 50) / 100.0))) * 1.8), 6) as level from {SIG} s group by all")
def _level(spark, d):
    return rnd(S.rms_levels(V.signal(spark, d), HOP, mid=50, scale=100), "level")


def band(lo, hi):
    return f"coalesce(avg(case when bin between {lo} and {hi - 1} then mag end), 0.0)"


BANDS = f"(select channel, hop, {band(0, 1)} as sub, {band(0, 2)} as bass, {band(0, 3)} as mid, {band(1, 5)} as treble from {SPEC} s group by all)"


@check("band_averages_sub_bass_mid_treble", f"select channel, hop, {r6(('sub', 'sub'), ('bass', 'bass'), ('mid', 'mid'), ('treble', 'treble'))} from {BANDS} q")
def _bands(spark, d):
    return rnd(S.dense(S.band_averages(series(spark, d))), "sub", "bass", "mid", "treble")


@check("bucket_average", f"select channel, hop, round({band(1, 4)}, 6) as mean_1_3, round({band(3, 3)}, 6) as mean_none from {SPEC} s group by all")
def _bucket(spark, d):
    return rnd(S.dense(series(spark, d).select(
        "channel", "hop", "run", S.bucket_average(1, 4, "mean_1_3"), S.bucket_average(3, 3, "mean_none"))), "mean_1_3", "mean_none")


ZC = f"""(select channel, hop, count(*) filter (where p <> q) / count(*) as zero_cross from (select channel, hop, sample >= 50 as p, lag(sample >= 50) over (partition by channel, hop order by ts_us, event_id) as q from {SIG} s) t group by all)"""


@check("zero_cross_rate", f"select channel, hop, round(zero_cross, 6) as zero_cross from {ZC} q")
def _zc(spark, d):
    return rnd(S.zero_crossings(slots(spark, d)), "zero_cross")


@check("spectral_centroid", f"select channel, hop, round(case when sum(mag) > 0 then sum(bin * mag) / (sum(mag) * 4) else 0.0 end, 6) as centroid from {SPEC} s group by all")
def _centroid(spark, d):
    return rnd(S.dense(S.spectral_centroid(series(spark, d))), "centroid")


FLUX = f"""(select p.channel, p.hop, least(1.0, sum(greatest(0.0, p.mag - coalesce(h.mag, p.mag))) / 5 * 4.0) as flux from {SPEC} p left join {SPEC} h on h.channel = p.channel and h.bin = p.bin and h.hop = p.hop - 1 group by all)"""
ONSET = f"(select f.channel, f.hop, f.flux, e.e as onset_ema, least(1.0, greatest(0.0, (f.flux - e.e) * 6)) as onset, greatest(0.0, f.flux - e.e) as novelty from {FLUX} f join {ema_sql(FLUX, 'flux', 0.9)} e using (channel, hop))"


@check("spectral_flux_onset", f"select channel, hop, {r6(('flux', 'flux'), ('onset_ema', 'onset_ema'), ('onset', 'onset'), ('novelty', 'novelty'))} from {ONSET} q")
def _onset(spark, d):
    return rnd(S.of_decays(S.onsets(S.flux(series(spark, d)))), "flux", "onset_ema", "onset", "novelty")


@check("stereo_width_balance", f"""with b as (select hop, sum(case when channel = 0 then mag else 0.0 end) as l, sum(case when channel = 1 then mag else 0.0 end) as r from {SPEC} s group by 1),
 s as (select hop, ts_us // 60000000 as slot, avg((sample - 50) / 100.0) filter (where channel = 0) as l, avg((sample - 50) / 100.0) filter (where channel = 1) as r from {SIG} g group by all),
 w as (select hop, sqrt(avg((l + r) * 0.5 * ((l + r) * 0.5))) as m, sqrt(avg((l - r) * 0.5 * ((l - r) * 0.5))) as d from s where l is not null and r is not null group by 1)
 select b.hop, round(case when l + r > 0 then least(1.0, greatest(0.0, (l - r) / (l + r) * 0.5 + 0.5)) else 0.5 end, 6) as balance,
 round(case when m + d > 0.00001 then d / (m + d) else 0.0 end, 6) as width from b left join w using (hop)""")
def _stereo(spark, d):
    sl = slots(spark, d)
    return rnd(S.stereo(S.series(sl, full_scale=4.0), sl), "balance", "width")


LEVELS = f"(select channel, hop, least(1.0, sqrt(avg((sample - 50) / 100.0 * ((sample - 50) / 100.0))) * 1.8) as level from {SIG} s group by all)"
BL = f"(select b.*, coalesce(l.level, 0.0) as level from {BANDS} b left join {LEVELS} l using (channel, hop))"
PEAK = f"(select p.channel, p.hop, max(h.level * pow(0.93, p.hop - h.hop)) as peak_decay from {BL} p join {BL} h on h.channel = p.channel and h.hop <= p.hop group by all)"


@check("envelopes_and_decays", f"""select channel, hop, {r6(('x.e', 'bass_envelope'), ('y.e', 'mid_envelope'), ('z.e', 'treble_envelope'), ('peak_decay', 'peak_decay'))} from {ema_sql(BL, 'bass', 0.8)} x
 join {ema_sql(BL, 'mid', 0.84)} y using (channel, hop) join {ema_sql(BL, 'treble', 0.88)} z using (channel, hop) join {PEAK} k using (channel, hop)""")
def _envelopes(spark, d):
    cols = ["bass_envelope", "mid_envelope", "treble_envelope", "peak_decay"]
    return rnd(S.of_decays(S.envelopes(S.with_bands(series(spark, d)))), *cols).select("channel", "hop", *cols)


def mixed(spark, d):
    """All metrics of the series, one row a hop with samples or a stretch without."""
    m = S.onsets(S.with_flux(S.with_bands(series(spark, d))))
    m = S.ema_of(m, "level", S.LEVEL_KEEP, "level_ema")
    m = m.withColumn("pulse", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("level") - F.col("level_ema")) * 5.0)))
    return S.derived_mixes(m)


@check("derived_mixes_band_ratio_roughness_harmonic_percussive", f"""with m as (select b.*, o.flux, o.onset, coalesce(z.zero_cross, 0.0) as zc, least(1.0, greatest(0.0, (b.level - e.e) * 5)) as pulse
  from {BL} b join {ONSET} o using (channel, hop) join {ema_sql(BL, 'level', 0.82)} e using (channel, hop) left join {ZC} z using (channel, hop))
 select channel, hop, round(least(1.0, greatest(0.0, bass / greatest(0.05, treble + 0.05))), 6) as band_ratio, round(least(1.0, greatest(0.0, (zc * 1.5 + treble * 0.7) / 2.2)), 6) as roughness,
 round(least(1.0, greatest(0.0, (1 - flux) * (0.35 + mid * 0.65))), 6) as harmonic, round(least(1.0, greatest(0.0, onset * 0.7 + pulse * 0.3)), 6) as percussive from m""")
def _mixes(spark, d):
    cols = ["band_ratio", "roughness", "harmonic", "percussive"]
    return rnd(S.of_decays(mixed(spark, d)), *cols).select("channel", "hop", *cols)


# ---- windows ----------------------------------------------------------------------------

def epoch(c):
    return F.unix_micros(c)


@check("novelty_hop_tumbling", f"""select channel, hop * {HOP} as start_us, count(*) as n, round(avg(sample), 6) as mean_sample from {SIG} s group by channel, hop""")
def _tumbling(spark, d):
    return V.signal(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "channel").agg(
        F.count("*").alias("n"), F.round(F.avg("sample"), 6).alias("mean_sample")).select(
        "channel", epoch("w.start").alias("start_us"), "n", "mean_sample")


@check("tempo_history_sliding", f"""select channel, (ts_us // 1440000000 - k) * 1440000000 as start_us, count(*) as n, round(sum(sample), 2) as total from {SIG} s, (select unnest(range(20)) as k) t group by all""")
def _sliding(spark, d):
    return V.signal(spark, d).groupBy(F.window("ts", "8 hours", "24 minutes").alias("w"), "channel").agg(
        F.count("*").alias("n"), F.round(F.sum("sample"), 2).alias("total")).select(
        "channel", epoch("w.start").alias("start_us"), "n", "total")


@check("tempo_history_rows", """select user_id, event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 7 preceding and current row), 6) as mean8 from events""")
def _history_rows(spark, d):
    """The same history as a row window, cut into chunks of each user's row number."""
    from pyspark.sql import Window
    e = V.events(spark, d).select("user_id", "event_id", "ts_us", "value", F.floor(F.col("ts_us") / 86_400_000_000).alias("_day"))
    e = O.bucketed_rank(e, ["user_id"], "_day", ["ts_us", "event_id"], "pos")
    c = O.chunked(e, "pos", 1024, 7)
    w = Window.partitionBy("user_id", "_chunk").orderBy("pos").rowsBetween(-7, 0)
    c = c.withColumn("mean8", F.round(F.avg("value").over(w), 6))
    return O.own_rows(c, "pos", 1024).select("user_id", "event_id", "mean8")


@check("idle_gap_reset_session", """with e as (select user_id, epoch_us(ts) as t, value from events), f as (select *, case when t - lag(t) over (partition by user_id order by t) <= 21600000000 then 0 else 1 end as fl from e),
 s as (select *, sum(fl) over (partition by user_id order by t) as sid from f)
 select user_id, min(t) as start_us, max(t) + 21600000000 as end_us, count(*) as n, round(max(value), 6) as peak from s group by user_id, sid""")
def _sessions(spark, d):
    return TL.idle_sessions(V.events(spark, d), ["user_id"], 6 * TL.HOUR_US, [
        F.count("*").alias("n"), F.round(F.max("value"), 6).alias("peak")])


# ---- tempo and state --------------------------------------------------------------------

@check("tempo_tracker", f"""with s as (select channel, hop, novelty - avg(novelty) over (partition by channel) as v, count(*) over (partition by channel) as n from {ONSET} q),
 a as (select p.channel, p.n, h.hop - p.hop as lag, sum(p.v * h.v) as s from s p join s h on h.channel = p.channel and h.hop - p.hop between 3 and 10 group by all),
 w as (select channel, lag, s / (n - lag) * greatest(0.35, 1 - abs(120 - 60000 / (lag * 100.0)) / 600) as score from a where n - lag > 8),
 b as (select channel, max(score) as best, avg(score) as m, sqrt(greatest(0.0, avg(score * score) - avg(score) * avg(score))) as sd, arg_max(60000 / (lag * 100.0), score) as bpm from w group by 1)
 select channel, round(bpm, 6) as bpm, round(case when sd > 0.00000001 then least(1.0, greatest(0.0, (best - m) / (sd * 4))) else 0.0 end, 6) as confidence from b where best > 0""")
def _tempo(spark, d):
    nov = S.onsets(S.flux(series(spark, d))).select("channel", "hop", "run", "novelty")
    return rnd(S.dominant_period(nov, hop_ms=100.0), "bpm", "confidence")


@check("tempo_status", """with m as (select user_id, count(*) as n, avg(value) as v from events group by 1)
 select user_id, case when user_id % 10 = 7 then 'locked' when n / 60.0 < 1 then 'warmup' when v / 3000.0 < 0.015 then 'silent' when user_id % 3 = 0 then 'searching' else 'locked' end as status from m""")
def _status(spark, d):
    m = V.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    m = m.select("user_id", (F.col("n") / 60.0).alias("warmup"), (F.col("v") / 3000.0).alias("level_ema"),
                 F.when(F.col("user_id") % 10 == 7, 120.0).alias("override"),
                 F.when(F.col("user_id") % 3 != 0, 100.0).alias("bpm"))
    return S.tempo_status(m).select("user_id", "status")


@check("adaptive_range", """with recursive e as materialized (select user_id, event_id, value / 100.0 as v, row_number() over (partition by user_id order by ts, event_id) as rn from events),
 f as (select user_id, event_id, rn, v, v as lo, v as hi from e where rn = 1 union all select e.user_id, e.event_id, e.rn, e.v,
  case when e.v < f.lo then e.v else f.lo + (e.v - f.lo) * 0.004 end, case when e.v > f.hi then e.v else f.hi + (e.v - f.hi) * 0.004 end from f join e on e.user_id = f.user_id and e.rn = f.rn + 1)
 select user_id, event_id, round(lo + 0.000000001, 6) as low, round(hi + 0.000000001, 6) as high, round(least(1.0, greatest(0.0, (v - (hi - greatest(0.08, hi - lo))) / greatest(0.08, hi - lo))) + 0.000000001, 6) as normalized from f""")
def _adaptive(spark, d):
    e = V.events(spark, d).select("user_id", "event_id", "ts_us", (F.col("value") / 100.0).alias("v"))
    return soft(FD.adaptive_range(e, ["user_id"], ["ts_us", "event_id"], "v", width=FD.DAY_US), "low", "high", "normalized").select(
        "user_id", "event_id", "low", "high", "normalized")


METRICS = ("level", "bass", "mid", "treble", "sub", "pulse", "onset", "flux", "percussive", "band_ratio", "roughness", "harmonic", "zero_cross")
_RAW = f"""(select b.channel, b.hop, b.level, b.bass, b.mid, b.treble, b.sub, o.onset, o.flux, coalesce(z.zero_cross, 0.0) as zero_cross, least(1.0, greatest(0.0, (b.level - e.e) * 5)) as pulse
 from {BL} b join {ONSET} o using (channel, hop) join {ema_sql(BL, 'level', 0.82)} e using (channel, hop) left join {ZC} z using (channel, hop))"""
_ALL = f"""(select *, least(1.0, greatest(0.0, onset * 0.7 + pulse * 0.3)) as percussive, least(1.0, greatest(0.0, bass / greatest(0.05, treble + 0.05))) as band_ratio,
 least(1.0, greatest(0.0, (zero_cross * 1.5 + treble * 0.7) / 2.2)) as roughness, least(1.0, greatest(0.0, (1 - flux) * (0.35 + mid * 0.65))) as harmonic from {_RAW} r)"""


@check("metric_normaliser", f"""with recursive w as materialized (select * from {_ALL} q), m as ({' union all '.join(f"select channel, hop, '{n}' as metric, {n} as v from w" for n in METRICS)}),
 e as materialized (select *, row_number() over (partition by channel, metric order by hop) as rn from m),
 f as (select channel, hop, metric, rn, v, v as lo, v as hi from e where rn = 1 union all select e.channel, e.hop, e.metric, e.rn, e.v,
  case when e.v < f.lo then e.v else f.lo + (e.v - f.lo) * 0.004 end, case when e.v > f.hi then e.v else f.hi + (e.v - f.hi) * 0.004 end
  from f join e on e.channel = f.channel and e.metric = f.metric and e.rn = f.rn + 1)
 select channel, hop, metric, round(v + 0.000000001, 6) as v, round(lo + 0.000000001, 6) as low, round(hi + 0.000000001, 6) as high, round(least(1.0, greatest(0.0, (v - (hi - greatest(0.08, hi - lo))) / greatest(0.08, hi - lo))) + 0.000000001, 6) as normalized from f""")
def _normaliser(spark, d):
    """Every metric of a hop follows its own range; keys are (channel, metric)."""
    m = S.of_decays(mixed(spark, d)).select("channel", "hop", F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in METRICS])))
    return soft(FD.adaptive_range(m, ["channel", "metric"], ["hop"], "v"), "v", "low", "high", "normalized")


def triggers(spark, d):
    """Hops with `trigger` and the kick that it looks at."""
    m = S.ema_of(mixed(spark, d), "bass", S.ENVELOPES["bass"], "bass_envelope")
    return cut_lineage(S.of_decays(m).select("channel", "hop", S.beat_trigger().alias("trigger"), F.col("sub").alias("kick")))


def beats(spark, d, hop_ms=100.0):
    return S.detect_beats(triggers(spark, d).select("channel", "hop", "trigger"), hop_ms=hop_ms)


_MIX = f"""(select b.channel, b.hop, b.sub, b.bass, b.level, o.onset, o.onset_ema, e.e as level_ema, v.e as bass_envelope,
 least(1.0, greatest(0.0, (b.level - e.e) * 5)) as pulse, least(1.0, greatest(0.0, o.onset * 0.7 + least(1.0, greatest(0.0, (b.level - e.e) * 5)) * 0.3)) as percussive
 from {BL} b join {ONSET} o using (channel, hop) join {ema_sql(BL, 'level', 0.82)} e using (channel, hop) join {ema_sql(BL, 'bass', 0.8)} v using (channel, hop))"""
_TRIGGER = f"""(select channel, hop, row_number() over (partition by channel order by hop) as i,
 (sub > 0.07 and pulse > 0.06) or (onset > 0.12 and bass > bass_envelope * 1.3 + 0.04)
 or greatest(sub * 1.35 + pulse * 0.85, bass * 0.95 + onset * 1.15, percussive * 1.2 + level * 0.45) > greatest(0.3, level_ema * 1.7 + onset_ema * 4.5) as fires from {_MIX} m)"""
BEATS = f"""with recursive t as materialized (select * from {_TRIGGER} q),
 s as (select channel, hop, i, fires as beat, case when fires then hop end as last, null::double as ema, 0.0 as conf, case when fires then 1.0 else 0.0 end as pulse, case when fires then 1.0 else 0.0 end as hold
  from t where i = 1
 union all select t.channel, t.hop, t.i, n.hit,
  case when n.hit then t.hop when (t.hop - s.last) * 100.0 > 9000.0 then null else s.last end,
  case when n.hit and n.gap >= 260.0 and n.gap < 1600.0 then n.mean else s.ema end,
  case when n.hit then case when n.gap >= 260.0 and n.gap < 1600.0 then greatest(0.0, least(1.0, 1 - abs(n.gap - n.mean) / greatest(180.0, n.mean))) else s.conf end
   else s.conf * 0.992 * case when (t.hop - s.last) * 100.0 > 9000.0 then 0.5 else 1.0 end end,
  case when n.hit then 1.0 when (t.hop - s.last) * 100.0 > 9000.0 then 0.0 else s.pulse * 0.72 end,
  case when n.hit then 1.0 when (t.hop - s.last) * 100.0 > 9000.0 then 0.0 else s.hold * 0.9 end
  from s join t on t.channel = s.channel and t.i = s.i + 1
  join lateral (select t.fires and coalesce((t.hop - s.last) * 100.0 >= 260.0, true) as hit, (t.hop - s.last) * 100.0 as gap, coalesce(s.ema * 0.8 + (t.hop - s.last) * 100.0 * 0.2, (t.hop - s.last) * 100.0) as mean) n on true)"""


@check("beat_detection", f"{BEATS} select channel, hop, beat, round(pulse, 6) as pulse, round(hold, 6) as hold, round(conf, 6) as confidence, round(ema, 6) as interval_ms from s")
def _beat_detection(spark, d):
    return rnd(beats(spark, d), "pulse", "hold", "confidence", "interval_ms")


_DAILY = f"""(with s as (select channel, hop // 48 as win, hop, novelty - avg(novelty) over (partition by channel, hop // 48) as v, count(*) over (partition by channel, hop // 48) as n from {ONSET} q),
 a as (select p.channel, p.win, p.n, h.hop - p.hop as lag, sum(p.v * h.v) as s from s p join s h on h.channel = p.channel and h.win = p.win and h.hop - p.hop between 3 and 10 group by all),
 w as (select channel, win, lag, s / (n - lag) * greatest(0.35, 1 - abs(120 - 60000 / (lag * 100.0)) / 600) as score from a where n - lag > 8),
 b as (select channel, win, max(score) as best, avg(score) as m, sqrt(greatest(0.0, avg(score * score) - avg(score) * avg(score))) as sd, arg_max(60000 / (lag * 100.0), score) as bpm from w group by all)
 select channel, win, bpm, case when sd > 0.00000001 then least(1.0, greatest(0.0, (best - m) / (sd * 4))) else 0.0 end as conf, row_number() over (partition by channel order by win) as i from b where best > 0)"""
_HALF, _TWICE = "case when c.bpm / 2 between 60 and 180 then c.bpm / 2 else c.bpm end", "case when c.bpm * 2 between 60 and 180 then c.bpm * 2 else c.bpm end"


@check("tempo_smoothing", f"""with recursive c as materialized (select * from {_DAILY} q),
 f as (select channel, win, i, bpm, conf, bpm as tempo, greatest(0.1, conf) as trust from c where i = 1
 union all select c.channel, c.win, c.i, c.bpm, c.conf, f.tempo * (1 - (0.2 + c.conf * 0.45)) + (0.2 + c.conf * 0.45) * case
   when abs(c.bpm - f.tempo) <= least(abs({_HALF} - f.tempo), abs({_TWICE} - f.tempo)) then c.bpm when abs({_HALF} - f.tempo) <= abs({_TWICE} - f.tempo) then {_HALF} else {_TWICE} end,
  f.trust * 0.7 + c.conf * 0.3 from f join c on c.channel = f.channel and c.i = f.i + 1)
 select channel, win as window, round(bpm, 6) as bpm, round(conf, 6) as confidence, round(tempo, 6) as tempo, round(trust, 6) as tempo_confidence from f""")
def _tempo_smoothing(spark, d):
    """Tempo per day of history, followed over the days."""
    nov = S.of_decays(S.onsets(S.flux(series(spark, d)))).withColumn("window", F.floor(F.col("hop") / 48))
    daily = nov.select(F.struct("channel", "window").alias("channel"), "hop", "novelty")
    c = S.dominant_period(daily, hop_ms=100.0).select("channel.channel", "channel.window", "bpm", "confidence")
    return rnd(S.smooth_tempo(c), "bpm", "confidence", "tempo", "tempo_confidence")


_NOW = "(e.hop * 100.0 - a.anchor) / e.span"


@check("phase_bar_position", f"""{BEATS}, e as materialized (select s.channel, s.hop, s.ema as span, b.sub, row_number() over (partition by s.channel order by s.hop) as j
  from s join {BANDS} b on b.channel = s.channel and b.hop = s.hop where s.beat and s.ema is not null),
 a as (select channel, hop, j, hop * 100.0 as anchor, hop * 100.0 as bar, 0.0 as since, sub as mean from e where j = 1
 union all select e.channel, e.hop, e.j, n.anchor, case when n.starts then n.anchor else a.bar end, case when n.starts then 0.0 else n.since end, n.mean
  from a join e on e.channel = a.channel and e.j = a.j + 1
  join lateral (select *, e.sub > greatest(0.08, m.mean * 1.35) and m.since >= 2 as starts from
   (select a.mean * 0.75 + e.sub * 0.25 as mean, case when h.moves then a.anchor + h.whole * e.span else a.anchor end as anchor, case when h.moves then a.since + h.whole else a.since end as since from
    (select floor({_NOW} + 0.5) as whole, floor({_NOW} + 0.5) >= 1 and abs({_NOW} - floor({_NOW} + 0.5)) < 0.22 as moves) h) m) n on true),
 p as (select s.channel, s.hop, s.ema as span, (select max(a.hop) from a where a.channel = s.channel and a.hop <= s.hop) as at from s where s.ema is not null),
 q as (select p.channel, p.hop, round((p.hop * 100.0 - a.anchor) / p.span, 9) as t, round((p.hop * 100.0 - a.bar) / (p.span * 4), 9) as b from p join a on a.channel = p.channel and a.hop = p.at)
 select channel, hop, round(t - floor(t), 6) as tempo_phase, round(b - floor(b), 6) as bar_phase, round(floor(round((b - floor(b)) * 4, 6)) / 3.0, 6) as bar_beat from q""")
def _phase(spark, d):
    """Phases of all hops with a known interval, from anchors that follow the beats."""
    t = triggers(spark, d)
    b = cut_lineage(S.detect_beats(t.select("channel", "hop", "trigger"), hop_ms=100.0).where("interval_ms is not null"))
    found = S.anchors(b.where("beat").join(t.select("channel", "hop", "kick"), ["channel", "hop"]).select("channel", "hop", "interval_ms", "kick"), hop_ms=100.0)
    at = S.with_anchors(b.select("channel", "hop", (F.col("hop") * 100.0).alias("now_ms"), "interval_ms"), found)
    return rnd(S.phase(at), "tempo_phase", "bar_phase", "bar_beat").select("channel", "hop", "tempo_phase", "bar_phase", "bar_beat")


@check("tap_downbeat_bpm_override", f"""with h as (select channel, hop, hop - min(hop) over (partition by channel) as n from (select distinct channel, hop from {SPEC} q)),
 taps as (select distinct channel, hop from {SIG} t0 where sample > 300)
 select channel, hop, n = 0 or floor(n * 100.0 / 500.0) > floor((n - 1) * 100.0 / 500.0) as beat, (select max(t.hop) from taps t where t.channel = h.channel and t.hop <= h.hop) as bar_anchor from h""")
def _taps(spark, d):
    hops = cut_lineage(S.with_hop(V.signal(spark, d), HOP).groupBy("channel", "hop").agg(F.max(F.col("sample") > 300).alias("tapped")))
    grid = S.grid_beats(S.dense(S.runs(hops.select("channel", "hop"))), 120.0, hop_ms=100.0).select("channel", "hop", "beat")
    return S.tap_controls(grid, hops.where("tapped").select("channel", "hop"))
