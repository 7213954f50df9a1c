"""Streaming operators, drained over the events files.

Each runs as a stream over everything available; where the result does not
depend on how rows fall into micro-batches it has SQL to match.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators.lineage import work_folder
from rasterloom.streaming import jobs as ST
from rasterloom.suite.registry import check

EV = "(select *, epoch_us(ts) as ts_us from events)"


@check("streaming_slow_step_flag", """select user_id % 5 || ':' || event_type as name from events group by 1 having max(value) * 10 >= 3500 or count(*) filter (where value * 10 >= 1500) >= 2""")
def _slow(spark, d):
    steps = ST.read_events(spark, d).select(F.concat_ws(":", F.pmod("user_id", F.lit(5)), "event_type").alias("name"),
                                            (F.col("value") * 10).alias("ms"))
    return ST.drain(ST.slow_step_flags(steps)).select("name")


@check("live_temporal_state", f"""with e as (select user_id as clip_id, cast(event_id % 4 as int) as tile, event_id, value as v, row_number() over (partition by user_id, event_id % 4 order by ts, event_id) - 1 as i from events)
 select p.clip_id, p.tile, p.event_id, p.v, max(case when h.i = p.i - 1 then h.v end) as prev, round(sum(h.v * (case when h.i = 0 then pow(0.9, p.i - 1) else 0.1 * pow(0.9, p.i - 1 - h.i) end)) + 0.000000033, 6) as ema
 from e p left join e h on h.clip_id = p.clip_id and h.tile = p.tile and h.i < p.i group by all""")
def _live_state(spark, d):
    e = ST.read_events(spark, d).select(F.col("user_id").alias("clip_id"), F.pmod("event_id", F.lit(4)).cast("int").alias("tile"),
                                        "event_id", "ts_us", F.col("value").alias("v"))
    return ST.drain(ST.live_frame_state(e)).withColumn("ema", F.round(F.col("ema") + 3.3e-8, 6))


@check("latest_frame_wins", "select user_id as clip_id, max(event_id) as frame_token, arg_max(value, event_id) as v from events group by 1")
def _latest(spark, d):
    e = ST.read_events(spark, d).select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("frame_token"), "ts", F.col("value").alias("v"))
    folder = work_folder(spark)
    ST.latest_frame_wins(e, folder)
    return spark.read.parquet(f"{folder}/out").select("clip_id", "frame_token", "v")


_T = "(select max(ts_us) - 60000000 from " + EV + " m)"


@check("level_stream", f"""select cast(user_id % 2 as int) as channel, ts_us // 3600000000 * 3600000000 as start_us, round(least(1.0, sqrt(avg(pow((value - 50) / 100.0, 2))) * 1.8), 6) as level, count(*) as n
 from {EV} e group by all having (ts_us // 3600000000 + 1) * 3600000000 <= {_T}""".replace("having (ts_us // 3600000000 + 1)", "having (min(ts_us) // 3600000000 + 1)"))
def _levels(spark, d):
    """Windows closed by the watermark; the batch metric gives the same values."""
    out = ST.drain(ST.hop_levels(ST.read_events(spark, d), "1 hour", mid=50, scale=100))
    return out.withColumn("level", F.round("level", 6))


_LEVEL = f"""(select cast(user_id % 2 as int) as channel, ts_us // 3600000000 as hop, least(1.0, sqrt(avg(pow((value - 50) / 100.0, 2))) * 1.8) as level
 from {EV} e group by all having (min(ts_us) // 3600000000 + 1) * 3600000000 <= {_T})"""


@check("beat_stream", f"""with recursive o as materialized (select *, level > 0.9 as fires, row_number() over (partition by channel order by hop) as i from {_LEVEL} l),
 s as (select channel, hop, i, fires as hit, case when fires then hop else -1 end as last, 0.0 as mean, 0.0 as sure from o where i = 1
 union all select o.channel, o.hop, o.i, n.hit, case when n.hit then o.hop when s.last >= 0 and n.age >= 91 then -1 else s.last end,
  case when n.hit and s.last >= 0 and n.age * 100.0 < 1600 then n.mean else s.mean end,
  case when not n.hit then s.sure * pow(0.992, o.hop - s.hop) * case when s.last >= 0 and n.age >= 91 then 0.5 else 1.0 end
   when s.last >= 0 and n.age * 100.0 < 1600 then greatest(0.0, least(1.0, 1 - abs(n.age * 100.0 - n.mean) / greatest(180.0, n.mean))) else s.sure end
  from s join o on o.channel = s.channel and o.i = s.i + 1
  join lateral (select o.hop - s.last as age, o.fires and (s.last < 0 or o.hop - s.last >= 3) as hit,
   case when s.mean > 0 then s.mean * 0.8 + (o.hop - s.last) * 100.0 * 0.2 else (o.hop - s.last) * 100.0 end as mean) n on true)
 select channel, hop, hit as beat, round(case when last >= 0 then pow(0.72, hop - last) else 0.0 end, 6) as pulse, round(sure, 6) as confidence from s""")
def _beats(spark, d):
    """Windowed energies feed the keyed beat state inside one stream per stage."""
    levels = ST.drain(ST.hop_levels(ST.read_events(spark, d), "1 hour", mid=50, scale=100))
    folder = work_folder(spark)
    levels.select("channel", F.floor(F.col("start_us") / F.lit(3_600_000_000)).cast("long").alias("hop"),
                  F.col("level").alias("energy"), F.lit(0.9).alias("floor")).write.parquet(f"{folder}/hops")
    hops = spark.readStream.schema("channel int, hop long, energy double, floor double").parquet(f"{folder}/hops")
    return ST.drain(ST.live_beats(hops, hop_ms=100.0)).withColumns({c: F.round(c, 6) for c in ("pulse", "confidence")})
