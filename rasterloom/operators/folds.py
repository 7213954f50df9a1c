"""Recurrences over frames and events, by the chunk maps and speculation of `scans`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.operators.ordered import bucketed_rank, shuffled_join
from rasterloom.operators.scans import CHUNK, Decay, bounded_decay, fold_chunks

PIXEL = ["clip_id", "x", "y"]


def additive_exposure(df: DataFrame, *, decay=0.05, brightnessThreshold=30.0, chunk=CHUNK) -> DataFrame:
    """Clamped leaky accumulation of bright pixels."""
    bright = F.when((F.col("r") + F.col("g") + F.col("b")) / 3 >= float(brightnessThreshold), 0.3).otherwise(0.0)
    d = bounded_decay(df, PIXEL, "frame", {f"_y{c}": Decay(1 - decay, F.col(c) * bright, F.lit(255.0), F.col(c).cast("double")) for c in C.RGB}, chunk=chunk)
    return d.withColumns({c: C.u8_soft(F.col(f"_y{c}")) for c in C.RGB}).drop("_yr", "_yg", "_yb")


def accumulated_heat(df: DataFrame, diff: str, *, accum: float, cool: float, chunk=CHUNK) -> DataFrame:
    """Add `heat`, a leaky sum of the difference that is held in 0..1 at every frame."""
    warm = F.coalesce(diff, F.lit(0.0)) / 255.0 * float(accum)
    return bounded_decay(df, PIXEL, "frame", {"heat": Decay(1 - cool, warm, F.lit(1.0), F.least(F.lit(1.0), warm))}, chunk=chunk)


def poster_hold(df: DataFrame, *, levels=5, holdThreshold=18.0, releaseSpeed=0.25, chunk=CHUNK, rounds: list | None = None) -> DataFrame:
    """Luma band with hysteresis; colours are scaled to the held band."""
    top = float(levels - 1)
    hold = holdThreshold / 255.0

    def step(state, target):
        if state is None:
            state = (target, 0.0)
        else:
            band, pressure = state
            gap = abs(target - band) / top
            if target == band:
                pressure = max(0.0, pressure - releaseSpeed * 0.5)
            elif gap > hold:
                pressure += ((gap - hold) / max(1 / 255.0, 1 - hold) + 0.15) * releaseSpeed
                if pressure >= 1.0:
                    band, pressure = target, 0.0
            else:
                pressure = max(0.0, pressure - releaseSpeed * 0.25)
            state = (band, pressure)
        return state, state
    d = df.withColumn("_t", C.clamp(0, top, F.floor(C.luma_unit() * top + 0.5)))
    d = fold_chunks(d, PIXEL, "frame", ["_t"], {"band": "double", "pressure": "double"}, step, chunk=chunk, rounds=rounds)
    k = F.col("band") / top / F.greatest(F.lit(1 / 255.0), C.luma_unit())
    d = d.withColumn("_k", k)
    return d.withColumns({c: C.from_unit(C.unit(c) * F.col("_k")) for c in C.RGB} | {
        "band": F.col("band").cast("int")}).drop("_t", "_k", "pressure")


def tile_stabiliser(df: DataFrame, *, tileSize=24, motionThreshold=72.0, holdFrames=8, chunk=CHUNK) -> DataFrame:
    """A tile refreshes when it moves enough or its age runs out.

    Only motion restarts the period of holdFrames + 1, so the frame shown follows from the latest
    frame with motion: its chunk's, or the latest of the chunks before.  Motion per tile is a
    partial aggregate; pixels read their tile's refresh frame by an equi-join.
    """
    from rasterloom.operators.temporal import delayed, previous
    tile = {"_bx": F.floor(F.col("x") / tileSize), "_by": F.floor(F.col("y") / tileSize)}
    d = previous(df, prefix="_p_", chunk=chunk).withColumns(tile)
    diff = sum((F.abs(F.col(c) - F.col(f"_p_{c}")) for c in ("g", "b")), F.abs(F.col("r") - F.col("_p_r")))
    key = ["clip_id", "_bx", "_by"]
    motion = d.groupBy(*key, "frame").agg(F.round(F.avg(diff / 3.0), 9).alias("_m")).withColumn("_c", F.floor(F.col("frame") / chunk).cast("long"))
    moved = F.when(F.coalesce(F.col("_m") > float(motionThreshold), F.lit(True)), F.col("frame"))   # a first frame has no motion yet
    before = Window.partitionBy(*key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = motion.groupBy(*key, "_c").agg(F.max(moved).alias("_l")).select(*key, "_c", F.max("_l").over(before).alias("_carry"))   # one row a chunk
    inside = Window.partitionBy(*key, "_c").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    ages = shuffled_join(motion.withColumn("_own", F.max(moved).over(inside)), carried, [*key, "_c"])
    since = F.col("frame") - F.coalesce("_own", "_carry")
    ages = ages.select(*key, "frame", F.pmod(since, F.lit(holdFrames + 1)).cast("int").alias("_age"))
    j = shuffled_join(df.withColumns(tile), ages, [*key, "frame"])
    return delayed(j, F.col("_age")).select(*df.columns)


def adaptive_range(df: DataFrame, keys: list[str], order: list[str], value: str, *, release=0.004,
                   min_span=0.08, width: int = 4096, chunk=CHUNK) -> DataFrame:
    """Fast-attack, slow-release range; adds low, high and the normalised value.

    Both ends are the nearer of the value and a step towards it, a clamped line in the end before.
    Rows are numbered in buckets of `width` units of the first order column.
    """
    d = bucketed_rank(df.withColumn("_bucket", F.floor(F.col(order[0]) / width).cast("long")), keys, "_bucket", order, "_pos").drop("_bucket")
    v = F.col(value).cast("double")
    d = bounded_decay(d, keys, "_pos", {"low": Decay(1 - release, v * release, v, v), "high": Decay(1 - release, v * release, v, v, upper=False)}, chunk=chunk)
    span = F.greatest(F.lit(min_span), F.col("high") - F.col("low"))
    return d.withColumn("normalized", C.clamp(0, 1, (v - (F.col("high") - span)) / span)).drop("_pos")


DAY_US = 86_400_000_000


def cadence_thinning(frames: DataFrame, spacing: DataFrame, *, key="clip_id", chunk=CHUNK, rounds: list | None = None) -> DataFrame:
    """Keep a frame if enough time passed since the last kept one, and the last frame.

    `spacing(key, min_us)`; frames are `(key, event_id, ts_us)`.
    """
    d = bucketed_rank(frames.withColumn("_day", F.floor(F.col("ts_us") / DAY_US).cast("long")), [key], "_day", ["ts_us", "event_id"], "_pos").drop("_day")
    ends = d.groupBy(key).agg(F.max("_pos").alias("_end"))
    d = d.join(spacing.join(ends, key), key).withColumn("_t", F.col("ts_us").cast("double"))

    def step(state, ts, gap):
        keep = state is None or ts - state[0] >= gap
        return ((ts,) if keep else state), (keep,)
    kept = fold_chunks(d, [key], "_pos", ["_t", "min_us"], {"_keep": "boolean"}, step, chunk=chunk, rounds=rounds)
    return kept.where(F.col("_keep") | (F.col("_pos") == F.col("_end"))).select(*frames.columns)
