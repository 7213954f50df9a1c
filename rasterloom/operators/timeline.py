"""Option modulation, frame timing and timeline selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.operators.ordered import bucketed_neighbour, bucketed_running_sum


def modulate_options(metrics: DataFrame, connections: DataFrame, options: DataFrame,
                     keys: list[str]) -> DataFrame:
    """Shift each option by its summed metric*weight, inside its range and step.

    `connections` and `options` are per-operator parameter tables of a few
    dozen rows, so Catalyst broadcasts them by their own size.
    """
    total = (metrics.join(connections, "metric")
             .groupBy(*keys, "target").agg(F.sum(F.col("v") * F.col("weight")).alias("_t")))
    moved = F.least(F.col("hi"), F.greatest(
        F.col("lo"), F.col("value") + F.col("_t") * (F.col("hi") - F.col("lo"))))
    stepped = F.when(F.col("step") > 0, F.floor(moved / F.col("step") + 0.5) * F.col("step")).otherwise(moved)
    return total.join(options, "target").select(*keys, "target", F.round(stepped, 6).alias("value"))


def match_themes(lists: DataFrame, themes: DataFrame) -> DataFrame:
    """Equi-join on the canonical text of the colour list."""
    return (lists.withColumn("_k", F.to_json("colors"))
            .join(themes.select("theme", F.to_json("colors").alias("_k")), "_k").drop("_k"))


# ---- decoded frames: (clip_id, event_id, ts_us, dur_us) ------------------------------------
# Work is split by clip and hour (`_bucket`), with one carried row per bucket.

HOUR_US = 3_600_000_000


def _bucketed(frames: DataFrame, width: int) -> DataFrame:
    return frames.withColumn("_bucket", F.floor(F.col("ts_us") / F.lit(width)).cast("long"))


def next_frame(frames: DataFrame, *, width=HOUR_US) -> DataFrame:
    """Add `next_ts`, the clip's following timestamp."""
    d = bucketed_neighbour(_bucketed(frames, width), ["clip_id"], "_bucket", ["ts_us", "event_id"],
                           ["ts_us"], forward=True, prefix="next_")
    return d.withColumnRenamed("next_ts_us", "next_ts").drop("_bucket")


def frame_durations(frames: DataFrame, *, fallback_us: int, end_us: int) -> DataFrame:
    """Stated duration capped by the range end, else the gap to the next frame, else the rest."""
    rest = F.greatest(F.lit(1), F.lit(end_us) - F.col("ts_us"))
    d = next_frame(frames)
    return d.withColumn("duration_us", F.when(F.col("dur_us") > 0, F.least(rest, F.col("dur_us")))
                        .when(F.col("next_ts").isNotNull(), F.greatest(F.lit(1), F.col("next_ts") - F.col("ts_us")))
                        .otherwise(F.greatest(rest, F.lit(fallback_us)))).drop("next_ts")


def drop_trailing(frames: DataFrame) -> DataFrame:
    """Remove each clip's last frame when it has more than one."""
    last = frames.groupBy("clip_id").agg(F.max(F.struct("ts_us", "event_id")).alias("_e"), F.count("*").alias("_n"))
    d = frames.join(last, "clip_id")
    is_last = (F.col("ts_us") == F.col("_e.ts_us")) & (F.col("event_id") == F.col("_e.event_id"))
    return d.where(~is_last | (F.col("_n") == 1)).select(*frames.columns)


def quantise_delay(ms: Column) -> Column:
    """Multiples of ten, at least ten."""
    return F.greatest(F.lit(10), C.jr(F.greatest(F.lit(10.0), ms.cast("double")) / 10.0) * 10)


def collapse_runs(frames: DataFrame, value: str, delay: str, *, width=HOUR_US) -> DataFrame:
    """Merge consecutive frames with equal content and add up their quantised delays."""
    d = _bucketed(frames, width)
    d = bucketed_neighbour(d, ["clip_id"], "_bucket", ["ts_us", "event_id"], [value])
    flag = F.when(F.col(value) == F.col(f"prev_{value}"), 0).otherwise(1)
    d = bucketed_running_sum(d, ["clip_id"], "_bucket", ["ts_us", "event_id"], flag, "run")
    return d.groupBy("clip_id", "run").agg(
        F.max(value).alias(value), F.min("ts_us").alias("ts_us"), F.count("*").alias("n"),
        F.sum(quantise_delay(F.col(delay))).cast("bigint").alias("delay_ms"))


def value_median(df: DataFrame, keys: list[str], value: str, *, width: int = 1_000_000) -> DataFrame:
    """Exact median per key; an even count gives the rounded mean of the middle two.

    Equal values are counted first.  The running count is split by value range
    (`width`), so a hot key with many distinct values is still spread.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_vb", F.floor(F.col(value) / F.lit(width)).cast("long"))
    c = bucketed_running_sum(counts, keys, "_vb", [value], F.col("_n"), "_hi")
    totals = df.groupBy(*keys).agg(F.count("*").alias("_t"))
    c = c.join(totals, keys).withColumn("_mid", F.floor(F.col("_t") / 2))

    def holds(pos: Column) -> Column:
        return (F.col("_hi") - F.col("_n") <= pos) & (pos < F.col("_hi"))
    upper, lower = holds(F.col("_mid")), holds(F.col("_mid") - 1)
    picked = c.where(upper | lower).groupBy(*keys).agg(
        F.max("_t").alias("_t"), F.max(F.when(upper, F.col(value))).alias("_b"),
        F.max(F.when(lower, F.col(value))).alias("_a"))
    even = F.pmod("_t", F.lit(2)) == 0
    return picked.select(*keys, F.when(even, F.floor((F.col("_a") + F.col("_b")) / 2.0 + 0.5)).otherwise(
        F.col("_b")).cast("bigint").alias("median"))


def cadence(frames: DataFrame, *, fallback_us: int) -> DataFrame:
    """Median stated duration, else median positive gap, else the fallback."""
    stated = value_median(frames.where("dur_us > 0"), ["clip_id"], "dur_us").withColumnRenamed("median", "_s")
    gaps = next_frame(frames).withColumn("_gap", F.col("next_ts") - F.col("ts_us")).where("_gap > 0")
    gap = value_median(gaps, ["clip_id"], "_gap").withColumnRenamed("median", "_g")
    clips = frames.select("clip_id").distinct()
    return clips.join(stated, "clip_id", "left").join(gap, "clip_id", "left").select(
        "clip_id", F.coalesce("_s", "_g", F.lit(fallback_us)).alias("cadence_us"))


def offline_timeline(ranges: DataFrame, *, fps: int) -> DataFrame:
    """Ticks of each `(clip_id, start_sec, end_sec)` range; the last tick carries the remainder."""
    dur = F.col("end_sec") - F.col("start_sec")
    n = F.greatest(F.lit(1), F.ceil(F.round(dur * fps, 9))).cast("int")
    d = ranges.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("index"))
    nominal = F.col("index") / float(fps)
    rest = F.greatest(F.lit(0.0), dur - nominal)
    last = F.col("index") == F.col("_n") - 1
    span = F.when(last, F.greatest(F.when(rest > 0, rest).otherwise(1.0 / fps), F.lit(1e-6))).otherwise(1.0 / fps)
    micros = F.floor(F.round(nominal * 1e6, 3) + 0.5).cast("bigint")
    return d.select("clip_id", "index", micros.alias("timestamp_us"), F.greatest(
        F.lit(1), F.floor(F.round(span * 1e6, 3) + 0.5)).cast("bigint").alias("duration_us"))


def select_range(frames: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Frames in `[start, end)`; clips without any keep all their frames."""
    hits = frames.where((F.col("ts_us") >= start_us) & (F.col("ts_us") < end_us))
    return with_fallback(frames, hits, ["clip_id"])


def with_fallback(everything: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """`hits`, plus all rows of the keys that have none."""
    have = hits.select(*keys).distinct()
    return hits.unionByName(everything.join(have, keys, "left_anti"))


def contact_sheet(frames: DataFrame, *, columns: int, frameWidth: int, frameHeight: int, gap=10, padding=12) -> DataFrame:
    """Grid cell and pixel offset of every frame, with its clip's sheet size.

    `frames(clip_id, frame)` with dense frame numbers, so the position needs no window.
    """
    n = frames.groupBy("clip_id").agg(F.count("*").alias("_n"))
    d = frames.join(n, "clip_id").withColumn("columns", F.least(F.col("_n"), F.lit(columns)).cast("int"))
    d = d.withColumns({"rows": F.ceil(F.col("_n") / F.col("columns")).cast("int"),
                       "col": F.pmod(F.col("frame"), F.col("columns")).cast("int"),
                       "row": F.floor(F.col("frame") / F.col("columns")).cast("int")})
    return d.select("clip_id", "frame", "columns", "rows", "col", "row",
                    (F.col("col") * (frameWidth + gap) + padding).alias("left"),
                    (F.col("row") * (frameHeight + gap) + padding).alias("top"),
                    (F.col("columns") * frameWidth + (F.col("columns") - 1) * gap + 2 * padding).alias("width"),
                    (F.col("rows") * frameHeight + (F.col("rows") - 1) * gap + 2 * padding).alias("height"))


def idle_sessions(df: DataFrame, keys: list[str], gap_us: int, aggs: list[Column], *, width: int | None = None) -> DataFrame:
    """Runs of rows without a gap longer than `gap_us`: `(keys, start_us, end_us, aggs...)`.

    Same rows as `session_window`, but a hot key is split by time bucket.  `df`
    needs `ts_us` and `event_id`.
    """
    d = _bucketed(df, width or gap_us)
    d = bucketed_neighbour(d, keys, "_bucket", ["ts_us", "event_id"], ["ts_us"])
    fresh = F.when(F.col("ts_us") - F.col("prev_ts_us") <= F.lit(gap_us), 0).otherwise(1)
    d = bucketed_running_sum(d, keys, "_bucket", ["ts_us", "event_id"], fresh, "_session")
    return d.groupBy(*keys, "_session").agg(
        F.min("ts_us").alias("start_us"), (F.max("ts_us") + F.lit(gap_us)).alias("end_us"), *aggs).drop("_session")
