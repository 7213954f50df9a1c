"""Structured Streaming forms of the signal and state operators.

Event time with watermarks; windows share their expressions with the batch
operators.  State lives in Spark's state store, so a lost executor resumes from
the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterloom.operators import signals as S
from rasterloom.operators.aggregate import SLOW_HARD_MS, SLOW_SOFT_MS
from rasterloom.operators.lineage import work_folder


def read_events(spark: SparkSession, folder: str, *, files_per_batch: int = 1) -> DataFrame:
    """The events files of a folder as a stream, with `ts` as an instant."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    e = (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
         .option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    if schema["ts"].dataType.typeName() == "timestamp_ntz":
        e = e.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return e.withColumn("ts_us", F.unix_micros("ts"))


def drain(stream: DataFrame, *, mode="append", folder: str | None = None) -> DataFrame:
    """Run everything available through a Parquet sink and read the result."""
    spark = stream.sparkSession
    base = folder or work_folder(spark)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


# ---- windows ----------------------------------------------------------------------------

def hop_levels(events: DataFrame, hop: str, *, mid: float, scale: float, lateness="1 minute") -> DataFrame:
    """Loudness per channel and tumbling window; late rows are dropped after the watermark."""
    d = events.withColumns({"channel": F.pmod("user_id", F.lit(2)).cast("int"), "x": (F.col("value") - mid) / scale})
    return (d.withWatermark("ts", lateness).groupBy(F.window("ts", hop).alias("w"), "channel")
            .agg(S.level().alias("level"), F.count("*").alias("n"))
            .select("channel", F.unix_micros("w.start").alias("start_us"), "level", "n"))


def sliding_counts(events: DataFrame, size: str, slide: str, *, lateness="1 minute") -> DataFrame:
    return (events.withWatermark("ts", lateness).groupBy(F.window("ts", size, slide).alias("w"), "event_type")
            .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
            .select("event_type", F.unix_micros("w.start").alias("start_us"), "n", "total"))


def idle_sessions(events: DataFrame, gap: str, *, lateness="1 minute") -> DataFrame:
    """Sessions separated by idle gaps, one per user."""
    return (events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
            .agg(F.count("*").alias("n"))
            .select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n"))


# ---- keyed state ------------------------------------------------------------------------

def slow_step_flags(steps: DataFrame, *, soft=SLOW_SOFT_MS, hard=SLOW_HARD_MS) -> DataFrame:
    """Two-strike registry per step name: emits a name once, when it is flagged.

    Rows are reduced to (name, worst, soft breaches) on the Python side batch by
    batch, so a hot name never sits in memory as a whole.
    """
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        strikes, flagged = state.get if state.exists else (0, False)
        worst, before = 0.0, flagged
        for pdf in batches:
            strikes += int((pdf["ms"] >= soft).sum())
            worst = max(worst, float(pdf["ms"].max()))
        flagged = flagged or worst >= hard or strikes >= 2
        state.update((strikes, flagged))
        if flagged and not before:
            yield pd.DataFrame({"name": [key[0]], "strikes": [strikes], "worst_ms": [worst]})
    # only breaches can change the registry
    return steps.where(F.col("ms") >= soft).groupBy("name").applyInPandasWithState(
        update, "name string, strikes long, worst_ms double", "strikes long, flagged boolean", "append",
        GroupStateTimeout.NoTimeout)


def live_frame_state(frames: DataFrame, *, alpha=0.1) -> DataFrame:
    """Previous value and EMA per key, as each frame sees them.

    Keyed by `(clip_id, tile)`: the state of one key is three numbers, and a
    clip is spread over its tiles.
    """
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have, prev, ema = state.get if state.exists else (False, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])   # one key, one micro-batch
        out = []
        for event_id, v in zip(rows["event_id"], rows["v"]):
            out.append((key[0], key[1], event_id, v, prev if have else None, ema if have else None))
            ema = v if not have else ema * (1 - alpha) + v * alpha
            have, prev = True, v
        state.update((have, float(prev), float(ema)))
        yield pd.DataFrame(out, columns=["clip_id", "tile", "event_id", "v", "prev", "ema"])
    return frames.groupBy("clip_id", "tile").applyInPandasWithState(
        update, "clip_id long, tile int, event_id long, v double, prev double, ema double",
        "have boolean, prev double, ema double", "append", GroupStateTimeout.NoTimeout)


def live_beats(hops: DataFrame, *, hop_ms: float) -> DataFrame:
    """Beat state per channel from a stream of `(channel, hop, energy, floor)` rows.

    The state is the latest beat and the confidence with its hop; pulses and decays follow from
    their age in hops, as in the batch form.
    """
    gap, idle = -(-S.MIN_BEAT // hop_ms), S.IDLE // hop_ms + 1

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, mean, sure, at = state.get if state.exists else (-1, 0.0, 0.0, -1)
        rows = pd.concat(list(batches)).sort_values("hop")   # hops of one micro-batch
        out = []
        for hop, fires in zip(rows["hop"].tolist(), (rows["energy"] > rows["floor"]).tolist()):
            age = hop - last if last >= 0 else None
            if hit := fires and (age is None or age >= gap):
                if age is not None and age * hop_ms < S.MAX_BEAT:
                    mean = mean * S.INTERVAL_KEEP + age * hop_ms * (1 - S.INTERVAL_KEEP) if mean else age * hop_ms
                    sure = min(1.0, max(0.0, 1 - abs(age * hop_ms - mean) / max(180.0, mean)))
                last = hop
            else:
                sure *= S.CONFIDENCE_DECAY ** (hop - at if at >= 0 else 1)
                if age is not None and age >= idle:
                    last, sure = -1, sure * S.IDLE_LOSS
            at = hop
            out.append((key[0], hop, bool(hit), S.PULSE_DECAY ** (hop - last) if last >= 0 else 0.0, sure))
        state.update((int(last), float(mean), float(sure), int(at)))
        yield pd.DataFrame(out, columns=["channel", "hop", "beat", "pulse", "confidence"])
    return hops.groupBy("channel").applyInPandasWithState(
        update, "channel int, hop long, beat boolean, pulse double, confidence double",
        "last long, mean double, sure double, at long", "append", GroupStateTimeout.NoTimeout)


def latest_frame_wins(frames: DataFrame, folder: str, *, lateness="10 minutes") -> None:
    """Per micro-batch only the newest frame of each clip goes on; re-sent tokens are dropped first."""
    unique = frames.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["clip_id", "frame_token"])

    def keep_newest(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("clip_id").agg(F.max_by(F.struct("frame_token", "v"), "frame_token").alias("s"))
        newest.select("clip_id", "s.*").write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
    q = (unique.writeStream.foreachBatch(keep_newest).option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
