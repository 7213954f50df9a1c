"""Tables to operate on, declared lazily over parquet.

`raster_px` is the long pixel form `(clip_id, frame, x, y, r, g, b, a)`.  Frames
are numbered densely per clip with a two-stage rank, so a clip holding most of
the data is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.operators.ordered import bucketed_rank, shuffled_join, spread

SIDE = 8  # frames of the vector-backed raster are 8 x 8
RANK_WIDTH = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame: `(clip_id, frame, q ARRAY<INT>)`, values 0..255."""
    vec = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("clip_id"), "vec_id",
        F.transform("embedding", lambda e: F.floor(
            (e.cast("double") + 1.0) * 127.5 + 0.5).cast("int")).alias("q"))
    ranked = bucketed_rank(
        vec.withColumn("_bucket", F.floor(F.col("vec_id") / RANK_WIDTH).cast("long")),
        ["clip_id"], "_bucket", ["vec_id"], "frame")
    return ranked.select("clip_id", F.col("frame").cast("int").alias("frame"), "q")


def explode_pixels(frames: DataFrame, side: int = SIDE) -> DataFrame:
    """Frame rows to pixel rows; keeps the partitioning of the frame rows."""
    n = side * side

    def rotated(k: int):
        return F.concat(F.slice("q", k + 1, n - k), F.slice("q", 1, k)) if k else F.col("q")

    zipped = F.arrays_zip(
        F.sequence(F.lit(0), F.lit(n - 1)).alias("i"),
        rotated(0).alias("r"), rotated(21).alias("g"), rotated(42).alias("b"))
    px = frames.select("clip_id", "frame", F.inline(zipped).alias("i", "r", "g", "b"))
    return px.select(
        "clip_id", "frame",
        F.pmod("i", F.lit(side)).cast("int").alias("x"),
        F.floor(F.col("i") / side).cast("int").alias("y"),
        "r", "g", "b", F.lit(255).alias("a"))


def raster_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of the vector-backed raster.

    The compact frame rows are hash-partitioned on `(clip_id, frame)` before
    they are exploded, so every later per-frame grouping runs without an
    exchange of pixel rows and a long clip is spread evenly.
    """
    return explode_pixels(spread(frame_vectors(spark, sf_dir), "clip_id", "frame"))


def channel_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-range channel values at volume, for map-only and aggregate work."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.pmod("l_partkey", F.lit(256)).cast("int").alias("r"),
        F.pmod((F.col("l_quantity") * 5).cast("int"), F.lit(256)).cast("int").alias("g"),
        F.pmod("l_suppkey", F.lit(256)).cast("int").alias("b"),
        F.lit(255).alias("a"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with `ts` as an instant and `ts_us` in microseconds.

    The files may hold zone-less timestamps; they are read as UTC whatever the
    session's zone is.
    """
    e = table(spark, sf_dir, "events")
    if e.schema["ts"].dataType.typeName() == "timestamp_ntz":
        e = e.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return e.withColumn("ts_us", F.unix_micros("ts"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event samples as a two-channel signal; `bin` is the event type's rank among all types there are, null the last."""
    e = events(spark, sf_dir)
    kinds = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind")).distinct().withColumn(
        "bin", (F.row_number().over(Window.orderBy(F.asc_nulls_last("kind"))) - 1).cast("int"))   # one row a type
    return e.join(kinds, F.col("event_type").eqNullSafe(F.col("kind"))).select(
        "event_id", "ts", "ts_us", F.pmod("user_id", F.lit(2)).cast("int").alias("channel"), "bin",
        F.col("value").alias("sample"))


def decoded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamped frames per clip; a zero duration means "not stated"."""
    return events(spark, sf_dir).select(
        F.col("user_id").alias("clip_id"), "event_id", "ts_us",
        F.expr("nullif(cast(floor(value) as bigint) * 1000, 0)").alias("dur_us"))


def step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("user_id").alias("run_id"), "event_id", "ts", "ts_us",
        F.col("event_type").alias("name"),
        F.round(F.col("value") * 10, 2).alias("ms"))


def chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chain step: `(chain_id, step, l_linenumber, ...)`."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chain_id"),
        F.concat(F.lit("S"), F.pmod("l_partkey", F.lit(40)).cast("string")).alias("step"),
        "l_linenumber", "l_partkey", "l_suppkey")


def positioned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(chain_id, pos, step)` without gathering a chain: a two-stage rank."""
    s = chain_steps(spark, sf_dir).withColumn(
        "_b", F.col("l_linenumber").cast("long") * F.lit(1 << 40) + F.floor(F.col("l_partkey") / 64))
    ranked = bucketed_rank(s, ["chain_id"], "_b", ["l_partkey", "l_suppkey"], "pos")
    return ranked.select("chain_id", F.col("pos").cast("int").alias("pos"), "step")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chain: ordered step names and a category.

    A chain is a short list by definition; work on chains of any length takes the
    rows of `positioned_steps`.
    """
    rows = chain_steps(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "step")))
    steps = rows.groupBy("chain_id").agg(ordered.alias("s"))
    cats = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("chain_id"), F.col("o_orderpriority").alias("category"))
    return steps.join(cats, "chain_id").select(
        "chain_id", "category", F.col("s.step").alias("steps"))
