"""Ordered work that never gathers a whole key in one task.

A plain `Window.partitionBy(key).orderBy(t)` puts a hot key in one task.  The
helpers here split each key into bounded buckets of its order column, run the
window inside a bucket, and carry the little that crosses a bucket border in a
per-bucket summary row (pre-aggregated before it is shuffled).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition rows that are about to be multiplied.

    The partition count is given, so AQE does not coalesce by the size of the
    compact rows what becomes many times larger after the explode.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.master.startswith("local"):   # more tasks than cores gain nothing there
        n = min(n, spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


def shuffled_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join two sides that both grow with the data.

    The hint keeps Catalyst from broadcasting a side whose size it
    underestimates after an explode; AQE may still split skewed partitions.
    """
    return left.join(right.hint("merge"), on, how)


def bucketed_rank(df: DataFrame, keys: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """0-based dense position of each row in its key, in `(bucket, order)` order.

    Offsets are a running sum over per-bucket counts, so the only whole-key
    window runs over one row per bucket.
    """
    by = [*keys, bucket]
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*by).agg(F.count("*").alias("_n")).select(
        *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return (df.withColumn("_rn", local).join(offsets, by)
            .withColumn(out, F.col("_off") + F.col("_rn") - 1)
            .drop("_rn", "_off"))


def bucketed_running_sum(df: DataFrame, keys: list[str], bucket: str, order: list,
                         value: Column, out: str) -> DataFrame:
    """Inclusive running sum per key, split by bucket."""
    by = [*keys, bucket]
    df = df.withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*by).agg(F.sum("_v").alias("_t")).select(
        *by, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    local = F.sum("_v").over(
        Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (df.withColumn("_run", local).join(offsets, by)
            .withColumn(out, F.col("_off") + F.col("_run")).drop("_v", "_run", "_off"))


def bucketed_neighbour(df: DataFrame, keys: list[str], bucket: str, order: list[str],
                       cols: list[str], *, forward: bool = False,
                       prefix: str = "prev_") -> DataFrame:
    """`lag` (or `lead`) of `cols` per key, split by bucket.

    The row next to a bucket border comes from the summary of the nearest
    non-empty bucket on that side.
    """
    by = [*keys, bucket]
    w = Window.partitionBy(*by).orderBy(*order)
    payload, rank = F.struct(*cols), F.struct(*order)
    if forward:
        edge = F.min_by(payload, rank)
        near = F.lead("_edge").over(Window.partitionBy(*keys).orderBy(bucket))
        local = F.lead(payload).over(w)
    else:
        edge = F.max_by(payload, rank)
        near = F.lag("_edge").over(Window.partitionBy(*keys).orderBy(bucket))
        local = F.lag(payload).over(w)
    edges = df.groupBy(*by).agg(edge.alias("_edge")).select(*by, near.alias("_near"))
    joined = df.withColumn("_local", local).join(edges, by)
    picked = F.coalesce("_local", "_near")
    return joined.withColumns({f"{prefix}{c}": picked[c] for c in cols}).drop("_local", "_near")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], *, left_ts: str,
              right_ts: str, payload: list[str], width: int,
              tie: list[str] | None = None) -> DataFrame:
    """Last `right` row with `right_ts <= left_ts`, else the key's first one.

    Both sides are cut into `width`-wide time buckets; a bucket sees its own
    rows plus one carried row from the nearest earlier non-empty bucket.
    """
    body = F.struct(*[F.col(c) for c in (right_ts, *payload)])
    lcols = [c for c in left.columns if c not in keys]
    rank = F.struct(*tie) if tie else F.struct(F.lit(0).alias("t"))
    ticks = left.select(*keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_kind"),
                        F.struct(*lcols).alias("_l"))
    rows = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_kind"),
                        body.alias("_r"), rank.alias("_rank"))
    both = ticks.unionByName(rows, allowMissingColumns=True).withColumn(
        "_b", F.floor(F.col("_t") / F.lit(width)).cast("long"))
    by = [*keys, "_b"]
    w = (Window.partitionBy(*by).orderBy("_t", "_kind", "_rank")
         .rowsBetween(Window.unboundedPreceding, 0))
    before = (Window.partitionBy(*keys).orderBy("_b")
              .rowsBetween(Window.unboundedPreceding, -1))
    edges = both.groupBy(*by).agg(
        F.max_by("_r", F.when(F.col("_kind") == 0, F.struct("_t", "_rank"))).alias("_last_r")).select(
        *by, F.last("_last_r", ignorenulls=True).over(before).alias("_carry"))
    first = rows.groupBy(*keys).agg(F.min_by("_r", F.struct("_t", "_rank")).alias("_first"))
    found = (both.withColumn("_local", F.last("_r", ignorenulls=True).over(w))
             .where("_kind = 1").join(edges, by).join(first, keys))
    hit = F.coalesce("_local", "_carry", "_first")
    return found.select(*keys, "_l.*", *[hit[c].alias(c) for c in (right_ts, *payload)])


def chunk_length(decay: float | None, lookback: int, chunk: int) -> tuple[int, int]:
    """Chunk and overlap sizes for a window or a decaying recurrence.

    For a recurrence with factor `decay`, an overlap of L frames leaves an
    error of decay**L; L is chosen so that this is below double rounding.
    """
    if decay is None:
        return chunk, lookback
    per = -math.log10(min(max(decay, 1e-3), 1 - 1e-9))
    overlap = max(1, math.ceil(18 / per))
    room = max(1, int(280 / per) - overlap)   # keeps decay**-(chunk+overlap) finite
    return max(1, min(max(chunk, overlap), room)), overlap


def chunked(df: DataFrame, order: str, chunk: int, overlap: int) -> DataFrame:
    """Copy each row into every chunk that looks back at it (`_chunk`).

    Only the last `overlap` positions of a chunk are copied.  Drop the copies
    with `own_rows` once the window columns are computed.
    """
    first = F.floor(F.col(order) / chunk).cast("long")
    last = F.floor((F.col(order) + overlap) / chunk).cast("long")
    return df.withColumn("_chunk", F.explode(F.sequence(first, last)))


def own_rows(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.where(F.col("_chunk") == F.floor(F.col(order) / chunk)).drop("_chunk")
