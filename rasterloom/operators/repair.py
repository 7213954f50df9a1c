"""Corruption, integrity checks and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.operators.ordered import shuffled_join

FRAME = ("clip_id", "frame")


def _rotl8(mask: Column, k: int) -> Column:
    return F.shiftleft(mask, k).bitwiseOR(F.shiftright(mask, 8 - k)).bitwiseAND(F.lit(255))


def bitplane_dropout(df: DataFrame, masks: DataFrame, *, mode="DROP", perChannel=True, chunk=1024) -> DataFrame:
    """Drop, flip or freeze masked bits per channel.

    `masks(clip_id, frame, mask)` has one row per damaged frame; frames without
    one pass through.  FREEZE takes the bits of the previous input frame.
    """
    from rasterloom.operators.temporal import previous
    d = previous(df, chunk=chunk, prefix="_p_") if mode == "FREEZE" else df
    d = d.join(masks, list(FRAME), "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    per = {"r": _rotl8(F.col("mask"), 1), "g": F.col("mask"), "b": _rotl8(F.col("mask"), 7)}

    def one(c: str) -> Column:
        m = per[c] if perChannel else F.col("mask")
        kept = F.col(c).bitwiseAND(F.lit(255) - m)
        if mode == "FLIP":
            return F.col(c).bitwiseXOR(m)
        if mode == "FREEZE":
            return kept.bitwiseOR(F.coalesce(F.col(f"_p_{c}").bitwiseAND(m), F.lit(0)))
        return kept
    return d.withColumns({c: one(c) for c in C.RGB}).select(*df.columns)


def stripe_checksums(df: DataFrame, stripeHeight: int) -> DataFrame:
    """CRC-32 of each stripe's pixels in row-major order (a stripe is one bounded list)."""
    px = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    text = F.array_join(F.transform(px, lambda p: F.concat_ws(",", p["r"], p["g"], p["b"])), ";")
    return (df.groupBy(*FRAME, F.floor(F.col("y") / stripeHeight).cast("int").alias("stripe"))
            .agg(F.crc32(text).alias("crc")))


def crc_stripe_reject(df: DataFrame, expected: DataFrame, *, height: int, stripeHeight=8, conceal="HOLD",
                      chunk=1024) -> DataFrame:
    """Compare stripe checksums with the expected ones and conceal the bad stripes.

    `expected(clip_id, frame, stripe, crc)`.  BLACK; HOLD shows the last good
    content of the same pixel; ABOVE copies the row above; NEAREST takes the
    closest good row of the column (the upper one on a tie).
    """
    mine = stripe_checksums(df, stripeHeight)
    good = mine.join(expected.withColumnRenamed("crc", "_want"), [*FRAME, "stripe"], "left").select(
        *FRAME, "stripe", (F.col("crc") == F.col("_want")).alias("_ok"))
    d = df.withColumn("stripe", F.floor(F.col("y") / stripeHeight).cast("int"))
    d = shuffled_join(d, good, [*FRAME, "stripe"]).withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    rgb = F.struct(*C.RGB)
    if conceal == "BLACK":
        fill = F.struct(*[F.lit(0).alias(c) for c in C.RGB])
    elif conceal == "HOLD":
        return _hold_last_good(d, chunk).select(*df.columns)
    elif conceal == "ABOVE":
        col = Window.partitionBy(*FRAME, "x").orderBy("y")
        fill = F.coalesce(F.lag(rgb).over(col), rgb)
    else:
        col = Window.partitionBy(*FRAME, "x").orderBy("y")
        sound = F.when(F.col("_ok"), F.struct("y", *C.RGB))
        up = F.last(sound, ignorenulls=True).over(col.rowsBetween(Window.unboundedPreceding, 0))
        down = F.first(sound, ignorenulls=True).over(col.rowsBetween(0, Window.unboundedFollowing))
        d = d.withColumns({"_up": up, "_down": down})
        use_up = F.col("_down").isNull() | (F.col("y") - F.col("_up.y") <= F.col("_down.y") - F.col("y"))
        pick = F.when(use_up, F.col("_up")).otherwise(F.col("_down"))
        fill = F.struct(*[F.coalesce(pick[c], F.lit(0)).alias(c) for c in C.RGB])
    d = d.withColumn("_f", fill)
    return d.withColumns({c: F.when(F.col("_ok"), F.col(c)).otherwise(F.col("_f")[c]) for c in C.RGB}).select(*df.columns)


def _hold_last_good(d: DataFrame, chunk: int) -> DataFrame:
    """Last good colour per pixel, split by frame chunk with one carried row per chunk."""
    keys = ["clip_id", "x", "y"]
    d = d.withColumn("_chunk", F.floor(F.col("frame") / chunk).cast("long"))
    by = [*keys, "_chunk"]
    sound = F.when(F.col("_ok"), F.struct(*C.RGB))
    w = Window.partitionBy(*by).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edge = d.groupBy(*by).agg(F.max_by(sound, F.when(F.col("_ok"), F.col("frame"))).alias("_e"))
    carry = edge.select(*by, F.last("_e", ignorenulls=True).over(before).alias("_carry"))
    d = d.withColumn("_local", F.last(sound, ignorenulls=True).over(w)).join(carry, by)
    hit = F.coalesce("_local", "_carry")
    return d.withColumns({c: F.coalesce(hit[c], F.lit(0)) for c in C.RGB})


def data_bend(df: DataFrame, *, width: int, height: int, effect="ECHO", intensity=0.5, offset=100) -> DataFrame:
    """Treat a frame's pixels as one signal in row-major order.

    Every effect reads the signal at computed positions, so it is a scatter
    of each sample to the positions it serves and one aggregate per frame pixel.
    """
    n = width * height
    i = F.col("y") * width + F.col("x")
    if effect in ("ECHO", "REVERB"):
        delays = [(1, intensity)] if effect == "ECHO" else [(k, intensity * 0.6 ** k) for k in range(1, 6)]
        reach = F.array(*[F.struct((i + offset * k).cast("int").alias("p"), F.lit(k).alias("k")) for k in
                          [0, *[k for k, _ in delays]]])
        t = df.select(*FRAME, *C.RGB, "a", F.inline(reach)).where(F.col("p") < n)
        take = {f"_{c}{k}": F.max(F.when(F.col("k") == k, F.col(c))) for c in C.RGB for k in [0, *[k for k, _ in delays]]}
        s = t.groupBy(*FRAME, "p").agg(*[e.alias(m) for m, e in take.items()],
                                       F.max(F.when(F.col("k") == 0, F.col("a"))).alias("a"))
        for k, decay in delays:   # each echo is rounded and capped before the next, so the steps are staged
            s = s.withColumns({f"_{c}0": F.coalesce(F.least(F.lit(255), C.jr(
                F.col(f"_{c}0") + F.col(f"_{c}{k}") * float(decay))), F.col(f"_{c}0")) for c in C.RGB})
        return s.select(*FRAME, F.pmod("p", F.lit(width)).cast("int").alias("x"),
                        F.floor(F.col("p") / width).cast("int").alias("y"),
                        *[F.col(f"_{c}0").alias(c) for c in C.RGB], "a")
    if effect == "BITCRUSH":
        bits = max(1, int(8 - intensity * 6 + 0.5))
        step = float(2 ** (8 - bits))
        hold = max(1, int(offset / 10 + 0.5))
        start = (F.floor(i / hold) * hold).cast("int")
        run = Window.partitionBy(*FRAME, "_s").orderBy("_i")
        d = df.withColumns({"_s": start, "_i": i})
        return d.withColumns({c: F.least(F.lit(255), F.first(C.jr(
            F.floor(F.col(c) / step + 0.5) * step)).over(run)) for c in C.RGB}).drop("_s", "_i")
    # REVERSE: every other chunk runs backwards
    part = F.floor(i / offset)
    start = part * offset
    end = F.least(start + offset, F.lit(n))
    p = F.when(F.pmod(part, F.lit(2)) == 0, start + end - 1 - i).otherwise(i)
    moved = df.withColumn("_p", p.cast("int"))
    return moved.withColumns({"x": F.pmod("_p", F.lit(width)).cast("int"),
                              "y": F.floor(F.col("_p") / width).cast("int")}).drop("_p")
