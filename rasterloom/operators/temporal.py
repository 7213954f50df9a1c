"""Operators over ordered frames.

Rows are keyed by pixel position and ordered by the dense `frame` number.
Bounded windows and decaying recurrences are cut into frame chunks with an
overlap (see `ordered.chunked`), so a clip of any length is spread over tasks.
Data-dependent delays are equi-joins on the delayed frame number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.operators.ordered import chunk_length, chunked, own_rows, shuffled_join

PIXEL = ("clip_id", "x", "y")
CHUNK = 1024


def _window(keys, lo=None, hi=0):
    w = Window.partitionBy(*keys, "_chunk").orderBy("frame")
    return w if lo is None else w.rowsBetween(lo, hi)


def previous(df: DataFrame, cols=C.RGB, *, keys=PIXEL, chunk=CHUNK, prefix="prev_") -> DataFrame:
    """The values one frame earlier; null on the first frame."""
    d = chunked(df, "frame", chunk, 1)
    w = _window(keys)
    d = d.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in cols})
    return own_rows(d, "frame", chunk)


def with_ema(df: DataFrame, cols=C.RGB, *, alpha=0.1, keys=PIXEL, chunk=CHUNK, prefix="ema_",
             shifted=True) -> DataFrame:
    """Exponential mean seeded by the first frame.

    `shifted` gives the mean before the current frame was added, which is what
    an operator sees at that frame.  Closed form inside a chunk:
    rho^k * (x_0 + sum alpha * rho^-j * x_j); the overlap makes the seed's
    error smaller than double rounding.
    """
    rho = 1.0 - alpha
    size, overlap = chunk_length(rho, 1, chunk)
    d = chunked(df, "frame", size, overlap + 1)
    k = F.col("_k")
    d = d.withColumn("_k", F.row_number().over(_window(keys)) - 1)
    run = _window(keys, Window.unboundedPreceding, 0)
    grow = F.pow(F.lit(1.0 / rho), k)
    shrink = F.pow(F.lit(rho), k)
    out = {}
    for c in cols:
        term = F.when(k == 0, F.col(c).cast("double")).otherwise(F.col(c) * F.lit(alpha) * grow)
        out[f"{prefix}{c}"] = F.sum(term).over(run) * shrink
    d = d.withColumns(out)
    if shifted:
        d = d.withColumns({n: F.lag(n).over(_window(keys)) for n in out})
    return own_rows(d.drop("_k"), "frame", size)


def decayed_max(df: DataFrame, terms: dict[str, tuple[Column, float]], *, keys=PIXEL,
                chunk=CHUNK) -> DataFrame:
    """`y = max(x, rho * y_prev)` per output column, for x >= 0.

    The running maximum of ln(x) - k ln(rho), which cannot overflow however
    different the rates are.
    """
    size, overlap = chunk, chunk_length(max(rho for _, rho in terms.values()), 1, chunk)[1]
    size = max(size, overlap)
    d = chunked(df.withColumns({f"_x{n}": e for n, (e, _) in terms.items()}), "frame", size, overlap)
    d = d.withColumn("_k", F.row_number().over(_window(keys)) - 1)
    run = _window(keys, Window.unboundedPreceding, 0)
    out = {}
    for n, (_, rho) in terms.items():
        slope = F.col("_k") * F.lit(math.log(rho))
        best = F.max(F.when(F.col(f"_x{n}") > 0, F.log(F.col(f"_x{n}")) - slope)).over(run)
        out[n] = F.coalesce(F.exp(best + slope), F.lit(0.0))
    d = d.withColumns(out)
    return own_rows(d.drop("_k", *[f"_x{n}" for n in terms]), "frame", size)


def leaky_mean(df: DataFrame, cols=C.RGB, *, retain: float, keys=PIXEL, chunk=CHUNK) -> DataFrame:
    """`y = retain * y_prev + (1 - retain) * x`, seeded by the first frame."""
    d = with_ema(df, cols, alpha=1.0 - retain, keys=keys, chunk=chunk, prefix="_y_", shifted=False)
    return d.withColumns({c: C.u8_soft(F.col(f"_y_{c}")) for c in cols}).drop(*[f"_y_{c}" for c in cols])


def delayed(df: DataFrame, offset: Column, *, keys=PIXEL, cols=C.RGB) -> DataFrame:
    """Show each pixel as it was `offset` frames ago.

    An equi-join on `(keys, frame)`: the hash spreads a long clip by frame, and
    no history is gathered.
    """
    d = df.withColumn("_src", (F.col("frame") - offset).cast("int"))
    past = df.select(*keys, F.col("frame").alias("_src"), *[F.col(c).alias(f"_{c}") for c in cols])
    j = shuffled_join(d, past, [*keys, "_src"])
    return j.withColumns({c: F.col(f"_{c}") for c in cols}).drop("_src", *[f"_{c}" for c in cols])


def filled(depth: int) -> Column:
    """Frames available in a history of `depth`."""
    return F.least(F.col("frame") + 1, F.lit(depth))


# ---- operators --------------------------------------------------------------------------

def frame_state(df: DataFrame, *, alpha=0.1) -> DataFrame:
    """Previous input and EMA as each frame sees them."""
    return with_ema(previous(df), alpha=alpha)


def _mean_diff(a: str, b: str) -> Column:
    return sum((F.abs(F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in C.RGB[1:]),
               F.abs(F.col(f"{a}r") - F.col(f"{b}r"))) / 3.0


# Per piece of a heat ramp its end, and offset and slope of red, green and blue; t counts from the piece's start.
HEAT_RAMPS = {
    "INFERNO": (4.0, [(0.25, (0, 100), (0, 0), (0, 150)), (0.5, (100, 155), (0, 50), (150, -100)),
                      (0.75, (255, 0), (50, 150), (50, -50)), (1.0, (255, 0), (200, 55), (0, 200))]),
    "VIRIDIS": (3.0, [(0.33, (68, -40), (1, 120), (84, 80)), (0.66, (28, 60), (121, 70), (164, -80)), (1.0, (88, 165), (191, 40), (84, -40))]),
    "HOT": (3.0, [(0.33, (0, 255), (0, 0), (0, 0)), (0.66, (255, 0), (0, 255), (0, 0)), (1.0, (255, 0), (255, 0), (0, 255))]),
}


def heat_ramp(t: Column, name: str = "INFERNO") -> tuple[Column, Column, Column]:
    """Piecewise-linear heat colours of a value in 0..1."""
    t, (rate, pieces) = F.round(C.clamp(0, 1, t), 9), HEAT_RAMPS[name]   # the pieces do not meet: a last bit must not choose one
    starts = [0.0, *(end for end, *_ in pieces)]

    def channel(k: int) -> Column:
        values = [F.lit(float(at[k][0])) + (t - start) * rate * float(at[k][1]) for start, (_, *at) in zip(starts, pieces)]
        out = values[-1]
        for (end, *_), v in reversed(list(zip(pieces[:-1], values))):
            out = F.when(t < end, v).otherwise(out)
        return out
    return channel(0), channel(1), channel(2)


def motion_analysis(df: DataFrame, *, source="EMA", renderMode="MASK", threshold=10.0, sensitivity=3.0,
                    backgroundColor=(0, 0, 0), accumRate=0.05, coolRate=0.01, colorMap="INFERNO", chunk=CHUNK) -> DataFrame:
    """Motion against the EMA or the previous frame: mask, heat, source, difference, accumulated heat."""
    d = (with_ema(df, chunk=chunk, prefix="_ref_") if source == "EMA"
         else previous(df, chunk=chunk, prefix="_ref_"))
    d = d.withColumn("_diff", _mean_diff("", "_ref_"))
    first = F.col("_ref_r").isNull()
    if renderMode == "ACCUMULATED_HEAT":
        from rasterloom.operators.folds import accumulated_heat
        return accumulated_heat(d, "_diff", accum=accumRate, cool=coolRate, chunk=chunk).drop("_diff", "_ref_r", "_ref_g", "_ref_b")
    motion = C.clamp(0, 1, (F.col("_diff") - float(threshold)) / 80.0 * float(sensitivity))
    d = d.withColumn("_m", motion)
    if renderMode == "MASK":
        shown = [F.col("_m") * 255.0] * 3
    elif renderMode == "HEATMAP":
        shown = heat_ramp(F.col("_m"), colorMap)
    elif renderMode == "SOURCE":
        shown = [F.col(c).cast("double") for c in C.RGB]
    else:
        shown = [F.lit(64.0) + F.col("_diff") * 3.0] * 3
    cols = {}
    for c, e, bg in zip(C.RGB, shown, backgroundColor):
        cols[c] = (F.when(first, C.u8_soft(F.col(c) * 0.3))
                   .when(F.col("_diff") < float(threshold), F.lit(int(bg))).otherwise(C.u8_soft(e)))
    return d.withColumns(cols).drop("_diff", "_m", "_ref_r", "_ref_g", "_ref_b")


def scene_separation(df: DataFrame, *, mode="FOREGROUND", threshold=20.0, feather=5.0,
                     background="TRANSPARENT", bgColor=(0, 0, 0), learnRate=0.02,
                     frozenFrame="FIRST", chunk=CHUNK) -> DataFrame:
    """Split moving foreground from the running background."""
    d = with_ema(df, chunk=chunk, prefix="_e_")
    d = d.withColumn("_diff", _mean_diff("", "_e_"))
    d = d.withColumn("_mv", C.smoothstep(max(0.0, threshold - feather), threshold + feather, F.col("_diff")))
    mv, st = F.col("_mv"), F.lit(1.0) - F.col("_mv")
    if mode == "FREEZE" and frozenFrame == "FIRST":
        first = df.where("frame = 0").select(*PIXEL, *[F.col(c).alias(f"_z_{c}") for c in C.RGB])
        d = shuffled_join(d, first, list(PIXEL))   # one row a pixel of every clip
    cols = {}
    for c, bg in zip(C.RGB, bgColor):
        e, x = F.col(f"_e_{c}"), F.col(c)
        if mode == "BACKGROUND":
            v = e * st + (e * (1.0 - learnRate) + x * learnRate) * mv
        elif mode == "FREEZE":
            v = (F.col(f"_z_{c}") if frozenFrame == "FIRST" else e) * st + x * mv
        elif background == "TRANSPARENT":
            v = x.cast("double")
        elif background == "DIM":
            v = x * mv + x * 0.2 * st
        else:
            v = x * mv + F.lit(float(bg)) * st
        cols[c] = F.when(F.col("_e_r").isNull(), x).otherwise(C.u8_soft(v))
    if mode == "FOREGROUND" and background == "TRANSPARENT":
        cols["a"] = F.when(F.col("_e_r").isNull(), 255).otherwise(C.jr(mv * 255.0 + 1e-9))
    return d.withColumns(cols).select(*df.columns)


def foreground_rows(df: DataFrame, *, threshold=20.0, feather=5.0, chunk=CHUNK) -> DataFrame:
    """Only the rows that are mostly moving."""
    d = with_ema(df, chunk=chunk, prefix="_e_").withColumn("_diff", _mean_diff("", "_e_"))
    mv = C.smoothstep(max(0.0, threshold - feather), threshold + feather, F.col("_diff"))
    return d.where(F.col("_e_r").isNotNull() & (mv > 0.5)).select(*df.columns)


def temporal_edge(df: DataFrame, *, threshold=15.0, sensitivity=3.0, accumulate=True, decayRate=0.08,
                  chunk=CHUNK) -> DataFrame:
    """Frame difference above a threshold, fading out."""
    d = previous(df, chunk=chunk, prefix="_p_")
    edge = {c: F.coalesce(C.clamp(0, 255, F.greatest(
        F.abs(F.col(c) - F.col(f"_p_{c}")) - float(threshold), F.lit(0.0)) * float(sensitivity)),
        F.lit(0.0)) for c in C.RGB}
    if not accumulate:
        return d.withColumns({c: C.u8_soft(e) for c, e in edge.items()}).select(*df.columns)
    d = decayed_max(d, {f"_d_{c}": (e, 1.0 - decayRate) for c, e in edge.items()}, chunk=chunk)
    return d.withColumns({c: C.u8_soft(F.col(f"_d_{c}")) for c in C.RGB}).select(*df.columns)


def long_exposure(df: DataFrame, *, mode="BLEND", blendFactor=0.7, windowSize=8, decay=0.05,
                  brightnessThreshold=30.0, chunk=CHUNK) -> DataFrame:
    """Shutter mean, leaky blends, or brightest-so-far trails."""
    if mode == "SHUTTER":
        d = chunked(df, "frame", chunk, windowSize - 1)
        w = _window(PIXEL, -(windowSize - 1), 0)
        d = d.withColumns({c: C.u8_soft(F.avg(c).over(w)) for c in C.RGB})
        return own_rows(d, "frame", chunk)
    if mode == "BLEND":
        return leaky_mean(df, retain=blendFactor, chunk=chunk)
    if mode == "RUNNING":
        return leaky_mean(df, retain=1.0 - decay, chunk=chunk)
    lum = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    above = (lum >= float(brightnessThreshold)) | (F.col("frame") == 0)
    if mode == "MAX":
        d = decayed_max(df, {f"_d_{c}": (F.when(above, F.col(c).cast("double")).otherwise(F.lit(0.0)),
                                         1.0 - decay) for c in C.RGB}, chunk=chunk)
        return d.withColumns({c: C.u8_soft(F.col(f"_d_{c}")) for c in C.RGB}).select(*df.columns)
    if mode == "ADDITIVE":
        from rasterloom.operators.folds import additive_exposure
        return additive_exposure(df, decay=decay, brightnessThreshold=brightnessThreshold, chunk=chunk)
    raise ValueError(f"unknown mode {mode!r}")


def phosphor_decay(df: DataFrame, *, redDecay=0.15, greenDecay=0.05, blueDecay=0.2, chunk=CHUNK) -> DataFrame:
    rates = dict(zip(C.RGB, (redDecay, greenDecay, blueDecay)))
    d = decayed_max(df, {f"_d_{c}": (F.col(c).cast("double"), 1.0 - k) for c, k in rates.items()}, chunk=chunk)
    return d.withColumns({c: C.u8_soft(F.col(f"_d_{c}")) for c in C.RGB}).select(*df.columns)


def echo_combiner(df: DataFrame, *, gain=2.0, baseline="ORIGINAL", chunk=CHUNK) -> DataFrame:
    d = with_ema(df, chunk=chunk, prefix="_e_")

    def one(c: str) -> Column:
        base = F.col(c) if baseline == "ORIGINAL" else F.lit(0)
        return F.when(F.col(f"_e_{c}").isNull(), base).otherwise(
            C.u8_soft(base + F.abs(F.col(c) - F.col(f"_e_{c}")) * float(gain)))
    return d.withColumns({c: one(c) for c in C.RGB}).select(*df.columns)


def chronophotography(df: DataFrame, *, exposures=8, interval=2, blendMode="LIGHTEN", fadeMode="LINEAR",
                      isolateSubject=False, chunk=CHUNK) -> DataFrame:
    """Combine the last `exposures` captures; a capture is every `interval`-th frame.

    The history of a frame is the captures up to it, at most `exposures`, so a
    bounded frame window over captured values is enough.
    """
    span = exposures * interval
    d = with_ema(df, chunk=chunk, prefix="_e_") if isolateSubject else df
    d = chunked(d, "frame", chunk, span)
    captured = F.pmod("frame", F.lit(interval)) == 0
    hist = F.collect_list(F.when(captured, F.struct("frame", "r", "g", "b"))).over(_window(PIXEL, -(span - 1), 0))
    d = d.withColumn("_h", hist)
    if isolateSubject:
        def far(h):
            return sum((F.abs(h[c] - F.col(f"_e_{c}")) for c in C.RGB[1:]),
                       F.abs(h["r"] - F.col("_e_r"))) / 3.0 >= 15.0
        d = d.withColumn("_use", F.transform("_h", lambda h: F.when(F.col("_e_r").isNull(), True).otherwise(far(h))))
    else:
        d = d.withColumn("_use", F.transform("_h", lambda h: F.lit(True)))

    def vals(c: str) -> Column:
        return F.filter(F.transform(F.col("_h"), lambda h, i: F.struct(
            F.element_at("_use", i + 1).alias("u"), h[c].alias("v"),
            (i + 1 if fadeMode == "TAIL" else F.size("_h") - i if fadeMode == "HEAD"
             else F.lit(1)).alias("w"))), lambda s: s["u"])

    def one(c: str) -> Column:
        v = vals(c)
        plain = F.transform(v, lambda s: s["v"])
        if blendMode == "LIGHTEN":
            return F.coalesce(F.array_max(plain), F.lit(0))
        if blendMode == "DARKEN":
            return F.coalesce(F.array_min(plain), F.lit(255))
        num = F.aggregate(v, F.lit(0).cast("bigint"), lambda s, e: s + e["v"] * e["w"])
        den = F.aggregate(v, F.lit(0).cast("bigint"), lambda s, e: s + e["w"])
        return F.when(den > 0, C.u8_soft(num / F.nullif(den, F.lit(0)))).otherwise(F.lit(0))
    d = d.withColumns({c: one(c) for c in C.RGB})
    return own_rows(d, "frame", chunk).select(*df.columns)


def time_median(df: DataFrame, *, windowSize=5, chunk=CHUNK) -> DataFrame:
    """Upper median of the last `windowSize` values per channel."""
    d = chunked(df, "frame", chunk, windowSize - 1)
    w = _window(PIXEL, -(windowSize - 1), 0)

    def med(c: str) -> Column:
        s = F.array_sort(F.collect_list(c).over(w))
        return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))
    return own_rows(d.withColumns({c: med(c) for c in C.RGB}), "frame", chunk)


def slit_scan(df: DataFrame, *, width: int, height: int, direction="HORIZONTAL", depth=30,
              reverse=False) -> DataFrame:
    """Column (or row) i shows an older frame the further it is from the newest edge."""
    pos, n = (F.col("x"), width) if direction == "HORIZONTAL" else (F.col("y"), height)
    have = filled(depth) - 1
    back = F.floor(pos * have / float(max(1, n - 1)))
    return delayed(df, back if reverse else have - back)


def pov_bands(df: DataFrame, *, height: int, bands=8, framesPerBand=3) -> DataFrame:
    tall = math.ceil(height / bands)
    band = F.least(F.lit(bands - 1), F.floor(F.col("y") / tall))
    depth = (bands - 1) * framesPerBand + 1
    return delayed(df, F.least(filled(depth) - 1, band * framesPerBand))


def time_warp_displacement(df: DataFrame, *, width: int, height: int, depth=16, source="LUMINANCE",
                           direction="BRIGHT_RECENT") -> DataFrame:
    """Delay chosen by the current pixel's luma, or by x or y."""
    t = {"LUMINANCE": C.luma_unit(), "X": F.col("x") / float(max(1, width - 1)),
         "Y": F.col("y") / float(max(1, height - 1))}[source]
    if direction == "BRIGHT_OLDEST":
        t = F.lit(1.0) - t
    have = filled(depth) - 1
    return delayed(df, F.least(have, F.floor(t * have + 0.5)))


# Odd factors that spread a tile's position over 32 bits.
TILE_MIX = (374761393, 668265263, 1442695041, 1274126177)


def tile_hash(tx: Column, ty: Column, seed: int = 0) -> Column:
    """Hash of a tile position to [0, 1), in whole numbers below 2^63."""
    m = F.pmod(tx.cast("long") * TILE_MIX[0] + ty.cast("long") * TILE_MIX[1] + seed * TILE_MIX[2], F.lit(1 << 32))
    m = F.pmod(m.bitwiseXOR(F.shiftright(m, 13)) * TILE_MIX[3], F.lit(1 << 32))
    return m.bitwiseXOR(F.shiftright(m, 16)) / float(1 << 32)


def time_mosaic(df: DataFrame, *, width: int, height: int, tileSize=24, maxDelay=10,
                pattern="RANDOM") -> DataFrame:
    """Each tile runs with its own delay."""
    bx, by = F.floor(F.col("x") / tileSize), F.floor(F.col("y") / tileSize)
    nx, ny = math.ceil(width / tileSize), math.ceil(height / tileSize)
    if pattern == "CHECKERBOARD":
        delay = F.when((bx + by) % 2 == 0, 0).otherwise(maxDelay - 1)
    elif pattern == "RADIAL":
        cx, cy = nx / 2, ny / 2
        dist = F.sqrt((bx - cx) * (bx - cx) + (by - cy) * (by - cy)) / math.sqrt(cx * cx + cy * cy)
        delay = F.floor(dist * (maxDelay - 1))
    elif pattern == "GRADIENT":
        delay = F.floor(bx / float(max(1, nx - 1)) * (maxDelay - 1))
    else:
        delay = F.floor(tile_hash(bx, by) * maxDelay)
    return delayed(df, F.least(delay, filled(maxDelay) - 1))


def stop_motion(df: DataFrame, *, holdFrames=6) -> DataFrame:
    """Hold each captured frame for `holdFrames` frames."""
    return delayed(df, F.pmod("frame", F.lit(holdFrames)))


def keyframe_smear(df: DataFrame, *, keyframeInterval=8, smear=0.65) -> DataFrame:
    """Mix the current frame with its latest keyframe."""
    keep = df.select("*", *[F.col(c).alias(f"_c{c}") for c in C.RGB])
    d = delayed(keep, F.pmod("frame", F.lit(keyframeInterval)))
    return d.withColumns({c: C.u8_soft(F.col(c) * float(smear) + F.col(f"_c{c}") * (1.0 - smear))
                          for c in C.RGB}).drop("_cr", "_cg", "_cb")


def motion_pixelate(df: DataFrame, *, blockSize=12, invert=False, threshold=5.0, chunk=CHUNK) -> DataFrame:
    """Blocks that move are replaced by their mean."""
    block = {"_bx": F.floor(F.col("x") / blockSize), "_by": F.floor(F.col("y") / blockSize)}
    d = with_ema(df, chunk=chunk, prefix="_e_").withColumns(block)
    d = d.withColumn("_diff", _mean_diff("", "_e_"))
    by = ["clip_id", "frame", "_bx", "_by"]
    stats = d.groupBy(*by).agg(F.avg("_diff").alias("_motion"),
                               *[C.jr(F.avg(c)).alias(f"_m{c}") for c in C.RGB])
    hit = F.col("_motion") < float(threshold) if invert else F.col("_motion") > float(threshold)
    d = shuffled_join(d, stats, by)
    return d.withColumns({c: F.when(F.coalesce(hit, F.lit(False)), F.col(f"_m{c}")).otherwise(F.col(c))
                          for c in C.RGB}).select(*df.columns)


def reset_sessions(df: DataFrame, keys: list[str], bucket: str, order: list[str], index: str) -> DataFrame:
    """Session ids that advance whenever the frame index restarts (drops)."""
    from rasterloom.operators.ordered import bucketed_neighbour, bucketed_running_sum
    d = bucketed_neighbour(df, keys, bucket, order, [index])
    restart = F.when(F.col(index) < F.col(f"prev_{index}"), 1).otherwise(0)
    return bucketed_running_sum(d, keys, bucket, order, restart, "session").drop(f"prev_{index}")
