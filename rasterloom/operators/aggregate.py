"""Histograms, cells, palettes and totals.

Everything here is a partial/final hash aggregate on small keys; the only
windows run over tables of at most 256 bins or over colour-count tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.operators.lineage import cut_lineage
from rasterloom.operators.ordered import shuffled_join


def unique_colours(df: DataFrame, *, limit: int | None = None, order: str = "asc") -> DataFrame:
    """Distinct colours with counts; `limit` keeps the rarest (or commonest with "desc").

    Ties are ordered by colour so the cut is repeatable.
    """
    out = df.groupBy("r", "g", "b", "a").agg(F.count("*").alias("n"))
    if limit is None:
        return out
    n = F.col("n").asc() if order == "asc" else F.col("n").desc()
    return out.orderBy(n, "r", "g", "b", "a").limit(limit)


def luma_bin() -> Column:
    return C.jr(C.luma())


def histogram(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return df.withColumn("bin", value).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def channel_histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """Histograms of r, g, b and luma in one pass."""
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(n).alias("channel"), e.alias("bin"))
        for n, e in (("r", F.col("r")), ("g", F.col("g")), ("b", F.col("b")), ("luma", luma_bin()))])))
    return long.groupBy(*keys, "channel", "bin").agg(F.count("*").alias("n"))


def _cdf_map(hist: DataFrame, keys: list[str]) -> DataFrame:
    """`mapped` = round((cdf - cdfMin) / (N - cdfMin) * 255) per bin (at most 256 rows per key)."""
    by_bin = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    h = hist.withColumn("_cdf", F.sum("n").over(by_bin.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumns({"_min": F.min("_cdf").over(whole), "_N": F.sum("n").over(whole)})
    flat = F.col("_N") == F.col("_min")
    m = C.jr((F.col("_cdf") - F.col("_min")) / F.nullif(F.col("_N") - F.col("_min"), F.lit(0)) * 255.0)
    return h.select(*keys, "bin", F.when(flat, F.col("bin")).otherwise(m).alias("mapped"))


def histogram_equalization(df: DataFrame, *, keys=("clip_id", "frame")) -> DataFrame:
    """Equalise luma per frame; RGB is scaled by mapped/luma."""
    keys = list(keys)
    d = df.withColumn("bin", luma_bin())
    lut = _cdf_map(histogram(df, keys, luma_bin()), keys)
    d = shuffled_join(d, lut, [*keys, "bin"]).withColumn("_l", C.luma_unit())
    k = F.when(F.col("_l") > 1 / 255.0, F.col("mapped") / 255.0 / F.col("_l")).otherwise(F.lit(1.0))
    d = d.withColumn("_k", k)
    return d.withColumns({c: C.from_unit(C.unit(c) * F.col("_k")) for c in C.RGB}).drop(
        "bin", "mapped", "_l", "_k")


def histogram_equalization_per_channel(df: DataFrame, *, keys=("clip_id", "frame")) -> DataFrame:
    """Three separate tables per frame, packed to one map row and looked up in place.

    A frame's tables hold at most 3 * 256 entries, so they travel as one row
    per frame and pixels join once instead of three times.
    """
    keys = list(keys)
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("ch"), F.col(c).alias("bin")) for c in C.RGB])))
    lut = _cdf_map(long.groupBy(*keys, "ch", "bin").agg(F.count("*").alias("n")), [*keys, "ch"])
    packed = lut.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", "ch", "bin").alias("k"), F.col("mapped").alias("v")))).alias("_lut"))
    d = shuffled_join(df, packed, keys)
    return d.withColumns({c: F.col("_lut")[F.concat_ws(":", F.lit(c), F.col(c))]
                          for c in C.RGB}).drop("_lut")


def clahe(df: DataFrame, *, width: int, height: int, tileSize=32, clipLimit=3.0,
          keys=("clip_id", "frame")) -> DataFrame:
    """Contrast-limited equalisation: per-tile clipped CDFs, bilinear mix of four tiles.

    A tile's 256-entry CDF is one array row; the tiles of a frame are looked up
    by an equi-join on the four corner ids exploded per pixel.
    """
    keys = list(keys)
    tx_n, ty_n = math.ceil(width / tileSize), math.ceil(height / tileSize)
    tile = {"tx": F.floor(F.col("x") / tileSize).cast("int"), "ty": F.floor(F.col("y") / tileSize).cast("int")}
    hist = (df.withColumns(tile).withColumn("bin", luma_bin())
            .groupBy(*keys, "tx", "ty", "bin").agg(F.count("*").alias("n"))
            .groupBy(*keys, "tx", "ty").agg(
                F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"),
                F.sum("n").alias("_total")))
    dense = hist.withColumns({
        "_cap": F.greatest(F.lit(1), C.jr(F.col("_total") * float(clipLimit) / 256.0))}).withColumn(
        "_excess", F.aggregate(F.map_values("h"), F.lit(0).cast("bigint"),
                               lambda s, v: s + F.greatest(F.lit(0), v - F.col("_cap"))))
    cut = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.struct(
        i.alias("bin"), F.least(F.coalesce(F.element_at("h", i), F.lit(0)), F.col("_cap")).alias("n")))
    dense = dense.select(*keys, "tx", "ty", "_total", "_excess", F.inline(cut))
    run = F.sum("n").over(Window.partitionBy(*keys, "tx", "ty").orderBy("bin")
                          .rowsBetween(Window.unboundedPreceding, 0))
    share = F.floor(F.col("_excess") / 256)
    total = run + share * (F.col("bin") + 1) + F.least(F.col("bin") + 1, F.col("_excess") - share * 256)
    cdf = (dense.withColumn("_v", C.jr(total / F.col("_total") * 255.0))
           .groupBy(*keys, "tx", "ty").agg(F.transform(
               F.array_sort(F.collect_list(F.struct("bin", "_v"))), lambda e: e["_v"]).alias("cdf")))

    fx = (F.col("x") + 0.5) / tileSize - 0.5
    fy = (F.col("y") + 0.5) / tileSize - 0.5
    d = df.withColumns({"_tx0": F.greatest(F.lit(0), F.floor(fx)).cast("int"),
                        "_ty0": F.greatest(F.lit(0), F.floor(fy)).cast("int"),
                        "_l": luma_bin()})
    d = d.withColumns({"_wx": C.clamp(0, 1, fx - F.col("_tx0")), "_wy": C.clamp(0, 1, fy - F.col("_ty0"))})
    corners = F.array(*[F.struct(
        F.least(F.lit(tx_n - 1), F.col("_tx0") + i).alias("tx"),
        F.least(F.lit(ty_n - 1), F.col("_ty0") + j).alias("ty"),
        ((F.col("_wx") if i else F.lit(1.0) - F.col("_wx"))
         * (F.col("_wy") if j else F.lit(1.0) - F.col("_wy"))).alias("w"))
        for j in (0, 1) for i in (0, 1)])
    taps = d.select(*keys, "x", "y", "r", "g", "b", "a", "_l", F.inline(corners))
    mapped = (shuffled_join(taps, cdf, [*keys, "tx", "ty"])
              .groupBy(*keys, "x", "y", "r", "g", "b", "a", "_l")
              .agg(F.sum(F.col("w") * F.element_at("cdf", F.col("_l") + 1)).alias("_m")))
    k = F.when(F.col("_l") > 0, F.round(F.col("_m"), 9) / F.col("_l")).otherwise(F.lit(1.0))
    return mapped.withColumn("_k", k).withColumns(
        {c: C.u8(F.col(c) * F.col("_k")) for c in C.RGB}).drop("_l", "_m", "_k")


def min_max_equalise(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """`(v - min) * 256 / (max - min)` per key; the range is one row per key."""
    rng = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    return df.join(rng, keys).withColumn(
        out, (F.col(value) - F.col("_lo")) * 256.0 / span).drop("_lo", "_hi")


def colour_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("r", "g", "b").agg(F.count("*").alias("n"))


def median_cut_palette(df: DataFrame, *, limit: int, adaptMode="MID", colorMode="RGB") -> DataFrame:
    """`palette(idx, r, g, b)` of 2**limit buckets.

    Runs on the colour-count table.  Each round ranks colours by pixel position
    inside their bucket: offsets per channel value first, then an order inside
    one channel value (at most 65 536 colours), and cuts at half the pixels; a
    colour that straddles the cut is split in two rows.
    """
    counts = colour_counts(df)
    if colorMode == "LAB":
        f = C.lab("r", "g", "b")
        counts = counts.withColumns({"c0": f["l"], "c1": f["a"], "c2": f["b"]})
    else:
        counts = counts.withColumns({"c0": F.col("r"), "c1": F.col("g"), "c2": F.col("b")})
    t = cut_lineage(counts.withColumn("bucket", F.lit(0)))
    rng = t.agg(*[(F.max(f"c{k}") - F.min(f"c{k}")).alias(f"c{k}") for k in range(3)]).first()
    order = sorted(range(3), key=lambda k: -rng[f"c{k}"])
    for depth in range(limit):
        t = _rank_pixels(t, f"c{order[depth % 3]}")
        left = F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.col("_size") / 2) - F.col("_at")))
        parts = F.array(F.struct((F.col("bucket") * 2).alias("bucket"), left.alias("n")),
                        F.struct((F.col("bucket") * 2 + 1).alias("bucket"), (F.col("n") - left).alias("n")))
        t = cut_lineage(t.select("r", "g", "b", "c0", "c1", "c2", F.inline(parts)).where("n > 0"))
    t = _rank_pixels(t, f"c{order[limit % 3]}")
    return _bucket_colours(t, adaptMode, colorMode).withColumn(
        "idx", F.row_number().over(Window.orderBy("bucket")) - 1).select("idx", "r", "g", "b")


def _rank_pixels(t: DataFrame, ch: str) -> DataFrame:
    """Add `_at`, the pixels before this colour in its bucket (widest channel
    descending), and `_size`, the pixels of the bucket."""
    per = t.groupBy("bucket", ch).agg(F.sum("n").alias("_n"))
    w = Window.partitionBy("bucket").orderBy(F.col(ch).desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("bucket", ch, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
                     F.sum("_n").over(Window.partitionBy("bucket")).alias("_size"))
    inner = (Window.partitionBy("bucket", ch).orderBy("r", "g", "b")
             .rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_in", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return t.join(per, ["bucket", ch]).withColumn("_at", F.col("_off") + F.col("_in")).drop("_off", "_in")


def _bucket_colours(t: DataFrame, adaptMode: str, colorMode: str) -> DataFrame:
    cs = ["c0", "c1", "c2"]
    if adaptMode == "AVERAGE":
        rep = t.groupBy("bucket").agg(*[
            F.floor(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in cs])
    else:
        want = F.lit(0) if adaptMode == "FIRST" else F.floor(F.col("_size") / 2)
        rep = t.where((F.col("_at") <= want) & (want < F.col("_at") + F.col("n"))).select("bucket", *cs)
    if colorMode == "LAB":
        rgb = C.lab_to_rgb(*(F.col(c).cast("double") for c in cs))
        return rep.select("bucket", *[e.alias(c) for c, e in zip(C.RGB, rgb)])
    return rep.select("bucket", *[F.col(c).cast("int").alias(n) for c, n in zip(cs, C.RGB)])


def octree_palette(df: DataFrame, *, levels: int = 12) -> DataFrame:
    """Palette of at most `levels` colours from 8-level colour-cube prefixes; every pixel counts in one.

    Takes the deepest prefix length whose cubes all fit.  One level deeper, the most
    populated cubes take the places that are left, and what remains of each parent
    is folded into one entry for the parent.
    """
    counts = colour_counts(df)

    def key(d: int) -> Column:
        s = 8 - d
        return (F.shiftleft(F.shiftright("r", s), 16) + F.shiftleft(F.shiftright("g", s), 8)
                + F.shiftright("b", s)) if d else F.lit(0)
    sizes = counts.agg(*[F.countDistinct(key(d)).alias(f"d{d}") for d in range(1, 9)]).first()
    depth = max([0] + [d for d in range(1, 9) if sizes[f"d{d}"] <= levels])
    free = levels - (sizes[f"d{depth}"] if depth else 1)
    inner = min(8, depth + 1)
    cubes = counts.groupBy(key(depth).alias("parent"), key(inner).alias("cube")).agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(f"s{c}") for c in C.RGB])
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), "cube"))   # at most 8 cubes a parent
    own = F.lit(True) if depth == 8 else rank <= free
    entries = cubes.withColumn("own", own).groupBy(
        "own", F.when(F.col("own"), F.col("cube")).otherwise(F.col("parent")).alias("cube")).agg(
        *[F.sum(c).alias(c) for c in ("n", "sr", "sg", "sb")])
    return entries.select("own", "cube", "n", *[C.jr(F.col(f"s{c}") / F.col("n")).alias(c) for c in C.RGB])


# ---- cells ------------------------------------------------------------------------------

def cell_average(df: DataFrame, cell: dict[str, Column], *, keys=("clip_id", "frame")) -> DataFrame:
    """Mean colour per cell, one row per cell."""
    by = [*keys, *cell]
    return df.withColumns(cell).groupBy(*by).agg(
        F.count("*").alias("n"), *[C.jr(F.avg(c)).alias(c) for c in C.RGB])


def pixelate(df: DataFrame, *, width: int, height: int, scale=0.25, scaleXOverride=0.0,
             scaleYOverride=0.0, keys=("clip_id", "frame")) -> DataFrame:
    """Each block shows the pixel at its centre."""
    dw = max(1, math.floor(width * (scaleXOverride or scale) + 0.5))
    dh = max(1, math.floor(height * (scaleYOverride or scale) + 0.5))
    bx = F.floor(F.least(F.lit(dw - 1.0), F.col("x") * dw / float(width)))
    by = F.floor(F.least(F.lit(dh - 1.0), F.col("y") * dh / float(height)))
    d = df.withColumns({"_bx": bx.cast("int"), "_by": by.cast("int")})
    sx = F.least(F.lit(width - 1.0), F.floor((F.col("_bx") + 0.5) * width / float(dw)))
    sy = F.least(F.lit(height - 1.0), F.floor((F.col("_by") + 0.5) * height / float(dh)))
    return spread_from_cell(d, sx.cast("int"), sy.cast("int"), ["_bx", "_by"], list(keys)).drop("_bx", "_by")


def spread_from_cell(d: DataFrame, sx: Column, sy: Column, cell: list[str], keys: list[str]) -> DataFrame:
    """Give every pixel of a cell the colour found at the cell's source position.

    The source pixels are gathered by an equi-join on position with the cell
    list, not by collecting cells.
    """
    d = d.withColumns({"_sx": sx, "_sy": sy})
    src = d.select(*keys, F.col("x").alias("_sx"), F.col("y").alias("_sy"),
                   *[F.col(c).alias(f"_{c}") for c in ("r", "g", "b", "a")])
    j = shuffled_join(d, src, [*keys, "_sx", "_sy"])
    return j.withColumns({c: F.col(f"_{c}") for c in ("r", "g", "b", "a")}).drop(
        "_sx", "_sy", "_r", "_g", "_b", "_a")


# Fixed value: the square root of three as the hexagon grid uses it.
SQRT3 = 1.7320508


def with_hex_cell(df: DataFrame, size: float) -> DataFrame:
    """Axial hexagon coordinates `q_cell, r_cell` by cube rounding."""
    px, py = F.col("x") - float(size), F.col("y") - float(size)
    d = df.withColumns({"_q": (px * (SQRT3 / 3.0) - py / 3.0) / float(size),
                        "_z": (py * (2.0 / 3.0)) / float(size)})
    d = d.withColumn("_w", -F.col("_q") - F.col("_z"))
    d = d.withColumns({"_rq": F.floor(F.col("_q") + 0.5), "_rz": F.floor(F.col("_z") + 0.5),
                       "_rw": F.floor(F.col("_w") + 0.5)})
    dq, dz, dw = (F.abs(F.col(f"_r{n}") - F.col(f"_{n}")) for n in "qzw")
    worst_q = (dq > dw) & (dq > dz)
    return d.withColumns({
        "q_cell": F.when(worst_q, -F.col("_rw") - F.col("_rz")).otherwise(F.col("_rq")).cast("int"),
        "r_cell": F.when(worst_q, F.col("_rz")).otherwise(-F.col("_rq") - F.col("_rw")).cast("int")}).drop(
        "_q", "_z", "_w", "_rq", "_rz", "_rw")


def hex_pixelate(df: DataFrame, *, width: int, height: int, cellSize=16.0,
                 keys=("clip_id", "frame")) -> DataFrame:
    d = with_hex_cell(df, cellSize)
    cx = float(cellSize) * SQRT3 * (F.col("q_cell") + F.col("r_cell") * 0.5) + float(cellSize)
    cy = float(cellSize) * 1.5 * F.col("r_cell") + float(cellSize)
    sx = F.least(F.lit(width - 1), F.greatest(F.lit(0), C.jr(cx)))
    sy = F.least(F.lit(height - 1), F.greatest(F.lit(0), C.jr(cy)))
    return spread_from_cell(d, sx, sy, ["q_cell", "r_cell"], list(keys)).drop("q_cell", "r_cell")


def triangle_cell(size: float) -> dict[str, Column]:
    s = float(size)
    tx, ty = F.floor(F.col("x") / s), F.floor(F.col("y") / s)
    up = F.when((F.col("x") - tx * s) + (F.col("y") - ty * s) < s, 0).otherwise(1)
    return {"tx": tx.cast("int"), "ty": ty.cast("int"), "up": up}


def triangle_pixelate(df: DataFrame, *, width: int, height: int, cellSize=16.0,
                      keys=("clip_id", "frame")) -> DataFrame:
    d = df.withColumns(triangle_cell(cellSize))
    frac = F.when(F.col("up") == 0, 1.0 / 3.0).otherwise(2.0 / 3.0) * float(cellSize)

    def pos(t: str, n: int) -> Column:
        return F.least(F.lit(n - 1), F.greatest(F.lit(0), C.jr(F.col(t) * float(cellSize) + frac)))
    return spread_from_cell(d, pos("tx", width), pos("ty", height), ["tx", "ty", "up"],
                            list(keys)).drop("tx", "ty", "up")


# ---- step statistics --------------------------------------------------------------------

SLOW_SOFT_MS, SLOW_HARD_MS = 1500.0, 3500.0


def slow_steps(steps: DataFrame, *, soft=SLOW_SOFT_MS, hard=SLOW_HARD_MS) -> DataFrame:
    """Steps with one hard breach or two soft ones."""
    agg = steps.groupBy("name").agg(F.max("ms").alias("max_ms"),
                                    F.count_if(F.col("ms") >= soft).alias("n_soft"))
    return agg.where((F.col("max_ms") >= hard) | (F.col("n_soft") >= 2))


def step_totals(steps: DataFrame) -> DataFrame:
    """Milliseconds per run and step, per run, and overall."""
    cents = F.sum(F.round(F.col("ms") * 100).cast("bigint"))
    return steps.rollup("run_id", "name").agg((cents / 100.0).alias("total_ms"), F.count("*").alias("n"))


def backend_usage(steps: DataFrame, name: str, backend: str) -> DataFrame:
    return steps.groupBy(name).agg(
        F.array_join(F.array_sort(F.collect_set(backend)), ",").alias("backends"),
        F.count_distinct(backend).alias("n_backends"))


def bench_compare(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Full match of two reports: change in percent and speed-up, infinite or NaN where a step took no time before."""
    b = before.select(*keys, F.col("v").alias("before"))
    a = after.select(*keys, F.col("v").alias("after"))
    j = b.join(a, keys, "full_outer")
    both = F.col("before").isNotNull() & F.col("after").isNotNull()

    def per_before(x: Column) -> Column:   # division by a zero is an error or null in Spark; a power of it keeps its sign
        by = F.col("before")
        return F.when(both & (by == 0), x * F.pow(by, F.lit(-1.0))).when(both, x / by)
    return j.select(*keys, "before", "after",
                    F.round(per_before(F.col("after") - F.col("before")) * 100.0, 6).alias("delta_pct"),
                    F.round(per_before(F.col("after")), 6).alias("speedup"),
                    F.when(both, "both").when(F.col("before").isNull(), "new").otherwise("removed").alias("status"))


def first_seen_colours(df: DataFrame, keys: list[str], pos: list[str], *, limit=256) -> DataFrame:
    """First-seen distinct colours per key, at most `limit`, for keys with two or more.

    Colours are reduced to their first position before anything is ranked, so
    a key's ranking sees distinct colours only.
    """
    first = df.groupBy(*keys, "r", "g", "b").agg(F.min(F.struct(*pos)).alias("_p"))
    n = F.count("*").over(Window.partitionBy(*keys))
    # two-stage top-k: the first `limit` of each of 64 slices, then the first of those
    slice_ = F.pmod(F.hash("r", "g", "b"), F.lit(64))
    part = Window.partitionBy(*keys, "_s").orderBy("_p")
    pre = (first.withColumn("_s", slice_).withColumn("_k", F.row_number().over(part))
           .where(F.col("_k") <= limit))
    final = Window.partitionBy(*keys).orderBy("_p")
    return (pre.withColumns({"idx": F.row_number().over(final) - 1, "_n": n})
            .where((F.col("idx") < limit) & (F.col("_n") >= 2))
            .select(*keys, "idx", "r", "g", "b"))


def most_common_recent(df: DataFrame, *, window: int, keys=("clip_id", "x", "y"), chunk=256) -> DataFrame:
    """Most frequent colour of the last `window` frames per pixel; later wins a tie."""
    from rasterloom.operators.ordered import chunked, own_rows
    d = chunked(df, "frame", chunk, window - 1)
    w = Window.partitionBy(*keys, "_chunk").orderBy("frame").rowsBetween(-(window - 1), 0)
    hist = F.collect_list(F.struct("r", "g", "b")).over(w)
    d = d.withColumn("_h", hist)
    scored = F.transform("_h", lambda c, i: F.struct(
        F.size(F.filter("_h", lambda o: o == c)).alias("n"), i.alias("i"), c.alias("c")))
    d = d.withColumn("_v", F.array_max(scored)["c"])
    d = d.withColumns({c: F.col("_v")[c] for c in C.RGB}).drop("_h", "_v")
    return own_rows(d, "frame", chunk)
