"""Block matching and operations on motion grids.

A block and its search window (the block plus a halo) are gathered as two
bounded arrays, so the shuffle carries each pixel a small constant number of
times instead of once per offset; the exhaustive search runs on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.functions import color as C
from rasterloom.operators.ordered import shuffled_join
from rasterloom.operators.stencil import own, square, stencil

BLOCK = ("clip_id", "frame", "bx", "by")


def scalar_planes(df: DataFrame) -> DataFrame:
    """All single-channel motion planes of a pixel; hue is circular over 360."""
    d = C.with_hsv(df, *(C.unit(c) for c in C.RGB)).withColumn("_lo", F.least(*(C.unit(c) for c in C.RGB)))
    hi, lo = F.col("_v"), F.col("_lo")
    spread = F.lit(1.0) - F.abs(hi + lo - 1.0)
    return d.withColumns({
        "red": F.col("r").cast("double"), "green": F.col("g").cast("double"), "blue": F.col("b").cast("double"),
        "luma": C.luma(), "hue": F.col("_h"), "hsv_saturation": F.col("_s") * 255.0, "value": hi * 255.0,
        "hsl_saturation": F.when((hi > lo) & (spread > 0), (hi - lo) / F.nullif(spread, F.lit(0.0)) * 255.0).otherwise(0.0),
        "lightness": (hi + lo) * 0.5 * 255.0}).drop("_h", "_s", "_v", "_lo")


def circular_range(mode: str) -> float:
    return 360.0 if mode == "hue" else 0.0


def _values(df: DataFrame, mode: str) -> DataFrame:
    if mode == "rgb":
        return df.withColumn("_vals", F.array(*[F.col(c).cast("double") for c in C.RGB]))
    return scalar_planes(df).withColumn("_vals", F.array(F.col(mode)))


def _blocks_with_halo(pos: str, size: int, r: int, n: int) -> Column:
    """Block indices whose window contains a coordinate."""
    last = (n - 1) // size
    lo = F.greatest(F.lit(0), F.floor((F.col(pos) - r) / size))
    hi = F.least(F.lit(last), F.floor((F.col(pos) + r) / size))
    return F.sequence(lo.cast("int"), hi.cast("int"))


def _packed(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    px = F.array_sort(F.collect_list(F.struct("y", "x", "_vals")))
    return df.groupBy(*keys).agg(F.flatten(F.transform(px, lambda p: p["_vals"])).alias(out))


def paired_blocks(df: DataFrame, *, width: int, height: int, cellSize: int, searchRadius: int, mode="rgb") -> DataFrame:
    """`(clip_id, frame, bx, by, cur, ref)`: a block and the previous frame's window around it."""
    d = _values(df, mode)
    cur = _packed(d.withColumns({"bx": F.floor(F.col("x") / cellSize).cast("int"),
                                 "by": F.floor(F.col("y") / cellSize).cast("int")}), list(BLOCK), "cur")
    halo = d.withColumn("frame", F.col("frame") + 1)
    halo = halo.withColumn("bx", F.explode(_blocks_with_halo("x", cellSize, searchRadius, width)))
    halo = halo.withColumn("by", F.explode(_blocks_with_halo("y", cellSize, searchRadius, height)))
    return shuffled_join(cur, _packed(halo, list(BLOCK), "ref"), list(BLOCK))


def _window_errors(cur, ref, bx, by, size, r, w, h, wrap):
    """Mean absolute error of one block for every (dy, dx), border clamped."""
    x0, y0 = bx * size, by * size
    bw, bh = min(size, w - x0), min(size, h - y0)
    rx, ry = max(0, x0 - r), max(0, y0 - r)
    rw, rh = min(w, x0 + size + r) - rx, min(h, y0 + size + r) - ry
    ch = len(cur) // (bw * bh)
    c = np.asarray(cur).reshape(bh, bw, ch)
    p = np.asarray(ref).reshape(rh, rw, ch)
    steps = np.arange(-r, r + 1)
    ys = np.clip(y0 + np.arange(bh)[None, :] + steps[:, None], 0, h - 1) - ry
    xs = np.clip(x0 + np.arange(bw)[None, :] + steps[:, None], 0, w - 1) - rx
    d = np.abs(c[None, None] - p[ys[:, None, :, None], xs[None, :, None, :]])
    if wrap:
        d = np.minimum(d, wrap - d)
    return d.mean(axis=(2, 3, 4))


def block_search(blocks: DataFrame, *, width: int, height: int, cellSize: int, searchRadius: int, wrap=0.0) -> DataFrame:
    """Best offset per block: smallest error, first in (dy, dx) scan order."""
    @F.pandas_udf("dx int, dy int, error double")
    def search(cur: pd.Series, ref: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
        out = []
        for c, p, x, y in zip(cur, ref, bx, by):
            e = np.round(_window_errors(c, p, x, y, cellSize, searchRadius, width, height, wrap), 9)
            k = int(e.argmin())
            out.append((k % e.shape[1] - searchRadius, k // e.shape[1] - searchRadius, float(e.flat[k])))
        return pd.DataFrame(out, columns=["dx", "dy", "error"])
    return blocks.withColumn("_s", search("cur", "ref", "bx", "by")).select(*BLOCK, "_s.*")


def motion_vectors(df: DataFrame, *, width: int, height: int, mode="luma", cellSize=12, searchRadius=6,
                   threshold=14.0) -> DataFrame:
    """One vector per block and frame (from frame 1 on), with strength and confidence."""
    blocks = paired_blocks(df, width=width, height=height, cellSize=cellSize, searchRadius=searchRadius, mode=mode)
    v = block_search(blocks, width=width, height=height, cellSize=cellSize, searchRadius=searchRadius,
                     wrap=circular_range(mode))
    mag = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    v = v.withColumn("magnitude", mag)
    return v.withColumns({
        "strength": C.clamp(0, 1, F.col("magnitude") / float(max(1, searchRadius))),
        "confidence": C.clamp(0, 1, (F.lit(float(threshold)) - F.col("error")) / float(max(1.0, threshold)))})


def block_error(df: DataFrame, dx: int, dy: int, *, width: int, height: int, cellSize=8, mode="rgb") -> DataFrame:
    """Mean absolute error of every block for one offset."""
    blocks = paired_blocks(df, width=width, height=height, cellSize=cellSize,
                           searchRadius=max(abs(dx), abs(dy)), mode=mode)
    r, wrap = max(abs(dx), abs(dy)), circular_range(mode)

    @F.pandas_udf("double")
    def err(cur: pd.Series, ref: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([float(_window_errors(c, p, x, y, cellSize, r, width, height, wrap)[dy + r, dx + r])
                          for c, p, x, y in zip(cur, ref, bx, by)])
    return blocks.select(*BLOCK, err("cur", "ref", "bx", "by").alias("error"))


FIELDS = ("dx", "dy", "strength", "confidence", "error")


def blur_grid(v: DataFrame, *, cols: int, rows: int, amount=0.25, searchRadius=6) -> DataFrame:
    """3x3 weighted mean on the block grid, centre weight two, outside skipped."""
    g = v.withColumnsRenamed({"bx": "x", "by": "y"})
    offs = [(dx, dy, 2 if (dx, dy) == (0, 0) else 1) for dx, dy in square(1)]
    names = ["dx", "dy", "confidence", "error"]
    g = g.withColumnsRenamed({n: f"v_{n}" for n in names})
    s = stencil(g, offs, [F.sum("w").alias("_w"), *[F.sum(F.col(f"v_{n}") * F.col("w")).alias(f"_s_{n}") for n in names],
                          *[own(f"v_{n}") for n in names]], width=cols, height=rows, border="skip", fields="w int")
    out = {n: F.col(f"v_{n}") * (1.0 - amount) + F.col(f"_s_{n}") / F.col("_w") * float(amount) for n in names}
    s = s.select("clip_id", "frame", F.col("x").alias("bx"), F.col("y").alias("by"), *[e.alias(n) for n, e in out.items()])
    mag = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return s.withColumn("strength", C.clamp(0, 1, mag / float(max(1, searchRadius))))


def blend_temporal(v: DataFrame, *, amount=0.4, chunk=1024) -> DataFrame:
    """Mix with the previous frame's vectors; the first frame stays."""
    from rasterloom.operators.temporal import previous
    p = previous(v, cols=FIELDS, keys=("clip_id", "bx", "by"), chunk=chunk, prefix="_p_")
    return p.withColumns({n: F.coalesce(F.col(n) * (1.0 - amount) + F.col(f"_p_{n}") * float(amount),
                                        F.col(n).cast("double")) for n in FIELDS}).select(*BLOCK, *FIELDS)


def encode_state(v: DataFrame) -> DataFrame:
    """Four numbers per block, in grid order, as one array per frame."""
    packed = F.array_sort(F.collect_list(F.struct("by", "bx", F.array(
        *[F.col(c).cast("double") for c in ("dx", "dy", "confidence", "strength")]).alias("q"))))
    return v.groupBy("clip_id", "frame").agg(F.flatten(F.transform(packed, lambda s: s["q"])).alias("state"))


def decode_state(states: DataFrame, *, cols: int, rows: int) -> DataFrame:
    """Back to one row per block; arrays of the wrong length give none."""
    ok = states.where(F.size("state") == 4 * cols * rows)
    idx = F.sequence(F.lit(0), F.lit(cols * rows - 1))
    d = ok.select("clip_id", "frame", "state", F.explode(idx).alias("i"))
    return d.select("clip_id", "frame", F.pmod("i", F.lit(cols)).cast("int").alias("bx"),
                    F.floor(F.col("i") / cols).cast("int").alias("by"),
                    *[F.element_at("state", (F.col("i") * 4 + k + 1).cast("int")).alias(n)
                      for k, n in enumerate(("dx", "dy", "confidence", "strength"))])


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], inputs: list[str],
                outputs: dict[str, str], step: Callable) -> DataFrame:
    """Add `outputs` (name -> type) by `state, values = step(state, *inputs)`; state starts as None."""
    names = list(outputs)
    schema = StructType(df.schema.fields + StructType.fromDDL(
        ", ".join(f"{n} {t}" for n, t in outputs.items())).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for key, row in zip(zip(*(pdf[k] for k in keys)), zip(*(pdf[c] for c in inputs))):
                if key != current:
                    current, state = key, None
                state, values = step(state, *row)
                out.append(values)
            yield pdf.assign(**{n: [v[i] for v in out] for i, n in enumerate(names)})

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)


def flip_dots(df: DataFrame, *, width: int, height: int, cellSize=10, threshold=128.0, hysteresis=12.0,
              maxFlipRate=0.2, responseFrames=3) -> DataFrame:
    """Bistable cells: at most a share of all cells may start flipping per frame, largest error first.

    The cap couples the cells of a frame, so the walk is per clip over one small
    row per frame (the cell lumas), streamed in frame order.
    """
    cols, rows = math.ceil(width / cellSize), math.ceil(height / cellSize)
    cell = {"cx": F.floor(F.col("x") / cellSize).cast("int"), "cy": F.floor(F.col("y") / cellSize).cast("int")}
    lum = df.withColumns(cell).groupBy("clip_id", "frame", "cx", "cy").agg(F.avg(C.luma()).alias("l"))
    grid = lum.groupBy("clip_id", "frame").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cy", "cx", "l"))), lambda s: s["l"]).alias("cells"))
    cap = max(1, int(cols * rows * maxFlipRate))

    def step(state, cells):
        lumas = np.asarray(cells)
        if state is None:
            state = (np.zeros(lumas.size, bool), np.zeros(lumas.size))
        on, progress = state[0].copy(), state[1].copy()
        moving = progress > 0
        progress[moving] += 1.0 / responseFrames
        done = moving & (progress >= 1)
        on[done] = ~on[done]
        progress[done] = 0.0
        want = np.where(on, lumas <= threshold + hysteresis, lumas < threshold - hysteresis)
        idle = (progress == 0) & (want != on)
        order = [i for i in np.argsort(-np.abs(lumas - threshold), kind="stable") if idle[i]][:cap]
        progress[order] = 1e-6 + 0.0 if responseFrames > 1 else 1.0
        return (on, progress), ([int(v) for v in on], len(order))
    out = fold_sorted(grid, ["clip_id"], ["frame"], ["cells"], {"on": "array<int>", "flips": "int"}, step)
    return out.select("clip_id", "frame", "flips", F.posexplode("on").alias("cell", "is_on"))
