"""Nearest-neighbour lookups against small candidate sets.

A palette holds at most 256 colours, so its candidates become one `least(...)`
over (distance, index) structs in the row's own projection: no join and no
shuffle.  The first candidate wins a tie because the index is part of the
struct.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import color as C
from rasterloom.operators.ordered import shuffled_join

MAX_PALETTE = 256
MAX_CENTROIDS = 4096


def palette_rows(palette: DataFrame) -> list[tuple[int, int, int]]:
    """A palette table `(idx, r, g, b)` as a list; refuses oversized tables."""
    rows = palette.select("idx", "r", "g", "b").limit(MAX_PALETTE + 1).collect()
    if len(rows) > MAX_PALETTE:
        raise ValueError(f"a palette holds at most {MAX_PALETTE} colours")
    return [(r["r"], r["g"], r["b"]) for r in sorted(rows, key=lambda r: r["idx"])]


CODEGEN_CANDIDATES = 64


def with_nearest(df: DataFrame, palette: Sequence, out: str, *, algorithm="RGB",
                 hsv_legacy=False) -> DataFrame:
    """Add the index of the nearest palette colour.

    8-bit RGB packs distance and index into one int; other distances compare
    (distance, index) structs.  Both stay inside codegen; long palettes, whose
    generated code would grow too big, use an array fold instead.
    """
    whole = all(float(v).is_integer() and 0 <= v <= 255 for c in palette for v in c[:3])
    if algorithm == "RGB" and whole and len(palette) <= CODEGEN_CANDIDATES:
        keys = []
        for i, p in enumerate(palette):
            d = [F.col(c) - int(v) for c, v in zip(C.RGB, p)]
            keys.append((d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) * 256 + i)
        best = F.least(*keys) if len(keys) > 1 else keys[0]
        return df.withColumn(out, best.bitwiseAND(F.lit(255)).cast("int"))
    d, here = C.with_features(df, algorithm)
    if len(palette) <= CODEGEN_CANDIDATES:
        cands = [F.struct(C.feature_distance(here, C.literal_features(p, algorithm), algorithm,
                                             hsv_legacy=hsv_legacy).alias("d"), F.lit(i).alias("i"))
                 for i, p in enumerate(palette)]
        best = F.least(*cands) if len(cands) > 1 else cands[0]
        return d.withColumn(out, best["i"]).drop("_f0", "_f1", "_f2")
    table = F.array(*[F.array(*C.literal_features(p, algorithm)) for p in palette])
    near = F.array_min(F.transform(table, lambda p, i: F.struct(C.feature_distance(
        here, [p[k] for k in range(3)], algorithm, hsv_legacy=hsv_legacy).alias("d"), i.alias("i"))))
    return d.withColumn(out, near["i"]).drop("_f0", "_f1", "_f2")


def pick(table: Sequence, idx: Column, k: int) -> Column:
    arr = F.array(*[F.lit(int(c[k])) for c in table])
    return F.element_at(arr, idx + 1)


def nearest_palette(df: DataFrame, palette: Sequence | DataFrame, *, algorithm="RGB",
                    hsv_legacy=False) -> DataFrame:
    """Replace each colour by its nearest palette colour."""
    pal = palette_rows(palette) if isinstance(palette, DataFrame) else list(palette)
    d = with_nearest(df, pal, "_i", algorithm=algorithm, hsv_legacy=hsv_legacy)
    return d.withColumns({c: pick(pal, F.col("_i"), k) for k, c in enumerate(C.RGB)}).drop("_i")


def linear_light_match(df: DataFrame, palette: Sequence, *, algorithm="RGB") -> DataFrame:
    """Match pixels held as linear-light doubles `lr, lg, lb`; result is linear too."""
    d = df.withColumns({c: C.from_unit(C.linear_to_srgb(F.col(f"l{c}"))) for c in C.RGB})
    d = nearest_palette(d, palette, algorithm=algorithm)
    return d.withColumns({f"l{c}": C.srgb_to_linear(C.unit(c)) for c in C.RGB})


def palette_index_drift(df: DataFrame, palette: Sequence, drift: Sequence[int], *,
                        lockLuma=True) -> DataFrame:
    """Nearest index, remapped through `drift`, optionally keeping luma."""
    drifted = [palette[k] for k in drift]
    d = with_nearest(df, palette, "_i")
    d = d.withColumns({f"_d{c}": pick(drifted, F.col("_i"), k).cast("double")
                       for k, c in enumerate(C.RGB)})
    if lockLuma:
        src, dst = C.luma(), C.luma("_dr", "_dg", "_db")
        d = d.withColumn("_k", src / F.greatest(F.lit(1.0), dst))
    else:
        d = d.withColumn("_k", F.lit(1.0))
    return d.withColumns({c: C.u8(F.col(f"_d{c}") * F.col("_k")) for c in C.RGB}).drop(
        "_i", "_dr", "_dg", "_db", "_k")


def centroid_rows(centroids: DataFrame, idx: str, vec: str) -> np.ndarray:
    rows = centroids.select(idx, vec).limit(MAX_CENTROIDS + 1).collect()
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"at most {MAX_CENTROIDS} centroids")
    rows.sort(key=lambda r: r[0])
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype="float64")


def nearest_centroid(df: DataFrame, centroids: DataFrame, *, vec="embedding", idx="idx",
                     out="centroid") -> DataFrame:
    """Nearest of a bounded set of wide vectors: one Arrow batch, one matrix product."""
    keys, mat = centroid_rows(centroids, idx, vec)

    @F.pandas_udf("int")
    def assign(v: pd.Series) -> pd.Series:
        x = np.vstack(v.to_numpy()).astype("float64")
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in mat], axis=1)
        return pd.Series(keys[d.argmin(axis=1)].astype("int32"))

    return df.withColumn(out, assign(F.col(vec)))


def lloyd(df: DataFrame, seeds: Sequence, iterations: int) -> list[tuple[float, float, float]]:
    """Lloyd iterations from fixed seeds over `(r, g, b)` rows.

    Colours are counted once; each round is a map plus a k-row aggregate, and
    only those k rows reach the driver.
    """
    counts = df.groupBy(*C.RGB).agg(F.count("*").alias("n")).persist()
    cents = [tuple(float(v) for v in s) for s in seeds]
    try:
        for _ in range(iterations):
            near = with_nearest(counts, cents, "_i")
            agg = near.groupBy("_i").agg(F.sum("n").alias("n"), *[
                F.sum(F.col(c) * F.col("n")).alias(c) for c in C.RGB]).collect()
            for row in agg:
                cents[row["_i"]] = tuple(row[c] / row["n"] for c in C.RGB)
    finally:
        counts.unpersist()
    return cents


def k_means(df: DataFrame, *, seeds: Sequence, iterations: int = 10) -> DataFrame:
    """Recolour by the nearest of the refined centroids."""
    cents = lloyd(df, seeds, iterations)
    d = with_nearest(df, cents, "_i")
    shown = [tuple(int(v + 0.5) for v in c) for c in cents]
    return d.withColumns({c: pick(shown, F.col("_i"), k) for k, c in enumerate(C.RGB)}).drop("_i")


def k_means_seeds(df: DataFrame, k: int, seed: int = 7) -> list[tuple[float, float, float]]:
    """Seeds by Spark ML's distributed k-means|| on distinct colours."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    counts = df.groupBy(*C.RGB).agg(F.count("*").alias("n"))
    vec = VectorAssembler(inputCols=list(C.RGB), outputCol="features").transform(counts)
    model = KMeans(k=k, initMode="k-means||", seed=seed, maxIter=1, weightCol="n").fit(vec)
    return [tuple(c) for c in model.clusterCenters()]


def voronoi(df: DataFrame, seeds: Sequence, *, width: int, height: int) -> DataFrame:
    """Average colour per nearest seed point.

    Seeds are placed on a grid of about one seed per cell.  A pixel reads the
    seeds of its 3x3 cells through an equi-join on cell, and keeps the answer if
    it is closer than the border of that block; the few pixels whose block
    cannot prove it search every seed (at most 4096, so a literal).
    """
    if len(seeds) > MAX_CENTROIDS:
        raise ValueError(f"at most {MAX_CENTROIDS} seeds")
    spark = df.sparkSession
    dim = max(1, int(np.ceil(np.sqrt(len(seeds)))))
    cw, ch = width / dim, height / dim
    near = []
    for i, (sx, sy) in enumerate(seeds):
        gx, gy = min(dim - 1, int(sx / cw)), min(dim - 1, int(sy / ch))
        near += [(cx, cy, i, float(sx), float(sy))
                 for cx in range(max(0, gx - 1), min(dim, gx + 2))
                 for cy in range(max(0, gy - 1), min(dim, gy + 2))]
    cells = (spark.createDataFrame(near, "cx int, cy int, i int, sx double, sy double")
             .groupBy("cx", "cy").agg(F.array_sort(F.collect_list(F.struct("i", "sx", "sy"))).alias("s")))
    d = df.withColumns({
        "cx": F.least(F.lit(dim - 1), F.floor(F.col("x") / cw)).cast("int"),
        "cy": F.least(F.lit(dim - 1), F.floor(F.col("y") / ch)).cast("int")})
    d = d.join(F.broadcast(cells), ["cx", "cy"], "left")   # at most 9 * 4096 seed entries

    def dist(sx, sy):
        return (sx - F.col("x")) * (sx - F.col("x")) + (sy - F.col("y")) * (sy - F.col("y"))
    local = F.array_min(F.transform("s", lambda s: F.struct(
        dist(s["sx"], s["sy"]).alias("d"), s["i"].alias("i"))))
    allseeds = [F.struct(dist(F.lit(float(sx)), F.lit(float(sy))).alias("d"), F.lit(i).alias("i"))
                for i, (sx, sy) in enumerate(seeds)]
    full = F.array_min(F.array(*allseeds))
    inf = F.lit(float("inf"))
    # distance to the nearest side of the 3x3 block that is not the image border
    gaps = [F.when(F.col("cx") >= 2, F.col("x") - (F.col("cx") - 1) * cw).otherwise(inf),
            F.when(F.col("cx") <= dim - 3, (F.col("cx") + 2) * cw - F.col("x")).otherwise(inf),
            F.when(F.col("cy") >= 2, F.col("y") - (F.col("cy") - 1) * ch).otherwise(inf),
            F.when(F.col("cy") <= dim - 3, (F.col("cy") + 2) * ch - F.col("y")).otherwise(inf)]
    d = d.withColumns({"_b": local, "_gap": F.least(*gaps)})
    sure = F.col("_b").isNotNull() & (F.col("_b.d") < F.col("_gap") * F.col("_gap"))
    d = d.withColumn("seed", F.when(sure, F.col("_b.i")).otherwise(full["i"])).drop(
        "cx", "cy", "s", "_b", "_gap")
    means = d.groupBy("clip_id", "frame", "seed").agg(
        *[C.jr(F.avg(c)).alias(f"_{c}") for c in ("r", "g", "b", "a")])
    j = shuffled_join(d, means, ["clip_id", "frame", "seed"])
    return j.withColumns({c: F.col(f"_{c}") for c in ("r", "g", "b", "a")}).drop("_r", "_g", "_b", "_a")
