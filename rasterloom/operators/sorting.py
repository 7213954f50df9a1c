"""Sorting pixels inside intervals of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import color as C

COMPARATORS = ("RGBA", "GBRA", "BGRA", "HSVA", "SVHA", "VSHA", "LABA", "ABLA", "BALA", "LUMINANCE")


def with_comparator(df: DataFrame, name: str) -> tuple[DataFrame, list[str], list[str]]:
    """Add the columns a comparator orders by; returns them and the ones to drop."""
    if name == "LUMINANCE":
        return df.withColumn("_key", C.luma()), ["_key"], ["_key"]
    if name in ("HSVA", "SVHA", "VSHA"):
        d = C.with_hsv(df, *(C.unit(c) for c in C.RGB), h="_kh", s="_ks", v="_kv")
        return d, [f"_k{c.lower()}" for c in name[:3]] + ["a"], ["_kh", "_ks", "_kv"]
    if name in ("LABA", "ABLA", "BALA"):
        e = C.lab("r", "g", "b")
        d = df.withColumns({"_kl": e["l"], "_ka": e["a"], "_kb": e["b"]})
        return d, [f"_k{c.lower()}" for c in name[:3]] + ["a"], ["_kl", "_ka", "_kb"]
    if name in ("RGBA", "GBRA", "BGRA"):
        return df, [c.lower() for c in name], []
    raise ValueError(f"unknown comparator {name!r}")


def ordered_by(df: DataFrame, name: str, *, descending=False, ties: list[str]) -> DataFrame:
    """All rows in comparator order."""
    d, keys, tmp = with_comparator(df, name)
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    return d.orderBy(*order, *ties).drop(*tmp)


def lines(direction: str) -> tuple[Column, Column]:
    """Line id and position along the line."""
    x, y = F.col("x"), F.col("y")
    if direction == "ROW":
        return y, x
    if direction == "COLUMN":
        return x, y
    if direction == "DIAGONAL":
        return x - y, F.least(x, y)
    raise ValueError(f"unknown direction {direction!r}")


def pixelsort(df: DataFrame, *, direction="COLUMN", sortDirection="ASCENDING", comparator="LUMINANCE",
              sortPixelLuminanceAbove=50.0, sortPixelLuminanceBelow=200.0, sortPixelLuminanceChangeAbove=-255.0,
              sortPixelLuminanceChangeBelow=255.0, maxIntervalSize=0) -> DataFrame:
    """Sort each interval of a line by a comparator.

    An interval is a run of pixels whose luma, and luma change along the line,
    are inside the windows.  It is contiguous, so the rank inside it already
    names the target position: no join and no write-back pass.  Windows are
    bounded by one line of one frame.
    """
    line, pos = lines(direction)
    d = df.withColumns({"_line": line, "_pos": pos, "_l": C.luma()})
    along = Window.partitionBy("clip_id", "frame", "_line").orderBy("_pos")
    step = F.col("_l") - F.coalesce(F.lag("_l").over(along), F.col("_l"))
    d = d.withColumn("_dl", step)
    d = d.withColumn("_on", F.col("_l").between(sortPixelLuminanceAbove, sortPixelLuminanceBelow)
                     & F.col("_dl").between(sortPixelLuminanceChangeAbove, sortPixelLuminanceChangeBelow))
    d = d.withColumn("_cut", F.when(F.col("_on") & F.coalesce(F.lag("_on").over(along), F.lit(False)), 0).otherwise(1))
    d = d.withColumn("_run", F.sum("_cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    if maxIntervalSize > 0:
        inside = F.col("_pos") - F.min("_pos").over(Window.partitionBy("clip_id", "frame", "_line", "_run"))
        d = d.withColumn("_part", F.floor(inside / maxIntervalSize))
    else:
        d = d.withColumn("_part", F.lit(0))
    d, keys, tmp = with_comparator(d, comparator)
    by = ["clip_id", "frame", "_line", "_run", "_part"]
    order = [F.col(k).desc() if sortDirection == "DESCENDING" else F.col(k).asc() for k in keys]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order, "_pos"))
    start = F.min("_pos").over(Window.partitionBy(*by))
    d = d.withColumn("_new", (start + rank - 1).cast("int"))
    x, y = F.col("x"), F.col("y")
    place = {"ROW": {"x": F.col("_new")}, "COLUMN": {"y": F.col("_new")},
             "DIAGONAL": {"x": x - F.col("_pos") + F.col("_new"), "y": y - F.col("_pos") + F.col("_new")}}[direction]
    return d.withColumns(place).drop("_line", "_pos", "_l", "_dl", "_on", "_cut", "_run", "_part", "_new", *tmp)
