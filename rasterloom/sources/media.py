"""Image files, frame tables, sinks and share strings."""

from __future__ import annotations

import base64
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rasterloom.operators.ordered import spread

FRAME_ROWS = "path string, clip_id bigint, frame int, width int, height int, y int, rgba array<int>"
LINE = ["path", "clip_id", "frame", "width", "height", "y", "rgba"]
HELD_BYTES, HELD_LINES = 4 << 20, 10_000   # of decoded lines that a task hands on at once
RUN_FRAMES = 256


def route_by_type(files: DataFrame, mime: str = "mime") -> tuple[DataFrame, DataFrame]:
    """Split a file table into videos and everything else."""
    is_video = F.coalesce(F.col(mime).startswith("video/"), F.lit(False))
    return files.where(is_video), files.where(~is_video)


def decode_pnm(data: bytes) -> np.ndarray:
    """Binary PPM/PGM (P5, P6) to an array of shape (h, w, 4)."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at:at + 1].isspace():
            at += 1
        if data[at:at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end:end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    kind, w, h = fields[0], int(fields[1]), int(fields[2])
    ch = {b"P5": 1, b"P6": 3}[kind]
    px = np.frombuffer(data, np.uint8, w * h * ch, at + 1).reshape(h, w, ch)
    return np.dstack([np.broadcast_to(px, (h, w, 3)), np.full((h, w, 1), 255, np.uint8)])


def decode_plain(data: bytes) -> np.ndarray:
    """Plain grey or colour PNM: numbers in text."""
    kind, w, h, top, *values = data.split()
    px = np.array(values, np.int64).reshape(int(h), int(w), 1 if kind == b"P2" else 3) * 255 // int(top)
    return np.dstack([np.broadcast_to(px, (int(h), int(w), 3)), np.full((int(h), int(w), 1), 255)]).astype(np.uint8)


def decode_image(data: bytes) -> np.ndarray:
    """Any format an installed decoder reads; PNM needs none."""
    if data[:2] in (b"P2", b"P3"):
        return decode_plain(data)
    if data[:2] in (b"P5", b"P6"):
        return decode_pnm(data)
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError("only PNM images can be read without an image library") from e
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGBA"))


def image_rows(files: DataFrame) -> DataFrame:
    """Decode `(path, content)` rows to one row per image line; small images leave a task together."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, held = [], 0
        for pdf in batches:
            for path, cid, data in zip(pdf["path"], pdf["clip_id"], pdf["content"]):
                px = decode_image(bytes(data)).astype(np.int32)
                h, w = px.shape[:2]
                made += [(path, cid, 0, w, h, y, line) for y, line in enumerate(px.reshape(h, w * 4))]
                held += px.nbytes
                if held >= HELD_BYTES or len(made) >= HELD_LINES:
                    yield pd.DataFrame(made, columns=LINE)
                    made, held = [], 0
        if made:
            yield pd.DataFrame(made, columns=LINE)
    d = files.select("path", F.xxhash64("path").alias("clip_id"), "content")
    return d.mapInPandas(run, FRAME_ROWS)


def write_images(frames: DataFrame, folder: str, *, width: int, height: int, run: int = RUN_FRAMES) -> None:
    """One plain grey image (PNM "P2") for each frame `(clip_id, frame, q)`, in run=../clip_id=../frame=../ folders.

    A run of frames is written by one task, so the commit moves a folder per run and not one per frame,
    and the folders of many runs are listed by tasks.
    """
    text = F.concat(F.lit(f"P2 {width} {height} 255\n"), F.array_join(F.transform("q", lambda v: v.cast("string")), " "))
    d = frames.select(F.concat_ws("_", "clip_id", F.floor(F.col("frame") / run)).alias("run"), "clip_id", "frame", text.alias("value"))
    spread(d, "run").write.partitionBy("run", "clip_id", "frame").mode("append").text(folder)


def scan_images(spark: SparkSession, folder: str, *, glob: str = "*") -> DataFrame:
    """Every image under a folder as line rows."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(folder))
    return image_rows(files)


def rows_to_pixels(rows: DataFrame) -> DataFrame:
    """Line rows to pixel rows."""
    d = rows.select("clip_id", "frame", "y", "rgba", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return d.select("clip_id", "frame", "x", "y", *[
        F.element_at("rgba", F.col("x") * 4 + k + 1).alias(c) for k, c in enumerate("rgba")])


def frame_stream(spark: SparkSession, folder: str, schema: StructType, *, glob: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    """Frame tables arriving in a folder as a stream."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_batch:
        r = r.option("maxFilesPerTrigger", per_batch)
    return r.parquet(folder)


def frame_tokens(frames: DataFrame) -> DataFrame:
    """Number frames per clip with a growing token, split by hour (see `ordered`)."""
    from rasterloom.operators.ordered import bucketed_rank
    d = frames.withColumn("_hour", F.floor(F.col("ts_us") / 3_600_000_000))
    return bucketed_rank(d, ["clip_id"], "_hour", ["ts_us", "event_id"], "frame_token").drop("_hour")


def write_frames(px: DataFrame, path: str, *, mode="overwrite", frames_per_file: int = 256) -> None:
    """Frame sequence sink: partitioned by clip, clustered by runs of frames.

    One directory per frame would mean millions of tiny files at scale, so the
    frame number stays a sorted column and files cover a run of frames.
    """
    part = F.floor(F.col("frame") / frames_per_file)
    (px.withColumn("frame_run", part).repartition("clip_id", "frame_run")
     .sortWithinPartitions("clip_id", "frame", "y", "x")
     .write.mode(mode).partitionBy("clip_id", "frame_run").parquet(path))


# ---- share strings ----------------------------------------------------------------------

PREFIX = "z."


def encode_share(text: Column) -> Column:
    """Versioned zlib + base64url text."""
    @F.pandas_udf("string")
    def enc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: PREFIX + base64.urlsafe_b64encode(zlib.compress(t.encode())).decode().rstrip("="), na_action="ignore")
    return enc(text)


def decode_share(text: Column) -> Column:
    """The inverse; unknown versions and damaged strings give null."""
    @F.pandas_udf("string")
    def dec(s: pd.Series) -> pd.Series:
        def one(t):
            if not t or not t.startswith(PREFIX):
                return None
            body = t[len(PREFIX):]
            try:
                return zlib.decompress(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))).decode()
            except (ValueError, zlib.error):
                return None
        return s.map(one, na_action="ignore")
    return dec(text)


def control_points(text: Column) -> Column:
    """JSON control points to a sorted array of (x, y), the identity if unusable."""
    def whole(v: Column) -> Column:
        return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v + 0.5))).cast("int")
    raw = F.filter(F.from_json(text, "array<array<double>>"), lambda p: F.size(p) >= 2)

    def point(p: Column) -> Column:
        k = F.when((p[0] <= 1) & (p[1] <= 1), 255.0).otherwise(1.0)
        return F.struct(whole(p[0] * k).alias("x"), whole(p[1] * k).alias("y"))
    # order by x only; equal x keep their order
    pts = F.transform(F.array_sort(F.transform(raw, lambda p, i: F.struct(
        point(p)["x"].alias("x"), i.alias("i"), point(p)["y"].alias("y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    none = F.array().cast("array<struct<x:int,y:int>>")

    def end(at: int, x: int) -> Column:
        p = F.element_at(pts, at)
        return F.when(p["x"] != x, F.array(F.struct(F.lit(x).alias("x"), p["y"].alias("y")))).otherwise(none)
    ident = F.array(*[F.struct(F.lit(v).alias("x"), F.lit(v).alias("y")) for v in (0, 255)])
    return F.when(F.coalesce(F.size(raw), F.lit(0)) < 2, ident).otherwise(F.concat(end(1, 0), pts, end(-1, 255)))
