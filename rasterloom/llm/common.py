"""Small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.operators.lineage import work_folder

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 2 << 20
ROW_BYTES = 64
BROADCAST_ROWS = 100_000
BATCH_ROWS = 1_000
KEPT = "rasterloom_kept"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder in the session's shared folder; it goes when the session ends."""
    return work_folder(spark)


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it: later jobs neither recompute nor depend on executors."""
    path = f"{shared_folder(df.sparkSession)}/t"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete staged tables of which nothing is read any more; what was made of them is staged itself."""
    for df in tables:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def dimension_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join a table to a staged dimension: broadcast if its counted rows are few, else shuffle both sides."""
    small = right.count() <= BROADCAST_ROWS
    return left.join(right.hint("broadcast" if small else "merge"), on, how)


def map_arrow(df: DataFrame, run, schema, keeps: bool = False) -> DataFrame:
    """mapInArrow over batches of few rows: a row may hold a long text, and a batch lies in memory on both sides.

    The session's batch size is lowered, never raised; it has no part in results.  Reused workers sit beside the next
    operators: a task returns what it needed, and one that `keeps` nothing in its worker drops what others kept there.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            sys.modules.pop(KEPT, None)
        yield from run(batches)
        give_back()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(task, schema)


def kept_by_worker(name: tuple, make):
    """What `make` gives, made once in a reused Python worker and kept between its tasks (functions come anew with each)."""
    store = sys.modules.setdefault(KEPT, ModuleType(KEPT))
    if getattr(store, "name", None) != name:  # one at a time: memory holds the latest
        store.name, store.value = name, make()
    return store.value


def give_back() -> None:
    """Let a reused Python worker return what a batch needed; where the C library cannot, nothing happens."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose text is at most `limit` bytes, but one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
    give_back()


def runs(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in ranges whose text, and ROW_BYTES a row, is about `limit` bytes at most, but one row at least."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, text, limit):
            more = (pc.sum(pc.binary_length(part.column(text))).as_py() or 0) + ROW_BYTES * part.num_rows
            if held and size + more > limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.concat_batches(held)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions of many runs, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total)


def binary_column(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte runs of one buffer as a binary column; `ends` are the runs' ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def write_raw(df: DataFrame, column: str, path: str, trailer: str, rows_per_file: int = 0) -> None:
    """Write byte strings, each followed by the trailer, one file per task, in row order.

    Spark's own line sink does it (any shared store, committed output, safe when executors are
    lost): a "line" is a record, its separator the trailer that the format demands anyway.
    """
    (df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", trailer)
     .option("maxRecordsPerFile", rows_per_file).text(path))


def running_total(parts: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Sum of `value` before each row in `key` order; for one row per file or partition."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
