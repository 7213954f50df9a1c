"""Cutting lineage between rounds of an iterative job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}   # folders made for local sessions, by application


def _delete_at_exit(spark, path: str) -> None:
    """Have the session's own file system remove a folder when the session ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def shared_base(spark) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Only a local session may leave it unset, as in tests; it then gets a folder of its
    own, once, which goes when the session ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    base = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="rasterloom-")
    _delete_at_exit(spark, base)
    return base


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so later rounds neither replan nor recompute earlier ones."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def work_folder(spark) -> str:
    """The name of a fresh folder in the shared one; it goes when the session ends."""
    path = f"{shared_base(spark)}/work-{uuid.uuid4().hex}"
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    _delete_at_exit(spark, path)
    return path
