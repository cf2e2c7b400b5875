"""What the text operators share: reading tables, batch bounds, shared scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches  # noqa: F401  (the operators look for it here)

_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that the frame doesn't have."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a folder of our own, but only in a local session:
    on a cluster the executors would not see it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
    return _own_folders[context.applicationId]


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and
    a frame with several readers is computed once. The folder goes with the
    application.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.parquet(path)


def plain(frame: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns cannot clash with ours."""
    return frame.select(*[F.col(f"`{n}`") for n in names])


def fold(key: Column, modulus: int) -> Column:
    """crc32 of a key's text form, modulo: the rule for held-out rows."""
    return F.crc32(key.cast("string").cast("binary")) % modulus
