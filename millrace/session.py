"""Session settings every job of this package assumes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


#: Rows in one Arrow batch. With whole texts of a few kB, a batch is a few MB.
BATCH_ROWS = 128


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``_`` for ``.``."""
    builder = (
        SparkSession.builder.master(master)
        .appName("millrace")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole texts in a Python worker.

    Plans run later than they are made, so there is one bound for all operators;
    a session whose own bound is smaller keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def once(frame: DataFrame) -> DataFrame:
    """A frame with several readers, computed once: a checkpoint where ``spark.checkpoint.dir`` names a folder for it,
    else kept on the executors' disks, from where a lost part is computed again."""
    context = frame.sparkSession.sparkContext
    if context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return frame.checkpoint()
    return frame.persist(StorageLevel.DISK_ONLY)
