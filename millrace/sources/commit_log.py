"""A log of numbered commits in a folder, and a table of runs kept in it.

A commit is a folder named by its number with one small JSON file. It is written
under another name and then renamed: a rename into a name that exists puts the
folder inside it, so of several writers of one number exactly one file stands
directly under the number, whole or not at all. The others find theirs one level
deeper, remove it and have a conflict. This needs a file system whose rename of a
folder is atomic (local disks, HDFS), not an object store.

A store keeps rows under unique ids in runs, as a log-structured tree does. A run
is a Parquet table dealt into buckets by the hash of its ids, more buckets the
larger it is. ``FANOUT`` runs of one level are merged into one of the next, so
there are few runs, each row is rewritten once a level, and whether ids are known
is decided by reading one bucket of a bounded size an id and run.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a bucket of a run holds on average, at most.
ROWS_A_BUCKET = 100_000
#: Runs of one level that are merged into one.
FANOUT = 4
_BITS = 24  # of a hash, from which buckets are taken


class Conflict(RuntimeError):
    """Another writer has published the number."""


@dataclass(frozen=True)
class Run:
    """A table of a store: its folder, the bits of its buckets, and which of them exist."""

    path: str
    level: int
    bits: int
    rows: int
    buckets: tuple[int, ...] = field(default=())


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def last_number(spark: SparkSession, root: str) -> int:
    """The highest published number; 0 before the first."""
    jvm, fs = _file_system(spark, root)
    log = jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    if not fs.exists(log):
        return 0
    return max((int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit()), default=0)


def read(spark: SparkSession, root: str, number: int) -> dict:
    """What was published under a number."""
    return json.loads(spark.read.text(f"{root}/log/{number:020d}/commit-*.json", wholetext=True).head()["value"])


def publish(spark: SparkSession, root: str, content: dict, after: int) -> int:
    """Publish ``content`` under the number after ``after``, or raise ``Conflict`` and change nothing."""
    jvm, fs = _file_system(spark, root)
    path = jvm.org.apache.hadoop.fs.Path
    name, number = f"commit-{uuid.uuid4().hex}.json", after + 1
    aside, place = path(f"{root}/log/.{name}"), path(f"{root}/log/{number:020d}")
    if after and not fs.exists(path(f"{root}/log/{after:020d}")):
        raise ValueError(f"{root} has no commit {after}")
    stream = fs.create(path(aside, name), False)
    try:
        stream.write(bytearray(json.dumps(content).encode("utf-8")))
    finally:
        stream.close()
    if not fs.exists(place):
        fs.rename(aside, place)
    if fs.exists(path(place, name)):
        return number
    for lost in (aside, path(place, f".{name}")):
        fs.delete(lost, True)
    raise Conflict(f"commit {number} of {root} is another writer's")


def publish_next(spark: SparkSession, root: str, content: dict) -> int:
    """Publish under the next free number, whatever others publish meanwhile."""
    while True:
        try:
            return publish(spark, root, content, last_number(spark, root))
        except Conflict:
            continue


def runs(spark: SparkSession, root: str, number: int | None = None) -> list[Run]:
    """The runs of a store as of a commit, by default the last."""
    number = last_number(spark, root) if number is None else number
    return [Run(**{**r, "buckets": tuple(r["buckets"])}) for r in read(spark, root, number)["runs"]] if number else []


def _hashed(ids: Column, bits: int) -> Column:
    return F.shiftright(F.pmod(F.xxhash64(ids), F.lit(1 << _BITS)), _BITS - bits).cast("int")


def _read_run(spark: SparkSession, run: Run, schema: str, buckets: set[int] | None = None) -> DataFrame | None:
    wanted = [b for b in run.buckets if buckets is None or b in buckets]
    if not wanted:
        return None
    return spark.read.schema(schema).parquet(*[f"{run.path}/bucket={b}" for b in wanted])


def _union(frames: list[DataFrame | None], spark: SparkSession, schema: str) -> DataFrame:
    out = None
    for frame in frames:
        if frame is not None:
            out = frame if out is None else out.union(frame)
    return spark.createDataFrame([], schema) if out is None else out


def rows(spark: SparkSession, root: str, schema: str, number: int | None = None) -> DataFrame:
    """All rows of a store."""
    return _union([_read_run(spark, r, schema) for r in runs(spark, root, number)], spark, schema)


def rows_beside(ids: DataFrame, root: str, schema: str, number: int, key: str = "id") -> DataFrame:
    """The rows of those buckets in which the given ids can lie: at most one bucket an id and run."""
    spark = ids.sparkSession
    parts = []
    for bits, level_runs in _by_bits(runs(spark, root, number)).items():
        touched = {r["b"] for r in ids.select(_hashed(F.col(key), bits).alias("b")).distinct().collect()}
        parts += [_read_run(spark, r, schema, touched) for r in level_runs]
    return _union(parts, spark, schema)


def _by_bits(all_runs: list[Run]) -> dict[int, list[Run]]:
    out: dict[int, list[Run]] = {}
    for run in all_runs:
        out.setdefault(run.bits, []).append(run)
    return out


def write_run(frame: DataFrame, root: str, level: int, rows_expected: int, key: str = "id") -> Run:
    """Write rows as a run of its own folder; nobody reads it before it is published."""
    bits = min(_BITS, max(0, -(-rows_expected // ROWS_A_BUCKET) - 1).bit_length())
    path = f"{root}/runs/{uuid.uuid4().hex}"
    frame.withColumn("bucket", _hashed(F.col(key), bits)).repartition("bucket").write.partitionBy("bucket").parquet(path)
    spark = frame.sparkSession
    found = spark.read.parquet(path).groupBy("bucket").count().collect() if _has_rows(spark, path) else []
    return Run(path, level, bits, sum(r["count"] for r in found), tuple(sorted(int(r["bucket"]) for r in found)))


def _has_rows(spark: SparkSession, path: str) -> bool:
    jvm, fs = _file_system(spark, path)
    return any(s.isDirectory() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)))


def publish_runs(spark: SparkSession, root: str, kept: list[Run], after: int, **more) -> int:
    return publish(spark, root, {"runs": [asdict(r) for r in kept], **more}, after)


def compact(spark: SparkSession, root: str, schema: str, key: str = "id") -> int | None:
    """Merge the lowest level that has ``FANOUT`` runs into one run of the next; None where no level has.

    Readers of the commit before go on: its folders stay until ``remove_unused``.
    A writer that publishes meanwhile makes this a ``Conflict``, which changes nothing.
    """
    number = last_number(spark, root)
    now = runs(spark, root, number)
    full = [level for level in sorted({r.level for r in now}) if sum(r.level == level for r in now) >= FANOUT]
    if not full:
        return None
    old = [r for r in now if r.level == full[0]]
    merged = write_run(_union([_read_run(spark, r, schema) for r in old], spark, schema), root, full[0] + 1, sum(r.rows for r in old), key)
    carried = {k: v for k, v in read(spark, root, number).items() if k != "runs"}
    return publish_runs(spark, root, [r for r in now if r.level != full[0]] + [merged], number, **carried)


def remove_unused(spark: SparkSession, root: str) -> int:
    """Remove the run folders that the last commit doesn't name; returns how many. Not while others read or write."""
    jvm, fs = _file_system(spark, root)
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/runs")
    named = {r.path.rsplit("/", 1)[-1] for r in runs(spark, root)}
    unused = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in named] if fs.exists(folder) else []
    for path in unused:
        fs.delete(path, True)
    return len(unused)
