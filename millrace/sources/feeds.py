"""JSON feeds and catalogues with explicit schemas, and writers with their guarantees."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import config_value
from ..operators.history import RECORD_SCHEMA, valid_records
from ..operators.validation import InvalidData, require_valid
from . import commit_log

_SOURCES = "sources ARRAY<STRUCT<id:STRING,title:STRING,url:STRING,checkedAt:STRING>>"
_ENTRY = "ARRAY<STRUCT<name:STRING,reason:STRING,description:STRING>>"
CATALOG_SCHEMA = (
    f"schemaVersion INT, seasonId STRING, seasonName STRING, patch STRING, updatedAt STRING, status STRING, {_SOURCES}, "
    "heroes ARRAY<STRUCT<id:STRING,name:STRING,cost:DOUBLE,traits:ARRAY<STRING>,skill:STRUCT<name:STRING,description:STRING>,stats:MAP<STRING,STRING>,"
    f"recommendations:STRUCT<patch:STRING,items:{_ENTRY},comps:{_ENTRY},sourceIds:ARRAY<STRING>>,"
    "variants:ARRAY<STRUCT<id:STRING,kind:STRING,label:STRING,url:STRING>>>>"
)
LINEUP_SCHEMA = (
    f"schemaVersion INT, seasonId STRING, seasonName STRING, patch STRING, updatedAt STRING, status STRING, {_SOURCES}, "
    "lineups ARRAY<STRUCT<id:STRING,officialId:STRING,name:STRING,quality:STRING,sortOrder:BIGINT,author:STRING,sourceIds:ARRAY<STRING>,"
    "members:ARRAY<STRUCT<unitId:STRING,heroId:STRING,name:STRING,cost:INT,kind:STRING,isCarry:BOOLEAN,"
    "position:STRUCT<row:INT,column:INT>,items:ARRAY<STRUCT<id:STRING,name:STRING>>>>,"
    "guide:STRUCT<early:STRING,reroll:STRING,position:STRING,matchups:STRING,equipment:STRING,augments:STRING,adventure:STRING>>>"
)
MANIFEST_SCHEMA = (
    "schemaVersion INT, datasetKind STRING, seasonId STRING, patch STRING, "
    "cases ARRAY<STRUCT<id:STRING,category:STRING,sourceId:STRING,expectedHeroId:STRING,path:STRING>>, "
    "references ARRAY<STRUCT<heroId:STRING,variantId:STRING,path:STRING>>"
)
#: Fixed value: the most bytes of a manifest.
MANIFEST_BYTES = 1024 * 1024
FEED_SCHEMA = "version STRING, season STRING, setId STRING, data MAP<STRING,{row}>"


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON under a schema; malformed files are errors."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def case_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of labelled cases; one over ``MANIFEST_BYTES`` is an error before it is read."""
    if spark.read.format("binaryFile").load(path).where(F.col("length") > MANIFEST_BYTES).select("path").head(1):
        raise InvalidData(f"{path} is over 1 MB")
    return json_documents(spark, path, MANIFEST_SCHEMA)


def feed(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """A feed of the form {version, season, setId, data: {id: row}}."""
    return json_documents(spark, path, FEED_SCHEMA.format(row=row_schema))


def config_values(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Assigned texts of a script, one column each."""
    script = spark.read.text(path, wholetext=True)
    return script.select(*[config_value(F.col("value"), n).alias(n) for n in names])


def with_fallback(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame], check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The primary catalogue if it reads, is valid and verified or has no pack beside it; else the pack.

    Reading failures and broken rules both lead to the pack; without one, the first failure is raised.
    """

    def pack() -> DataFrame | None:
        try:
            found = fallback()
            return found if found.head(1) else None
        except AnalysisException:
            return None

    try:
        found = primary()
        require_valid(check(found))
        first = found.select("status").head()
    except (InvalidData, PySparkException):
        stored = pack()
        if stored is None:
            raise
        return stored
    if first and first["status"] == "unverified" and (stored := pack()) is not None:
        return stored
    return found


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Stored score records; an absent, empty or unknown store is an empty history, bad rows are left out."""
    schema = f"schemaVersion INT, records ARRAY<STRUCT<{RECORD_SCHEMA.replace(' STRING', ':STRING').replace(' INT', ':INT').replace(' DOUBLE', ':DOUBLE')}>>"
    try:
        stored = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        stored = spark.createDataFrame([], schema)
    rows = stored.where("schemaVersion = 1").select(F.posexplode("records").alias("ordinal", "r")).select("ordinal", "r.*")
    return valid_records(rows)


def replace_tables(tables: dict[str, DataFrame], root: str, after: int | None = None) -> str:
    """Write all tables of one version beside each other, then publish the version: readers see all or none.

    Returns the version. The highest number is in force, and no two writers have
    one number: a writer that fails leaves the old version. With ``after``, the
    version is published only if that number is still the last (``last_version``),
    else the error is ``commit_log.Conflict``.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/{version}/{name}")
    if after is None:
        commit_log.publish_next(spark, root, {"version": version})
    else:
        commit_log.publish(spark, root, {"version": version}, after)
    return version


def last_version(spark: SparkSession, root: str) -> int:
    """The number in force, for a conditional ``replace_tables``; 0 before the first."""
    return commit_log.last_number(spark, root)


def _earlier_version(spark: SparkSession, root: str) -> str | None:
    """The version in force of a folder that was written before there was a log."""
    try:
        newest = spark.read.parquet(f"{root}/versions").agg(F.max(F.struct("number", "version")).alias("v")).head()["v"]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return newest and newest["version"]


def current_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version in force; without one that is an error."""
    number = last_version(spark, root)
    version = commit_log.read(spark, root, number)["version"] if number else _earlier_version(spark, root)
    if version is None:
        raise InvalidData(f"no version is named in {root}")
    return spark.read.parquet(f"{root}/{version}/{name}")


def clear_tables(spark: SparkSession, root: str, schemas: dict[str, str]) -> str:
    """The empty version of every table."""
    return replace_tables({name: spark.createDataFrame([], schema) for name, schema in schemas.items()}, root)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """One JSON document (a catalogue is one row)."""
    catalog.coalesce(1).write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report is never overwritten."""
    report.coalesce(1).write.mode("errorifexists").json(path)


def content_hash(files: DataFrame, length: int = 16) -> str:
    """Hash of files (path, content) in path order. A build lists few files; their digests, not their bytes, are gathered."""
    digests = files.select("path", F.sha2("content", 256).alias("digest"))
    joined = digests.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: F.concat_ws(" ", x["path"], x["digest"]))).alias("all"))
    return joined.select(F.left(F.sha2(F.col("all").cast("binary"), 256), F.lit(length)).alias("h")).head()["h"]
