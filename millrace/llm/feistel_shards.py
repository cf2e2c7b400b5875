"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row has a global row number; a keyed permutation of 0..N-1 maps it to a
place; place mod shards is the shard and place div shards the slot. So a row's
shard and slot can be computed from its number, and a row's number from its
shard and slot, without any table of the shuffle. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

ROUNDS = 6
#: The domain is a*b with a = ceil(sqrt(N)), so fewer than a of its places lie
#: beyond N, and no walk is longer than a steps. All rows take up to so many steps
#: at first; the few that are still outside then take as many as they need.
FIRST_STEPS = 16
#: Row numbers are counted within hash ranges of about this many rows.
ROWS_A_BUCKET = 1000
MOST_BUCKETS = 8192


def domain(rows: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-rows // a))


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The place of a row number under the keyed permutation of 0..rows-1."""
    a, b = domain(rows)

    def walk(place: Column, steps: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), place, lambda at, _: F.when(at < rows, at).otherwise(_network(at, a, b, seed))
        )

    near = walk(_network(number, a, b, seed), min(a, FIRST_STEPS))
    return near if a <= FIRST_STEPS else F.when(near < rows, near).otherwise(walk(near, a))


def _network(place: Column, a: int, b: int, seed: int) -> Column:
    """The Feistel network on Z_a x Z_b: each half in turn is shifted by a keyed hash of the other.

    A round swaps the halves, so the modulus alternates; after an even number
    of rounds each half is back in its own ring.
    """
    halves = F.struct(F.floor(place / F.lit(b)).cast("long").alias("l"), (place % F.lit(b)).cast("long").alias("r"))
    rounds = F.array(
        *[
            F.struct(F.lit(seed * 1_000_003 + k).cast("long").alias("key"), F.lit(b if k % 2 else a).cast("long").alias("m"))
            for k in range(ROUNDS)
        ]
    )

    def one(acc: Column, k: Column) -> Column:
        shifted = (acc["l"] + F.pmod(F.xxhash64(acc["r"], k["key"]), k["m"])) % k["m"]
        return F.struct(acc["r"].alias("l"), shifted.cast("long").alias("r"))

    return F.aggregate(rounds, halves, one, lambda acc: (acc["l"] * F.lit(b) + acc["r"]).cast("long"))


def numbered(frame: DataFrame, keys: list[str], into: str = "row_number") -> DataFrame:
    """Gapless global row numbers from 0, in the order of a hash of ``keys``, then ``keys``.

    The numbers depend on the rows alone, not on files, partitions or retries.
    Hash ranges make even buckets whatever the keys look like, also where one of
    them is often null or repeated; a bucket's rows are numbered by one window and
    the buckets' sizes (at most 8,192 rows) are summed to offsets. Rows equal in all
    keys are interchangeable. Of the frame's columns only one named ``into`` is replaced.
    """
    total = frame.count()
    buckets = min(MOST_BUCKETS, max(1, total // ROWS_A_BUCKET))
    kept = frame.drop(into)
    h, bucket, within, offset = common.fresh(kept, "_h", "_bucket", "_within", "_offset")
    columns = [F.col(f"`{k}`") for k in keys]
    hashed = kept.withColumn(h, F.xxhash64(*columns)).withColumn(
        bucket, F.least(F.floor((F.col(h) / F.lit(2.0**64) + 0.5) * buckets), F.lit(buckets - 1)).cast("int")
    )
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy(bucket).agg(F.count("*").alias("rows")).select(bucket, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(offset))
    order = Window.partitionBy(bucket).orderBy(h, *columns)
    return (
        hashed.withColumn(within, F.row_number().over(order))
        .join(F.broadcast(offsets), bucket)
        .withColumn(into, (F.col(offset) + F.col(within) - 1).cast("long"))
        .drop(h, bucket, within, offset)
    )


def sharded(frame: DataFrame, keys: list[str], shards: int, seed: int = 20) -> DataFrame:
    """Add ``shard`` and ``slot``; shard sizes differ by one row at most.

    Null keys are numbered like any other; repeated rows get places of their
    own; an empty table stays empty; columns named shard or slot are replaced.
    """
    rows = frame.count()
    kept = frame.drop("shard", "slot")
    number, place = common.fresh(kept, "_number", "_place")
    return (
        numbered(kept, keys, number)
        .withColumn(place, permuted(F.col(number), rows, seed))
        .withColumn("shard", (F.col(place) % shards).cast("int"))
        .withColumn("slot", F.floor(F.col(place) / shards).cast("long"))
        .drop(place, number)
    )


def shards_query(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents by all three laws; a null text has no bytes, null ids and repeated rows are places of their own, an
    empty table has none."""
    docs = common.plain(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = docs.select(
        "doc_id",
        (F.octet_length(data) + 16).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
    )
    return sharded(thin, ["doc_id", "text_crc32", "size"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
