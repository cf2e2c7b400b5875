"""SimHash fingerprints of texts, and all fingerprints within a Hamming radius.

Terms are the lower-cased words and the pairs of neighbouring words; a term
that occurs n times weighs sqrt(n). Every term's hash votes, with its weight,
on each bit of the fingerprint. Texts that share a part s of their terms agree
on about 1 - arccos(s)/pi of the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: 64-bit lanes of a fingerprint: 256 bits.
LANES = 4
#: Terms that vote at once; more are taken in turns.
BLOCK_TERMS = 32_768
#: The search's radius and blocks: eight blocks of 32 bits, of which one at least is equal.
RADIUS, BLOCKS = 7, 8
#: Rows in a range of ids that one task walks in order, and the most ranges.
ROWS_A_RANGE = 1000
MOST_RANGES = 16_384

_GOLDEN, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9))


class _WordHashes(dict):
    """Hashes of the words a worker has met; emptied when it holds 200,000."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)
        return h


_words = _WordHashes()


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.int64, count=len(words)).view(np.uint64)


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes and their weights."""
    one = _word_hashes((text or "").lower().split())
    if not len(one):
        return one, np.empty(0, np.float32)
    two = (one[:-1] * _GOLDEN) ^ one[1:]
    two = (two ^ (two >> np.uint64(29))) * _GOLDEN
    hashes, counts = np.unique(np.concatenate([one, two]), return_counts=True)
    return hashes, np.sqrt(counts).astype(np.float32)


def fingerprint(text: str | None) -> np.ndarray:
    """Packed bits, ``LANES`` * 8 bytes; of a text without words, all zero."""
    hashes, weights = terms(text)
    votes = np.zeros(LANES * 64, dtype=np.float64)
    for at in range(0, len(hashes), BLOCK_TERMS):
        h, w = hashes[at : at + BLOCK_TERMS], weights[at : at + BLOCK_TERMS]
        for lane in range(LANES):
            x = h + np.uint64((lane + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ (x >> np.uint64(31))) * _MIX_A
            x = (x ^ (x >> np.uint64(29))) * _MIX_B
            x ^= x >> np.uint64(32)
            bits = np.unpackbits(x.astype("<u8").view(np.uint8)).reshape(-1, 64)
            votes[lane * 64 : lane * 64 + 64] += w @ bits.astype(np.float32)
    return np.packbits(2 * votes > weights.sum(dtype=np.float64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal bits."""
    return 1.0 - int(np.unpackbits(a ^ b).sum()) / (LANES * 64)


def fingerprints(frame: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Add each text's fingerprint in hex; equal texts have equal ones.

    Null and empty texts have no terms and the all-zero fingerprint. Texts of any
    length vote whole, in blocks. A column named like the output is replaced.
    """
    common.bound_batches(frame.sparkSession)

    @F.pandas_udf("string")
    def hashed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: fingerprint(t).tobytes().hex(), na_action=None)

    return frame.withColumn(into, hashed(F.col(f"`{text}`")))


def within_radius(queries: DataFrame, index: DataFrame, radius: int, blocks: int | None = None, bits: int = LANES * 64) -> DataFrame:
    """All (query, fingerprint, distance) of two tables of fingerprints, distance <= radius.

    Null fingerprints meet nothing, repeated ones count once, an empty side gives no rows.

    Fingerprints are cut into ``blocks`` > radius blocks; two within the radius
    agree on blocks - radius of them at least, so one table for each choice of so
    many blocks, keyed by their bits, meets every pair. Both sides are reduced to
    distinct fingerprints first: copies are joined back by whoever needs them and
    are never multiplied here.
    """
    blocks = blocks or radius + 1
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    if (blocks - radius) * (bits // blocks) < 16 and radius:
        raise ValueError("keys of fewer than 16 bits meet nearly everything: use fewer blocks")
    digits = bits // 4
    edges = [round(i * digits / blocks) for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))

    def keyed(frame: DataFrame, name: str) -> DataFrame:
        distinct = frame.select(F.col("fingerprint").alias(name)).where(f"{name} IS NOT NULL").distinct()
        keys = [
            F.concat(F.lit(f"{k}:"), *[F.substring(name, edges[b] + 1, edges[b + 1] - edges[b]) for b in choice])
            for k, choice in enumerate(choices)
        ]
        return distinct.withColumn("key", F.explode(F.array(*keys)))

    words = [(i * 15, min(15, digits - i * 15)) for i in range(-(-digits // 15))]
    distance = sum(
        (
            F.bit_count(
                F.conv(F.substring("query", at + 1, n), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("found", at + 1, n), 16, 10).cast("long"))
            )
            for at, n in words
        ),
        F.lit(0),
    )
    return (
        keyed(queries, "query")
        .join(keyed(index, "found"), "key")
        .withColumn("distance", distance)
        .where(F.col("distance") <= radius)
        .select("query", "found", "distance")
        .distinct()
    )


def _bucketed(frame: DataFrame, key: str, tie: str) -> DataFrame:
    """Add ``_bucket``: a text that orders as the ranges of (key, tie) do.

    Ranges of keys are cut at quantiles and around every key that more rows share
    than two ranges should hold; such a key's rows are cut further by their tie, a hash.
    """
    total = frame.count()
    ranges = min(MOST_RANGES, max(1, total // ROWS_A_RANGE))
    hot = frame.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * ROWS_A_RANGE).orderBy(F.desc("rows"), key).limit(MOST_RANGES).collect() if ranges > 1 else []
    splits = set(frame.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))) if ranges > 1 else set()
    splits = sorted({int(x) for x in splits} | {r[0] for r in hot} | {r[0] + 1 for r in hot if r[0] < (1 << 63) - 1})
    if not splits:
        return frame.withColumn("_bucket", F.lit("0"))
    step = max(1, int(len(splits) ** 0.5))
    fine, coarse = F.lit(splits), F.lit(splits[::step])
    at = F.size(F.filter(coarse, lambda c: c <= F.col(key)))
    below = F.size(F.filter(F.slice(fine, (at - 1) * step + 1, F.lit(step)), lambda c: c <= F.col(key)))
    bucket = F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + below)
    parts = F.lit(1)
    if hot:
        table = F.create_map(*[F.lit(x) for r in hot for x in (r[0], -(-r["rows"] // ROWS_A_RANGE))])
        parts = F.coalesce(F.try_element_at(table, F.col(key)), F.lit(1))
    part = F.least(F.floor((F.col(tie) / F.lit(2.0**64) + 0.5) * parts), parts - 1)
    return frame.withColumn("_bucket", F.concat_ws("-", F.lpad(bucket.cast("string"), 8, "0"), F.lpad(part.cast("string"), 8, "0")))


def with_next(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, text) dealt into ranges of ids, each sorted by descending id and closed by a
    copy of the next range's first row, so that every row's successor follows it.

    Null ids come last, ties by a hash of their texts and then by the texts; the last
    row's successor is the first. An id that very many rows share is dealt to several ranges.
    """
    low = -(1 << 63)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = _bucketed(
        frame.select(F.col(f"`{key}`").alias("id"), body.alias("text")).withColumns({"_key": F.coalesce(F.col("id").cast("long"), F.lit(low)), "_tie": F.xxhash64("text")}),
        "_key",
        "_tie",
    )
    top = F.max(F.struct("_key", "_tie")).alias("head")
    heads = [(r["_bucket"], *r["head"]) for r in rows.groupBy("_bucket").agg(top).orderBy("_bucket").collect()]
    if not heads:
        return rows.withColumn("copy", F.lit(0))
    above = [h[0] for h in heads[1:]] + [heads[0][0]]
    copies = frame.sparkSession.createDataFrame([(h[1], h[2], to) for h, to in zip(heads, above, strict=True)], "_key long, _tie long, _to string")
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("copy"))
    also = F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("bucket"), F.lit(1).alias("copy")))
    return (
        rows.join(F.broadcast(copies), ["_key", "_tie"], "left")
        .withColumn("_target", F.explode(F.array_compact(F.array(own, also))))
        .select("id", "text", "_key", "_tie", F.col("_target.bucket").alias("_bucket"), F.col("_target.copy").alias("copy"))
        .repartition("_bucket")
        .sortWithinPartitions("_bucket", "copy", F.desc("_key"), F.desc("_tie"), "text")
    )


def compare_with_edits(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edit (the last half taken from the next text's start)
    and their likenesses. A null text is empty, null ids come last; repeated rows are compared each; texts of any
    length are read whole; an empty table gives no rows. Ids are whole numbers."""
    common.bound_batches(frame.sparkSession)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # id, text, fingerprint, bucket of the row that waits for its successor
        for batch in batches:
            out = []
            for row_id, body, bucket, copy in zip(batch["id"], batch["text"], batch["_bucket"], batch["copy"], strict=True):
                if copy and (held is None or held[3] != bucket):
                    continue
                mark = fingerprint(body)
                if held is not None and held[3] == bucket:
                    old_id, old, old_mark, _ = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + body[:half]
                    edited_mark = fingerprint(edited)
                    out.append((old_id, len(old), edited, old_mark.tobytes().hex(), edited_mark.tobytes().hex(), likeness(old_mark, edited_mark), likeness(old_mark, mark)))
                held = None if copy else (row_id, body, mark, bucket)
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    # ids travel as text: a null among them must not turn the others into floating-point numbers
    rows = with_next(frame, key, text)
    done = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(
        walk, "id string, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return done.withColumn("id", F.col("id").cast("long"))


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``compare_with_edits`` of all documents, the edited texts as digests."""
    docs = common.plain(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    return compare_with_edits(docs).select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def near_documents(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, found_id, distance): documents whose id is divisible by 20, against all documents within the radius.

    Each other fingerprint within the radius is named by the smallest id that has
    it; rows with a null id, and texts without words, whose fingerprint says
    nothing, neither ask nor are found.
    """
    marks = common.stored(fingerprints(common.plain(docs, "doc_id", "text").where("doc_id IS NOT NULL")).select("doc_id", "fingerprint"), "fingerprints")
    marks = marks.where(F.col("fingerprint") != "0" * (LANES * 16))
    asked = marks.where("doc_id % 20 = 0")
    found = within_radius(asked.select("fingerprint"), marks.select("fingerprint"), radius, blocks)
    named = marks.groupBy(F.col("fingerprint").alias("found")).agg(F.min("doc_id").alias("found_id"))
    pairs = found.join(named, "found").join(asked.withColumnRenamed("fingerprint", "query"), "query")
    return pairs.where("doc_id <> found_id").select("doc_id", "found_id", "distance")


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(common.table(spark, sf_dir, "documents"))
