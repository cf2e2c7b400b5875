"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (n = 1..3), by
rank. A document's own most frequent n-grams are held against each profile:
every n-gram costs the distance between its two ranks, or the most possible if
the profile lacks it. The language with the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: N-grams in a profile, of a language and of a document.
PROFILE_SIZE = 300
#: Learning documents of each language, at most about so many on average: those
#: whose hashed id falls below the language's share. A profile of 300 n-grams is
#: settled long before.
TRAIN_DOCS_A_LANGUAGE = 4000
#: Languages that are learnt, those with most documents: a column of stray values must not become as many profiles.
LANGUAGES = 500
#: Code points counted at once; longer texts are counted piece by piece.
BLOCK_CHARS = 500_000
UNKNOWN = "und"

_BITS = 21  # of a code point; three fit into 63 bits
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _grams(chars: np.ndarray) -> np.ndarray:
    one = chars[chars != 32]
    two = (chars[:-1] << _BITS) | chars[1:]
    three = (two[:-1] << _BITS) | chars[2:]
    return np.concatenate([one, two, three])


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts, first)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of the lower-cased letters; other runs are one blank."""
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    text = text or ""
    carry = np.array([32], dtype=np.int64)
    for at in range(0, len(text), BLOCK_CHARS):
        raw = np.frombuffer(text[at : at + BLOCK_CHARS].lower().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        chars = np.where(_letter_table()[raw], raw, 32)
        last = at + BLOCK_CHARS >= len(text)
        chars = np.concatenate([carry, chars, np.array([32], dtype=np.int64)] if last else [carry, chars])
        keep = np.ones(len(chars), dtype=bool)
        keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
        chars = chars[keep]
        carried = len(carry) if at else 0
        grams = _grams(chars)
        if at:  # what lies wholly in the carried characters was counted before
            seen = _grams(carry)
            some, n = np.unique(np.concatenate([grams, seen]), return_counts=True)
            old, m = np.unique(seen, return_counts=True)
            n[np.searchsorted(some, old)] -= 2 * m
            some, n = some[n > 0], n[n > 0]
        else:
            some, n = np.unique(grams, return_counts=True)
        codes, counts = _merged(np.concatenate([codes, some]), np.concatenate([counts, n])) if carried else (some, n)
        carry = chars[-2:]
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    if len(codes) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= floor
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Ranked n-grams of each language, ready for lookups."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size = size
        self.langs = sorted(profiles)
        self.codes = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in self.langs] or [np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text)
        top = ranked(codes, counts, self.size)
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == top, at, len(self.codes))
        ranks = self.ranks[:, at]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1.0 - distance[best] / (self.size * len(top)))


def learn_profiles(train: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE, most: int = TRAIN_DOCS_A_LANGUAGE, key: str = "doc_id") -> dict[str, list[int]]:
    """Profiles of the languages named in ``train``.

    Documents of a language count equally; each task sums the n-grams of its
    documents before anything is shuffled. What reaches the driver is
    ``size`` n-grams for each of at most ``LANGUAGES`` languages, those with most documents.
    """
    spark = train.sparkSession
    common.bound_batches(spark)
    rows = train.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return {}
    rows = rows.where(F.col("lang").isin(*sizes))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, most / n))]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for batch in batches:
            for value, body in zip(batch["lang"], batch["text"], strict=True):
                codes, counts = gram_counts(body)
                if not len(codes):
                    continue
                parts = held.setdefault(value, [])
                parts.append((codes, counts.astype(np.float64) / counts.sum()))
                if len(parts) >= 256:
                    held[value] = [_merged(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))]
        for value, parts in held.items():
            codes, weights = _merged(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))
            yield pd.DataFrame({"lang": value, "code": codes, "weight": np.round(weights * 1e9).astype(np.int64)})

    summed = chosen.select("lang", "text").mapInPandas(partial, "lang string, code long, weight long").groupBy("lang", "code").agg(F.sum("weight").alias("weight"))
    # Each of 64 parts of a language's n-grams keeps its best, then these few meet.
    best = (
        summed.groupBy("lang", F.pmod(F.xxhash64("code"), F.lit(64)).alias("part"))
        .agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "code"))), 1, size).alias("top"))
        .select("lang", F.explode("top").alias("t"))
        .groupBy("lang")
        .agg(F.slice(F.sort_array(F.collect_list("t")), 1, size).alias("top"))
    )
    return {r["lang"]: [t["code"] for t in r["top"]] for r in best.collect()}


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE_SIZE) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (1: ranks agree wholly, 0: nothing in common).

    A null text, one without letters, or no profile at all gives ``und`` and 0.
    Ties go to the language first in order. Texts of any length are read whole,
    block by block. Repeated rows give repeated results; columns of these two
    names are replaced, all others kept.
    """
    common.bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Profiles(shipped.value, size)
        for batch in batches:
            yield pd.DataFrame([known.predict(x) for x in batch], columns=["lang_pred", "score"])

    return (
        docs.drop("lang_pred", "score")
        .withColumn("_id", predicted(F.col(f"`{text}`")))
        .withColumn("lang_pred", F.col("_id.lang_pred"))
        .withColumn("score", F.col("_id.score"))
        .drop("_id")
    )


def held_out(key: Column) -> Column:
    return common.fold(key, 3) == 1


def langid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from rows that are not held out; nulls, empty and long texts as in ``identify``."""
    docs = common.plain(common.table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    profiles = learn_profiles(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    thin = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(thin, profiles).select("doc_id", "held_out", "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known, with the columns they came with; profiles come from these documents.

    Null and empty texts and texts without letters have no language and go; with no
    document that names its language, all go. Repeated rows are kept or go
    together; ids are not looked at but for holding out a third of them. An empty
    table stays empty. A column named lang_pred or score comes back as it was.
    """
    profiles = learn_profiles(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    kept = identify(docs.select(F.struct("*").alias("row"), "text"), profiles)
    return kept.where(F.col("lang_pred") != UNKNOWN).select("row.*")
