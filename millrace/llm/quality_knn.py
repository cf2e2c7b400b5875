"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed term weights: the shapes of its words and of neighbouring
words (which tell prose from tables, shouting and symbol noise), how much of it
repeats, and the words themselves. A truncated singular value decomposition of
the labelled sample's weighted terms gives the latent space. The labelled
vectors are broadcast; every document's vector is held against all of them by
exact blocked products, and its nearest neighbours vote, each with a weight
that rises with its cosine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The most labelled rows that are fitted: those with the lowest hashed ids.
TRAIN_ROWS = 2000
SHAPE_TERMS = 1024
WORD_TERMS = 512
#: Words tell the language more than the quality, so they weigh less.
WORD_SHARE = 0.3
LATENT = 64
NEIGHBOURS = 15
#: Cosines that agree to so many decimals are equally near.
TIE_DIGITS = 5
#: A neighbour's weight is its cosine to this power.
SHARPNESS = 8
THRESHOLD = 0.3


def _shape(word: str) -> str:
    """Runs of small letters, capitals and digits as one sign each; other signs up to twice."""
    out: list[str] = []
    for c in word:
        kind = ("X" if c != c.lower() else "x") if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind or (kind not in "Xx9" and out[-2:] != [kind, kind]):
            out.append(kind)
    return "".join(out)


class _Words(dict):
    """Packed (shape bucket, word hash) of the words a worker has met; emptied when it holds 200,000."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        shape = zlib.crc32(_shape(word).encode()) % SHAPE_TERMS
        packed = self[word] = (zlib.crc32(word.encode()) << 16) | shape
        return packed


_words = _Words()


def term_weights(text: str | None) -> np.ndarray:
    """Square roots of the shares of each hashed term; all zero for a text without words."""
    out = np.zeros(SHAPE_TERMS + WORD_TERMS, dtype=np.float32)
    words = (text or "").split()
    n = len(words)
    if not n:
        return out
    packed = np.fromiter(map(_words.__getitem__, words), dtype=np.int64, count=n)
    shape, word = packed & 0xFFFF, packed >> 16
    pair = (shape[:-1] * 31 + shape[1:] * 17 + 7) % SHAPE_TERMS
    out[:SHAPE_TERMS] = np.sqrt((np.bincount(shape, minlength=SHAPE_TERMS) + np.bincount(pair, minlength=SHAPE_TERMS)) / n)
    distinct, times = np.unique(word, return_counts=True)
    out[0] += 2 * np.sqrt((word[:-1] == word[1:]).sum() / n)
    out[1] += np.sqrt((n - len(distinct)) / n)
    out[SHAPE_TERMS:] = np.sqrt(np.bincount(distinct % WORD_TERMS, weights=times, minlength=WORD_TERMS) / n)
    return out


class Voter:
    """The fitted space, the labelled vectors in it and their votes."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray):
        rows = max(1, len(terms))
        idf = np.log((1 + rows) / (1 + (terms > 0).sum(axis=0))) + 1
        idf[SHAPE_TERMS:] *= WORD_SHARE
        weighted = terms * idf.astype(np.float32)
        _, axes = np.linalg.eigh(weighted.T @ weighted)
        self.project = (idf[:, None] * axes[:, ::-1][:, :LATENT]).astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.vectors = self.latent(terms)

    def latent(self, terms: np.ndarray) -> np.ndarray:
        v = terms.astype(np.float32) @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """One block: cosines to every labelled vector, then the vote of the nearest ``NEIGHBOURS`` and of all that
        are as near as the last of them."""
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        cosine = self.latent(terms) @ self.vectors.T
        cosine = np.round(cosine, TIE_DIGITS)
        last = max(0, cosine.shape[1] - NEIGHBOURS)
        near = cosine >= np.partition(cosine, last, axis=1)[:, last, None]
        weight = np.zeros(cosine.shape)
        weight[near] = np.maximum(cosine[near], 1e-6).astype(np.float64) ** SHARPNESS
        vote = weight @ self.labels / weight.sum(axis=1)
        return np.where(terms.any(axis=1), np.clip(vote, 0.0, 1.0), 0.0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality") -> Voter:
    """A voter from at most ``rows`` labelled documents, chosen by hashed id.

    Several labels of one document count by their mean; rows with a null id or
    label are not learnt from. What reaches the driver is ``rows`` vectors of a
    fixed width, made where the texts are.
    """
    common.bound_batches(docs.sparkSession)
    chosen = (
        labels.where(f"doc_id IS NOT NULL AND `{label}` IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [term_weights(t).astype("<f2").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "terms": packed})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    chosen = chosen.withColumn("doc_id", F.col("doc_id").cast(id_type))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(vectors, f"doc_id {id_type}, label double, terms binary")
    held = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "terms").limit(rows).collect()
    terms = np.array([np.frombuffer(r["terms"], dtype="<f2") for r in held], dtype=np.float32).reshape(len(held), SHAPE_TERMS + WORD_TERMS)
    return Voter(terms, np.array([float(r["label"] >= 0.5) for r in held]))


def scored(docs: DataFrame, voter: Voter, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.3 up).

    Null and empty texts, and texts without words, score 0; with no labelled
    row at all, every other text scores 0.5. Whole texts are read; repeated rows
    give repeated results; columns of these two names are replaced.
    """
    common.bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(voter)

    @F.pandas_udf(T.DoubleType())
    def voted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            terms = np.array([term_weights(t) for t in batch], dtype=np.float32).reshape(len(batch), SHAPE_TERMS + WORD_TERMS)
            yield pd.Series(shipped.value.score(terms), dtype="float64")

    return docs.withColumn("score", voted(F.col(f"`{text}`"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(key: Column) -> Column:
    return common.fold(key, 5) == 0


def _learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.plain(common.table(spark, sf_dir, "labels"), "doc_id", "quality")
    return labels.where(~held_out(F.col("doc_id")))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labelled rows that are not held out; nulls, empty and long texts as in ``scored``."""
    docs = common.plain(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    voter = fit(docs, _learnable(spark, sf_dir))
    return scored(docs, voter).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents predicted to be good, with the columns they came with.

    Null and empty texts and texts without words score 0 and go; repeated rows are
    kept or go together; rows with a null id are judged by their text like any
    other; with no learnable label every text with words stays. An empty table
    stays empty. A column named score or predicted comes back as it was.
    """
    voter = fit(docs, _learnable(spark, sf_dir))
    kept = scored(docs.select(F.struct("*").alias("row"), "text"), voter)
    return kept.where("predicted = 1").select("row.*")
