"""Chroma audio fingerprints of media columns, and the alignment of recordings.

A recording (16-bit mono PCM in a binary column) becomes frames of twelve
pitch-class energies. Filters, evaluated through an integral image over time and
pitch class, compare the energy of two areas; sixteen of them with two bits each
pack one 32-bit integer for every frame. Two recordings are aligned by a
histogram of the offsets at which their integers agree, and the alignment is
judged by the share of bits that differ along it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RATE = 4096
FRAME, HOP = 1024, 256
#: Frames under a filter; a recording of f frames has f - SPAN + 1 integers.
SPAN = 12
LOWEST_HZ, HIGHEST_HZ = 110.0, 1760.0
#: Alignments with a larger share of differing bits are no matches (unrelated ones differ in about half).
MOST_BIT_ERROR = 0.3
#: Frames between the two integers of an index key.
KEY_STEP = 3
#: The bank: (kind, first pitch class, height, width), kinds as in ``_areas``.
FILTERS = [(k % 4, (5 * k) % 9, 3 + k % 2, (4, 6, 8, 12)[k // 4]) for k in range(16)]


def _chroma_map() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    for i, f in enumerate(hz):
        if LOWEST_HZ <= f <= HIGHEST_HZ:
            out[i, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return out


_MAP, _HANN = _chroma_map(), np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Unit-length pitch-class frames; a silent frame is all zero."""
    count = max(0, (len(samples) - FRAME) // HOP + 1)
    if not count:
        return np.empty((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float64) / 32768.0, FRAME)[::HOP][:count]
    energy = np.concatenate([(np.abs(np.fft.rfft(part * _HANN, axis=1)) ** 2) @ _MAP for part in np.array_split(frames, max(1, count // 256))])
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-6, energy / np.maximum(norm, 1e-6), 0.0)


def _areas(image: np.ndarray, kind: int, y: int, h: int, w: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Energies of the two areas a filter compares, at every frame."""

    def box(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        a, b = image[x0 : x0 + n], image[x1 : x1 + n]
        return b[:, y1] - a[:, y1] - b[:, y0] + a[:, y0]

    half_w, half_h = w // 2, h // 2
    if kind == 0:  # earlier and later
        return box(0, half_w, y, y + h), box(half_w, w, y, y + h)
    if kind == 1:  # lower and upper
        return box(0, w, y, y + half_h), box(0, w, y + half_h, y + h)
    if kind == 2:  # two diagonals
        return (
            box(0, half_w, y, y + half_h) + box(half_w, w, y + half_h, y + h),
            box(0, half_w, y + half_h, y + h) + box(half_w, w, y, y + half_h),
        )
    return box(w // 4, w - w // 4, y, y + h), box(0, w // 4, y, y + h) + box(w - w // 4, w, y, y + h)  # middle and sides


def audio_fingerprint(samples: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer, as int64, for each frame."""
    frames = chroma(samples)
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int64)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    out = np.zeros(n, np.int64)
    for kind, y, h, w in FILTERS:
        a, b = _areas(image, kind, y, h, w, n)
        level = np.searchsorted([-0.35, 0.0, 0.35], np.log((0.1 + a) / (0.1 + b)))
        out = (out << 2) | (level ^ (level >> 1))  # neighbouring levels differ in one bit
    return out


def fingerprints(media: DataFrame, key: str, audio: str) -> DataFrame:
    """(key, codes array<long>); a null or too short recording has no codes."""
    common.bound_batches(media.sparkSession)

    @F.pandas_udf("array<long>")
    def coded(batch: pd.Series) -> pd.Series:
        return pd.Series([audio_fingerprint(np.frombuffer(x[: len(x) // 2 * 2], "<i2")) if x is not None else np.empty(0, np.int64) for x in batch], dtype=object)

    return media.select(F.col(key).alias("id"), coded(F.col(audio)).alias("codes"))


def classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal recordings as one class: (class_id, codes, n_copies), and id -> class_id.

    The class id is its smallest member; recordings without codes are in none.
    """
    marked = prints.where("size(codes) > 0 AND id IS NOT NULL").withColumn("mark", F.sha2(F.concat_ws(",", F.col("codes").cast("array<string>")), 256))
    one = marked.groupBy("mark").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"), F.first("codes").alias("codes"))
    return one.select("class_id", "codes", "n_copies"), marked.select("id", "mark").join(one.select("mark", "class_id"), "mark").select("id", "class_id")


def _keys(frame: DataFrame, name: str) -> DataFrame:
    """An entry for each run of equal keys: a frame's code and the one three frames on make the key.

    Silence or a held note is one long run, not an entry for each frame.
    """
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("codes") - KEY_STEP),
        lambda i: F.struct(F.element_at("codes", i).alias("k1"), F.element_at("codes", i + KEY_STEP).alias("k2")),
    )
    return _runs(frame.where(F.size("codes") > KEY_STEP).select(name, pairs.alias("keys")), name).select(name, "at", "n", "k.k1", "k.k2")


def _single_keys(frame: DataFrame, name: str) -> DataFrame:
    """Runs of equal codes, for what is too short to have keys of two codes."""
    return _runs(frame.where(F.size("codes") > 0).select(name, F.col("codes").alias("keys")), name).withColumnRenamed("k", "code")


def _runs(frame: DataFrame, name: str) -> DataFrame:
    """(name, at, n, k) of the runs of equal values in the array ``keys``: where each begins and how long it is."""
    starts = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: (i == 0) | (F.get("keys", i) != F.get("keys", i - 1)))
    marked = frame.withColumn("starts", starts)
    after = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("keys")))
    runs = F.zip_with("starts", after, lambda at, end: F.struct(at.alias("at"), (end - at).alias("n"), F.get("keys", at).alias("k")))
    return marked.select(name, F.explode(runs).alias("run")).select(name, "run.*")


def _hits(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, class_id, offset_frames, votes) of equal keys; where either side is too short for keys of two codes, of equal codes.

    Two runs agree at every offset at which they overlap, once for each frame of the overlap.
    """

    def met(q: DataFrame, c: DataFrame, on: list[str]) -> DataFrame:
        both = q.withColumnRenamed("at", "q_at").withColumnRenamed("n", "q_n").join(c, on)
        offsets = F.sequence(F.col("at") - F.col("q_at") - F.col("q_n") + 1, F.col("at") + F.col("n") - 1 - F.col("q_at"))
        o = F.col("offset_frames")
        overlap = F.least(F.col("q_at") + F.col("q_n") + o, F.col("at") + F.col("n")) - F.greatest(F.col("q_at") + o, F.col("at"))
        return both.withColumn("offset_frames", F.explode(offsets)).select("query_id", "class_id", "offset_frames", overlap.cast("long").alias("votes"))

    short = F.size("codes") <= KEY_STEP
    return (
        met(_keys(queries, "query_id"), _keys(index, "class_id"), ["k1", "k2"])
        .union(met(_single_keys(queries.where(short), "query_id"), _single_keys(index, "class_id"), ["code"]))
        .union(met(_single_keys(queries.where(~short), "query_id"), _single_keys(index.where(short), "class_id"), ["code"]))
    )


def aligned(queries: DataFrame, index: DataFrame, most_bit_error: float = MOST_BIT_ERROR) -> DataFrame:
    """Best alignment of each query class with each recording class it meets.

    ``queries`` is (query_id, codes), ``index`` (class_id, codes, n_copies).
    Returns query_id, class_id, offset_frames (where in the recording the query
    begins), votes, bit_error, n_copies. The bit error is computed at every offset
    that has a vote; of those within ``most_bit_error`` the one with the most votes
    is taken, ties going to the smallest offset. Equal recordings are one class,
    never multiplied out. Null and empty code lists meet nothing, empty tables give no
    rows. Recordings and queries of any length that has codes are
    found: up to KEY_STEP codes by their single codes.
    """
    votes = (
        _hits(queries, index)
        .groupBy("query_id", "class_id", "offset_frames")
        .agg(F.sum("votes").alias("votes"))
        .groupBy("query_id", "class_id")
        .agg(F.collect_list(F.struct("offset_frames", "votes")).alias("voted"))
    )
    q = queries.select("query_id", F.col("codes").alias("q_codes"))

    def judged(v: Column) -> Column:
        offset = v["offset_frames"]
        lo, hi = F.greatest(F.lit(0), -offset), F.least(F.size("q_codes"), F.size("codes") - offset)
        bits = F.aggregate(
            F.sequence(lo + 1, hi),
            F.lit(0).cast("long"),
            lambda acc, i: acc + F.bit_count(F.element_at("q_codes", i).bitwiseXOR(F.element_at("codes", (i + offset).cast("int")))),
        )
        return F.struct(v["votes"].alias("votes"), (-offset).alias("before"), (bits / (32.0 * (hi - lo))).alias("bit_error"))

    return (
        votes.join(q, "query_id")
        .join(index, "class_id")
        .withColumn("best", F.array_max(F.filter(F.transform("voted", judged), lambda v: v["bit_error"] <= most_bit_error)))
        .where("best IS NOT NULL")
        .select("query_id", "class_id", (-F.col("best.before")).alias("offset_frames"), "best.votes", "best.bit_error", "n_copies")
    )


def with_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs and, as rows without a query, who belongs to the classes in them.

    A member row holds its recording against its class: offset and bit error are
    zero, votes are null, member_id is the recording. In pairs member_id is null.
    A class in many pairs is listed once.
    """
    found = members.join(pairs.select("class_id", "n_copies").distinct(), "class_id")
    none = F.lit(None)
    return pairs.withColumn("member_id", none.cast("long")).unionByName(
        found.select(
            none.cast("long").alias("query_id"), "class_id", F.lit(0).alias("offset_frames"), none.cast("long").alias("votes"),
            F.lit(0.0).alias("bit_error"), "n_copies", F.col("id").alias("member_id"),
        )
    )


def melody(values: np.ndarray, seed: int = 0, noise: float = 0.0) -> np.ndarray:
    """16-bit samples that play a vector: one note of 1/16 s for each of its numbers."""
    pitch = np.clip(np.round(12 + 40 * np.nan_to_num(values.astype(np.float64))), 0, 24)
    hz = np.repeat(220.0 * 2 ** (pitch / 12), HOP)
    phase = 2 * np.pi * np.cumsum(hz) / RATE
    wave = 0.6 * np.sin(phase) + 0.2 * np.sin(2 * phase)
    if noise:
        wave = wave + noise * np.random.default_rng(seed).standard_normal(len(wave))
    return np.clip(np.round(wave * 20000), -32768, 32767).astype("<i2")


def recordings(vectors: DataFrame) -> DataFrame:
    """(vec_id, audio, excerpt): each vector's melody as PCM, and for ids divisible by 20 a noisy
    excerpt of it that begins 8 to 23 frames later. The tables have no media of their own."""
    common.bound_batches(vectors.sparkSession)

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            audio, excerpt = [], []
            for row_id, vector in zip(batch["row_id"], batch["embedding"], strict=True):
                v = np.empty(0) if vector is None else np.asarray(vector)
                audio.append(melody(v).tobytes() if len(v) else None)
                number = int(row_id) if row_id is not None else 1
                start = (8 + number // 20 % 16) * HOP
                excerpt.append(melody(v, abs(number), 0.02)[start : start + 36 * HOP].tobytes() if len(v) and number % 20 == 0 else None)
            yield pd.DataFrame({"row_id": batch["row_id"], "audio": audio, "excerpt": excerpt})

    rows = vectors.select(F.col("vec_id").cast("string").alias("row_id"), "embedding")
    played = rows.mapInPandas(play, "row_id string, audio binary, excerpt binary")
    return played.select(F.col("row_id").cast("long").alias("vec_id"), "audio", "excerpt")


def media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of every twentieth recording, searched in all recordings, and the members of the classes found.

    Null, empty and too short vectors have no codes and match nothing; rows with a
    null id are in no class; equal recordings are one class; an empty table gives no rows.
    """
    media = recordings(common.plain(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    prints = common.stored(fingerprints(media, "vec_id", "audio"), "prints")
    index, members = classes(prints)
    index = common.stored(index, "recordings")
    asked = fingerprints(media.where(F.pmod("vec_id", F.lit(20)) == 0), "vec_id", "excerpt")
    asked = common.stored(asked.where("size(codes) > 0").select(F.col("id").alias("query_id"), "codes"), "excerpts")
    return with_members(common.stored(aligned(asked, index), "pairs"), members)
