"""Image files as pixel rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the most bytes of a case image.
MOST_BYTES = 24 * 1024 * 1024


def case_files(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, content, length) of files that are neither empty nor too large; the length is tested before bytes are read."""
    return spark.read.format("binaryFile").load(path).where(F.col("length").between(1, most)).select("path", "content", "length")


def _place(path: Column) -> Column:
    """A file's address, whose scheme two sources write with one slash or three."""
    return F.regexp_replace(path, "^([a-z]+):/+", "$1:/")


_TAG, _SHORT = 0x0112, 3


def _tagged(tiff: bytes) -> int:
    """The orientation in the first directory of a TIFF block; 1 where there is none."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if order is None or len(tiff) < 8:
        return 1
    (at,) = struct.unpack_from(order + "I", tiff, 4)
    if at + 2 > len(tiff):
        return 1
    (count,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(count):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            return 1
        tag, kind, _, value = struct.unpack_from(order + "HHIH", tiff, entry)
        if tag == _TAG and kind == _SHORT:
            return value if 1 <= value <= 8 else 1
    return 1


def orientation(content: bytes) -> int:
    """How a JPEG, PNG or WebP file says its picture is turned (1 to 8, 1: not); broken files say nothing."""
    at, end = 0, len(content)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= end and content[at] == 0xFF and content[at + 1] != 0xDA:
            size = int.from_bytes(content[at + 2 : at + 4], "big")
            if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
                return _tagged(content[at + 10 : at + 2 + size])
            at += 2 + max(size, 2)
    elif content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= end:
            size = int.from_bytes(content[at : at + 4], "big")
            if content[at + 4 : at + 8] == b"eXIf":
                return _tagged(content[at + 8 : at + 8 + size])
            at += 12 + size
    elif content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        at = 12
        while at + 8 <= end:
            size = int.from_bytes(content[at + 4 : at + 8], "little")
            if content[at : at + 4] == b"EXIF":
                return _tagged(content[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return 1


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """Stored pixels as they are to be seen. From 5 on rows are stored as columns; then rows and columns may run backwards."""
    if turn >= 5:
        pixels = pixels.swapaxes(0, 1)
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(id, width, height, rgba) of PNG, JPEG and other files that Spark's image source decodes, upright; others are left out.

    The source does not show orientation tags, so they are read from the files' bytes.
    """

    @F.pandas_udf("int")
    def tagged(content: pd.Series) -> pd.Series:
        return content.map(orientation)


    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for origin, width, height, channels, data, turn in batch.itertuples(index=False):
                raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                out = np.full((height, width, 4), 255, np.uint8)
                out[..., :3] = raw[..., [2, 1, 0]] if channels >= 3 else raw[..., [0, 0, 0]]  # the source gives blue first
                if channels == 4:
                    out[..., 3] = raw[..., 3]
                out = np.ascontiguousarray(upright(out, turn))
                rows.append((origin, out.shape[1], out.shape[0], out.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "width", "height", "rgba"])

    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.width", "image.height", "image.nChannels", "image.data")
    files = spark.read.format("binaryFile").load(path).select(_place(F.col("path")).alias("_place"), tagged("content").alias("_turn"))
    image = image.join(files, _place(F.col("origin")) == F.col("_place"), "left").drop("_place").withColumn("_turn", F.coalesce("_turn", F.lit(1)))
    return image.mapInPandas(turn, "id string, width int, height int, rgba binary")
