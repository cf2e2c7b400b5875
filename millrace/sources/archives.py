"""Archives as tables: every entry of every ZIP file a row, checked more strictly than the library does."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """The sizes an archive may have."""

    archive_bytes: int = 80 * 1024 * 1024
    entries: int = 512
    entry_bytes: int = 24 * 1024 * 1024
    total_bytes: int = 160 * 1024 * 1024


class BadArchive(ValueError):
    pass


def _unsafe(path: str) -> bool:
    parts = path.removesuffix("/").split("/")
    return bool(not path or "\\" in path or re.match(r"[a-zA-Z]:", path) or re.search(r"[\x00-\x1f\x7f]", path) or any(p in ("", ".", "..") for p in parts))


def _local_header_agrees(data: bytes, info: zipfile.ZipInfo) -> bool:
    at = info.header_offset
    if data[at : at + 4] != b"PK\x03\x04":
        return False
    method, name_length = struct.unpack_from("<H", data, at + 8)[0], struct.unpack_from("<H", data, at + 26)[0]
    raw = info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437")
    return method == info.compress_type and data[at + 30 : at + 30 + name_length] == raw


def read_entries(data: bytes, limits: Limits = Limits()) -> dict[str, bytes]:
    """Stored and deflated entries of a plain single-disk archive; anything else is an error.

    Refused: sizes beyond the limits, other methods, encryption, ZIP64, several
    disks, unsafe or repeated paths, headers that disagree, wrong checksums.
    """
    if len(data) > limits.archive_bytes:
        raise BadArchive("archive exceeds size limit")
    end = data.rfind(b"PK\x05\x06", max(0, len(data) - 65557))
    if end < 0 or end + 22 > len(data) or end + 22 + struct.unpack_from("<H", data, end + 20)[0] != len(data):
        raise BadArchive("end-of-central-directory record missing")
    disk, start_disk, here, count, size, offset = struct.unpack_from("<HHHHII", data, end + 4)
    if disk or start_disk or here != count:
        raise BadArchive("multi-disk archive is unsupported")
    if count == 0xFFFF or 0xFFFFFFFF in (size, offset):
        raise BadArchive("ZIP64 is unsupported")
    if count > limits.entries:
        raise BadArchive("too many entries")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, NotImplementedError, UnicodeDecodeError) as error:
        raise BadArchive(str(error)) from error
    out: dict[str, bytes] = {}
    total = 0
    for info in archive.infolist():
        name = info.orig_filename
        if not info.flag_bits & 0x800 and not name.isascii():  # names are UTF-8 whatever the flag says
            try:
                name = name.encode("cp437").decode("utf-8")
            except UnicodeError as error:
                raise BadArchive("entry name is not UTF-8") from error
        if _unsafe(name):
            raise BadArchive(f"unsafe entry path {name!r}")
        if name.endswith("/"):
            continue
        if name in out:
            raise BadArchive(f"duplicate entry {name}")
        if info.flag_bits & 0x41:
            raise BadArchive("encrypted entries are unsupported")
        if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise BadArchive(f"compression method {info.compress_type} is unsupported")
        total += info.file_size
        if info.file_size > limits.entry_bytes or total > limits.total_bytes:
            raise BadArchive("uncompressed size limit exceeded")
        if info.file_size > 1 << 20 and info.compress_size * 400 < info.file_size:
            raise BadArchive("compression ratio limit exceeded")
        if not _local_header_agrees(data, info):
            raise BadArchive("local header disagrees")
        try:
            out[name] = archive.read(info)
        except (zipfile.BadZipFile, zlib.error, EOFError) as error:
            raise BadArchive(f"checksum or size mismatch for {name}") from error
        if len(out[name]) != info.file_size:
            raise BadArchive(f"checksum or size mismatch for {name}")
    return out


ENTRY_SCHEMA = "archive string, path string, content binary, problem string"


def archive_entries(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """(archive, path, content, problem) of all archives under a path.

    A bad archive is one row with its problem and no content; archives beyond the
    limit are told by their length and their bytes never read.
    """
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > limits.archive_bytes).select(
        F.col("path").alias("archive"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("content"), F.lit("archive exceeds size limit").alias("problem")
    )

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(archive, name, data, None) for name, data in read_entries(bytes(content), limits).items()]
                except BadArchive as error:
                    rows = [(archive, None, None, str(error))]
                yield pd.DataFrame(rows, columns=["archive", "path", "content", "problem"])

    small = files.where(F.col("length") <= limits.archive_bytes).select("path", "content")
    return small.mapInPandas(expand, ENTRY_SCHEMA).unionByName(large)


def write_stored(entries: list[tuple[str, bytes]], limits: Limits = Limits()) -> bytes:
    """A small archive of uncompressed entries, read back before it is given out."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as archive:
        for name, content in entries:
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
    data = buffer.getvalue()
    if read_entries(data, limits) != dict(entries):
        raise BadArchive("the archive does not read back")
    return data
