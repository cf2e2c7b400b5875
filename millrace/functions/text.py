"""Text rules: markup, identifiers, paths, dates, searching."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches

#: Identifier patterns.
ID_PATTERN = r"^[a-z0-9][a-z0-9_-]{0,63}$"
UNIT_PATTERN = r"^[0-9]{1,12}$"
DAY_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DAY_OR_INSTANT_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z)?$"
STAMP_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,3})?(?:Z|[+-][0-9]{2}:[0-9]{2})$"
IMAGE_PATH_PATTERN = r"(?i)^[a-z0-9][a-z0-9_./-]*\.(?:png|jpe?g|webp)$"
#: The named references that are decoded.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}

_BLANK = r"(?U)^\s+|\s+$"


def trimmed(x: Column) -> Column:
    """Trimmed of all Unicode white space (``trim`` knows the blank only)."""
    return F.regexp_replace(x, _BLANK, "")


def has_text(x: Column, most: int) -> Column:
    """Text of at most so many characters that is not blank; null is none."""
    return F.coalesce((F.length(trimmed(x)) > 0) & (F.char_length(x) <= most), F.lit(False))


def matches(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(pattern), F.lit(False))


def is_day(x: Column) -> Column:
    """A calendar day; the pattern comes first, since words such as 'tomorrow' would parse."""
    return F.when(matches(x, DAY_PATTERN), F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).isNotNull()).otherwise(False)


def is_day_or_instant(x: Column) -> Column:
    return F.when(matches(x, DAY_OR_INSTANT_PATTERN), F.try_to_timestamp(x).isNotNull()).otherwise(False)


def stamp(x: Column) -> Column:
    """An instant with offset, else null; days that the calendar lacks are null, too."""
    t = trimmed(x)
    day = F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))
    return F.when(matches(t, STAMP_PATTERN) & day.isNotNull(), F.try_to_timestamp(t))


def is_https(x: Column) -> Column:
    return matches(x, r"(?i)^https://")


def safe_image_path(x: Column) -> Column:
    """A relative path of an image without empty, '.' or '..' parts."""
    bad = F.exists(F.split(x, "/"), lambda p: p.isin("", ".", ".."))
    return matches(x, IMAGE_PATH_PATTERN) & ~F.coalesce(bad, F.lit(True)) & (F.char_length(x) <= 500)


def safe_entry_path(x: Column) -> Column:
    """An archive entry's path: relative, without '.', '..', empty parts (but a closing '/'), backslash, drive or control characters."""
    parts = F.split(F.regexp_replace(x, "/$", ""), "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce((F.length(x) > 0) & ~bad & ~x.contains("\\") & ~x.rlike(r"^[a-zA-Z]:") & ~x.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def haystack_match(name: Column, traits: Column, term: str | None) -> Column:
    """The lower-cased term stands in the name and traits joined by blanks; a blank term matches all."""
    wanted = (term or "").strip().lower()
    return F.lit(True) if not wanted else F.contains(F.lower(F.concat_ws(" ", name, traits)), F.lit(wanted))


def without_tags(x: Column) -> Column:
    """Line breaks for <br>, no other tags."""
    return F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?\s*>", "\n"), r"<[^>]*>", "")


def _bound(x: Column, rule: Callable[[Column], Column]) -> Column:
    """A rule that names its argument several times, which is evaluated once."""
    return F.get(F.transform(F.array(x), rule), F.lit(0))


def _numeric_references(x: Column) -> Column:
    """Numeric references as characters; those of no character stay."""
    pattern = r"&#(?:[xX][0-9a-fA-F]+|[0-9]+);"

    def one(reference: Column) -> Column:
        base16, digits = F.substring(reference, 3, 1).isin("x", "X"), F.regexp_replace(reference, "^&#[xX]?0*|;$", "")
        short = F.length(digits).between(F.lit(1), F.when(base16, 6).otherwise(7))
        code = F.when(short, F.when(base16, F.conv(digits, 16, 10)).otherwise(digits).cast("int"))
        sound = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # a mark of the byte order in front, so that the character itself is not taken for one
        sign = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code), 8, "0"))), "UTF-32")
        return F.when(sound, sign).otherwise(reference)

    between, references = F.split(x, pattern, -1), F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, references, lambda a, r: F.concat(a, F.coalesce(one(r), F.lit("")))), "")


def _mapped(x: Column, rule: Callable[[str], str]) -> Column:
    """A text rule that Spark has no function for, on small Arrow batches; null stays null."""
    bound_batches(SparkSession.active())

    def batches(batch: pd.Series) -> pd.Series:
        return batch.map(rule, na_action="ignore")

    return F.pandas_udf(batches, T.StringType())(x)


def plain_text(x: Column) -> Column:
    """Markup to plain text: tags, six named references in one pass, then numeric ones, line ends, trim.

    Named references are decoded before numeric ones, so '&amp;#65;' becomes 'A',
    and each once, so '&amp;lt;' becomes '&lt;'. Null becomes empty. No text
    goes through Python.
    """

    def decoded(out: Column) -> Column:
        for name, sign in ENTITIES.items():  # '&' last: what it makes is not decoded again
            out = F.regexp_replace(out, f"(?i)&{name};", sign)
        return _bound(out, lambda o: F.when(F.contains(o, F.lit("&#")), _numeric_references(o)).otherwise(o))

    out = _bound(without_tags(F.coalesce(x, F.lit(""))), lambda o: F.when(F.contains(o, F.lit("&")), decoded(o)).otherwise(o))
    return trimmed(F.regexp_replace(out, "\r\n?", "\n"))


def _compatible(text: str) -> str:
    return unicodedata.normalize("NFKC", text)


def _spelled(x: Column, left_out: str) -> Column:
    # only what is not ASCII travels: a condition around a Python function does not keep the other texts from it
    folded = F.coalesce(_mapped(F.when(x.rlike(r"[^\x00-\x7f]"), x), _compatible), x)
    return F.lower(F.regexp_replace(F.coalesce(folded, F.lit("")), left_out, ""))


def ocr_line(x: Column) -> Column:
    """Compatibility form without white space, punctuation and symbols, lower case; ASCII stays in the JVM."""
    return _spelled(x, r"(?U)[\s\p{P}\p{S}]+")


def ocr_lines(x: Column) -> Column:
    """``ocr_line`` of each line of a text; the line ends stay."""
    return _spelled(x, r"(?U)[[\s\p{P}\p{S}]&&[^\n]]+")


def grid_position(x: Column, rows: int = 4, columns: int = 7) -> Column:
    """'row,column' as a struct; null and empty give null, other text null too (see ``bad_position``)."""
    at = F.regexp_extract(x, rf"^([1-{rows}]),([1-{columns}])$", 1)
    column = F.regexp_extract(x, rf"^([1-{rows}]),([1-{columns}])$", 2)
    return F.when(at != "", F.struct(at.cast("int").alias("row"), column.cast("int").alias("column")))


def bad_position(x: Column) -> Column:
    return F.coalesce((x != "") & grid_position(x).isNull(), F.lit(False))


def listed(x: Column, sign: str = ",") -> Column:
    """The non-empty parts of a list in one text, untrimmed."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), sign), lambda p: p != "")


def config_value(x: Column, name: str) -> Column:
    """The text assigned to a variable in a script."""
    return F.nullif(F.regexp_extract(x, rf"(?m)^\s*var {name}\s*=\s*['\"]([^'\"]+)['\"]", 1), F.lit(""))


def image_mime(content: Column, path: Column) -> Column:
    """The media type that both the first bytes and the extension show, else null."""
    kind = extension(path)
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A") & (kind == "png"), "image/png")
        .when(head.startswith("FFD8FF") & kind.isin("jpg", "jpeg"), "image/jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250") & (kind == "webp"), "image/webp")
    )


def initial(x: Column) -> Column:
    """The first character of a name, which stands for a missing picture; empty for none."""
    return F.left(F.coalesce(x, F.lit("")), F.lit(1))


def extension(path: Column) -> Column:
    """What follows the last dot of a path, in lower case; the whole path where it has none."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def without_prefix(x: Column, prefix: str) -> Column:
    """An id without the prefix of its kind; others stay."""
    return F.when(F.startswith(x, F.lit(prefix)), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)


def short_date(x: Column) -> Column:
    """Month/day hour:minute."""
    return F.date_format(x, "M/d HH:mm")


def composite_key(*parts: str) -> Column:
    return F.concat_ws("/", *parts)
