"""Quality rules by distribution: does a text use characters and words as its language does?

For each language a reference is made of all documents: the shares of the
character classes, and of the most common words with one share for all others.
A document's own shares are held against its language's reference by the
Jensen-Shannon distance (the square root of the divergence in bits: 0 alike, 1
nothing in common). A text too short for a histogram to say anything is not
judged by it. Plain base rules (length, repetition) come first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .phrase_collocations import UNKNOWN, phrase_counts

#: Languages that get a reference: those with most words. References are broadcast, so their number is bounded.
LANGUAGES = 64
COMMON_WORDS = 50
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A histogram of fewer characters or words than these is not judged.
MIN_JUDGED_CHARS = 400
MIN_JUDGED_WORDS = 50
MAX_CLASS_DISTANCE = 0.2
MAX_WORD_DISTANCE = 0.42
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
BLANKS = " \t\n\v\f\r"
CLASSES = ("lower", "upper", "letter", "digit", "punctuation", "symbol", "other")
#: Code points classified at once.
BLOCK_CHARS = 1_000_000

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?", b"abcdefghijklmnopqrstuvwxyz      ")
_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, ref string, words array<long>"
_class_of: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """The class of every code point; blanks are one past the last class."""
    global _class_of
    if _class_of is None:
        kinds = {"Ll": 0, "Lu": 1, "Nd": 3}
        letters = {"Lt", "Lm", "Lo"}
        other = CLASSES.index("other")
        categories = map(unicodedata.category, map(chr, range(0x110000)))
        _class_of = np.fromiter((kinds.get(c, 2 if c in letters else other) for c in categories), np.uint8, 0x110000)
        for chars, kind in ((PUNCTUATION, 4), (SYMBOLS, 5), (BLANKS, len(CLASSES))):
            _class_of[[ord(c) for c in chars]] = kind
    return _class_of


def class_counts(text: str) -> np.ndarray:
    """How many characters of each class a text has; blanks are not counted."""
    counts = np.zeros(len(CLASSES) + 1, np.int64)
    for at in range(0, len(text), BLOCK_CHARS):
        points = np.frombuffer(text[at : at + BLOCK_CHARS].encode("utf-32-le"), np.uint32)
        counts += np.bincount(_class_table()[points], minlength=len(counts))
    return counts[:-1]


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of ``width`` words which the text has more than once."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    window = codes[:n]
    for k in range(1, width):
        _, window, copies = np.unique(window * len(numbers) + codes[k : k + n], return_inverse=True, return_counts=True)
    twice = copies[window] > 1
    turns = np.zeros(len(words) + 1, np.int64)
    turns[:n] += twice
    turns[width : width + n] -= twice
    return int(np.count_nonzero(np.cumsum(turns)[:-1]))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def common_words(docs: DataFrame, languages: int = LANGUAGES, most: int = COMMON_WORDS) -> dict[str, list[str]]:
    """The most frequent words of the ``languages`` languages with most words; A-Z are lower-cased.

    All documents count. Ties go to the first in byte order. Documents without a
    language are one, ``und``, only where there is no other. At most ``languages``
    times ``most`` words reach the driver.
    """
    counts = common.stored(phrase_counts(common.plain(docs, "text", "lang"), 1), "words")
    largest = counts.where("phrase = ''").orderBy(F.col("lang") == UNKNOWN, F.desc("f"), "lang").limit(languages).select("lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("f"), "phrase"))
    best = counts.where("phrase <> ''").join(F.broadcast(largest), "lang").withColumn("rank", rank).where(F.col("rank") <= most)
    found: dict[str, list[str]] = {}
    for row in best.orderBy("lang", "rank").collect():
        found.setdefault(row["lang"], []).append(row["phrase"])
    if len(found) > 1:
        found.pop(UNKNOWN, None)
    return found


def measured(docs: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Add the base measures, the two histograms and ``ref``, the language they are to be held against.

    That is the document's language where ``words`` knows it, else the one whose
    common words cover most of the text (ties: the first name), else null. The
    last entry of ``words`` counts the other words. A null text is empty.
    """
    common.bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf(_MEASURES)
    def measure(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        places = {k: {w.encode("utf-8"): i for i, w in enumerate(v)} for k, v in sorted(shipped.value.items())}
        for texts, langs in batches:
            yield pd.DataFrame([_measures(t or "", g, places) for t, g in zip(texts, langs, strict=True)], columns=[m.split()[0] for m in _MEASURES.split(", ")])

    return docs.withColumn("_m", measure(F.col("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)))).select("*", "_m.*").drop("_m")


def _measures(text: str, lang: str, places: dict[str, dict[bytes, int]]) -> tuple:
    data = text.encode("utf-8")
    words = data.split()
    kinds = class_counts(text)
    folded = data.translate(_FOLD).split()
    ref = lang if lang in places else max(places, key=lambda g: sum(w in places[g] for w in folded), default=None)
    known = places.get(ref, {})
    hits = np.bincount([known.get(w, len(known)) for w in folded], minlength=len(known) + 1)
    return (len(words), int(kinds.sum()), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeated_window_words(words), kinds.tolist(), ref, hits.tolist())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / total)


def references(rows: DataFrame) -> DataFrame:
    """(ref, ref_classes, ref_words): mean shares over the different texts that pass the rules.

    ``rows`` are measured rows with a column ``same`` that is equal for equal
    texts: copies count once, so that a text with very many does not become the
    reference. A first reference is made of what passes the base rules, the
    second of what the first one lets pass.
    """
    rows = rows.dropDuplicates(["ref", "same"])
    first = _mean_shares(rows.where(~base_failed()))
    return _mean_shares(judged(rows, first).where("kept").select(*rows.columns))


def _mean_shares(base: DataFrame) -> DataFrame:
    base = base.where(F.col("ref").isNotNull())
    long = base.select("ref", F.explode(F.array(F.struct(F.lit("c").alias("kind"), _shares("classes").alias("p")), F.struct(F.lit("w").alias("kind"), _shares("words").alias("p")))).alias("h"))
    mean = long.select("ref", "h.kind", F.posexplode("h.p").alias("at", "share")).groupBy("ref", "kind", "at").agg(F.avg("share").alias("share"))
    listed = mean.groupBy("ref").pivot("kind", ["c", "w"]).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "share"))), lambda x: x["share"]))
    return listed.withColumnsRenamed({"c": "ref_classes", "w": "ref_words"})


def _bits(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two lists of shares, to nine digits."""
    parts = F.zip_with(shares, reference, lambda p, q: (_bits(p, (p + q) / 2) + _bits(q, (p + q) / 2)) / 2)
    return F.round(F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))), 9)


def judged(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """Add ``base_failed``, both distances (null where not judged) and ``kept``."""
    held = rows.join(F.broadcast(refs), "ref", "left")
    n_counted = F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x)
    held = held.withColumns(
        {
            "base_failed": base_failed(),
            "class_distance": F.when((F.col("word_chars") >= MIN_JUDGED_CHARS) & F.col("ref_classes").isNotNull(), distance(_shares("classes"), F.col("ref_classes"))),
            "word_distance": F.when((n_counted >= MIN_JUDGED_WORDS) & F.col("ref_words").isNotNull(), distance(_shares("words"), F.col("ref_words"))),
        }
    )
    far = F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return held.withColumn("kept", ~F.col("base_failed") & ~far)


def with_rules(docs: DataFrame) -> DataFrame:
    """Each document with its measures, ``base_failed``, both distances and ``kept``; the other columns stay.

    ``docs`` needs columns text and lang. A null text is empty and fails; a text
    whose language has no reference is held against the one it resembles. Where
    there are no references at all, only the base rules judge. Equal texts of one
    language are judged alike, repeated rows each, texts of any length whole.
    References come from these documents; an empty table gives none and no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), "text", "lang")
    named = common_words(rows)
    small = common.stored(measured(rows.select("text", "lang"), named).withColumn("same", F.md5(F.col("text").cast("binary"))).drop("text"), "measures")
    return judged(measured(rows, named), references(small)).drop("text", "lang", "classes", "words", "ref_classes", "ref_words")


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all documents; their measures are taken once, the texts go no further."""
    docs = common.plain(common.table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    rows = measured(docs, common_words(docs)).withColumn("same", F.md5(F.col("text").cast("binary"))).drop("text", "lang")
    rows = common.stored(rows, "measures")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    return judged(rows, references(rows)).select(*columns)


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, 'und') AS lang,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D.,;:!?]+') AS folded,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT r, unnest(range(len(w) - 2)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS three FROM docs),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, three) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY r),
counted AS (
  SELECT d.*, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
    [length(regexp_replace(text, c, '', 'g')) for c in ['[^\p{Ll}]', '[^\p{Lu}]', '[^\p{Lt}\p{Lm}\p{Lo}]', '[^\p{Nd}]', '[^.,;:!?''"()-]', '[^#*$%&|<>]']] AS six
  FROM docs d LEFT JOIN repeated p USING (r)),
based AS (
  SELECT *, list_append(six, word_chars - list_sum(six)::BIGINT) AS classes, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counted),
tokens AS (SELECT r, lang, unnest(folded) AS word FROM docs),
languages AS (SELECT lang, count(*) AS f FROM tokens WHERE lang <> 'und' OR NOT EXISTS (SELECT 1 FROM tokens WHERE lang <> 'und') GROUP BY lang ORDER BY f DESC, lang LIMIT 64),
frequent AS (SELECT lang, word, count(*) AS f FROM tokens SEMI JOIN languages USING (lang) GROUP BY ALL),
common AS (SELECT lang AS ref, word, row_number() OVER (PARTITION BY lang ORDER BY f DESC, word) AS slot FROM frequent QUALIFY slot <= 50),
covered AS (SELECT t.r, c.ref, count(*) AS f FROM tokens t JOIN common c USING (word) GROUP BY ALL),
chosen AS (
  SELECT d.r, l.lang AS ref FROM docs d, languages l LEFT JOIN covered c ON c.r = d.r AND c.ref = l.lang
  QUALIFY row_number() OVER (PARTITION BY d.r ORDER BY (l.lang = d.lang)::INT DESC, coalesce(c.f, 0) DESC, l.lang) = 1),
places AS (SELECT ref, slot FROM common UNION SELECT lang, 51 FROM languages),
hits AS (SELECT t.r, coalesce(c.slot, 51) AS slot, count(*) AS f FROM tokens t JOIN chosen x USING (r) LEFT JOIN common c ON c.ref = x.ref AND c.word = t.word GROUP BY ALL),
shares AS (
  SELECT x.r, x.ref, 'w' AS kind, p.slot, coalesce(h.f, 0) / len(d.folded) AS p, len(d.folded) >= 50 AS judged
  FROM chosen x JOIN docs d USING (r) JOIN places p ON p.ref = x.ref LEFT JOIN hits h ON h.r = x.r AND h.slot = p.slot WHERE len(d.folded) > 0
  UNION ALL SELECT x.r, x.ref, 'c', unnest(range(7)), unnest(b.classes) / b.word_chars, b.word_chars >= 400 FROM chosen x JOIN based b USING (r) WHERE b.word_chars > 0),
different AS (SELECT min(b.r) AS r FROM based b JOIN chosen x USING (r) WHERE NOT base_failed GROUP BY x.ref, b.text),
first AS (SELECT ref, kind, slot, avg(p) AS q FROM shares SEMI JOIN different USING (r) GROUP BY ALL),
far AS (
  SELECT s.r, s.kind, round(sqrt(greatest(sum(
    (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)), 9) AS distance
  FROM shares s JOIN first f USING (ref, kind, slot) WHERE judged GROUP BY ALL),
passing AS (SELECT r FROM different WHERE r NOT IN (SELECT r FROM far WHERE distance > CASE kind WHEN 'c' THEN 0.2 ELSE 0.42 END)),
second AS (SELECT ref, kind, slot, avg(p) AS q FROM shares SEMI JOIN passing USING (r) GROUP BY ALL),
judged AS (
  SELECT s.r, s.kind, round(sqrt(greatest(sum(
    (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)), 9) AS distance
  FROM shares s JOIN second f USING (ref, kind, slot) WHERE judged GROUP BY ALL)
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words, b.base_failed,
  NOT b.base_failed AND coalesce(c.distance, 0) <= 0.2 AND coalesce(w.distance, 0) <= 0.42 AS kept, c.distance AS class_distance, w.distance AS word_distance
FROM based b LEFT JOIN judged c ON c.r = b.r AND c.kind = 'c' LEFT JOIN judged w ON w.r = b.r AND w.kind = 'w'
"""
