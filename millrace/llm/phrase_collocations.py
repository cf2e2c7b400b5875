"""Phrases whose words stand together more often than chance has them do.

Every text is cut into pieces at punctuation and line ends, every piece into
words. All phrases of 1 to ``max_n`` words become rows, which are counted for
each language. A candidate's counts meet the counts of its two parts at every
cut (both parts are at least as frequent as the candidate, so the rows below the
least count are not needed), the score is exact decimal arithmetic, candidates
that a one-word longer candidate explains go by an anti join, and a window ranks
each language's rest.

Tasks count the phrases of some megabytes of text before the rows are shuffled;
the words of a chunk are numbered, so that phrases are counted as integers and
only different ones are spelled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_WORDS = 3
LEAST_COUNT = 10
#: A candidate goes when a longer one has at least this share of its occurrences, in percent.
EXPLAINED_PERCENT = 50
MOST_RANKS = 2000
UNKNOWN = "und"
BREAKS = "[.,;:!?\n-\r]"
#: Characters whose phrases are counted together before they are emitted.
CHUNK_CHARS = 4_000_000
#: Words of a chunk whose phrases are made at once.
BLOCK_WORDS = 500_000

def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the piece and the text that each stands in."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), BREAKS)
    split = pc.split_pattern_regex(pc.list_flatten(pieces), "[ \t]+")
    words = pc.list_flatten(split)
    full = pc.greater(pc.binary_length(words), 0)
    piece = pc.list_parent_indices(split).filter(full).to_numpy(zero_copy_only=False)
    text_of_piece = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
    return words.filter(full), piece, text_of_piece[piece]


def _counted(key: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First positions of the different (key, code) pairs, their counts, and each row's pair number."""
    joint = key * (int(code.max(initial=0)) + 1) + code
    _, first, number, n = np.unique(joint, return_index=True, return_inverse=True, return_counts=True)
    return first, n, number


def _phrase_rows(texts: pa.Array, langs: pa.Array, max_n: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of some texts, for each language; the empty phrase counts the words."""
    words, piece, text = _words(texts)
    lang = langs.dictionary_encode()
    lang_of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
    spelled = words.dictionary_encode()
    code = spelled.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    totals = np.bincount(lang_of, minlength=len(lang.dictionary))
    some = np.flatnonzero(totals)
    yield _keyed(lang.dictionary.take(pa.array(some)), [pa.array([""] * len(some), pa.string())], totals[some])
    for at in range(0, len(code), BLOCK_WORDS):
        stop = min(at + BLOCK_WORDS, len(code))
        number = lang_of[at:stop]  # of the phrase that begins at each word, grown word by word
        begin = np.arange(at, stop)
        for n in range(1, max_n + 1):
            whole = begin + n - 1 < len(code)
            begin, number = begin[whole], number[whole]
            whole = piece[begin] == piece[begin + n - 1]
            begin, number = begin[whole], number[whole]
            if not len(begin):
                break
            first, count, number = _counted(number, code[begin + n - 1])
            heads = begin[first]
            parts = [spelled.dictionary.take(pa.array(code[heads + k])) for k in range(n)]
            yield _keyed(lang.dictionary.take(pa.array(lang_of[heads])), parts, count)


def _keyed(lang: pa.Array, words: list[pa.Array], count: np.ndarray) -> pa.RecordBatch:
    """Language and phrase as one key: there are very many rows, and one short column is shuffled in fewer bytes than two."""
    phrase = pc.binary_join_element_wise(*words, " ") if len(words) > 1 else words[0]
    return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(lang, phrase, "\n"), pa.array(count, pa.int64())], names=["key", "f"])


def phrase_counts(docs: DataFrame, max_n: int = MAX_WORDS, least: int = 1, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to ``max_n`` words that occur ``least`` times in a language.

    The empty phrase has the number of all words of the language, whatever
    ``least`` is. A null text is empty, a null language ``und``; an empty table,
    or one without words, gives no rows. Repeated rows count each. Texts of any
    length are read whole, ``BLOCK_WORDS`` words at a time.
    """
    common.bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= CHUNK_CHARS:
                yield from chunk(held)
                held, size = [], 0
        if held:
            yield from chunk(held)

    def chunk(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        for texts, langs in zip(table.column("text").chunks, table.column("lang").chunks, strict=True):
            yield from _phrase_rows(texts, langs, max_n)

    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(count, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    if least > 1:
        counted = counted.where((F.col("f") >= least) | F.endswith("key", F.lit("\n")))
    phrase = F.substring_index("key", "\n", -1)  # no word has a line end, a language may
    return counted.select(F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "f")


def _score() -> F.Column:
    """floor(1000000 * a * a / (l * r)); the numerator has up to 38 digits."""
    a, l, r = (f"cast({c} AS decimal(18,0))" for c in "alr")
    return F.expr(f"(cast(1000000 AS decimal(7,0)) * ({a} * {a})) div ({l} * {r})")


def _words_of(phrase: str, first: F.Column | int, length: F.Column | int) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, length), " ")


def collocations(docs: DataFrame, max_n: int = MAX_WORDS, least: int = LEAST_COUNT, explained_percent: int = EXPLAINED_PERCENT, most: int = MOST_RANKS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` highest-scoring phrases of 2 to ``max_n`` words.

    ``docs`` needs columns text and lang; others are ignored. Ties in score go to
    the more frequent phrase, then to the first in byte order. Counts up to
    10^15 are exact. Nulls, empty tables, repeated rows and long texts are as in
    ``phrase_counts``; a language without candidates gives no rows.
    """
    counts = common.stored(phrase_counts(common.plain(docs, "text", "lang"), max_n, least), "phrases")
    sizes = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    counts = counts.where("phrase <> ''")
    candidates = counts.where(F.contains("phrase", F.lit(" "))).withColumnRenamed("f", "a")

    n_words = F.size(F.split("phrase", " "))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), n_words - 1)))
    cut = cut.withColumns({"head": _words_of("phrase", 1, F.col("k")), "rest": _words_of("phrase", F.col("k") + 1, n_words - F.col("k"))})
    cut = cut.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_score().alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")

    # a phrase two words longer that explains a candidate does so through the one between them
    longer = candidates.where(n_words > 2)
    inner = F.explode(F.array(_words_of("phrase", 1, n_words - 1), _words_of("phrase", 2, n_words - 1)))
    explained = longer.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    same = (F.col("s.lang") == F.col("e.lang")) & (F.col("s.phrase") == F.col("e.phrase")) & (F.col("e.longer") * 100 >= F.col("s.a") * explained_percent)
    kept = scored.alias("s").join(explained.alias("e"), same, "left_anti")

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``collocations`` of all documents, with the parameters at the top of this module."""
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM listed GROUP BY lang),
phrases AS (
  SELECT lang, unnest(w) AS phrase FROM listed
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM listed
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM listed),
counts AS (SELECT lang, phrase, count(*) AS f FROM phrases GROUP BY ALL HAVING count(*) >= 10),
candidates AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE contains(phrase, ' ')),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE len(w) = 3
  UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE len(w) = 3),
kept AS (SELECT * FROM lowest x WHERE NOT EXISTS (SELECT 1 FROM longer y WHERE y.lang = x.lang AND y.phrase = x.phrase AND 100 * y.a >= 50 * x.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, s.n, r.score FROM ranked r JOIN sizes s USING (lang) WHERE r.rank <= 2000
"""
