"""Periodic runs of words, by the runs theorem.

Every run (a stretch whose smallest period q fits at least twice, extended as far
as the period holds) contains the longest Lyndon word that begins at some of its
positions, under one of two orders of the words: the order and its reverse. That
word is the run's root and its length the period. So two candidates a position
give all runs:

* the texts of a batch are laid in one array, each closed by a mark of its own
  that is smaller than its words; no comparison leaves a text;
* the suffix array comes by prefix doubling, where only suffixes that still tie
  are sorted again; the ranks of each round give the LCP array;
* the next smaller value of the inverse suffix array ends the longest Lyndon word
  under the order, the next greater value the one under the reverse;
* roots are extended by the longest common extension, a range minimum of the LCP
  array from a sparse table: to the right in the texts, to the left in the
  reversed texts. Only roots that the right side lets reach the least exponent
  are extended to the left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Words laid in one array; a longer text makes an array alone. An array needs
#: some 150 bytes a word, and up to 400 where the text is periodic throughout.
BATCH_WORDS = 250_000

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _doubled(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for h = 1, 2, 4, ... ranks that are equal where the first h symbols are."""
    n = len(symbols)
    suffixes = np.argsort(symbols)
    key = symbols[suffixes]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int32)
    rank[suffixes] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rounds, h = [rank], 1
    slots = np.arange(n)
    while True:
        alone = new & np.r_[new[1:], True]
        slots = slots[~alone]  # what still ties, group after group
        if not len(slots):
            return suffixes, rounds
        tied = suffixes[slots]
        key = rank[tied].astype(np.int64) * n + rank[tied + h]
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        suffixes[slots] = tied
        new = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[tied] = np.maximum.accumulate(np.where(new, slots, 0))
        rounds.append(rank)
        h *= 2


def _lcp(suffixes: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Entry i: the symbols that suffixes i - 1 and i of the array have in common."""
    lcp = np.zeros(len(suffixes), np.int32)
    at = 1 + np.flatnonzero(rounds[0][suffixes[1:]] == rounds[0][suffixes[:-1]])
    if len(at):
        x, y = suffixes[at - 1].copy(), suffixes[at].copy()
        for k in range(len(rounds) - 1, -1, -1):
            step = np.where(rounds[k][x] == rounds[k][y], 1 << k, 0)
            x += step
            y += step
        lcp[at] = y - suffixes[at]
    return lcp


class _SparseTable:
    """Minima of ranges whose lengths are powers of two, for ranges of up to ``widest`` entries."""

    def __init__(self, values: np.ndarray, widest: int):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= min(widest, len(values)):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def minimum(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the entries begin .. end - 1 of each non-empty range."""
        out = np.empty(len(begin), self.levels[0].dtype)
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(self.levels[k][begin[some]], self.levels[k][end[some] - (1 << k)])
        return out

    def next_smaller(self, values: np.ndarray) -> np.ndarray:
        """For each entry the next position with a smaller value; the number of entries where there is none in reach."""
        n = len(values)
        at = np.arange(1, n + 1)
        for k in range(len(self.levels) - 1, -1, -1):
            block = self.levels[k]
            inside = at < len(block)
            clear = np.zeros(n, bool)
            clear[inside] = block[at[inside]] > values[inside]
            at += clear.astype(np.int64) << k
        return at


class _Extensions:
    """Longest common extensions to the right of two positions, by range minima of the LCP array."""

    def __init__(self, symbols: np.ndarray):
        self.suffixes, rounds = _doubled(symbols)
        self.inverse = np.empty(len(symbols), np.int32)
        self.inverse[self.suffixes] = np.arange(len(symbols), dtype=np.int32)
        self.lcp = _lcp(self.suffixes, rounds)

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.inverse[x], self.inverse[y]), np.maximum(self.inverse[x], self.inverse[y])
        if not len(low):
            return np.empty(0, np.int64)
        return _SparseTable(self.lcp, int((high - low).max())).minimum(low + 1, high + 1).astype(np.int64)


def _lyndon_ends(inverse: np.ndarray, longest: int) -> list[np.ndarray]:
    """Where the longest Lyndon word that begins at each position ends, under the order and under its reverse."""
    return [_SparseTable(v, longest).next_smaller(v) for v in (inverse, -inverse)]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, from 1."""
    numbers: dict[bytes, int] = {}
    following = count(1)
    return np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(following)) for w in words), np.int64, len(words))


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One array of all texts, each closed by a mark that is its smallest symbol; and where each text begins."""
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    base = np.cumsum([0, *[int(t.max(initial=0)) + 1 for t in texts]])[:-1]
    symbols = np.repeat(base, sizes)
    body = np.ones(int(sizes.sum()), bool)
    body[begins + sizes - 1] = False
    symbols[body] += np.concatenate(texts)
    return symbols, begins


def find_runs(texts: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """The runs of each text of words numbered from 1: rows (start, length, period), by start and period.

    ``min_exponent`` is 2 at least. No words give no runs.
    """
    none = np.empty((0, 3), np.int64)
    if not texts or not any(len(t) for t in texts):
        return [none] * len(texts)
    symbols, begins = _laid(texts)
    forward = _Extensions(symbols)
    longest = max(map(len, texts)) + 1
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    found = []
    for end in _lyndon_ends(forward.inverse, longest):
        # a run's first root is followed by the same symbol again
        at = np.flatnonzero((end < len(symbols)) & (symbols == symbols[np.minimum(end, len(symbols) - 1)]))
        found.append(at * len(symbols) + end[at] - at)
    begin, period = np.divmod(np.unique(np.concatenate(found)), len(symbols))
    right = forward.of(begin, begin + period)
    # the first root begins less than a period after the run: what follows it is over (exponent - 2) periods
    enough = right > (min_exponent - 2) * period
    begin, period, right = begin[enough], period[enough], right[enough]
    if not len(begin):
        return [none] * len(texts)

    members, owner = np.unique(text[begin], return_inverse=True)
    turned, turned_begins = _laid([texts[t][::-1] for t in members])
    ends = turned_begins + np.array([len(texts[t]) for t in members])  # of the reversed texts, at their marks
    start = begin - begins[text[begin]]
    mirror = ends[owner] - start  # of the symbol before the root, or the mark where the root begins the text
    inner = start > 0
    left = np.zeros(len(begin), np.int64)
    # the symbol before position i of a text of n words stands at n - i of the reversed text
    left[inner] = _Extensions(turned).of(mirror[inner], mirror[inner] - period[inner])
    runs = np.stack([owner, start - left, period + left + right, period], axis=1)
    runs = np.unique(runs[(runs[:, 2] >= min_exponent * runs[:, 3]) & (runs[:, 2] >= min_length)][:, [0, 1, 3, 2]], axis=0)
    out = [none] * len(texts)
    for k, t in enumerate(members):
        out[t] = runs[runs[:, 0] == k][:, [1, 3, 2]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for each of n words that no run contains after the run's first period."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turns, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(turns[:n]) == 0


def with_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Add ``runs`` (start, length, period; by start, then period) and ``collapsed``, the words left when every run
    keeps its first period, joined by one space.

    Words are runs of characters other than ASCII white space. A null text has no
    words: no runs and an empty ``collapsed``; so has an empty one. Repeated rows
    give repeated results, an empty table an empty one. Texts are read whole; a
    very long one is laid in an array alone. Columns of these two names are
    replaced, all others kept.
    """
    common.bound_batches(docs.sparkSession)

    @F.pandas_udf(f"runs {_RUNS}, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            held: list[list[bytes]] = []
            laid = 0
            for body in batch:
                held.append((body or "").encode("utf-8").split())
                laid += len(held[-1])
                if laid >= BATCH_WORDS:
                    out += collapse(held)
                    held, laid = [], 0
            yield pd.DataFrame(out + collapse(held), columns=["runs", "collapsed"])

    def collapse(held: list[list[bytes]]) -> list[tuple]:
        out = []
        for words, runs in zip(held, find_runs([word_numbers(w) for w in held], min_length, min_exponent), strict=True):
            if len(runs):
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs))]
            named = [{"start": int(s), "length": int(n), "period": int(p)} for s, n, p in runs]
            out.append((named, b" ".join(words).decode("utf-8")))
        return out

    done = docs.drop("runs", "collapsed").withColumn("_found", found(F.col(f"`{text}`")))
    return done.withColumns({"runs": F.col("_found.runs"), "collapsed": F.col("_found.collapsed")}).drop("_found")


def planted(key: Column, text: Column) -> Column:
    """The text, but every tenth (by the crc32 of its key) made periodic from some word on; rows without a key stay."""
    h = F.crc32(key.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words)
    g = F.floor(h / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(turns, F.lit(1), n - a)), " ")).otherwise(text)


def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, as digests; null texts have no words, null ids plant nothing."""
    docs = common.plain(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    found = with_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))

    def tighter(best: Column, run: Column) -> Column:
        ahead, level = run["length"] * best["period"], best["length"] * run["period"]
        return F.when(best.isNull() | (ahead > level), run).otherwise(best)  # runs come by start, then period

    first = F.aggregate("runs", F.lit(None).cast(_RUNS[6:-1]), tighter)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


ORACLE_SQL = r"""
WITH hashed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(4294967295, list_reduce(
      list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda x, s: CASE WHEN s >= 0 THEN xor(x, s) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)) AS h
  FROM documents),
measured AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM hashed),
turned AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_concat(w[1:a], list_transform(range(n - a), lambda i: w[1 + a + i % (1 + (n - a) // (3 + (h // 10) % 8))]))
    ELSE w END AS w
  FROM measured),
words AS (SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM turned),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches t WHERE t.r = s.r AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
best AS (SELECT * FROM runs x QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DECIMAL(38, 0) * 1000000000000 // q DESC, start, q) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT t.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.length // b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.words, '')) AS collapsed_sha256
FROM turned t LEFT JOIN best b ON b.r = t.r LEFT JOIN listed l ON l.r = t.r LEFT JOIN kept k ON k.r = t.r
"""
