"""Matching without meeting all pairs: names in texts, hashes within a Hamming radius, nearest descriptors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, once
from .ordering import first_per_key, top_per_key

#: Names in one automaton, which is broadcast; more names take more passes over the texts.
NAMES_A_PASS = 200_000
HASH_BITS = 63
WORD_BITS = 64
#: Queries and rows that one task meets (about so many, they are dealt by a hash), and pairs of them it looks at in one step.
TILE_QUERIES, TILE_ROWS, TILE_PAIRS = 4096, 16_384, 1 << 22


def names_in_lines(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name_id) for every name that stands in a line of a text.

    ``docs``: doc_id, text, whose lines and the ``names`` (name_id, name) are in
    one spelling already. All names of a pass are looked for at once by an
    Aho-Corasick automaton, in one walk along each text. Null and empty texts and
    names match nothing; a name that several ids have is found for each of them;
    names do not reach over a line's end.
    """
    bound_batches(docs.sparkSession)
    known = names.where("name <> '' AND NOT contains(name, '\n')").select(F.col("name_id").cast("string").alias("name_id"), "name")
    passes = max(1, -(-known.count() // NAMES_A_PASS))
    id_type = names.schema["name_id"].dataType
    texts = docs.where("text <> ''").select("doc_id", "text")
    found = None
    for k in range(passes):
        part = known.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == k).groupBy("name").agg(F.collect_set("name_id").alias("ids"))
        held = docs.sparkSession.sparkContext.broadcast({r["name"]: list(r["ids"]) for r in part.collect()})
        ids = texts.withColumn("_ids", F.explode(_found(held)(F.col("text")))).select("doc_id", F.col("_ids").cast(id_type).alias("name_id"))
        found = ids if found is None else found.union(ids)
    return found


def _found(held):
    @F.pandas_udf("array<string>")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for name, ids in held.value.items():
            automaton.add_word(name, ids)
        if held.value:
            automaton.make_automaton()
        for batch in batches:
            yield pd.Series([sorted({i for _, ids in automaton.iter(text) for i in ids}) if held.value else [] for text in batch])

    return walk


def _ball(bits: int, radius: int) -> int:
    """Values within a Hamming radius of one of ``bits`` bits."""
    return sum(comb(bits, k) for k in range(min(bits, radius) + 1))


def _spans(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of blocks of nearly equal width."""
    edges = [i * bits // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def blocks_for(radius: int, rows: int, bits: int = HASH_BITS) -> int:
    """The number of blocks with least work for one query against ``rows`` hashes; 0 where meeting all is less.

    If two hashes differ in at most ``radius`` bits, one of m blocks differs in at
    most radius // m of them. A query asks for all values that near in each block.
    """
    cost = {0: float(rows)}
    for m in range(1, min(radius + 1, bits) + 1):
        near = radius // m
        balls = [_ball(width, near) / 2**width for _, width in _spans(bits, m)]
        probes = sum(_ball(width, near) for _, width in _spans(bits, m))
        if probes <= 10_000:
            cost[m] = probes + rows * sum(balls)
    return min(cost, key=lambda m: (cost[m], m))


def _block(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, near: int) -> list[int]:
    """Every way to change at most ``near`` of ``width`` bits."""
    return [sum(1 << i for i in chosen) for k in range(min(width, near) + 1) for chosen in combinations(range(width), k)]


def _around(value: Column, width: int, near: int) -> Column:
    """All values that differ from one in at most ``near`` of its ``width`` bits."""
    return F.transform(F.array(*[F.lit(f).cast("long") for f in _flips(width, near)]), lambda f: value.bitwiseXOR(f))


def within_hamming(queries: DataFrame, rows: DataFrame, radius: int, keys: list[str] = (), bits: int = HASH_BITS, blocks: int | None = None) -> DataFrame:
    """Pairs of ``queries`` and ``rows`` with equal ``keys`` whose hashes (``q_hash``, ``hash``) differ in at most
    ``radius`` bits, with their ``distance``. The frames share no column but the keys.

    A pair is met in the first block that is near enough, so once. Null hashes
    and keys meet nothing; equal rows meet each.
    """
    distance = F.bit_count(F.col("q_hash").bitwiseXOR(F.col("hash"))).cast("int")
    return candidates(queries, rows, radius, keys, bits, blocks).withColumn("distance", distance).where(F.col("distance") <= radius)


def candidates(queries: DataFrame, rows: DataFrame, radius: int, keys: list[str] = (), bits: int = HASH_BITS, blocks: int | None = None) -> DataFrame:
    """The pairs that ``within_hamming`` compares."""
    keys = list(keys)
    m = blocks_for(radius, rows.count(), bits) if blocks is None else blocks
    if not m:
        return queries.join(rows, keys) if keys else queries.join(rows, F.col("q_hash").isNotNull() & F.col("hash").isNotNull())
    near, spans = radius // m, _spans(bits, m)
    asked = F.array(*[F.struct(F.lit(i).alias("block"), _around(_block(F.col("q_hash"), s, w), w, near).alias("values")) for i, (s, w) in enumerate(spans)])
    asked = queries.where("q_hash IS NOT NULL").withColumn("_a", F.explode(asked)).withColumn("_value", F.explode("_a.values")).withColumn("_block", F.col("_a.block")).drop("_a")
    held = F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("hash"), s, w).alias("value")) for i, (s, w) in enumerate(spans)])
    held = rows.where("hash IS NOT NULL").withColumn("_h", F.explode(held)).withColumns({"_block": F.col("_h.block"), "_value": F.col("_h.value")}).drop("_h")
    met = asked.join(held, [*keys, "_block", "_value"])
    apart = F.col("q_hash").bitwiseXOR(F.col("hash"))
    earlier = F.lit(False)
    for i, (s, w) in enumerate(spans):
        earlier = earlier | ((F.col("_block") > i) & (F.bit_count(_block(apart, s, w)) <= near))
    return met.where(~earlier).drop("_block", "_value")


def _apart(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Bits in which each row of words of the one differs from each of the other."""
    out = np.zeros((len(asked), len(held)), np.int32)
    for k in range(asked.shape[1]):
        out += np.bitwise_count(asked[:, k, None] ^ held[None, :, k])
    return out


def _tile(count: int, query: str, tie: str, others: bool, columns: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What one task does: the ``count`` nearest rows of each query of a tile, ties by ``tie``, in blocks of TILE_PAIRS pairs."""

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame(columns=columns)
        held = held.sort_values(tie, kind="stable", ignore_index=True)
        words, wanted, n = np.stack(held["_words"].to_list()), np.stack(asked["_words"].to_list()), len(held)
        far, most, step, found = words.shape[1] * WORD_BITS + 1, min(count, n), max(1, TILE_PAIRS // n), []
        for begin in range(0, len(asked), step):
            part = asked.iloc[begin : begin + step]
            apart = _apart(wanted[begin : begin + step], words)
            if others:
                ends = [held[tie].searchsorted(part[query], side=side) for side in ("left", "right")]
                for i in np.flatnonzero(ends[0] < ends[1]):
                    apart[i, ends[0][i] : ends[1][i]] = far
            place = np.partition(apart * n + np.arange(n, dtype=np.int32), most - 1, axis=1)[:, :most].ravel()
            met = part.iloc[np.repeat(np.arange(len(part)), most)].assign(distance=place // n, **{tie: held[tie].to_numpy()[place % n]})
            met["_n"] = met["_n"].to_numpy() * held["_n"].to_numpy()[place % n]
            found.append(met[met["distance"] < far])
        return pd.concat(found)[columns]

    return meet


def _nearest(queries: DataFrame, rows: DataFrame, count: int, query: str, tie: str, keys: list[str], others: bool) -> DataFrame:
    """(keys, query, tie, distance, rank) of the ``count`` nearest ``rows`` of each query with equal ``keys``, by the bits of ``_words``, ties by ``tie``.

    With ``others`` a query's own id is not among them. Each query meets every row
    of its keys, but no pair is a row: queries and rows are dealt into tiles, and
    the task that a tile of both goes to gives on only the nearest ones. A tile's
    size is bounded, so memory is, whatever the groups' sizes; what is shuffled grows
    by the number of tiles of the other side. Equal rows beyond those that can
    be among the nearest are left out before, and equal rows and queries travel once.
    """
    sound = lambda frame, *ids: frame.dropna(subset=[*keys, *ids]).where("forall(_words, w -> w IS NOT NULL)")
    asked = sound(queries, query).groupBy(*keys, query, "_words").agg(F.count("*").alias("_n"))
    held = sound(rows, tie).groupBy(*keys, tie, "_words").agg(F.count("*").alias("_n"))
    held = top_per_key(held, [*keys, "_words"], count + 1, tie).drop("rank")
    asked, held = once(asked), once(held)  # read for their counts and for the tiles
    tiles = lambda frame, size, name: frame.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    tiles = once(tiles(asked, TILE_QUERIES, "_qs").join(tiles(held, TILE_ROWS, "_ts"), keys) if keys else tiles(asked, TILE_QUERIES, "_qs").crossJoin(tiles(held, TILE_ROWS, "_ts")))

    def dealt(frame: DataFrame, own: str, other: str, size: str, copies: str, by: list[str]) -> DataFrame:
        at = frame.join(tiles, keys) if keys else frame.crossJoin(tiles)
        at = at.withColumn(own, F.pmod(F.xxhash64(*by), F.col(size)).cast("int"))
        at = at.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop(size, copies)
        return at.select(*[F.col(c).alias(c) for c in at.columns])  # columns of its own: both sides have the keys of ``tiles``

    asked = dealt(asked, "_q", "_t", "_qs", "_ts", [query, "_words"])
    held = dealt(held, "_t", "_q", "_ts", "_qs", [tie, "_words"])
    types = [(c, asked.schema[c].dataType) for c in (*keys, query)] + [(tie, held.schema[tie].dataType)]
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in types) + ", distance int, _n long"
    at = [*keys, "_q", "_t"]
    meet = _tile(count, query, tie, others, [*keys, query, tie, "distance", "_n"])
    near = asked.groupBy(*at).cogroup(held.groupBy(*at)).applyInPandas(meet, schema)
    near = near.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(count)).cast("int"))))
    return top_per_key(near.drop("_n"), query if others else [*keys, query], count, "distance", tie)


def nearest_hashes(queries: DataFrame, rows: DataFrame, count: int, tie: str, query: str, keys: list[str] = ()) -> DataFrame:
    """(keys, query, tie, distance) of the ``count`` nearest ``rows`` (``hash``) of each query (``q_hash``) that is not the row itself
    (``query`` <> ``tie``), ties by ``tie``. Null hashes, ids and keys meet nothing; frames share no column but the keys.

    Hashes without structure have their nearest ones at a quarter of the bits and
    more, where looking hash blocks up saves nothing (see ``blocks_for``); so every row
    is met, in tiles (see ``_nearest``).
    """
    keys = list(keys)
    asked = queries.where("q_hash IS NOT NULL").select(*keys, query, F.array("q_hash").alias("_words"))
    held = rows.where("hash IS NOT NULL").select(*keys, tie, F.array("hash").alias("_words"))
    return _nearest(asked, held, count, query, tie, keys, others=True).drop("rank")


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)


def descriptor_pairs(queries: DataFrame, train: DataFrame, near: int, blocks: int) -> DataFrame:
    """(group, q, t, distance) of the descriptors of which one of ``blocks`` equal parts differs in at most ``near`` bits:
    all pairs that differ in fewer than ``blocks * (near + 1)`` bits are among them. A pair is met once."""
    width = WORD_BITS // 4
    part = lambda words, i: _block(F.get(words, F.lit(i // 4)), i % 4 * width, width)
    at = lambda words: F.array(*[part(F.col(words), i) for i in range(blocks)])
    asked = queries.withColumn("q_parts", at("q_words")).select("group", "q", "q_words", "q_parts", F.posexplode("q_parts").alias("_block", "_part"))
    asked = asked.withColumn("_part", F.explode(_around(F.col("_part"), width, near)))
    held = train.withColumn("t_parts", at("t_words")).select("group", "t", "t_words", "t_parts", F.posexplode("t_parts").alias("_block", "_part"))
    met = asked.join(held, ["group", "_block", "_part"])
    first = F.array_position(F.zip_with("q_parts", "t_parts", lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= near), True) - 1
    return met.where(first == F.col("_block")).select("group", "q", "t", _distance("q_words", "t_words").alias("distance"))


def nearest_descriptors(queries: DataFrame, train: DataFrame, most: int = 70, ratio: float = 0.75) -> DataFrame:
    """Nearest descriptors (group, q|t, words array<bigint>): near enough, clearly nearer than the second, each train row used once.

    Descriptors of one image pair (``group``) meet, in tiles (see ``_nearest``), all
    of one length; the first query in order keeps a train row. A descriptor that
    differs in more than ``most`` bits can be the second one, which no lookup by
    equal parts finds, so each query meets its whole group.
    """
    asked, held = (f.select("group", c, F.col(f"{c}_words").alias("_words")) for f, c in ((queries, "q"), (train, "t")))
    two = _nearest(asked, held, 2, "q", "t", ["group"], others=False)
    near = two.groupBy("group", "q").agg(F.array_sort(F.collect_list(F.struct("distance", "t"))).alias("near"))
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    good = near.where((F.size("near") == 2) & (first["distance"] <= most) & (first["distance"] < ratio * second["distance"]))
    return first_per_key(good.select("group", "q", first["t"].alias("t"), first["distance"].alias("distance")), ["group", "t"], "q")
