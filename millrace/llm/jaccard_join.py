"""Exact n-gram Jaccard join with set-relation skipping, and its link classes.

A text's set is its distinct word shingles. Sets with equal members are one
class; one set stands for each. Members are put in one global order, rarest
first (by a count over all documents), and a set is indexed under its first
members only: two sets that link share one of those.

Index level. A member's list is cut into blocks by set size, and entries carry
the member's position: an entry is held only against blocks whose sizes allow a
link, and only where the two positions do. Entries that no other of their block
can meet are not kept: most sets that share a first member by chance differ in
size, or share it too late. What is kept thus follows the near texts, also where
the order says little about rarity.

Answer level. Each set is compared with one leader, the set that most of its
lists name, and its difference to the leader is kept. What the followers of one
leader have in common follows from these differences alone: sets a and b differ
in |D_a| + |D_b| - 2 |D_a & D_b| members, so a's answer is the leader's answer,
changed by the few members in which they differ. Two followers can only link
beyond what the leader says if their differences share members, and those are
indexed within the leader's group like the sets were, rarest first. Sets already
joined are not compared again. Sets of different leaders that meet in a list are
held against each other's parity maps first, which grow with the sets, and then
member by member. A leader whose map is far from a set's is not followed.
The classes are those of all links.

``all_links`` is the join itself: every link between different sets, also within
a class. There the leaders' distances (the Jaccard distance is a metric) bound
each candidate pair's distance from both sides; what the bounds leave open is
compared. ``linked_documents`` counts each document's links and takes the classes
from them.

The global order comes from a million counters, whatever the size of the input:
where very many members share a counter it knows only the most frequent ones, and
lists of rarer members are longer. The links don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

#: Counters of the member counts behind the global order. More make the order
#: sharper; any number gives the same links.
COUNTER_BITS = 20
COUNTER_BLOCK = 4096
#: Tables of ids of at most so many rows are broadcast (below 200 MB with six columns, by what 220,000 rows took);
#: larger ones are joined by shuffle, with the same result.
BROADCAST_ROWS = 400_000
#: Followers of a leader that meet a copy of it in one place.
LED_ROWS = 2000
#: A set's 512-bit parity map: bit k says whether an odd number of its members fall on k. Two maps differ
#: in no more bits than their sets in members.
BIT_LANES = [f"bits{k}" for k in range(8)]

_GOLDEN, _MIX, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF) for k in range(64)]


#: Bytes hashed at once; longer texts are cut between two words.
BLOCK_BYTES = 1 << 20
_LENGTH = np.uint64(0x8CB92BA72F3D8DD7)
_EIGHT = 8  # bytes of a word that are hashed as one number


def _is_blank(data: np.ndarray) -> np.ndarray:
    """ASCII white space: a space, or a byte from tab to carriage return."""
    return (data == 0x20) | ((data - np.uint8(0x09)) < 5)


def _scattered(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes that are no ASCII white space.

    Every eight bytes of a word, with their place in it, are scattered by a map
    that is not linear, and these numbers are added: words of up to eight bytes
    and one length have different hashes, others share one by chance only.
    """
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _is_blank(data)
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = turns[0::2], turns[1::2]
    if not len(begin):
        return np.empty(0, np.uint64)
    parts = (end - begin + _EIGHT - 1) // _EIGHT
    first = np.cumsum(parts) - parts
    place = np.arange(int(parts.sum())) - np.repeat(first, parts)
    at = np.repeat(begin, parts) + place * _EIGHT
    used = np.minimum(np.repeat(end, parts) - at, _EIGHT).astype(np.uint64)
    eights = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(_EIGHT, np.uint8)]).tobytes(), strides=(1,))
    number = eights[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - used * np.uint64(8)))
    h = np.add.reduceat(_scattered(number + place.astype(np.uint64) * _GOLDEN), first)
    return _scattered(h + (end - begin).astype(np.uint64) * _LENGTH)


def _words(text: bytes) -> np.ndarray:
    """Hashes of the words, A-Z as a-z."""
    data, parts, at = np.frombuffer(text.lower(), np.uint8), [], 0
    while len(data) - at > BLOCK_BYTES:
        tail = data[at + BLOCK_BYTES :]
        stop = at + BLOCK_BYTES + next((k + int(np.argmax(_is_blank(tail[k : k + 4096]))) for k in range(0, len(tail), 4096) if _is_blank(tail[k : k + 4096]).any()), len(tail))
        parts.append(_word_hashes(data[at:stop]))
        at = stop
    return np.concatenate([*parts, _word_hashes(data[at:])])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer
    words than ``width`` has its whole sequence as one shingle; without words, none.
    """
    h = _words((text or "").encode("utf-8"))
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    span = min(width, n)
    mixed = h[: n - span + 1] ^ _SEEDS[span]
    for k in range(1, span):
        mixed = (mixed * _GOLDEN) ^ h[k : n - span + 1 + k]
        mixed ^= mixed >> np.uint64(29)
    members = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    members.sort()
    return members[np.r_[True, members[1:] != members[:-1]]]


class Threshold:
    """Jaccard >= up/down, kept in whole numbers."""

    def __init__(self, up: int, down: int):
        self.up, self.down = up, down
        self.distance = 1.0 - up / down

    def prefix(self, size: int) -> int:
        """Members under which a set of this size is indexed: size - ceil(t * size) + 1."""
        return size - -(-self.up * size // self.down) + 1

    def overlap(self, sizes: Column) -> Column:
        """Least intersection of a linked pair whose sizes sum to ``sizes``."""
        return F.ceil(sizes * self.up / (self.up + self.down) - 1e-9)

    def size_block(self, size: Column) -> Column:
        """Blocks of sizes; sets that link lie in the same or in neighbouring blocks."""
        return F.floor(F.log(size.cast("double")) / float(np.log(self.down / self.up)) + 1e-9).cast("int")

    def may_link(self, n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
        """Sizes and positions of a first shared member allow a link."""
        return (
            (n1 * self.down >= n2 * self.up)
            & (n2 * self.down >= n1 * self.up)
            & (p1 + p2 <= n1 + n2 - 2 * self.overlap(n1 + n2))
        )


    def excess(self, n: Column, pos: Column) -> Column:
        """Two entries' positions allow a link only if these numbers of theirs add up to no more than 0 (see ``may_link``)."""
        return pos * (self.up + self.down) - n * (self.down - self.up)

    def apart_allows(self, apart: Column, sizes: Column) -> Column:
        """Linked sets may differ in so many members."""
        return apart * (self.up + self.down) <= sizes * (self.down - self.up)

    def bits_allow(self, sizes: Column) -> Column:
        """The parity maps of p and q differ in no more bits than the sets of a linked pair may in members."""
        return self.apart_allows(sum((F.bit_count(F.col(f"p.{c}").bitwiseXOR(F.col(f"q.{c}"))) for c in BIT_LANES), F.lit(0)), sizes)


def digest_of(members: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set, as two signed numbers."""
    digest = xxhash.xxh3_128_intdigest(members.tobytes())
    return (digest >> 64) - (1 << 63), (digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def parity_map(members: np.ndarray) -> np.ndarray:
    """The set's parity map, as bytes, of at least as many bits as it has members (up to 2^24) and as ``BIT_LANES`` hold."""
    bits = 64 * len(BIT_LANES)
    while bits < min(len(members), 1 << 24):
        bits *= 2
    counts = np.bincount((members >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8))


def folded(wide: np.ndarray, size: int) -> np.ndarray:
    """The parity map of the same set in ``size`` bytes."""
    while len(wide) > size:
        wide = wide[: len(wide) // 2] ^ wide[len(wide) // 2 :]
    return wide


def apart(a: bytes, b: bytes) -> tuple[int, float]:
    """In how many members two sets differ, by their parity maps: at least, and likely."""
    size = min(len(a), len(b))
    p, q = (folded(np.frombuffer(x, np.uint8), size) for x in (a, b))
    least = int(np.bitwise_count(p ^ q).sum())
    alike = 1 - least / (4 * size)
    return least, -4 * size * float(np.log(alike)) if alike > 0 else float("inf")


def measured(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """``pairs`` of ids (a, b, ...) with their sets' sizes n_a and n_b and in how many members those differ: ``least``, ``likely``.

    ``maps`` is what ``parity_maps`` gives.
    """

    def compare(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([apart(a, b) for a, b in zip(left, right, strict=True)], columns=["least", "likely"])

    found = pairs
    for end in "ab":
        found = found.join(maps.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("wide").alias(f"wide_{end}")), end)
    found = found.withColumn("apart", F.pandas_udf(compare, "least long, likely double")("wide_a", "wide_b"))
    return found.select(*pairs.columns, "n_a", "n_b", "apart.*")


def member_levels(docs: DataFrame, width: int) -> np.ndarray:
    """A level for each of 2^20 counters: quarter octaves of how many members of all documents fall there.

    Every task counts its own documents; counters are added up block by block,
    in two steps, and reach the driver as one byte each (1 MB whatever the data).
    """
    size = 1 << COUNTER_BITS
    mask = np.uint64(size - 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, many = np.zeros(size, np.int64), [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append((shingle_set(text, width) & mask).astype(np.int64))
                many += len(held[-1])
                if many > 500_000:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, many = [], 0
        if many:
            total += np.bincount(np.concatenate(held), minlength=size)
        salt = int(total[:64].sum()) % 64
        for k in range(size // COUNTER_BLOCK):
            part = total[k * COUNTER_BLOCK : (k + 1) * COUNTER_BLOCK]
            if part.any():
                yield pd.DataFrame({"block": [k], "salt": [salt], "counts": [part.astype("<i8" if part.max() >= 1 << 31 else "<i4").tobytes()]})

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTER_BLOCK, np.int64)
        for raw in rows["counts"]:
            total += np.frombuffer(raw, dtype="<i4" if len(raw) == 4 * COUNTER_BLOCK else "<i8")
        return pd.DataFrame({"block": [key[0]], "salt": [0], "counts": [total.astype("<i8").tobytes()]})

    schema = "block int, salt int, counts binary"
    parts = docs.select("text").mapInPandas(count, schema)
    summed = parts.groupBy("block", "salt").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            marks = [np.floor(4 * np.log2(1 + np.frombuffer(raw, dtype="<i8"))).astype(np.uint8).tobytes() for raw in batch["counts"]]
            yield pd.DataFrame({"block": batch["block"], "levels": marks})

    levels = np.zeros(size, np.uint8)
    for row in summed.mapInPandas(level, "block int, levels binary").collect():
        at = row["block"] * COUNTER_BLOCK
        levels[at : at + COUNTER_BLOCK] = np.frombuffer(row["levels"], dtype=np.uint8)
    return levels


def indexed(docs: DataFrame, width: int, threshold: Threshold, levels: np.ndarray) -> DataFrame:
    """(doc_id, n, s1, s2, prefix, bits, wide): size of the set, a 128-bit digest of it, its first members in global order, its parity map of 512 bits and whole."""
    shipped = docs.sparkSession.sparkContext.broadcast(levels)
    mask = np.uint64((1 << COUNTER_BITS) - 1)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = shipped.value
        for batch in batches:
            out = []
            for row_id, text in zip(batch["row_id"], batch["text"], strict=True):
                members = shingle_set(text, width)
                n = len(members)
                order = np.argsort(rank[(members & mask).astype(np.int64)], kind="stable") if n else np.empty(0, np.int64)
                prefix = members[order[: threshold.prefix(n)]].view(np.int64) if n else np.empty(0, np.int64)
                wide = parity_map(members)
                out.append((row_id, n, *digest_of(members), prefix, *folded(wide, 8 * len(BIT_LANES)).view("<i8"), wide.tobytes()))
            yield pd.DataFrame(out, columns=["row_id", "n", "s1", "s2", "prefix", *BIT_LANES, "wide"])

    # ids travel as text: a null among them must not turn the others into floating-point numbers
    rows = docs.select(F.col("doc_id").cast("string").alias("row_id"), "text")
    done = rows.mapInPandas(index, "row_id string, n long, s1 long, s2 long, prefix array<long>, " + ", ".join(f"{c} long" for c in BIT_LANES) + ", wide binary")
    return done.select(F.col("row_id").cast("long").alias("doc_id"), "n", "s1", "s2", "prefix", *BIT_LANES, "wide")


def small(frame: DataFrame) -> DataFrame:
    """Broadcast a table of ids if a count shows that it is small enough."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def verified(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Exact (a, b, inter, n_a, n_b) of pairs of ids of ``docs``; only texts of ids in a pair are moved."""
    needed = common.stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(small(needed), "id", "left_semi")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_id, last = None, None
        for batch in batches:
            out = []
            for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if last_id != (b, text_b):
                    last_id, last = (b, text_b), shingle_set(text_b, width)
                own = shingle_set(text_a, width)
                out.append((a, b, len(np.intersect1d(own, last, assume_unique=True)), len(own), len(last)))
            yield pd.DataFrame(out, columns=["a", "b", "inter", "n_a", "n_b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return (
        pairs.select("a", "b")
        .join(left, "a")
        .join(right, "b")
        .select("a", "b", "text_a", "text_b")
        .mapInPandas(compare, "a long, b long, inter long, n_a long, n_b long")
        .groupBy("a", "b")
        .agg(F.max_by(F.struct("inter", "n_a", "n_b"), F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))).alias("v"))
        .select("a", "b", "v.*")
        .withColumn("distance", _distance())
    )


def _distance() -> Column:
    return 1.0 - F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))


def _is_link(threshold: Threshold) -> Column:
    return (F.col("inter") * threshold.down) >= (F.col("n_a") + F.col("n_b") - F.col("inter")) * threshold.up


def _blocks(frame: DataFrame) -> DataFrame:
    """Each entry in its own block and, for smaller sets to find it, in the next."""
    return frame.withColumn("home", F.explode(F.array(F.col("block"), F.col("block") + 1)))


def entries(table: DataFrame, threshold: Threshold) -> tuple[DataFrame, DataFrame]:
    """(s1, s2, rep, n) of the distinct sets, and the entries of the members' lists, each in the blocks (``home``) where
    others may link with it.

    Two sets are held against each other in the larger one's block. An entry stays
    there only if another's size is near enough, if the least position among the
    others allows a link, and if there is an entry whose own block it is. The
    postings are moved once, and all of this is judged where they then lie.
    """
    classes = table.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    classes = common.stored(classes, "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "s1", "s2")
    first = table.select("doc_id", "s1", "s2", "n", "prefix").join(small(reps), ["doc_id", "s1", "s2"], "left_semi")
    # each entry also knows the member before it in its set
    steps = F.transform("prefix", lambda m, i: F.struct(m.alias("member"), F.get("prefix", i - 1).alias("prev")))
    postings = first.select(F.col("doc_id").alias("id"), "n", F.posexplode(steps).alias("pos", "step")).select("id", "n", "pos", "step.*")

    # Members under which only one set is indexed lead to no pair.
    shared = postings.withColumn("c", F.count("*").over(Window.partitionBy("member"))).where("c > 1").drop("c")
    placed = _blocks(shared.withColumns({"block": threshold.size_block(F.col("n")), "x": threshold.excess(F.col("n"), F.col("pos"))}))
    here = Window.partitionBy("member", "home")
    by_size = here.orderBy("n")
    below, above = F.lag("n").over(by_size), F.lead("n").over(by_size)
    near = placed.withColumns({"below": below, "above": above}).where((F.col("below") * threshold.down >= F.col("n") * threshold.up) | (F.col("n") * threshold.down >= F.col("above") * threshold.up))
    least = near.drop("below", "above").withColumn("least", F.min("x").over(here))
    early = least.where(F.col("x") + F.col("least") <= 0)
    some = early.withColumns({"c": F.count("*").over(here), "own": F.max(F.col("block") == F.col("home")).over(here)}).where("c > 1 AND own")
    return classes, common.stored(some.select("member", "home", "id", "n", "pos", "prev", "block"), "lists")


def named_leaders(lists: DataFrame, threshold: Threshold) -> DataFrame:
    """(id, lead): for every set the one that most of its lists' blocks name as their leader.

    A block's leader is the entry with the fewest early prefix members that no
    other set is indexed under, so the text that the others are copies of; ties go to
    the smaller id. Blocks overlap (see ``_blocks``), so a group of copies whose
    sizes stand in two blocks names one leader.
    """
    # of the positions at which a set of the same size may be met; an entry may stand in two blocks
    early = F.when(threshold.excess(F.col("n"), F.col("pos")) <= 0, F.col("pos"))
    sizes = lists.groupBy("id").agg(F.first("n").alias("n"), F.count_distinct(early).alias("shared"))
    alone = sizes.select("id", (F.floor(F.col("n") * (threshold.down - threshold.up) / (threshold.down + threshold.up)) + 1 - F.col("shared")).alias("alone"))
    at = lists.join(small(common.stored(alone, "alone")), "id").select("member", "home", "id", "n", "pos", "alone")
    leaders = at.groupBy("member", "home").agg(F.min(F.struct("alone", "id", "n", "pos")).alias("lead"))
    return (
        at.join(leaders, ["member", "home"])
        .where((F.col("id") != F.col("lead.id")) & threshold.may_link(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
        .groupBy("id", F.col("lead.id").alias("lead"), F.col("lead.alone").alias("alone"))
        .agg(F.count("*").alias("times"))
        .groupBy("id")
        .agg(F.max_by("lead", F.struct("times", -F.col("alone"), -F.col("lead"))).alias("lead"))
    )


def followers(lists: DataFrame, classes: DataFrame, maps: DataFrame, docs: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """(a, b, n_a, n_b, inter, distance, diff): every set a with its named leader b.

    Sets that by their parity maps differ from it in more than two fifths of their
    sizes' sum follow nobody: they are met like leaders, and no text is moved.
    ``diff`` is the symmetric difference of the two, where it is at most a third of
    their sizes' sum, else null. Texts are moved to their leader once; a leader
    with many followers is copied to several places, LED_ROWS followers each.
    """
    named = measured(named_leaders(lists, threshold).select(F.col("id").alias("a"), F.col("lead").alias("b")), maps)
    named = named.where(5 * F.col("likely") <= 2 * (F.col("n_a") + F.col("n_b"))).select(F.col("a").alias("id"), F.col("b").alias("lead"))
    named = common.stored(named, "named")
    counts = named.groupBy("lead").agg(F.ceil(F.count("*") / LED_ROWS).cast("int").alias("places"))
    led = named.join(counts, "lead").select("id", "lead", F.pmod(F.xxhash64("id"), F.col("places")).cast("int").alias("place"), F.lit(1).alias("role"))
    lead = counts.select(F.col("lead").alias("id"), "lead", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("role"))
    moves = led.unionByName(lead).join(classes.select(F.col("rep").alias("id"), "s1", "s2"), "id")
    moves = common.stored(moves, "moves")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, base, last = None, np.empty(0, np.uint64), None
        for batch in batches:
            out = []
            columns = (batch[c] for c in ("id", "lead", "place", "role", "s1", "s2", "text"))
            for row_id, lead_id, place, role, s1, s2, text in zip(*columns, strict=True):
                members = shingle_set(text, width)
                if digest_of(members) != (s1, s2) or (row_id, lead_id, role) == last:
                    continue  # another text of the same id, or the row once more
                last = (row_id, lead_id, role)
                if role == 0:
                    at, base = (lead_id, place), members
                elif at == (lead_id, place):
                    diff = np.setxor1d(members, base, assume_unique=True)
                    n = len(members) + len(base)
                    out.append((row_id, lead_id, len(members), len(base), (n - len(diff)) // 2, diff.view(np.int64) if 3 * len(diff) <= n else None))
            yield pd.DataFrame(out, columns=["a", "b", "n_a", "n_b", "inter", "diff"])

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(small(moves), "id")
    pairs = (
        texts.repartition("lead", "place")
        .sortWithinPartitions("lead", "place", "role", "id")
        .mapInPandas(compare, "a long, b long, n_a long, n_b long, inter long, diff array<long>")
    )
    return common.stored(pairs.withColumn("distance", _distance()), "star")


def derived_links(star: DataFrame, component: DataFrame, maps: DataFrame, threshold: Threshold) -> DataFrame:
    """Links (a, b) between followers of one leader that stand in different components, from their differences to it.

    With D the difference to the leader, sets a and b differ in |D_a| + |D_b| -
    2 |D_a & D_b| members, so they link if

        2 (up + down) |D_a & D_b| >= x_a + x_b,   x = (up + down) |D| - (down - up) n.

    Two followers of which one doesn't link with the leader must share members of
    their differences. These are indexed like the sets were: rarest within the
    leader's group first, only as many as the needed overlap leaves. Edits that a
    copy shares with no other copy come first, so most copies meet nobody.
    """
    both = 2 * (threshold.up + threshold.down)
    excess = F.col("m") * (threshold.up + threshold.down) - F.col("n") * (threshold.down - threshold.up)
    led = (
        star.where("diff IS NOT NULL")
        .select(F.col("a").alias("id"), F.col("b").alias("leader"), F.col("n_a").alias("n"), "diff", F.size("diff").alias("m"))
        .join(component, "id", "left")
        .withColumns({"component": F.coalesce("component", "id"), "x": excess})
    )
    least = led.groupBy("leader", "component").agg(F.min("x").alias("x"))
    first = least.groupBy("leader").agg(F.min(F.struct("x", "component")).alias("first"))
    second = least.join(first, "leader").where("component <> first.component").groupBy("leader", "first").agg(F.min("x").alias("second"))
    led = common.stored(
        led.join(second, "leader")
        .withColumn("needed", F.ceil((F.col("x") + F.when(F.col("component") == F.col("first.component"), F.col("second")).otherwise(F.col("first.x"))) / both))
        .drop("first", "second"),
        "led",
    )
    steps = led.select("id", "leader", F.explode("diff").alias("member"))
    often = steps.groupBy("leader", "member").agg(F.count("*").alias("times")).where("times > 1")
    known = common.stored(steps.join(often, ["leader", "member"]), "steps")
    in_order = Window.partitionBy("id").orderBy("times", "member")
    ranked = known.withColumns({"nth": F.row_number().over(in_order), "many": F.count("*").over(Window.partitionBy("id"))})
    index = (
        ranked.join(led.drop("leader", "diff"), "id")
        .withColumn("left", F.col("many") - F.col("nth") + 1)  # members from here on, this one included
        .where("left >= needed")
        .join(maps.select("id", *BIT_LANES), "id")
    )
    index = common.stored(index.select("leader", "member", "id", "component", "n", "x", "left", *BIT_LANES), "differences")
    p, q = index.alias("p"), index.alias("q")
    needed = F.col("p.x") + F.col("q.x")
    met = (
        p.join(
            q,
            (F.col("p.leader") == F.col("q.leader"))
            & (F.col("p.member") == F.col("q.member"))
            & (F.col("p.id") < F.col("q.id"))
            & (F.col("p.component") != F.col("q.component"))
            & (F.col("p.left") * both >= needed)
            & (F.col("q.left") * both >= needed)
            & threshold.bits_allow(F.col("p.n") + F.col("q.n")),
        )
        .select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), needed.alias("needed"))
        .distinct()
    )
    met = common.stored(met, "met")
    diffs = led.select("id", "diff")
    left, right = (diffs.select(F.col("id").alias(c), F.col("diff").alias(f"d_{c}")) for c in "ab")
    judged = met.join(left, "a").join(right, "b").where(F.size(F.array_intersect("d_a", "d_b")) * both >= F.col("needed"))
    return common.stored(judged.select("a", "b"), "derived")


def cross_links(lists: DataFrame, star: DataFrame, component: DataFrame, maps: DataFrame, docs: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """Links (a, b) between sets of different leaders and components, which meet in a block of a list."""
    followed = star.where("diff IS NOT NULL").select(F.col("a").alias("id"), F.col("b").alias("leader"))
    marks = common.stored(component.join(followed, "id", "full"), "marks")
    placed = lists.join(small(marks), "id", "left").withColumns({"leader": F.coalesce("leader", "id"), "component": F.coalesce("component", "id")})
    at = common.stored(placed, "placed")
    ends = [f(c).alias(f"{e}_{c}") for c in ("leader", "component") for e, f in (("lo", F.min), ("hi", F.max))]
    several = at.groupBy("member", "home").agg(*ends).where("lo_leader < hi_leader AND lo_component < hi_component")
    at = common.stored(at.join(several.select("member", "home"), ["member", "home"], "left_semi").join(maps.select("id", *BIT_LANES), "id"), "open")
    p, q = at.alias("p"), at.alias("q")
    met = (
        p.join(
            q,
            (F.col("p.member") == F.col("q.member"))
            & (F.col("p.home") == F.col("q.home"))
            & (F.col("p.id") < F.col("q.id"))
            & (F.col("p.leader") != F.col("q.leader"))
            & (F.col("p.leader") != F.col("q.id"))
            & (F.col("q.leader") != F.col("p.id"))
            & (F.col("p.component") != F.col("q.component"))
            # a pair meets once for each run of members that both sets have one after the other
            & (F.col("p.home") == F.greatest("p.block", "q.block"))
            & F.coalesce(F.col("p.prev") != F.col("q.prev"), F.lit(True))
            & threshold.may_link(F.col("p.n"), F.col("p.pos"), F.col("q.n"), F.col("q.pos"))
            & threshold.bits_allow(F.col("p.n") + F.col("q.n")),
        )
        .select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
        .distinct()
    )
    met = measured(met, maps).where(threshold.apart_allows(F.col("least"), F.col("n_a") + F.col("n_b")))
    met = common.stored(met.select("a", "b"), "met")
    return common.stored(verified(met, docs, width).where(_is_link(threshold)).select("a", "b"), "crossed")


def links(table: DataFrame, docs: DataFrame, width: int, threshold: Threshold) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between the sets' representatives that make the same classes as all links do.

    ``table`` is what ``indexed`` gives. Returns (s1, s2, rep, n) of the sets and
    the links of three rounds: with the leader, between followers of one leader,
    between leaders. ``all_links`` gives every link.
    """
    classes, lists = entries(table, threshold)
    maps = parity_maps(table, classes, lists)
    star = followers(lists, classes, maps, docs, width, threshold)
    first = star.where(_is_link(threshold)).select("a", "b")
    second = derived_links(star, components(first), maps, threshold)
    third = cross_links(lists, star, components(first.union(second)), maps, docs, width, threshold)
    return classes, [first, second, third]


def parity_maps(table: DataFrame, classes: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, n, bits, wide): size and parity map of each different set with an entry in the lists."""
    listed = common.stored(lists.select(F.col("id").alias("rep")).distinct().join(classes, "rep").select(F.col("rep").alias("doc_id"), "s1", "s2"), "listed")
    found = table.select("doc_id", "s1", "s2", "n", *BIT_LANES, "wide").join(small(listed), ["doc_id", "s1", "s2"], "left_semi")
    return common.stored(found.select(F.col("doc_id").alias("id"), "n", *BIT_LANES, "wide").dropDuplicates(["id"]), "maps")


def all_links(lists: DataFrame, classes: DataFrame, maps: DataFrame, docs: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """Every link (a, b), a < b, between the sets of ``lists``, which ``entries`` gives; ids of ``docs`` are distinct.

    Pairs whose parity maps differ in more bits than a link allows are not kept.
    With d(a, leader of a), d(b, leader of b) and the leaders' distance D known, the
    distance of a and b lies between D less both and D plus both. The rows grow with
    the links: with the square of a group's size, if all its members link.
    """
    star = followers(lists, classes, maps, docs, width, threshold).where(_is_link(threshold))
    at = lists.join(maps.select("id", *BIT_LANES), "id")
    p, q = at.alias("p"), at.alias("q")
    met = (
        p.join(
            q,
            (F.col("p.member") == F.col("q.member"))
            & (F.col("p.home") == F.col("q.home"))
            & (F.col("p.id") < F.col("q.id"))
            & (F.col("p.home") == F.greatest("p.block", "q.block"))
            & threshold.bits_allow(F.col("p.n") + F.col("q.n"))
            # a pair meets once for each run of members that both sets have one after the other
            & F.coalesce(F.col("p.prev") != F.col("q.prev"), F.lit(True))
            & threshold.may_link(F.col("p.n"), F.col("p.pos"), F.col("q.n"), F.col("q.pos")),
        )
        .select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), (F.col("p.n") + F.col("q.n")).alias("sizes"))
        .distinct()
    )
    met = common.stored(met, "candidates")
    # the maps of 512 bits say little of sets beyond some times that size
    large = F.col("sizes") > 128 * len(BIT_LANES)
    wide = measured(met.where(large), maps).where(threshold.apart_allows(F.col("least"), F.col("sizes")))
    met = met.where(~large).union(wide.select(*met.columns)).drop("sizes")
    followed = small(star.select(F.col("a").alias("id"), F.col("b").alias("leader"), "distance"))

    def led(frame: DataFrame, side: str) -> DataFrame:
        marks = followed.select(F.col("id").alias(side), F.col("leader").alias(f"l_{side}"), F.col("distance").alias(f"far_{side}"))
        return frame.join(marks, side, "left").withColumns({f"l_{side}": F.coalesce(f"l_{side}", side), f"far_{side}": F.coalesce(f"far_{side}", F.lit(0.0))})

    met = led(led(met, "a"), "b")
    met = common.stored(met.withColumns({"lo": F.least("l_a", "l_b"), "hi": F.greatest("l_a", "l_b")}).drop("l_a", "l_b"), "met")
    apart = common.stored(met.where("lo <> hi").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct(), "apart")
    known = verified(apart, docs, width).select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("distance").alias("between"))
    both = F.col("far_a") + F.col("far_b")
    bounded = met.join(common.stored(known, "leaders"), ["lo", "hi"], "left").withColumn("between", F.coalesce("between", F.lit(0.0)))
    bounded = bounded.select(
        "a", "b",
        (F.col("between") + both <= threshold.distance - 1e-9).alias("sure"),
        (F.greatest(F.col("between") - both, F.abs(F.col("far_a") - F.col("far_b")) - F.col("between")) > threshold.distance + 1e-9).alias("never"),
    )
    bounded = common.stored(bounded.where("NOT never"), "bounded")
    compared = verified(bounded.where("NOT sure").select("a", "b"), docs, width).where(_is_link(threshold))
    return common.stored(bounded.where("sure").select("a", "b").union(compared.select("a", "b")), "all_links")


def linked_documents(docs: DataFrame, width: int = 5, up: int = 80, down: int = 100) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id) of every row of ``docs`` (doc_id, text), from all links.

    n_links counts the other rows whose text links with the row's, equal texts
    included; component_id is the smallest doc_id reachable by links. Rows are
    judged by their texts, also where they share an id. Rows without words have no
    links; rows with a null id have none either and a null class.
    """
    common.bound_batches(docs.sparkSession)
    docs = common.plain(docs, "doc_id", "text")
    threshold = Threshold(up, down)
    rows = docs.where("doc_id IS NOT NULL")
    texts = one_row_each(rows).select(F.col("key").alias("doc_id"), "text")
    table = common.stored(indexed(texts, width, threshold, member_levels(texts, width)), "sets")
    classes, lists = entries(table, threshold)
    found = all_links(lists, classes, parity_maps(table, classes, lists), texts, width, threshold)
    sets = table.join(classes.select("s1", "s2", "rep"), ["s1", "s2"]).select(F.col("doc_id").alias("key"), F.col("n").alias("n_shingles"), "rep")
    held = rows.where(has_words(F.col("text"))).select("doc_id", text_key(F.col("text")).alias("key"))
    held = common.stored(held.join(sets, "key").select("doc_id", "n_shingles", "rep"), "held")
    copies = common.stored(held.groupBy("rep").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "copies")
    both = found.union(found.select("b", "a"))
    others = both.join(copies.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    group = copies.join(components(found).withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = group.join(least, "component").join(others, "rep", "left").select("rep", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [len(shingle_set(text, width)) for text in batch["text"]]})

    zero = F.lit(0).cast("long")
    unnamed = docs.where(F.col("doc_id").isNull() & has_words(F.col("text"))).select("text").mapInPandas(count, "n long")
    return (
        held.join(facts, "rep")
        .select("doc_id", "n_shingles", "n_links", "component_id")
        .union(docs.where(~has_words(F.col("text"))).select("doc_id", zero, zero, "doc_id"))
        .union(unnamed.select(F.lit(None).cast("long"), "n", zero, F.lit(None).cast("long")))
    )


def classes_of(docs: DataFrame, width: int = 5, up: int = 80, down: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable by links, itself included.
    Null and empty texts, and texts without words, have no shingles and link
    with nothing; rows with a null id link with nothing and have a null class.
    Repeated rows, and rows that share an id, share one class. An empty table
    gives no rows. Extra columns are not looked at. Ids are whole numbers; one
    that is not raises.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    docs = common.plain(docs, "doc_id", "text")
    threshold = Threshold(up, down)
    levels = member_levels(docs, width)
    table = common.stored(indexed(docs, width, threshold, levels), "sets")
    classes, rounds = links(table, docs, width, threshold)
    every = rounds[0]
    for more in rounds[1:]:
        every = every.union(more)
    # rows that share an id are one document: their sets' representatives are linked through it
    shared_id = (
        table.where("n > 0 AND doc_id IS NOT NULL")
        .select("doc_id", "s1", "s2")
        .join(classes.select("s1", "s2", "rep"), ["s1", "s2"])
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        .where("a <> b")
    )
    component = components(every.union(shared_id))
    return (
        table.select("doc_id", F.col("n").alias("n_shingles"))
        .join(component.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by three-word shingles at 0.9; nulls and ties as in ``classes_of``."""
    return classes_of(common.table(spark, sf_dir, "documents"), width=3, up=90, down=100)


def text_key(text: Column) -> Column:
    """Stands for a text: rows with equal texts share it, whatever their ids."""
    return F.xxhash64(text)


def has_words(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"[^\x09-\x0D\x20]")


def one_row_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with words and a column ``key`` (see text_key), one row for each text.

    The row kept has the smallest id, null ids last, and then the smallest digest
    of all columns. Only rows whose text is repeated are moved. Texts are told
    apart by a key and a digest: where different ones share a key, each has a
    key of its digest instead.
    """
    rest = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    rows = docs.where(has_words(F.col("text"))).withColumn("key", text_key(F.col("text")))
    digest, torn = common.fresh(rows, "digest", "torn")
    marked = rows.withColumn(digest, F.sha2("text", 256))
    groups = marked.groupBy("key").agg(F.count("*").alias("c"), (F.min(digest) < F.max(digest)).alias(torn))
    repeated = small(common.stored(groups.where("c > 1").select("key", torn), "repeated"))
    first = Window.partitionBy("key", digest).orderBy(F.col("doc_id").asc_nulls_last(), F.sha2(F.to_json(F.array(*rest)), 256))
    firsts = marked.join(repeated, "key").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    firsts = firsts.withColumn("key", F.when(F.col(torn), F.xxhash64(digest)).otherwise(F.col("key")))
    firsts = common.stored(firsts.select(*rows.columns), "firsts")
    return rows.join(repeated, "key", "left_anti").select(*rows.columns).union(firsts)


def text_classes(distinct: DataFrame, width: int = 5, up: int = 80, down: int = 100) -> DataFrame:
    """(key, class) of each row of ``one_row_each``: class is the smallest key reachable by links.

    Texts take the place of ids, so null ids and ids with several texts have their classes too.
    """
    found = classes_of(distinct.select(F.col("key").alias("doc_id"), "text"), width, up, down)
    return common.stored(found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("class")), "text_classes")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of texts: the smallest id, null ids last, then the smallest text key.

    A row's class is that of its text, so repeated rows, rows with a null id and
    rows that share an id are judged like any other. Rows without words stay.
    """
    distinct = one_row_each(docs)
    ranked = distinct.select("key", "doc_id").join(text_classes(distinct), "key")
    kept = ranked.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("least"))
    kept = small(common.stored(kept.select("least.key"), "kept"))
    return distinct.join(kept, "key", "left_semi").select(*docs.columns).union(docs.where(~has_words(F.col("text"))))


def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join's own answer beside the classes: how many documents each document links with."""
    return linked_documents(common.table(spark, sf_dir, "documents"), width=3, up=90, down=100)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose id is the smallest of its class.

    Documents are known by their ids: all rows of a kept id stay, and so do all
    rows without an id. ``one_of_each_class`` keeps one row instead.
    """
    kept = classes_of(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(small(kept), "doc_id", "left_semi").union(docs.where("doc_id IS NULL")).select(*docs.columns)


#: The same classes, written anew for DuckDB.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

#: The same with the number of links of each document.
LINKS_SQL = (
    ORACLE_SQL.replace("c.component_id\n", "c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links\n")
    + "LEFT JOIN (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a) k ON k.a = w.doc_id\n"
)
