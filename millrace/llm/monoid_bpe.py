"""Byte-level BPE by monoid tree reduction.

A piece (one match of the split pattern) is encoded by halves down to single
bytes: each half is encoded by itself, and two neighbours are joined by
re-encoding a window around their seam that grows until its edges are stable.
All merging is done by these joins; halves that a worker has met are remembered.

Why the join is exact. Call a pair of tokens *compatible* if encoding their
joined bytes gives the pair back. In the merge process over a whole string, the
first merge that crosses a token boundary would also happen when only the two
tokens beside that boundary are encoded, because the merges on either side of
it go on independently until then. So a token sequence is the encoding of its
bytes exactly if all its neighbours are compatible. Neighbours inside a half
are compatible already, so a window is final once both its edges are. The rule
needs tokens that are the encoding of their own bytes; a vocabulary's other
tokens (none in ``last_merges``) can only be whole pieces and are looked up as such.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A piece of at most this many bytes is a leaf of the tree.
LEAF_BYTES = 1
#: Halves of at most so many bytes are remembered.
MEMO_BYTES = 24
#: Entries a worker remembers before it starts afresh; memory only, never results.
MEMO_ENTRIES = 500_000


#: Later than any merge.
NEVER = 1 << 60


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the lines of a rank file: base64 of the token, a space, its id."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge_short(data: bytes, ranks: dict[bytes, int], leave: int = 1) -> list[int]:
    """As ``merge_all``, by scanning: the quicker way for a few dozen bytes. Stops at ``leave`` tokens."""
    none, get = NEVER, ranks.get
    parts = [data[i : i + 1] for i in range(len(data))]
    costs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
    while len(costs) >= leave and (least := min(costs)) != none:
        i = costs.index(least)
        parts[i] += parts.pop(i + 1)
        del costs[i]
        if i < len(costs):
            costs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            costs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merge_all(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the lowest-ranked neighbouring pair, leftmost first, until none is left."""
    n = len(data)
    if n <= 48:
        return merge_short(data, ranks)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(data[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(data[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = end[i]
    return out


def last_merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens whose merge ends the encoding of each token of several bytes; without those that merging
    their own bytes does not give."""
    found = {}
    for token, rank in ranks.items():
        if len(token) > 1 and len(ids := merge_short(token, ranks, 2)) == 2:
            found[rank] = (ids[0], ids[1])
    return found


class TreeBpe:
    """Encoder and decoder of one vocabulary; memoises pieces, halves and seams within bounds.

    ``parts`` is what ``last_merges`` gives. Where every token comes after its
    parts, as in trained vocabularies, merges happen in the order of the ranks, and
    two tokens' compatibility is read off the parts that stand beside their seam.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = LEAF_BYTES, parts: dict[int, tuple[int, int]] | None = None):
        self.ranks = ranks
        self.parts = last_merges(ranks) if parts is None else parts
        self.whole = {token: rank for token, rank in ranks.items() if len(token) > 1 and rank not in self.parts}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        long = {rank for token, rank in ranks.items() if len(token) > 1}
        self.ordered = all(p < rank for rank, pair in self.parts.items() for p in pair if p in long)
        self.findall = regex.compile(pattern).findall
        self.leaf_bytes = leaf_bytes
        self.pieces: dict[str, list[int]] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.joins = 0  # seams at which a window was re-encoded

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at a token's start (side 0) or end (1) while it is merged, each with the rank that takes it up."""
        known = self.edges[side].get(token)
        if known is None:
            chain = [token]
            while (pair := self.parts.get(chain[-1])) is not None:
                chain.append(pair[side])
            chain.reverse()
            known = self.edges[side][token] = [(self.bytes_of[t], after) for t, after in zip(chain, [*chain[1:], NEVER], strict=True)]
        return known

    def seam_holds(self, left: int, right: int) -> bool:
        """No merge across the seam comes before the merges that take up the parts beside it; of equal ranks the left one is first."""
        a, b, get = self.edge(left, 1), self.edge(right, 0), self.ranks.get
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = a[i], b[j]
            rank = get(x + y)
            if rank is not None and rank < x_gone and rank <= y_gone:
                return False
            if x_gone <= y_gone:
                if x_gone == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMO_ENTRIES:
                self.pairs.clear()
            known = self.seam_holds(left, right) if self.ordered else self.merged([left, right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def merged(self, ids: list[int]) -> list[int]:
        """The encoding of a window's bytes; a token's bytes give the token, others are merged."""
        data = b"".join([self.bytes_of[t] for t in ids])
        token = self.ranks.get(data)
        return [token] if token is not None and data not in self.whole else merge_all(data, self.ranks)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right or self.compatible(left[-1], right[0]):
            return left + right
        self.joins += 1
        i, j, grow = len(left) - 1, 1, 1
        while True:
            middle = self.merged(left[i:] + right[:j])
            left_final = i == 0 or self.compatible(left[i - 1], middle[0])
            right_final = j == len(right) or self.compatible(middle[-1], right[j])
            if left_final and right_final:
                return left[:i] + middle + right[j:]
            grow *= 2
            if not left_final:
                i = max(0, i - grow)
            if not right_final:
                j = min(len(right), j + grow)

    def reduce(self, data: bytes) -> list[int]:
        """Encode by halves. Short halves come up again and again and are encoded once."""
        n = len(data)
        if n <= self.leaf_bytes:
            return merge_all(data, self.ranks)
        known = self.halves.get(data)
        if known is None:
            known = self.join(self.reduce(data[: n // 2]), self.reduce(data[n // 2 :]))
            if n <= MEMO_BYTES:
                if len(self.halves) >= MEMO_ENTRIES:
                    self.halves.clear()
                self.halves[data] = known
        return known

    def piece(self, text: str) -> list[int]:
        """One match of the pattern."""
        data = text.encode("utf-8")
        whole = self.whole.get(data)
        return [whole] if whole is not None else self.reduce(data)

    def encode(self, text: str) -> list[int]:
        known, out = self.pieces, []
        if len(known) >= MEMO_ENTRIES:
            known.clear()
        for match in self.findall(text):
            ids = known.get(match)
            if ids is None:
                ids = self.piece(match)
                if len(match) <= 64:
                    known[match] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Concatenate up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_coders: dict[tuple[int, str], TreeBpe] = {}


def _coder(shipped, pattern: str) -> TreeBpe:
    """One coder in each Python worker, built from the broadcast rank file and its tokens' parts."""
    key = (shipped.id if hasattr(shipped, "id") else id(shipped), pattern)
    if key not in _coders:
        _coders.clear()
        raw, parts = shipped.value
        _coders[key] = TreeBpe(load_ranks(raw), pattern, parts=parts)
    return _coders[key]


class ByteBpe:
    """Column operators for one rank file.

    ``encode`` gives ``array<int>`` (null text: empty array); ``decode`` gives
    the bytes of such an array (null array: empty). Empty texts give no tokens;
    texts of any length are encoded whole; repeated rows give repeated results;
    other columns are kept as they are, one named like the output is replaced.
    The rank file is read on the driver and broadcast: its size is the
    vocabulary's, never the data's.
    """

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        common.bound_batches(spark)
        with open(rank_file, "rb") as file:
            raw = file.read()
        shipped = spark.sparkContext.broadcast((raw, last_merges(load_ranks(raw))))

        @F.pandas_udf("array<int>")
        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            coder = _coder(shipped, pattern)
            for texts in batches:
                yield pd.Series([np.array(coder.encode(t or ""), dtype=np.int32) for t in texts], dtype=object)

        @F.pandas_udf("binary")
        def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            coder = _coder(shipped, pattern)
            for rows in batches:
                yield pd.Series([coder.decode([] if ids is None else ids.tolist()) for ids in rows], dtype=object)

        self._encoded, self._decoded = encoded, decoded

    def encode(self, frame: DataFrame, text: str = "text", into: str = "token_ids") -> DataFrame:
        return frame.withColumn(into, self._encoded(F.col(f"`{text}`")))

    def decode(self, frame: DataFrame, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
        return frame.withColumn(into, self._decoded(F.col(f"`{ids}`")))


def digest_query(spark: SparkSession, sf_dir: str, rank_file: str, pattern: str) -> DataFrame:
    """Ids and decoded bytes of every document as digests; null and empty texts have no ids, texts are read whole, repeated
    rows each."""
    coder = ByteBpe(spark, rank_file, pattern)
    docs = common.plain(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    both = coder.decode(coder.encode(docs))
    return both.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
