"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

A bin never holds two items of one source, nor two of one duplicate cluster: it
carries both sets as bitmaps. Clusters are a column of the items, or are found in
the task that packs: items that can share a bin are in one task, so near copies
need to be known only among these. Open bins are ordered by what room they have left.
An item looks up the first bin with room enough and, while that bin's bitmaps
clash with its own bits, goes on to the next: so it takes the tightest bin that
is compatible, or opens a new one.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard_join

CAPACITY = 4096
#: Items packed together by one task, on average; a group's items are dealt by
#: hash, so every source and cluster is spread evenly over the groups.
GROUP_ITEMS = 2000
#: Bytes of text that a task gets on average, at most, where it looks for near copies itself.
GROUP_BYTES = 32_000_000
#: Near copies: five-word shingles, Jaccard 0.8.
NEAR_WIDTH, NEAR_UP, NEAR_DOWN = 5, 80, 100


def word_count(text: Column) -> Column:
    """Words between white space; null counts none."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"\s+")
    return F.size(F.array_remove(pieces, "")).cast("long")


def pack_group(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, items taken in the given order.

    ``sources`` and ``clusters`` are bit numbers; -1 stands for no constraint.
    """
    open_bins: list[tuple[int, int]] = []  # room left, bin
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        own_source = 1 << source if source >= 0 else 0
        own_cluster = 1 << cluster if cluster >= 0 else 0
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (source_bits[b] & own_source or cluster_bits[b] & own_cluster):
                break
            at += 1
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= own_source
        cluster_bits[b] |= own_cluster
        bins.append(b)
        offsets.append(capacity - room)
        if room > size:
            insort(open_bins, (room - size, b))
    return bins, offsets


def near_classes(texts: list[str | None], width: int = NEAR_WIDTH, up: int = NEAR_UP, down: int = NEAR_DOWN) -> np.ndarray:
    """The class of each of a task's texts by the links among them; -1 for texts without words.

    Each text is listed under its rarest shingles only, of which two linked texts
    share one. Texts of one class are not compared again.
    """
    labels = np.full(len(texts), -1, np.int64)
    sets: list[np.ndarray] = []
    known: dict[bytes, int] = {}
    for i, text in enumerate(texts):
        members = jaccard_join.shingle_set(text, width)
        if len(members):
            labels[i] = known.setdefault(xxhash.xxh3_128_digest(members.tobytes()), len(sets))
            if labels[i] == len(sets):
                sets.append(members)
    if len(sets) < 2:
        return labels
    sizes = np.array([len(x) for x in sets])
    _, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    listed, owners = [], []
    for i, (begin, end) in enumerate(zip(ends - sizes, ends, strict=True)):
        own = number[begin:end]
        first = own[np.argsort(often[own], kind="stable")[: len(own) + (-up * len(own)) // down + 1]]
        first = first[often[first] > 1]
        listed.append(first)
        owners.append(np.full(len(first), i))
    listed, owners = np.concatenate(listed), np.concatenate(owners)
    order = np.argsort(listed, kind="stable")
    listed, owners = listed[order], owners[order]

    root = np.arange(len(sets))
    compared: set[tuple[int, int]] = set()
    for together in np.split(owners, np.flatnonzero(listed[1:] != listed[:-1]) + 1):
        if len(together) < 2 or len(np.unique(root[together])) == 1:
            continue
        together = [int(x) for x in together]
        for k, a in enumerate(together):
            for b in together[k + 1 :]:
                if root[a] == root[b] or (a, b) in compared or min(sizes[a], sizes[b]) * down < max(sizes[a], sizes[b]) * up:
                    continue
                compared.add((a, b))
                inter = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if inter * down >= (sizes[a] + sizes[b] - inter) * up:
                    root[root == root[b]] = root[a]
    labels[labels >= 0] = root[labels[labels >= 0]]
    return labels


def _counted(items: DataFrame, keys: list[str], text: str | None) -> DataFrame:
    """Each different item once, with its ``copies``; only repeated ones are moved with their texts."""
    if text is None:
        return items.groupBy(*keys).agg(F.count("*").alias("copies"))
    keyed = items.withColumn("_row", F.sha2(F.to_json(F.struct(*keys, F.sha2(text, 256).alias("digest")), {"ignoreNullFields": "false"}), 256))
    repeated = jaccard_join.small(common.stored(keyed.groupBy("_row").agg(F.count("*").alias("copies")).where("copies > 1"), "repeated_items"))
    once = keyed.join(repeated.select("_row"), "_row", "left_anti").drop("_row").withColumn("copies", F.lit(1).cast("long"))
    more = keyed.join(repeated, "_row").groupBy("_row").agg(*[F.first(c).alias(c) for c in items.columns], F.first("copies").alias("copies"))
    return once.unionByName(more.drop("_row"))


def packed(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, text: str | None = None) -> DataFrame:
    """Pack rows (doc_id, size, source, cluster) into bins.

    Returns one row for each item and part: doc_id, part, doc_offset, n_tokens,
    bin_id, bin_offset: tokens doc_offset to doc_offset + n_tokens of the document
    stand in the bin from bin_offset on (``sequences`` lays them out). An item above
    the capacity is cut into full parts, each filling a bin of its own, and a rest
    that is packed like any item. Items of size zero take no room but are placed.
    Null sources and clusters clash with nothing; a null or negative size counts
    zero; repeated rows are items of their own and are dealt to all groups; ids may
    be of any type that has a text form. Within a group the largest items come
    first; ties go by the text form of doc_id, then part, then cluster. Bin ids are
    unique over all groups; an empty table gives no rows.

    With ``text``, the name of a column, near copies among a group's items make the
    clusters (``near_classes``) in place of the column ``cluster``; a text goes with
    the one part of its item that can share a bin. Texts without words, and nulls,
    clash with nothing. Items of different groups share no bin, so no near copies do.
    """
    n_bytes = F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)) if text else F.lit(0)
    total = items.agg(F.count("*").alias("rows"), n_bytes.alias("bytes")).head()
    groups = max(1, -(-total["rows"] // group_items), -(-total["bytes"] // GROUP_BYTES))
    id_type = items.schema["doc_id"].dataType
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0))
    full = F.floor(F.greatest(size - 1, F.lit(0)) / capacity).cast("long")
    keys = ["doc_id", "size", "source", "cluster"]
    rows = items.select("doc_id", size.alias("size"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"), *([F.col(f"`{text}`").alias("_text")] if text else []))
    parts = (
        _counted(rows, keys, "_text" if text else None)
        .withColumns({"full": full, "copy": F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))})
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
        .select(
            F.col("doc_id").cast("string").alias("doc_id"),  # as text, a null leaves the others whole
            F.col("part").cast("int").alias("part"),
            F.when(F.col("part") < F.col("full"), F.lit(capacity)).otherwise(F.col("size") - F.col("full") * capacity).cast("int").alias("n_tokens"),
            F.xxhash64("source").alias("source"),
            F.col("source").isNotNull().alias("has_source"),
            "cluster",
            F.pmod(F.xxhash64("doc_id", "cluster", "part", "copy", *(["_text"] if text else [])), F.lit(groups)).cast("long").alias("grp"),
            # a part that fills its bin meets no other
            *([F.when(F.col("part") == F.col("full"), F.col("_text")).alias("_text")] if text else []),
        )
    )

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ties = ["doc_id", "part", "cluster", "source", *(["_text"] if text else [])]
        rows = rows.sort_values(["n_tokens", *ties], ascending=[False, *[True] * len(ties)], kind="stable")
        sources = pd.factorize(rows["source"].where(rows["has_source"]))[0]
        if text:
            near = near_classes(rows["_text"].tolist())
            rows = rows.assign(cluster=pd.Series(near, index=rows.index).where(near >= 0))
        # only clusters that occur twice in the group can clash
        clusters = pd.factorize(rows["cluster"].where(rows["cluster"].duplicated(keep=False)))[0]
        bins, offsets = pack_group(rows["n_tokens"].tolist(), sources.tolist(), clusters.tolist(), capacity)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].to_numpy(),
                "part": rows["part"].to_numpy(),
                "n_tokens": rows["n_tokens"].to_numpy(),
                "bin_id": [key[0] * (1 << 32) + b for b in bins],
                "bin_offset": offsets,
            }
        )

    done = parts.groupBy("grp").applyInPandas(pack, "doc_id string, part int, n_tokens int, bin_id long, bin_offset int")
    return done.select(F.col("doc_id").cast(id_type), "part", (F.col("part").cast("long") * capacity).alias("doc_offset"), "n_tokens", "bin_id", "bin_offset")


def sequences(placed: DataFrame, tokens: DataFrame) -> DataFrame:
    """The bins laid out: (bin_id, token_ids, segments, loss_mask, documents).

    ``placed`` is what ``packed`` gives, ``tokens`` has doc_id (each once, not null)
    and token_ids. ``segments`` numbers the document of each token in its bin from
    1; ``loss_mask`` is 0 at the first token of each, which nothing before it in
    the bin foretells; ``documents`` are the bin's (doc_id, doc_offset, bin_offset).
    A bin holds no more than the capacity. Parts without tokens, and rows without a
    document in ``tokens``, take no place.
    """
    part = F.slice("token_ids", (F.col("doc_offset") + 1).cast("int"), F.col("n_tokens"))
    rows = placed.where("n_tokens > 0").join(tokens.select("doc_id", "token_ids"), "doc_id")
    row = F.struct("bin_offset", "doc_id", "doc_offset", part.alias("ids"))
    bins = rows.groupBy("bin_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return bins.select(
        "bin_id",
        F.flatten(F.transform("rows", lambda r: r["ids"])).alias("token_ids"),
        F.flatten(F.transform("rows", lambda r, k: F.array_repeat(k + 1, F.size(r["ids"])))).alias("segments"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["ids"], lambda _, k: (k > 0).cast("int")))).alias("loss_mask"),
        F.transform("rows", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["doc_offset"].alias("doc_offset"), r["bin_offset"].alias("bin_offset"))).alias("documents"),
    )


def document_items(docs: DataFrame) -> DataFrame:
    """Items of whole documents: size in words; exact copies make a cluster; empty texts have none."""
    return docs.select(
        "doc_id",
        word_count(F.col("text")).alias("size"),
        "source",
        F.when(F.length("text") > 0, F.xxhash64("text")).alias("cluster"),
    )


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed, near copies apart; null and empty texts are items of size zero, the rest is as in ``packed``."""
    docs = common.plain(common.table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    items = docs.select("doc_id", word_count(F.col("text")).alias("size"), "source", F.lit(None).cast("string").alias("cluster"), "text")
    return packed(items, text="text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what the near-duplicate stage left; no two of its texts with words are linked, so their classes are
    single rows, which the exact copies' clusters say as well without a second join.

    Null and empty texts are items of size zero; null ids and sources, repeated rows
    and an empty table are as in ``packed``; other columns are not looked at.
    """
    return packed(document_items(common.plain(docs, "doc_id", "text", "source")))
