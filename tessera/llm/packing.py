"""Conflict-constrained best-fit packing of documents into fixed-length training sequences.

A document longer than a sequence is cut into full pieces, which fill a bin each, and a rest. Rests
and short documents are packed best-fit decreasing: bins are kept in order of their residual, each
with a bitmap of the sources and one of the duplicate clusters it holds, and the search walks from
the tightest residual that fits to its successors until a bin shares neither with the document.
Only clusters of two or more members have a bit, since others can't conflict. The query's clusters
are the groups of near copies that minhash finds; a text without words forms one with its equals.

Bins never cross shards. A shard is a slice of the documents by the id's hash (of what else it has where the id is
null), packed whole in one task, so conflicts are exact. Their number is a parameter; like that of any shuffle it is by default
what the session sets in spark.sql.shuffle.partitions.

Defined results: a null or empty text has no tokens and is in no bin; a null source or cluster
conflicts with none; a null id is packed like others; equal rows are packed each, one to a bin, as
they are duplicates; ties go by id, then by text digest. An empty table gives an empty result. Only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash
from .common import table

CAPACITY = 2048
#: Share of minima from which the pipeline keeps two texts apart that its near-duplicate stage let both stay.
RELATED = 0.3
TOKEN = r"[^\s\p{P}]+|\p{P}"


def count_tokens(text: Column) -> Column:
    """Words and punctuation marks of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def plain_hash(text: Column) -> Column:
    """Equal for texts that are equal but for case and white space."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.concat(F.hex(F.xxhash64(plain)), F.hex(F.crc32(plain)))


class Bins:
    """Open bins ordered by residual; at each residual they are grouped by equal bitmaps."""

    def __init__(self, capacity: int):
        self.levels: list[int] = []  # residuals that have bins, ascending
        self.at: dict[int, dict[tuple[int, int], list[int]]] = {}  # residual -> (sources, clusters) -> bins
        self.capacity, self.opened = capacity, 0

    def _put(self, residual: int, sources: int, clusters: int, number: int) -> None:
        if residual <= 0:
            return
        level = self.at.get(residual)
        if level is None:
            insort(self.levels, residual)
            level = self.at[residual] = {}
        insort(level.setdefault((sources, clusters), []), number)

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bitmaps of the document -> (bin, offset in it): the tightest compatible bin, the oldest of equals."""
        for k in range(bisect_left(self.levels, size), len(self.levels)):
            residual = self.levels[k]
            level = self.at[residual]
            best = None
            for key, numbers in level.items():
                if not (key[0] & source or key[1] & cluster) and (best is None or numbers[0] < level[best][0]):
                    best = key
            if best is not None:
                numbers = level[best]
                number = numbers.pop(0)
                if not numbers:
                    del level[best]
                    if not level:
                        del self.at[residual]
                        self.levels.pop(k)
                self._put(residual - size, best[0] | source, best[1] | cluster, number)
                return number, self.capacity - residual
        number, self.opened = self.opened, self.opened + 1
        self._put(self.capacity - size, source, cluster, number)
        return number, 0


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each document, given in the order of packing; sizes are at most capacity."""
    bins = Bins(capacity)
    source_bit: dict = {}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit: dict = {}
    out = []
    for size, s, c in zip(sizes, sources, clusters):
        sb = 0 if s is None else 1 << source_bit.setdefault(s, len(source_bit))
        cb = 0 if c is None or seen[c] < 2 else 1 << cluster_bit.setdefault(c, len(cluster_bit))
        out.append(bins.place(size, sb, cb))
    return out


def _pack_shard(capacity: int):
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("rest", "descending"), ("order", "ascending"), ("cluster", "ascending")])
        number, tokens = shard.column("shard")[0].as_py(), shard.column("tokens").to_numpy()
        rest, full = shard.column("rest").to_numpy(), tokens // capacity
        some = np.flatnonzero(rest > 0)
        pick = shard.take(pa.array(some))
        placed = pack(pick.column("rest").to_pylist(), pick.column("source").to_pylist(), pick.column("cluster").to_pylist(), capacity)
        opened = 1 + max((b for b, _ in placed), default=-1)
        # Full pieces: a bin each, after the shared ones.
        row = np.concatenate([some, np.repeat(np.arange(len(full)), full)]).astype(np.int64)
        ordinal = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
        bins = np.concatenate([[b for b, _ in placed], opened + np.arange(full.sum())]).astype(np.int64)
        offset = np.concatenate([[o for _, o in placed], np.zeros(full.sum())]).astype(np.int64)
        begin = np.concatenate([full[some] * capacity, ordinal * capacity]).astype(np.int64)
        length = np.concatenate([rest[some], np.full(full.sum(), capacity)]).astype(np.int64)
        return pa.table({"shard": pa.array(np.full(len(row), number), pa.int64()), "bin": pa.array(bins), "id": shard.column("id").take(pa.array(row)), "bin_offset": pa.array(offset), "doc_offset": pa.array(begin), "length": pa.array(length)})

    return run


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, tokens: Column | None = None) -> DataFrame:
    """(shard, bin, id, bin_offset, doc_offset, length): where each piece of each document lies.

    tokens: the length of a row's document, by default its words and punctuation marks. cluster_col: its
    duplicate cluster; by default documents whose texts are equal but for case and white space form one.
    """
    text = F.col(text_col)
    cluster = F.col(cluster_col).cast("string") if cluster_col else plain_hash(text)
    rows = documents.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), (tokens if tokens is not None else count_tokens(text)).cast("bigint").alias("tokens"),
    ).filter("tokens > 0")
    shards = shards or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.when(F.col("id").isNotNull(), F.xxhash64(F.lit(3), F.col("id").cast("string"))).otherwise(F.xxhash64("source", "cluster", "tokens"))
    rows = rows.select(F.pmod(key, F.lit(shards)).alias("shard"), "id", "source", "cluster", "tokens", (F.col("tokens") % capacity).alias("rest"), F.col("id").alias("order"))
    kind = documents.schema[id_col].dataType.simpleString()
    got = rows.groupBy("shard").applyInArrow(_pack_shard(capacity), f"shard bigint, bin bigint, id {kind}, bin_offset bigint, doc_offset bigint, length bigint")
    return got.withColumnRenamed("id", id_col)


def near_clusters(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", threshold: float = minhash.THRESHOLD) -> DataFrame:
    """(id, source, tokens, cluster): near copies have one cluster, and so have texts without words that are equal but for case and white space."""
    text = F.col(text_col)
    bare = F.when(~text.rlike(r"[\p{L}\p{N}]"), plain_hash(text))
    rows = documents.select(F.col(id_col), F.col(source_col), text, count_tokens(text).alias("tokens"), bare.alias("bare"))
    return minhash.clusters(rows, text_col, threshold).select(id_col, source_col, "tokens", F.coalesce("cluster", "bare").alias("cluster"))


def op3_bestfit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(near_clusters(table(spark, sf_dir, "documents")), cluster_col="cluster", tokens=F.col("tokens"))
