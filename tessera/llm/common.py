"""Helpers that the training-data operators share: scratch tables, batches, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Workspace


class Scratch(Workspace):
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them."""

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self.keep(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about `most` characters; a null counts as ''."""
    rows, size, first = [], 0, 0
    for i, x in enumerate(texts.to_pylist()):
        x = x or ""
        if rows and size + len(x) > most:
            yield first, rows
            rows, size, first = [], 0, i
        rows.append(x)
        size += len(x)
    if rows:
        yield first, rows


def array_slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[pa.Array]:
    """The texts in runs of about `most` bytes; a null counts as ''."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
        yield texts.slice(first, last - first)
        first = last


def tokenized(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct tokens between white space, each token's index among them, and the number of tokens by text.

    Splitting and numbering run in Arrow; only distinct tokens become Python strings.
    """
    lists = pc.utf8_split_whitespace(texts)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    if "" in words:  # before leading and after closing white space
        some = index != words.index("")
        owner = np.repeat(np.arange(len(sizes)), sizes)[some]
        index, sizes = index[some], np.bincount(owner, minlength=len(sizes))
    return words, index, sizes


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs: 0, then the running sum."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]]; an empty run gives 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def bounded_sample(df: DataFrame, key: str, most: int, by: str | None = None) -> DataFrame:
    """About `most` rows (of each value of `by`), picked by the key's hash: the same rows on every run.

    One counting job; the kept share is most / count, so the size doesn't grow with the table.
    """
    spread = F.pmod(F.xxhash64(F.lit(17), F.col(key).cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    if by is None:
        n = df.count()
        return df.filter(spread < F.lit(most / max(n, 1))) if n > most else df
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}  # one row for each class
    kept = F.lit(False)
    for value, n in counts.items():
        share = spread < F.lit(most / max(n, 1)) if n > most else F.lit(True)
        kept = kept | (F.col(by).eqNullSafe(F.lit(value)) & share)
    return df.filter(kept)


class Recent(dict):
    """What `make` gives by key, kept for the keys met lately: at most `most` of up to 64 characters.

    Two generations: when the young one holds half of `most`, it takes the place of the old one. Workers serve one operator
    after another: of the memos that are to be alone in theirs, only the one last asked for something new holds anything.
    """

    _holder: Recent | None = None

    def __init__(self, make, most: int = 600_000, alone: bool = False):
        super().__init__()
        self.alone = alone
        self.make, self.half, self.old = make, most // 2, {}

    def __missing__(self, key: str):
        if self.alone and Recent._holder is not self:
            if Recent._holder is not None:
                Recent._holder.clear()
                Recent._holder.old = {}
            Recent._holder = self
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
