"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree hold, for each live token, the rank of the pair that it makes with its
successor, joined with its position; a node holds the least of its two. So the root is the leftmost
lowest-rank merge. A merge is three point updates, each logarithmic, until the root says that no
mergeable pair remains: O(n log n) however long the piece.

Workers keep the ids of the pieces they met lately, a bounded number. Where
a text has only single spaces between non-blanks, no piece can reach over one, so that it is looked up
word by word; other texts are split by the full pattern.

Defined results: a null or empty text has no ids; lone surrogates can't occur in a UTF-8 column;
rows repeat as they come; an empty table gives an empty result; only the named columns are read, so
others may have any name. Ids that aren't in the vocabulary can't be decoded and raise KeyError.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Recent, starts_of, table, text_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 62


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece by repeated merging of its leftmost lowest-rank pair."""
    whole = ranks.get(piece)
    if whole is not None and len(piece) == 1:
        return [whole]
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    size = 1 << max(0, (n - 2).bit_length())  # leaves: a power of two for the n - 1 pairs
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        part[i] += part[j]
        part[j] = b""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = get(part[i] + part[k])
            put(i, _NONE if r is None else r << 32 | i)
        else:
            put(i, _NONE)
        if j < n - 1:
            put(j, _NONE)
        h = before[i]
        if h >= 0:
            r = get(part[h] + part[i])
            put(h, _NONE if r is None else r << 32 | h)
    return [ranks[p] for p in part if p]


class Bpe:
    """A vocabulary of ranks (base64 token, blank, rank a line) with its encoder and decoder."""

    def __init__(self, path: str):
        lines = Path(path).read_bytes().splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(PATTERN)
        self.pieces = Recent(self._piece)
        self.inner, self.first = Recent(lambda w: self._word(" ", w)), Recent(lambda w: self._word("", w))

    def _piece(self, piece: str) -> bytes:
        """A piece's ids as int32."""
        return array("i", merge_piece(piece.encode("utf-8"), self.ranks)).tobytes()

    def _word(self, lead: str, word: str) -> bytes | None:
        """The ids of the text between two single spaces; None where blanks adjoin."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(lead + word)))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian int32."""
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.inner.__getitem__, rest))
        except TypeError:  # a None: blanks adjoin, which the whole pattern has to see
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.int32)

    def decode(self, ids) -> str:
        of = self.tokens
        return b"".join([of[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One encoder a worker and path."""
    return Bpe(path)


def _encode(path: str, texts: pa.Array) -> pa.Array:
    bpe = load(path)
    got = [bpe.encode_bytes(x) for _, rows in text_slices(texts) for x in rows]
    offsets = starts_of(np.fromiter((len(g) // 4 for g in got), np.int64, len(got)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(got), np.int32)))


def _decode(path: str, ids: pa.Array) -> pa.Array:
    bpe = load(path)
    flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()  # a row's ids at a time become objects
    return pa.array([bpe.decode(flat[a:b] if some else []) for a, b, some in zip(at, at[1:], ids.is_valid().to_pylist())], pa.string())


def encoder(path: str = VOCABULARY):
    """A column function: text -> array<int> of ids."""

    def encode(texts: pa.Array) -> pa.Array:
        return _encode(path, texts)

    return arrow_udf(encode, "array<int>")


def decoder(path: str = VOCABULARY):
    """A column function: array<int> -> text; a null gives ''."""

    def decode(ids: pa.Array) -> pa.Array:
        return _decode(path, ids)

    return arrow_udf(decode, "string")


def both_ways(path: str = VOCABULARY):
    """A column function: text -> struct of its ids and the text that they decode to; as decoder() of encoder() Spark would encode twice."""

    def both(texts: pa.Array) -> pa.Array:
        ids = _encode(path, texts)
        return pa.StructArray.from_arrays([ids, _decode(path, ids)], ["token_ids", "text"])

    return arrow_udf(both, "struct<token_ids: array<int>, text: string>")


def encode_documents(documents: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids, n_tokens) for each row of documents."""
    got = documents.select(F.col(id_col).alias(id_col), encoder(path)(F.col(text_col)).alias("token_ids"))
    return got.withColumn("n_tokens", F.size("token_ids"))


def decode_documents(encoded: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text) for each row of encoded documents."""
    return encoded.select(F.col(id_col).alias(id_col), decoder(path)(F.col(ids_col)).alias("text"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token_ids, n_tokens, text): the ids of each document, and the text that they decode to."""
    got = table(spark, sf_dir, "documents").select("doc_id", both_ways()(F.col("text")).alias("b"))
    return got.select("doc_id", "b.token_ids", F.size("b.token_ids").alias("n_tokens"), "b.text")
