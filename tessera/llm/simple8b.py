"""Token-id output in Simple-8b words: 4 bits of selector and 60 of ids, coded and decoded in numpy.

Selector s packs COUNT[s] ids of WIDTH[s] bits. Selector 1 is a run of up to 120 zeros. Selector 0 is
the escape: the word after it is one id of 60 bits or more, as it is. Ids are cut into blocks of
BLOCK, each starting at a word of its own whose place is kept, so that blocks decode alone and all at
once. Within a block each word takes the selector that covers most ids; a block's last word may
have fewer ids than its selector, the rest being zeros.

Defined results: a null or empty text has no words and no offsets; negative ids raise ValueError; rows
repeat as they come; an empty table gives an empty result; only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Recent, starts_of, table, text_slices

BLOCK = 512
WIDTH = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bit lengths of uint64 ids."""
    if not len(ids) or ids.max() < np.uint64(1 << 53):  # a double's exponent is exact
        return np.frexp(ids.astype(np.float64))[1].astype(np.int64)
    out = np.zeros(len(ids), np.int64)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.uint64(1) << np.uint64(step)
        out[high] += step
        rest[high] >>= np.uint64(step)
    return out + (rest > 0)


def _choose(bits: np.ndarray, end: np.ndarray, take: np.ndarray, choice: np.ndarray) -> None:
    """Fill in the best selector for a word that begins at each id, and how many ids it takes."""
    n = len(bits)
    here = np.arange(n, dtype=np.int32)
    room = end - here
    bits = bits.astype(np.int8)
    low, high = int(bits.min()), int(bits.max())
    for s in range(15, 0, -1):
        w, c = int(WIDTH[s]), int(COUNT[s])
        if w < low or (s > 2 and WIDTH[s - 1] >= high):
            continue  # no id is so narrow, or a narrower selector holds them all
        full = np.minimum(room, c)
        if w >= high:
            reach = room
        else:
            wall = np.where(bits > w, here, np.int32(n))
            reach = np.minimum(np.minimum.accumulate(wall[::-1])[::-1], end) - here
        good = (reach >= full) & ((full > take) | (choice == 0))
        np.copyto(take, full, where=good, casting="unsafe")
        np.copyto(choice, s, where=good, casting="unsafe")


def encode(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ids, laid end to end -> words, each block's first word (within its row), words by row."""
    if len(ids) and ids.dtype.kind == "i" and ids.min() < 0:
        raise ValueError("ids must not be negative")
    ids = ids.astype(np.uint64)
    blocks = -(-lengths // block)  # of each row
    row = np.repeat(np.arange(len(lengths)), blocks)
    first = starts_of(lengths)[:-1][row] + block * (np.arange(len(row)) - np.repeat(starts_of(blocks)[:-1], blocks))
    last = np.minimum(first + block, starts_of(lengths)[1:][row])
    n = len(ids)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), none, np.zeros(len(lengths), np.int64)
    # How far each id sees: for every width, up to the next wider id or the block's end.
    take, choice = np.ones(n, np.int16), np.zeros(n, np.int8)
    group = max(1, (1 << 15) // block)  # blocks at once: their arrays stay in the cache
    for k in range(0, len(first), group):
        a, b = first[k], last[min(k + group, len(first)) - 1]
        end = np.repeat(last[k : k + group] - a, last[k : k + group] - first[k : k + group]).astype(np.int32)
        _choose(_bits(ids[a:b]), end, take[a:b], choice[a:b])
    # All blocks step together from word to word.
    at, live, begins, owners = first.copy(), np.arange(len(first)), [], []
    while len(live):
        begins.append(at[live])
        owners.append(live)
        at[live] += take[at[live]]
        live = live[at[live] < last[live]]
    begin, owner = np.concatenate(begins), np.concatenate(owners)
    order = np.argsort(begin, kind="stable")
    begin, owner = begin[order], owner[order]
    kind = choice[begin].astype(np.int64)
    width = np.where(kind == 0, 2, 1)  # an escape takes two words
    place = starts_of(width)
    words = np.zeros(place[-1], np.uint64)
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        if s == 0:
            words[place[mine] + 1] = ids[begin[mine]]
        elif s > 1:
            span = begin[mine, None] + np.arange(COUNT[s])
            value = np.where(span < last[owner[mine], None], ids[np.minimum(span, n - 1)], 0)
            value = value << (np.arange(COUNT[s], dtype=np.uint64) * np.uint64(WIDTH[s]))
            words[place[mine]] = np.bitwise_or.reduce(value, 1) | (np.uint64(s) << np.uint64(60))
        else:
            words[place[mine]] = np.uint64(1) << np.uint64(60)
    per_block = np.bincount(owner, width, len(first)).astype(np.int64)
    per_row = np.bincount(row, per_block, len(lengths)).astype(np.int64)
    offsets = starts_of(per_block)[:-1] - starts_of(per_row)[:-1][row]
    return words, offsets, per_row


def decode(words: np.ndarray, n: int, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The n ids of one row, all blocks at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    kind = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    for p in np.flatnonzero(kind == 0):
        if not raw[p]:
            raw[p + 1] = True
    raw = raw[:-1]
    count = np.where(raw, 0, COUNT[kind])
    # A block's last word may be part filled: positions are counted within the block and cut at its end.
    owner = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    running = starts_of(count)
    position = running[:-1] - running[offsets[owner]] + owner * block
    stop = np.minimum((owner + 1) * block, n)
    for s in np.unique(kind[~raw]):
        mine = np.flatnonzero((kind == s) & ~raw)
        if s == 0:
            out[position[mine]] = words[mine + 1]
        elif s > 1:
            span = position[mine, None] + np.arange(COUNT[s])
            value = (words[mine, None] >> (np.arange(COUNT[s], dtype=np.uint64) * np.uint64(WIDTH[s]))) & ((np.uint64(1) << np.uint64(WIDTH[s])) - np.uint64(1))
            ok = span < stop[mine, None]
            out[span[ok]] = value[ok]
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A worker's encoder: text -> int32 ids as bytes. path: a vocabulary of ranks."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in Path(path).read_bytes().splitlines() if x.strip())}
    encoding = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def word_ids(lead: str, word: str) -> bytes | None:
        """Of the text between two single spaces, over which no piece reaches; None where blanks adjoin."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return array("i", encoding.encode_ordinary(lead + word)).tobytes()

    inner, first = Recent(lambda w: word_ids(" ", w)), Recent(lambda w: word_ids("", w))

    def ids_of(text: str) -> bytes:
        head, *rest = text.split(" ")
        try:
            return first[head] + b"".join(map(inner.__getitem__, rest))
        except TypeError:  # blanks adjoin, which the whole pattern has to see
            return np.array(encoding.encode_ordinary(text), np.int32).tobytes()

    return ids_of


def _columns(words, offsets, per_row, lengths, block):
    at = starts_of(per_row * 8)
    flat = words.astype("<u8").tobytes()
    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
    lists = pa.ListArray.from_arrays(pa.array(starts_of(-(-lengths // block)), pa.int32()), pa.array(offsets, pa.int32()))
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int32()), binary, lists], ["n", "words", "offsets"])


def packer(path: str = VOCABULARY, block: int = BLOCK):
    """A column function: text -> struct(n, words, offsets)."""

    def run(texts: pa.Array) -> pa.Array:
        ids_of = tokenizer(path)
        parts = []
        for _, rows in text_slices(texts):
            got = [ids_of(x) for x in rows]
            lengths = np.fromiter((len(g) // 4 for g in got), np.int64, len(got))
            parts.append(_columns(*encode(np.frombuffer(b"".join(got), np.int32), lengths, block), lengths, block))
        kind = pa.struct([("n", pa.int32()), ("words", pa.binary()), ("offsets", pa.list_(pa.int32()))])
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return arrow_udf(run, "struct<n: int, words: binary, offsets: array<int>>")


def coder(block: int = BLOCK):
    """A column function: array of ids -> struct(n, words, offsets); a null counts as empty, null ids raise."""

    def run(ids: pa.Array) -> pa.Array:
        rows = [np.array(x or [], np.int64) for x in ids.to_pylist()]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return _columns(*encode(np.concatenate(rows) if rows else np.zeros(0, np.int64), lengths, block), lengths, block)

    return arrow_udf(run, "struct<n: int, words: binary, offsets: array<int>>")


def unpacker(block: int = BLOCK):
    """A column function: (n, words, offsets) -> array<bigint> of ids (ids of 63 bits and less)."""

    def run(n: pa.Array, words: pa.Array, offsets: pa.Array) -> pa.Array:
        out = [decode(np.frombuffer(w or b"", "<u8"), k or 0, np.array(o or [], np.int64), block).astype(np.int64) for k, w, o in zip(n.to_pylist(), words.to_pylist(), offsets.to_pylist())]
        return pa.array([x.tolist() for x in out], pa.list_(pa.int64()))

    return arrow_udf(run, "array<bigint>")


def pack_documents(documents: DataFrame, path: str = VOCABULARY, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, words, block_offsets) for each row of documents."""
    got = documents.select(F.col(id_col).alias(id_col), packer(path, block)(F.col(text_col)).alias("p"))
    return got.select(id_col, F.col("p.n").alias("n_tokens"), F.col("p.words").alias("words"), F.col("p.offsets").alias("block_offsets"))


def unpack_documents(packed: DataFrame, block: int = BLOCK, id_col: str = "doc_id") -> DataFrame:
    """(id, token_ids) for each row of packed documents."""
    return packed.select(F.col(id_col).alias(id_col), unpacker(block)("n_tokens", "words", "block_offsets").alias("token_ids"))


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
