"""Telephony audio columns: mu-law, A-law and IMA ADPCM to 16-bit PCM at another rate.

G.711 bytes are expanded by lookup tables of 256 samples. ADPCM is decoded across blocks: all blocks
of a batch go through one nibble at a time together, so the loop is as long as a block and not as the
audio. Samples are resampled by a windowed-sinc polyphase filter, silence lying beyond both ends, and
stored as little-endian 16-bit PCM.

An ADPCM block is 4 bytes of header (first sample as int16, step index, one unused) and nibbles, low
one first. Defined results: a null payload or an unknown or null codec gives null PCM and no sample
count; an empty payload gives empty PCM; a closing block of under 4 bytes is dropped; a step index over
88 counts as 88; rows repeat as they come; an empty table gives an empty result. Only the named
columns are read, so others may have any name. Payloads are decoded whole.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import starts_of, table

CODECS = ("ulaw", "alaw", "ima")
SOURCE, TARGET, BLOCK, TAPS, SLICE = 8000, 16000, 256, 16, 1 << 20


def _ulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)
    return np.where(u & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    exponent, mantissa = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


ULAW, ALAW = _ulaw_table(), _alaw_table()
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
_CODE = np.arange(16)
_MOVE = np.where(_CODE & 7 < 4, -1, 2 * (_CODE & 3) + 2)
_DELTA = (STEPS[:, None] >> 3) + np.where(_CODE & 4, STEPS[:, None], 0) + np.where(_CODE & 2, STEPS[:, None] >> 1, 0) + np.where(_CODE & 1, STEPS[:, None] >> 2, 0)
_DELTA = np.where(_CODE & 8, -_DELTA, _DELTA)
_NEXT = np.clip(np.arange(89)[:, None] + _MOVE, 0, 88)


def decode_ima(payloads: list[bytes], block: int = BLOCK) -> list[np.ndarray]:
    """The samples of each payload, all blocks of all payloads decoded in step."""
    pieces = [p[i : i + block] for p in payloads for i in range(0, len(p), block) if len(p) - i >= 4]
    counts = [sum(len(p) - i >= 4 for i in range(0, len(p), block)) for p in payloads]
    if not pieces:
        return [np.zeros(0, np.int16) for _ in payloads]
    sizes = np.array([len(x) for x in pieces])
    data = np.zeros((len(pieces), block), np.uint8)
    data.reshape(-1)[np.repeat(np.arange(len(pieces)) * block, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(b"".join(pieces), np.uint8)
    value = data[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.minimum(data[:, 2], 88).astype(np.int64)
    longest = int(sizes.max()) - 4
    nibbles = np.empty((2 * longest, len(pieces)), np.int64)
    nibbles[0::2], nibbles[1::2] = (data[:, 4 : 4 + longest] & 15).T, (data[:, 4 : 4 + longest] >> 4).T
    out = np.empty((2 * longest + 1, len(pieces)), np.int16)
    out[0] = value
    for t, code in enumerate(nibbles, 1):
        value = np.clip(value + _DELTA[index, code], -32768, 32767)
        index = _NEXT[index, code]
        out[t] = value
    rows = [column[: 2 * (n - 4) + 1] for column, n in zip(np.ascontiguousarray(out.T), sizes)]
    at = starts_of(np.array(counts))
    return [np.concatenate(rows[a:b]) if b > a else np.zeros(0, np.int16) for a, b in zip(at[:-1], at[1:])]


def sinc_filter(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Low-pass at the lower of both Nyquist rates, at the up-sampled rate: 2 * taps * max(up, down) + 1 weights."""
    wide = max(up, down)
    t = np.arange(-taps * wide, taps * wide + 1)
    return np.sinc(t / wide) * np.hanning(len(t) + 2)[1:-1] * (up / wide)


def resample(x: np.ndarray, source: int = SOURCE, target: int = TARGET, taps: int = TAPS) -> np.ndarray:
    """int16 samples at the target rate: ceil(n * target / source) of them."""
    g = gcd(source, target)
    up, down = target // g, source // g
    n = -(-len(x) * up // down)
    if not len(x) or up == down:
        return x.astype(np.int16)
    h = sinc_filter(up, down, taps)
    half = len(h) // 2
    y = np.empty(n)
    signal = x.astype(np.float64)
    for phase in range(min(up, n)):  # outputs m = phase, phase + up, ... share one subset of the weights
        m = np.arange(phase, n, up)
        first = m[0] * down + half  # output m is the sum of x[i] * h[m * down + half - i * up]
        branch = h[first % up :: up]
        full = np.convolve(signal, branch)
        y[m] = full[np.minimum(first // up + (m - m[0]) // up * down, len(full) - 1)]
    return np.clip(np.rint(y), -32768, 32767).astype(np.int16)


def decode(payloads: list[bytes | None], codecs: list[str | None], block: int = BLOCK) -> list[np.ndarray | None]:
    """The PCM of each payload at its own rate."""
    out: list[np.ndarray | None] = [None] * len(payloads)
    for name, law in (("ulaw", ULAW), ("alaw", ALAW)):
        for i, (p, c) in enumerate(zip(payloads, codecs)):
            if c == name and p is not None:
                out[i] = law[np.frombuffer(p, np.uint8)]
    at = [i for i, (p, c) in enumerate(zip(payloads, codecs)) if c == "ima" and p is not None]
    for i, x in zip(at, decode_ima([payloads[i] for i in at], block)):
        out[i] = x
    return out


def _decode_batches(source: int, target: int, block: int, kind: pa.DataType):
    def emit(rows):
        pcm = decode([r[2] for r in rows], [r[1] for r in rows], block)
        pcm = [None if x is None else resample(x, source, target) for x in pcm]
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array([None if x is None else target for x in pcm], pa.int32()),
            pa.array([None if x is None else len(x) for x in pcm], pa.int64()), pa.array([None if x is None else x.astype("<i2").tobytes() for x in pcm], pa.binary()),
        ], ["id", "codec", "sample_rate", "n_samples", "pcm"])

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for i, codec, payload in zip(batch.column("id").to_pylist(), batch.column("codec").to_pylist(), batch.column("payload")):
                payload = payload.as_py()
                rows.append((i, codec, payload))
                size += len(payload or b"")
                if size >= SLICE or len(rows) >= 4096:  # output is up to 8 bytes a byte: small batches
                    yield emit(rows)
                    rows, size = [], 0
            if rows:
                yield emit(rows)

    return run


def decode_audio(media: DataFrame, source: int = SOURCE, target: int = TARGET, block: int = BLOCK, id_col: str = "id", payload_col: str = "payload", codec_col: str = "codec") -> DataFrame:
    """(id, codec, sample_rate, n_samples, pcm) for each row of media; its id is an integer or a string."""
    rows = media.select(F.col(id_col).alias("id"), F.col(codec_col).cast("string").alias("codec"), F.col(payload_col).cast("binary").alias("payload"))
    spark_kind = rows.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    got = rows.mapInArrow(_decode_batches(source, target, block, to_arrow_type(rows.schema["id"].dataType)), f"id {spark_kind}, codec string, sample_rate int, n_samples bigint, pcm binary")
    return got.withColumnRenamed("id", id_col)


def page_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, codec, payload): no table has audio, so the bytes of each page stand for a call's, coded by turns in the three codecs."""
    codec = F.element_at(F.array(*map(F.lit, CODECS)), (F.pmod("page_id", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", codec.alias("codec"), F.col("html").cast("binary").alias("payload"))


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_audio(page_audio(spark, sf_dir), id_col="page_id")
