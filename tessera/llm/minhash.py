"""Near-duplicate groups: universal-hash minima, banding, signature verification, star components.

Words are runs without white space, lower-cased and stripped of punctuation at their edges; a
text's shingles are its runs of `SHINGLE` words (all its words where it has fewer). PERMS
multiply-shift minima make the signature. Texts of equal signature are one node. Nodes that share a
band are compared by whole signatures and joined where at least `threshold` of the minima agree;
groups are the connected components of all verified pairs, found by alternating large-star and small-star.

Components are made without making all pairs (see _edges): copies by the thousand cost one comparison each.

Defined results: a null text, or one without words, is in no group (its own only). Ids may repeat: a
group is one of texts, so rows of one id with unlike texts are in unlike groups, and no text goes for
its id's sake. groups() drops null ids, deduplicate() compares their rows like others. An empty table gives
an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..operators.components import components
from .common import Recent, Scratch, array_slices, starts_of, table, tokenized

PERMS, BANDS, SHINGLE, THRESHOLD = 128, 32, 3, 0.5
CHUNK = 4096  # members of a bucket that are compared in one group
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(raw: str) -> int:
    """64-bit hash of a raw token; 0 for a token of punctuation only."""
    word = _EDGE.sub("", raw.lower())
    return (int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") | 1) if word else 0


_words = Recent(_word_hash, alone=True)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Mixed shingle hashes of all texts in a row, and each text's offsets."""
    distinct, index, sizes = tokenized(texts)
    word = np.fromiter(map(_words.__getitem__, distinct), np.uint64, len(distinct))[index]
    doc = np.repeat(np.arange(len(texts)), sizes)[word > 0]
    word = word[word > 0]
    n = np.bincount(doc, minlength=len(texts))
    at = starts_of(n)
    # Windows may begin at all but a text's last SHINGLE - 1 words; a short text has one window over all of it.
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begin = np.repeat(at[:-1], made) + (np.arange(made.sum()) - np.repeat(starts_of(made)[:-1], made))
    end = np.repeat(at[1:], made)
    out = np.zeros(len(begin), np.uint64)
    for k in range(SHINGLE):
        here = begin + k
        out = (out ^ (out >> np.uint64(31))) * _P + np.where(here < end, word[np.minimum(here, len(word) - 1)] if len(word) else 0, 0).astype(np.uint64)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(27)), starts_of(made)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """[texts, PERMS] minima as uint32, and which texts have any word; no text is null."""
    x, at = shingles(texts)
    n = np.diff(at)
    some = n > 0
    out = np.full((len(texts), PERMS), 0xFFFFFFFF, np.uint32)
    rows = np.flatnonzero(some)
    cell = 1 << 14  # shingles at once: they stay in the cache over all permutations
    first = 0
    while first < len(rows):
        last = first + 1
        while last < len(rows) and at[rows[last] + 1] - at[rows[first]] <= cell:
            last += 1
        a, b = at[rows[first]], at[rows[last - 1] + 1]
        if last == first + 1:  # one text, perhaps a very long one
            for c in range(a, b, cell):
                part = x[c : min(b, c + cell)]
                low = np.array([((part * _A[p] + _B[p]) >> np.uint64(32)).min() for p in range(PERMS)]).astype(np.uint32)
                out[rows[first]] = np.minimum(out[rows[first]], low)
        else:
            part, cuts = x[a:b], (at[rows[first:last]] - a)
            for p in range(PERMS):
                out[rows[first:last], p] = np.minimum.reduceat((part * _A[p] + _B[p]) >> np.uint64(32), cuts)
        first = last
    return out, some


def _signature(texts: pa.Array) -> pa.Array:
    sig: list[bytes | None] = []
    for part in array_slices(texts):
        got, some = signatures(part)
        sig += [r.tobytes() if s else None for r, s in zip(got, some)]
    dg = [hashlib.md5(s).digest() if s else None for s in sig]
    return pa.StructArray.from_arrays([pa.array(sig, pa.binary()), pa.array(dg, pa.binary())], ["sig", "dg"])


def signature(text):
    """A text column's struct(sig, dg): the minima, and their digest; nulls where there's no word."""
    return arrow_udf(_signature, "struct<sig: binary, dg: binary>")(text)


def _agree(u: pa.Array, v: pa.Array) -> np.ndarray:
    """How many minima the signatures in two columns share, row by row."""
    sig = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(-1, PERMS)
    return (sig(u) == sig(v)).sum(1)


def _held(threshold: float):
    """The pairs with whether their signatures agree."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                b = batch.slice(k, 4096)
                near = pa.array(_agree(b.column("su"), b.column("sv")) >= threshold * PERMS)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("least", "node", "u", "v")), near], ["least", "node", "u", "v", "near"])

    return run


def _walk(threshold: float):
    """Edges of a spanning forest of each group's verified graph."""

    def walk(batches):
        for batch in batches:
            us: list[bytes] = []
            vs: list[bytes] = []
            for members in batch.column("members").to_pylist():
                dg = [m["dg"] for m in members]
                sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint32).reshape(len(members), PERMS)
                left = np.arange(len(members))
                while len(left):
                    queue, left = [int(left[0])], left[1:]
                    while queue and len(left):
                        at = queue.pop()
                        near = (sig[left] == sig[at]).sum(1) >= threshold * PERMS
                        found = left[near].tolist()
                        us += [dg[at]] * len(found)
                        vs += [dg[i] for i in found]
                        queue += found
                        left = left[~near]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    return walk


def _signed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with their struct s of signature() taken apart, written."""
    rest = [c for c in rows.columns if c != "s"]
    return scratch.table(rows.select(*rest, F.col("s.sig").alias("sig"), F.col("s.dg").alias("dg")), "signatures")


def _edges(sigs: DataFrame, threshold: float, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """(u, v): verified pairs of digests that hold each group together, each once, u > v; written.

    Each member of a band's bucket is held against the bucket's least node. A bucket all of whose members agree with it is
    done, so are those of near copies, whatever their number. In the others all pairs are compared, since their verified
    graph may hang together by other members. That is done in groups of at most about `chunk` members: a larger
    bucket is cut in parts by the node, and each two of its parts make a group, so that no group grows with the bucket and
    no pair is left out. A set that meets in many bands is walked once. node: 8 bytes of a digest, enough to bring
    candidates together; the digest itself decides.
    """
    worded = sigs.filter(F.col("sig").isNotNull())
    nodes = scratch.table(worded.groupBy(F.xxhash64("dg").alias("node"), "dg").agg(F.first("sig").alias("sig")), "nodes")
    width = 4 * PERMS // BANDS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(BANDS)])
    banded = nodes.select("node", F.explode(bands).alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    met = scratch.table(banded.join(buckets, "band").select("band", "n", "least", "node"), "met")
    wanted = scratch.table(nodes.join(met.select("node").distinct(), "node", "left_semi"), "wanted")
    side = lambda key, name: wanted.select(F.col("node").alias(key), F.col("dg").alias(name), F.col("sig").alias("s" + name))
    pairs = met.filter("node <> least").select("least", "node").distinct()
    pairs = pairs.join(side("node", "v"), "node").join(side("least", "u"), "least").select("least", "node", "u", "v", "su", "sv")
    held = scratch.table(pairs.mapInArrow(_held(threshold), "least bigint, node bigint, u binary, v binary, near boolean"), "held")
    far = held.filter("not near").select("least", "node").distinct()
    mixed = met.join(far, ["least", "node"], "left_semi").select("band").distinct()
    unsure = met.join(mixed, "band", "left_semi")
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"m{seed}")
    once = unsure.groupBy("band", "least", "n").agg(mark(1), mark(2)).groupBy("least", "n", "m1", "m2").agg(F.min("band").alias("band")).select("band")
    parts = F.when(F.col("n") > chunk, F.ceil(2 * F.col("n") / chunk)).otherwise(F.lit(1)).cast("int")
    asked = unsure.join(once, "band", "left_semi").select("band", "node", parts.alias("parts"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")).cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least("part", i).alias("a"), F.greatest("part", i).alias("b")))
    grouped = asked.select("band", "node", F.explode(each).alias("two")).join(wanted, "node")
    full = grouped.groupBy("band", "two").agg(F.collect_list(F.struct("dg", "sig")).alias("members"))  # about `chunk` members
    walked = full.select("members").mapInArrow(_walk(threshold), "u binary, v binary")
    both = held.filter("near").select("u", "v").union(walked)
    edges = scratch.table(both.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for name in ("nodes", "met", "wanted", "held"):
        scratch.drop(name)
    return edges


def groups(documents: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, group_id, keep, links): a row for each id and each text of its own, but for texts of one signature.

    group_id is the least id of the group. keep is 1 for one row of a group, that of the least id, of these of the least
    signature. links counts the other rows of the same signature, and the verified links of the text to other signatures
    that hold its group together.
    """
    scratch = scratch or Scratch(documents.sparkSession, "minhash")
    rows = documents.select(F.col(id_col).alias("id"), signature(F.col(text_col)).alias("s")).filter(F.col("id").isNotNull())
    sigs = _signed(rows, scratch)
    edges = _edges(sigs, threshold, scratch)
    roots = scratch.table(components(edges, scratch), "roots")
    degree = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("others"))
    one = sigs.select("id", "dg").distinct()
    linked = degree.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "others")
    placed = one.join(linked, one.dg == linked.node, "left").select("id", "dg", F.coalesce("root", "dg").alias("root"), F.coalesce("others", F.lit(0)).alias("others"))
    copies = placed.groupBy("root", "dg").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter(F.col("dg").isNotNull())
    first = copies.groupBy("root").agg(F.min(F.struct("id", "dg")).alias("kept"), F.sum("n").alias("size")).filter("size > 1")
    of = copies.join(first, "root").select(F.col("dg").alias("c_dg"), "kept", "n")
    out = placed.join(of, placed.dg == of.c_dg, "left")
    keep = F.col("kept").isNull() | ((F.col("id") == F.col("kept.id")) & (F.col("dg") == F.col("kept.dg")))
    return out.select(F.col("id").alias(id_col), F.coalesce("kept.id", "id").alias("group_id"), keep.cast("int").alias("keep"), (F.col("others") + F.coalesce(F.col("n") - 1, F.lit(0))).alias("links"))


def clusters(rows: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, scratch: Scratch | None = None) -> DataFrame:
    """The rows with `cluster` in place of the text: one value for all rows of a near-duplicate group, whatever their ids; null where there's no word."""
    scratch = scratch or Scratch(rows.sparkSession, "clusters")
    rest = [c for c in rows.columns if c != text_col]
    sigs = _signed(rows.select(*rest, signature(F.col(text_col)).alias("s")), scratch)
    roots = scratch.table(components(_edges(sigs, threshold, scratch), scratch), "roots")
    return sigs.join(roots, sigs.dg == roots.node, "left").select(*rest, F.hex(F.coalesce("root", "dg")).alias("cluster"))


def deduplicate(documents: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without all but one row of each near-duplicate group.

    Rows are told apart by id and text, so that a group keeps one of its texts whatever ids repeat: the row of the least id,
    a null id being last, of these of the least signature, then of the least text hash; of rows equal in id and text the one of
    the least hash over all columns. Texts without words are in no group: all their rows stay.
    """
    scratch = Scratch(documents.sparkSession, "dedup")
    text = F.col(f"`{text_col}`")
    told = lambda: F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h1"), F.crc32(text.cast("binary")).alias("h2"))
    sigs = _signed(documents.select(told().alias("row"), signature(text).alias("s")), scratch)
    roots = scratch.table(components(_edges(sigs, threshold, scratch), scratch), "roots")
    worded = sigs.filter(F.col("dg").isNotNull()).groupBy("row", "dg").agg(F.count("*").alias("n"))
    placed = worded.join(roots, worded.dg == roots.node, "left").select("row", "n", "dg", F.coalesce("root", "dg").alias("root"))
    order = F.struct(F.col("row.id").isNull().alias("last"), F.col("row.id").alias("id"), F.col("dg").alias("dg"), F.col("row.h1").alias("h1"), F.col("row.h2").alias("h2"))
    best = placed.groupBy("root").agg(F.min(order).alias("kept"), F.count("*").alias("size"))
    judged = placed.join(best, "root").withColumn("away", ~order.eqNullSafe(F.col("kept")))
    verdicts = scratch.table(judged.filter("away or n > 1").select("row", "away"), "verdicts")
    names = documents.columns
    key, whole = _unused("row", names), [F.col(f"`{c}`") for c in names]
    away, again = (verdicts.filter(c).select(F.col("row").alias(_unused("of", [*names, key]))) for c in ("away", "not away"))
    rows = documents.withColumn(key, told())
    same = lambda side: F.col(f"`{key}`").eqNullSafe(F.col(side.columns[0]))
    kept = rows.join(verdicts.select(F.col("row").alias(away.columns[0])), same(away), "left_anti").select(*whole)
    if again.isEmpty():  # no row repeats, and the second read of the documents would find none
        return kept
    held, least = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(whole)]), F.xxhash64(*[c.cast("string") for c in whole])
    one = rows.join(again, same(again), "left_semi").groupBy(key).agg(F.min_by(held, least).alias("held"))
    return kept.unionByName(one.select(*[F.col(f"held.c{k}").alias(c) for k, c in enumerate(names)]))


def _unused(name: str, taken: list[str]) -> str:
    """A column name like `name` that none of those taken is, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
