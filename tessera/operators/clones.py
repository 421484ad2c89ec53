"""Repeated token runs: k-grams by hash, their common length, and a greedy cover of each project."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.identity import SEPARATOR, hex_digest
from ..scratch import Workspace
from ..sources.facts import Facts
from .components import components
from .relations import each_group

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[2]
    x = (x ^ (x >> np.uint64(27))) * _MIX[3]
    return x ^ (x >> np.uint64(31))


def _runs(h: np.ndarray, k: int, join) -> np.ndarray:
    """join over each k consecutive values, from those of half the length, the last two of which overlap: log k steps.

    The last k - 1 values have no run, and what is returned for them means nothing.
    """
    width = 1
    while width < k:
        shift = min(width, k - width)
        h = join(h, np.concatenate([h[shift:], np.zeros(min(shift, len(h)), h.dtype)]), width)
        width += shift
    return h


def _anchor(k: int) -> tuple[int, int]:
    """Of a run of k tokens: the length of the shorter runs within it, and how many of those it has."""
    short = max(1, k // 2)
    return short, k - short + 1


class _Texts:
    """Token hashes of a batch laid end to end."""

    def __init__(self, lists: pa.Array, k: int):
        lists = lists.cast(pa.large_list(pa.string())) if not pa.types.is_large_list(lists.type) else lists
        sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
        coded = lists.flatten().dictionary_encode()
        names = [xxhash.xxh3_128_intdigest((w or "").encode("utf-8", "surrogatepass")) for w in coded.dictionary.to_pylist()]
        index = coded.indices.to_numpy(zero_copy_only=False)
        pick = lambda shift: np.array([n >> shift & 0xFFFFFFFFFFFFFFFF for n in names], np.uint64)[index] if len(index) else np.zeros(0, np.uint64)
        self.k, self.sizes, self.h1, self.h2 = k, sizes, pick(0), pick(64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.valid = np.arange(len(self.h1)) + k <= self.starts[1:][self.owner]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of the run that begins at each token. Together they are 128 bits, so equal hashes stand for equal runs."""
        mixed = lambda c: lambda a, b, width: _finish(a * c + (b ^ (b >> np.uint64(29))) + np.uint64(width))
        return _runs(self.h1, self.k, mixed(_MIX[0])), _runs(self.h2, self.k, mixed(_MIX[1]))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the run that begins at each token the least hash of a shorter run within it, 0 where no run fits; the shorter run's hash at each token, and the places where
        it is such a least one."""
        short, n = _anchor(self.k)
        low = _runs(self.h1, short, lambda a, b, width: _finish(a * _MIX[1] + (b ^ (b >> np.uint64(31))) + np.uint64(width)))
        least = np.where(self.valid, _runs(low, n, lambda a, b, _: np.minimum(a, b)), np.uint64(0))
        # A place is one if a run over it has its hash as the least: the greatest of the leasts of those runs is its own.
        before = np.concatenate([np.zeros(n - 1, np.uint64), least])
        top = _runs(before, n, lambda a, b, _: np.maximum(a, b))[: len(least)]
        return least, low, np.flatnonzero((top == low) & (top > 0))


def anchors(tokens: Column | str, k: int) -> Column:
    """array(struct(a, n)): hashes such that any two equal runs of k tokens share one, and at how many places of the text each lies.

    A run's anchor is the least hash of the shorter runs within it, so that only a small part of the places bears one.
    """

    @arrow_udf("array<struct<a: bigint, n: int>>")
    def run(lists: pa.Array) -> pa.Array:
        t = _Texts(lists, k)
        _, low, places = t.anchors()
        owner, value = t.owner[places], low[places].view(np.int64)
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])) if len(owner) else np.zeros(0, np.int64)
        counts = np.diff(np.concatenate([head, [len(owner)]])).astype(np.int32)
        at = np.concatenate([[0], np.cumsum(np.bincount(owner[head], minlength=len(t.sizes)))])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(value[head]), pa.array(counts)], ["a", "n"]))

    return run(tokens)


def grams(tokens: Column | str, wanted: Column | str, k: int) -> Column:
    """array(struct(pos, h1, h2)): the runs of k tokens whose anchor is among those wanted."""

    @arrow_udf("array<struct<pos: int, h1: bigint, h2: bigint>>")
    def run(lists: pa.Array, sets: pa.Array) -> pa.Array:
        t = _Texts(lists, k)
        least, _, _ = t.anchors()
        h1, h2 = t.grams()
        keep = np.zeros(len(least), bool)
        for i, row in enumerate(sets):
            a, b = t.starts[i], t.starts[i + 1]
            if b - a >= k and row.as_py():
                keep[a:b] = np.isin(least[a:b].view(np.int64), np.array(row.values.to_numpy(zero_copy_only=False)))
        at = np.flatnonzero(keep & t.valid)
        rows = np.concatenate([[0], np.cumsum(np.bincount(t.owner[at], minlength=len(t.sizes)))])
        pos = (at - t.starts[t.owner[at]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays([pa.array(pos), pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64))], ["pos", "h1", "h2"]))

    return run(tokens, wanted)


def repeated(texts: DataFrame, keys: list[str], tokens: str, k: int, within: list[str] = (), workspace: Workspace | None = None) -> DataFrame:
    """(keys, pos, h1, h2) of runs of k tokens, among them all those that occur twice or more (in the same `within`).

    What crosses the network is a part of the places, counted before they are shuffled, and then only texts that
    share an anchor with another or with themselves. keys, of which within is a part, name a text. With a workspace the
    anchors, which are read twice, are made once.
    """
    # A size that an outer explode has as well keeps the optimizer from making the hashes anew to filter by it.
    found = texts.select(*keys, F.explode_outer(anchors(tokens, k)).alias("x")).filter("x is not null").select(*keys, "x.a", "x.n")
    found = workspace.keep(found, "anchors") if workspace else found
    twice = found.groupBy(*within, "a").agg(F.sum("n").alias("n")).filter("n > 1").drop("n")
    wanted = found.join(twice, [*within, "a"], "left_semi").groupBy(*keys).agg(F.collect_set("a").alias("wanted"))
    again = texts.select(*keys, tokens).join(wanted, keys)
    return again.select(*keys, F.explode_outer(grams(tokens, "wanted", k)).alias("g")).filter("g is not null").select(*keys, "g.*")


class _Prefixes:
    """Hashes of any stretch of a sequence, to find how far two places agree."""

    PRIMES, BASES = (2147483629, 2147483587), (1_000_003, 1_299_709)

    def __init__(self, ids: np.ndarray):
        self.n, self.powers, self.sums = len(ids), [], []
        for p, b in zip(self.PRIMES, self.BASES):
            power = np.ones(1, np.int64)
            while len(power) <= self.n:
                power = np.concatenate([power, power * (int(power[-1]) * b % p) % p])
            power = power[: self.n + 1]
            self.powers.append(power)
            self.sums.append(np.concatenate([[0], np.cumsum((ids + 1) * power[: self.n] % p)]))

    def agree(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n tokens at a equal those at b, for a <= b."""
        same = np.ones(len(a), bool)
        for p, power, s in zip(self.PRIMES, self.powers, self.sums):
            same &= (s[a + n] - s[a]) % p * power[b - a] % p == (s[b + n] - s[b]) % p
        return same

    def common(self, a: np.ndarray, b: np.ndarray, least: int, end: np.ndarray) -> np.ndarray:
        """Length of the run that a and b share, known to be `least` at least and `end` at most."""
        low, high = np.full(len(a), least), end.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.agree(a, b, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def cover(files: list[tuple[str, list[str], list[int], list[tuple[int, int, int]]]], rank: dict[str, int], k: int, min_lines: int) -> list[dict]:
    """Clone families of a project. files: (rel, norms, lines, runs (pos, h1, h2)), sorted by rel.

    Families go by falling length, then by the rank of their tokens. A member whose start lies in an
    earlier family's stretch of its file is out; two members are needed, and one of min_lines lines.
    """
    starts = np.concatenate([[0], np.cumsum([len(f[1]) + 1 for f in files])]).astype(np.int64)
    ids = np.concatenate([np.array([*(rank[t] for t in f[1]), len(rank) + i], np.int64) for i, f in enumerate(files)])
    groups: dict[tuple[int, int], list[int]] = {}
    for i, f in enumerate(files):
        for pos, h1, h2 in f[3]:
            groups.setdefault((h1, h2), []).append(int(starts[i]) + pos)
    members = [sorted(g) for g in groups.values() if len(g) > 1]
    if not members:
        return []
    first = np.repeat([g[0] for g in members], [len(g) - 1 for g in members]).astype(np.int64)
    other = np.array([p for g in members for p in g[1:]], np.int64)
    owner = np.repeat(np.arange(len(members)), [len(g) - 1 for g in members])
    file_of = lambda p: np.searchsorted(starts, p, "right") - 1
    room = starts[file_of(other) + 1] - 1 - other
    room = np.minimum(room, starts[file_of(first) + 1] - 1 - first)
    length = np.full(len(members), np.iinfo(np.int64).max)
    np.minimum.at(length, owner, _Prefixes(ids).common(first, other, k, room))
    order = sorted(range(len(members)), key=lambda g: (-length[g], tuple(ids[members[g][0] : members[g][0] + k])))
    covered = np.zeros(len(ids), bool)
    out = []
    for g in order:
        n = int(length[g])
        kept = [p for p in members[g] if not covered[p]]
        if len(kept) < 2:
            continue
        places = set()
        for p in kept:
            covered[p : p + n] = True
            i = int(file_of(p))
            at, lines = p - int(starts[i]), files[i][2]
            places.add((i, lines[at], lines[at + n - 1]))
        if len(places) < 2 or max(b - a + 1 for _, a, b in places) < min_lines:
            continue
        places = sorted(places)
        i = int(file_of(kept[0]))
        at = kept[0] - int(starts[i])
        digest = hex_digest("".join(t + SEPARATOR for t in files[i][1][at : at + n]))
        out.append({"hash": digest, "length": n, "rel": files[places[0][0]][0], "line": places[0][1], "end_line": places[0][2], "places": [f"{files[j][0]}:{a}" for j, a, _ in places]})
    return out


def clones(facts: Facts, workspace: Workspace, min_tokens: int = 40, min_lines: int = 5) -> DataFrame:
    """(project, hash, length, rel, line, end_line, places): clone families of every project.

    Files that share a repeated run, by however many others between them, are one task's work; no family reaches beyond.
    """
    k = max(8, min_tokens)
    texts = facts.records.filter(F.size("tokens") >= k).select("project", "rel", F.col("tokens.norm").alias("norms"), F.col("tokens.line").alias("lines"))
    runs = repeated(texts, ["project", "rel"], "norms", k, ["project"], workspace)
    found = workspace.keep(runs.groupBy("project", "rel").agg(F.collect_list(F.struct("pos", "h1", "h2")).alias("runs")), "runs")
    held = found.select("project", "rel", F.inline("runs")).select("project", "rel", "h1", "h2").distinct()
    first = held.groupBy("project", "h1", "h2").agg(F.min("rel").alias("low"))
    node = lambda c: F.struct("project", F.col(c).alias("rel"))
    roots = components(held.join(first, ["project", "h1", "h2"]).select(node("rel").alias("u"), node("low").alias("v")), workspace)
    roots = roots.select(F.col("node.project").alias("project"), F.col("node.rel").alias("rel"), F.col("root.rel").alias("part"))
    files = texts.join(found, ["project", "rel"]).join(roots, ["project", "rel"], "left").withColumn("part", F.coalesce("part", "rel"))
    # Tokens rank by where the project has them first; projects without a repeated run need no ranks.
    ranked = texts.join(found.select("project").distinct(), "project", "left_semi")
    seen = ranked.select("project", "rel", F.posexplode("norms").alias("pos", "norm")).groupBy("project", "norm").agg(F.min(F.struct("rel", "pos")).alias("first"))
    needed = files.select("project", "part", F.explode(F.array_distinct("norms")).alias("norm")).distinct()
    words = needed.join(seen, ["project", "norm"]).select("project", "part", F.col("first.rel").alias("rel"), F.col("first.pos").alias("pos"), "norm")
    schema = "project string, hash string, length int, rel string, line int, end_line int, places array<string>"
    arrow = pa.schema([("project", pa.string()), ("hash", pa.string()), ("length", pa.int32()), ("rel", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("places", pa.list_(pa.string()))])

    def run(rows: list[dict]) -> list[dict]:
        words = [r["norm"] for r in rows if r["norms"] is None]
        texts = [(r["rel"], r["norms"], r["lines"], [(x["pos"], x["h1"], x["h2"]) for x in r["runs"]]) for r in rows if r["norms"] is not None]
        return [{"project": rows[0]["project"]} | g for g in cover(texts, {w: i for i, w in enumerate(words)}, k, min_lines)] if texts else []

    both = files.select("project", "part", "rel", "norms", "lines", "runs").unionByName(words, allowMissingColumns=True)
    return each_group(both, ["project", "part"], ["rel", "pos"], run, schema, arrow)
