"""Versions and version specs: ordering keys, matching, whether two ranges meet."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

_RELEASE = re.compile(r"(?:(\d+)!)?([0-9.]+)(.*)", re.DOTALL)
_PHASE = re.compile(r"[._-]*(alpha|beta|preview|post|pre|rev|rc|dev|a|b|c|r)[._-]*(\d*)")
_RANK = {"alpha": 0, "a": 0, "beta": 1, "b": 1, "rc": 2, "c": 2, "pre": 2, "preview": 2}
_LAST = 2**64 - 1
OPERATORS = ("==", "!=", "<=", ">=", "~=", "<", ">")


@lru_cache(65536)
def version_key(text: str) -> tuple | None:
    """(epoch, release, phase), which orders versions; None where text isn't one. Local parts don't count."""
    m = _RELEASE.fullmatch(text.strip().removeprefix("v").partition("+")[0])
    release = tuple(int(p) for p in m[2].split(".") if p) if m else ()
    if not release:
        return None
    pre = post = dev = None
    at, tail = 0, m[3].lower()
    while p := _PHASE.match(tail, at):
        at, n = p.end(), int(p[2] or 0)
        if p[1] == "dev":
            dev = n if dev is None else dev
        elif p[1] in _RANK:
            pre = (_RANK[p[1]], n) if pre is None else pre
        else:
            post = n if post is None else post
    end = _LAST if dev is None else dev
    phase = (1, *pre, end) if pre else (3, 0, post, end) if post is not None else (2, 0, 0, 0) if dev is None else (0, 0, dev, 0)
    return int(m[1] or 0), release, phase


def ordered(key: tuple) -> tuple:
    """A key of versions whose trailing zeros don't count."""
    epoch, release, phase = key
    n = len(release)
    while n and release[n - 1] == 0:
        n -= 1
    return epoch, release[:n], phase


def _split(part: str) -> tuple[str, str]:
    for op in OPERATORS:
        if part.startswith(op):
            return op, part[len(op) :].strip()
    return "==", part


def _starts(release: tuple, head: tuple) -> bool:
    return release[: len(head)] == head


def _holds(key: tuple, part: str) -> bool:
    op, bound = _split(part)
    if op in ("==", "!=") and bound.endswith(".*"):
        head = version_key(re.sub(r"(\.\*)+$", "", bound))
        return head is not None and _starts(key[1], head[1]) == (op == "==")
    other = version_key(bound)
    if other is None:
        return False
    a, b = ordered(key), ordered(other)
    if op == "~=":
        return a >= b and (len(other[1]) < 2 or _starts(key[1], other[1][:-1]))
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def matches(version: str, spec: str) -> bool:
    """All parts of a spec hold for a version; an empty spec takes any, what isn't a version matches nothing."""
    key = version_key(version)
    return key is not None and all(_holds(key, p) for p in map(str.strip, spec.split(",")) if p)


def intersect(a: str, b: str) -> bool:
    """Whether some version near the specs' bounds satisfies both."""
    tried = ["0"]
    for part in filter(None, map(str.strip, f"{a},{b}".split(","))):
        bound = re.sub(r"(\.\*)+$", "", _split(part)[1]).strip()
        if key := version_key(bound):
            tried += [bound, f"{bound}.1", f"{bound}.0.1", ".".join(map(str, [*key[1][:-1], key[1][-1] + 1]))]
    return any(matches(v, a) and matches(v, b) for v in tried)


def from_poetry(spec: str) -> str:
    """^ and ~ ranges of Poetry as plain bounds; '*' is no bound."""
    spec = spec.strip()
    if spec in ("", "*"):
        return ""
    if spec[0] not in "^~" or spec.startswith("~="):
        return spec
    low = spec[1:]
    n = [int(p) if p.isdigit() else 0 for p in low.split(".")]
    if spec[0] == "^":
        keep = next((i for i, p in enumerate(n) if p), len(n) - 1)
        top = [*n[:keep], n[keep] + 1]
    else:
        top = [n[0] + 1] if len(n) == 1 else [n[0], n[1] + 1]
    return f">={low},<{'.'.join(map(str, top))}"


_TOP = 2**63 - 1
_KEY = "epoch: bigint, trimmed: array<bigint>, phase: array<bigint>, release: array<bigint>"
_NO_KEY = {"epoch": None, "trimmed": None, "phase": None, "release": None}


def _key_row(key: tuple) -> dict:
    """A key as columns that order as it does; numbers beyond 64 bits count as the largest."""
    low = lambda xs: [min(x, _TOP) for x in xs]
    return {"epoch": min(key[0], _TOP), "trimmed": low(ordered(key)[1]), "phase": low(key[2]), "release": low(key[1])}


@lru_cache(65536)
def _version_row(text: str) -> dict:
    key = version_key(text)
    return {"ok": key is not None} | (_key_row(key) if key else _NO_KEY)


@lru_cache(65536)
def _spec_rows(spec: str) -> list[dict]:
    out = []
    for part in filter(None, map(str.strip, spec.split(","))):
        op, bound = _split(part)
        star = op in ("==", "!=") and bound.endswith(".*")
        key = version_key(re.sub(r"(\.\*)+$", "", bound) if star else bound)
        row = {"op": op, "star": star, "ok": key is not None} | (_key_row(key) if key else _NO_KEY)
        if op == "~=" and key:
            row["release"] = row["release"][:-1]
        out.append(row)
    return out


def _each_distinct(parse, kind: str):
    """A column function that parses every distinct text of a batch once."""

    def run(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        return pa.array([None if x is None else parse(x) for x in coded.dictionary.to_pylist()], arrow).take(coded.indices)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))
    return arrow_udf(run, kind)


def parsed_version(version: Column | str) -> Column:
    """struct(ok, epoch, trimmed, phase, release): the first three after ok order versions."""
    return _each_distinct(_version_row, f"struct<ok: boolean, {_KEY}>")(version)


def parsed_spec(spec: Column | str) -> Column:
    """An array with a struct for each part of a spec."""
    return _each_distinct(_spec_rows, f"array<struct<op: string, star: boolean, ok: boolean, {_KEY}>>")(spec)


def satisfies(version: Column, spec: Column) -> Column:
    """Whether a parsed version lies within a parsed spec: plain comparisons, without Python. Null if either is."""
    key = lambda x: F.struct(x["epoch"].alias("e"), x["trimmed"].alias("r"), x["phase"].alias("p"))
    starts = lambda head: F.slice(version["release"], 1, F.size(head)) == head

    def holds(p: Column) -> Column:
        a, b, op = key(version), key(p), p["op"]
        plain = F.when(op == "==", a == b).when(op == "!=", a != b).when(op == "<", a < b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == ">=", a >= b)
        return p["ok"] & F.when(p["star"], starts(p["release"]) == (op == "==")).when(op == "~=", (a >= b) & starts(p["release"])).otherwise(plain)

    return F.when(version.isNotNull() & spec.isNotNull(), version["ok"] & F.forall(spec, holds))


def with_match(rows: DataFrame, version: str, spec: str, name: str) -> DataFrame:
    """rows with a boolean column: whether the version lies within the spec."""
    both = rows.withColumns({"_version": parsed_version(version), "_spec": parsed_spec(spec)})
    return both.withColumn(name, satisfies(F.col("_version"), F.col("_spec"))).drop("_version", "_spec")


def specs_intersect(a: Column | str, b: Column | str) -> Column:
    """Whether two ranges meet, tried out near their bounds once for each distinct pair of a batch."""

    @arrow_udf("boolean")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        tried: dict = {}
        for pair in zip(xs.to_pylist(), ys.to_pylist()):
            if pair not in tried:
                tried[pair] = None if None in pair else intersect(*pair)
        return pa.array([tried[p] for p in zip(xs.to_pylist(), ys.to_pylist())], pa.bool_())

    return run(a, b)
