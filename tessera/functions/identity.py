"""Identities of findings: a 64-bit XXH3 of the rule and its parts, and occurrence numbers."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

SEPARATOR = "\x1f"


def joined(*parts: Column | str) -> Column:
    """The parts with unit separators between them; a null part counts as ''."""
    cols = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat_ws(SEPARATOR, *cols)


def hex_digest(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else hex_digest(t) for t in texts.to_pylist()], pa.string())


def xxh3_hex(text: Column) -> Column:
    """16 hex digits for each text; null for null."""
    return arrow_udf(_digests, "string")(text)


def fingerprint(rule: Column, identity: Column) -> Column:
    """rule:digest, where the identity holds the parts joined by separators."""
    return F.concat(rule, F.lit(":"), xxh3_hex(F.concat(rule, F.lit(SEPARATOR), identity)))


def fingerprint_of(rule: str, *parts: str) -> str:
    return f"{rule}:{hex_digest(SEPARATOR.join([rule, *parts]))}"


def occurrence(keys: list, order: list) -> Column:
    """0-based number of a row among those with its keys, in the given order, as text."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("string")
