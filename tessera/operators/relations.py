"""Relational steps that several rules share: ranges within a key, first rows, conflicts, shares, changes."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def each_group(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[list[dict]], list[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """What run makes of the rows of each key, in their order; schema and arrow: of its rows.

    A partition's rows flow by sorted, and a group ends where the key changes: for small groups sending each by itself costs
    more than its work. The number of partitions is that of shuffles, as few bytes may be much work.
    """

    def flow(batches):
        held, at, out = [], None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (key := tuple(r[k] for k in keys)) != at:
                    out += run(held) if held else []
                    held, at = [], key
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                held.append(r)
        out += run(held) if held else []
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(flow, schema)


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, so that rows are combined before they are shuffled."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order, *[c for c, kind in rows.select(*rest).dtypes if not kind.startswith("map")])).alias("_m"))
    return best.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in (*order, *rest)]).select(rows.columns)


def enclosing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Points with each span of their key that holds them, both ends included: the key is hashed, the range a residue."""
    return points.join(spans, keys).filter((F.col(begin) <= F.col(at)) & (F.col(at) <= F.col(end)))


def innermost(inside: DataFrame, point: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Of the spans around each point the one that is last in order: (point, keep)."""
    best = inside.groupBy(*point).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_m"))
    return best.select(*point, *[F.col(f"_m.{c}").alias(c) for c in keep])


def conflicts(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows whose value isn't the one that their key has first, with that `first`."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("first", first).filter(F.col(value) != F.col("first"))


def changes(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows whose value isn't that of the row before them in their key."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.struct(value))).drop("_before")


def census(rows: DataFrame, keys: list[str], bare: Column, least: int, share: float) -> DataFrame:
    """(keys, total, untyped, rolled): how many rows of a key there are, how many are bare, and whether it's large and mostly so."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(bare).alias("untyped"))
    return counts.withColumn("rolled", (F.col("total") >= least) & (F.col("untyped") >= share * F.col("total")))


def hot(size: DataFrame, churn: DataFrame, keys: list[str], least_size: int, least_churn: int) -> DataFrame:
    """size (keys, complexity) that is large and whose churn (keys, commits) is, too."""
    return size.filter(F.col("complexity") >= least_size).join(churn.filter(F.col("commits") >= least_churn), keys)


def unexecuted(spans: DataFrame, ran: DataFrame, keys: list[str], begin: Column, end: Column) -> DataFrame:
    """Spans (keys, ..) none of whose lines ran (keys, line). A key without any such line is wholly unexecuted."""
    lines = ran.groupBy(*keys).agg(F.collect_set("line").alias("_ran"))
    joined = spans.join(lines, keys, "left")
    return joined.filter(~F.coalesce(F.exists("_ran", lambda x: x.between(begin, end)), F.lit(False))).drop("_ran")


def repeats(rows: DataFrame, value: str, owner: str) -> DataFrame:
    """(value, n, owners) of what occurs more than once; partial counts by owner keep hot values small."""
    per = rows.groupBy(value, owner).agg(F.count("*").alias("n"))
    return per.groupBy(value).agg(F.sum("n").alias("n"), F.count("*").alias("owners")).filter("n > 1")


def frequencies(rows: DataFrame, name: str) -> DataFrame:
    """(name, n): how often each name occurs."""
    return rows.groupBy(name).agg(F.count("*").alias("n"))
