"""Exact top-k inner-product search by norm buckets: stated queries against all vectors.

Vectors are grouped by length into buckets of falling norms, queries into blocks. Every block first meets the bucket of
the longest vectors, which gives each query a k-th score to beat. A bucket whose longest vector has length l can serve a
query q with k-th score t only if |q| l reaches t; pairs of block and bucket in which that holds for no query are dropped before
any vector moves. In the others each live query has the local cosine threshold t / (|q| l), and chooses its own pruning
by a count: the threshold leaves an interval on each of the query's FOCUS largest coordinates. If the narrowest of
them holds few of the bucket's vectors, these are its candidates, less those outside of the other intervals
(coordinate pruning); otherwise the vectors that are long enough, a prefix of the bucket, are all multiplied (length
pruning). Whatever is left is verified by its exact product.

Scores are products in double precision, rounded to 9 places; ranks go by score, then by id.
Defined results: rows with a null id, or a null, empty or other-sized vector (the size that most
rows have counts, the smaller one on a tie), take no part, and so do vectors with a null, NaN or
infinite part; of rows with one id the least vector stands; a zero vector scores 0 with all; with
fewer than k others, all others are listed. An empty table gives an empty result. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K, BUCKET, QUERIES, EPS = 10, 4096, 4096, 1e-8
FEW = 0.05  # share of a bucket up to which candidates from coordinates are cheaper than all products
FOCUS = 4  # coordinates by which a query may prune
GROUP = 4  # buckets that a task meets with one block
EVERY = 20  # the registered query's queries: rows whose id it divides


def _blocks(size: int):
    """Consecutive rows of a partition as one row for each bucket."""

    def emit(ids, rows):
        x = np.array(rows, np.float64)
        norms = np.sqrt((x * x).sum(1))
        order = np.lexsort((ids, -norms))
        return pa.RecordBatch.from_arrays([pa.array([float(norms.max())]), pa.array([np.array(ids, "<i8")[order].tobytes()], pa.binary()), pa.array([x[order].tobytes()], pa.binary())], ["longest", "ids", "data"])

    def run(batches):
        ids: list[int] = []
        rows: list = []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            rows += batch.column("vec").to_pylist()
            while len(ids) >= size:
                yield emit(ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
        if ids:
            yield emit(ids, rows)

    return run


class TopK:
    """Running best k of a block of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norm = np.sqrt((q * q).sum(1))
        self.row, self.near, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(ids), -np.inf)
        self.used = {"length": 0, "coordinate": 0, "pruned": 0}

    def floor(self, least: np.ndarray) -> None:
        """Scores that the k-th is known to reach."""
        self.least = np.maximum(self.least, least)

    def live(self, longest: float) -> np.ndarray:
        """Queries that a vector of this length could still serve."""
        return np.flatnonzero(self.norm * longest >= self.least - EPS)

    def _verify(self, row: np.ndarray, ids: np.ndarray, p: np.ndarray, col: np.ndarray) -> None:
        keep = self.ids[row] != ids[col]
        row, col = row[keep], col[keep]
        exact = np.round((self.q[row] * p[col]).sum(1), 9)
        row, near, score = np.concatenate([self.row, row]), np.concatenate([self.near, ids[col]]), np.concatenate([self.score, exact])
        order = np.lexsort((near, -score, row))
        row, near, score = row[order], near[order], score[order]
        first = np.searchsorted(row, np.arange(len(self.ids)))
        rank = np.arange(len(row)) - first[row]
        best = rank < self.k
        self.row, self.near, self.score = row[best], near[best], score[best]
        full = np.bincount(self.row, minlength=len(self.ids)) >= self.k
        last = np.searchsorted(self.row, np.arange(len(self.ids)), side="right") - 1
        self.least[full] = np.maximum(self.least[full], self.score[last[full]])

    def _coordinate(self, live: np.ndarray, ids: np.ndarray, p: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Serve those live queries whose coordinates leave few candidates; the others are given back."""
        bound = self.least[live] / np.maximum(self.norm[live] * norms[0], 1e-300)
        able = np.isfinite(bound) & (bound > 0) & (self.norm[live] > 0)
        if not able.any():
            return live
        mine, t = live[able], np.clip(bound[able] - EPS, 0, 1)[:, None]
        unit = self.q[mine] / self.norm[mine, None]
        focus = np.argsort(-np.abs(unit), 1, kind="stable")[:, :FOCUS]
        top = np.take_along_axis(unit, focus, 1)
        spread = np.sqrt((1 - t * t) * np.maximum(1 - top * top, 0))
        # A shorter vector needs a larger cosine, within these bounds for the bucket's threshold; beyond the
        # cosine `top` itself the extreme coordinate of the cap is 1 (or -1).
        lo = np.where(-top >= t, -1.0, top * t - spread) - EPS
        hi = np.where(top >= t, 1.0, top * t + spread) + EPS
        p_unit = p / np.maximum(norms, 1e-300)[:, None]
        first, count, order = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64), {}
        for f in np.unique(focus):
            order[f] = np.argsort(p_unit[:, f], kind="stable")
            column, at = p_unit[order[f], f], focus == f
            first[at] = np.searchsorted(column, lo[at], "left")
            count[at] = np.searchsorted(column, hi[at], "right") - first[at]
        best = count.argmin(1)
        rows = np.arange(len(mine))
        few = count[rows, best] <= FEW * len(p)
        for f in np.unique(focus[rows, best][few]):
            own = np.flatnonzero(few & (focus[rows, best] == f))
            n, a = count[own, best[own]], first[own, best[own]]
            row = np.repeat(own, n)
            col = order[f][np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            for k in range(focus.shape[1]):  # the other intervals
                value = p_unit[col, focus[row, k]]
                inside = (value >= lo[row, k]) & (value <= hi[row, k])
                row, col = row[inside], col[inside]
            self._verify(mine[row], ids, p, col)
        self.used["coordinate"] += int(few.sum())
        return np.concatenate([live[~able], mine[~few]])

    def meet(self, ids: np.ndarray, p: np.ndarray) -> None:
        """Take in one bucket, its vectors in order of falling norm."""
        norms = np.sqrt((p * p).sum(1))
        live = self.live(norms[0])
        self.used["pruned"] += len(self.ids) - len(live)
        if len(live):
            live = self._coordinate(live, ids, p, norms)
        self.used["length"] += len(live)
        for a in range(0, len(live), 512):
            rows = live[a : a + 512]
            need = (self.least[rows] - EPS) / np.maximum(self.norm[rows], 1e-300)
            upto = int(np.searchsorted(-norms, -need.min(), "right")) if np.isfinite(need).all() else len(p)
            if not upto:
                continue
            s = self.q[rows] @ p[:upto].T
            bound = self.least[rows]
            if upto > self.k + 1:  # the query itself may be among the best k + 1
                bound = np.maximum(bound, np.partition(s, upto - self.k - 1, axis=1)[:, upto - self.k - 1])
            r, c = np.nonzero(s >= bound[:, None] - EPS)
            self._verify(rows[r], ids, p[:upto], c)


def _read(ids, data) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids.as_py(), "<i8")
    return ids, np.frombuffer(data.as_py(), np.float64).reshape(len(ids), -1)


def _begin(k: int, ids: bytes, data: bytes):
    """Blocks of queries with their k-th scores among the longest vectors, and the length that a vector needs to serve any of them."""

    def run(batches):
        longest = _read(pa.scalar(ids, pa.binary()), pa.scalar(data, pa.binary()))
        for batch in batches:
            for number, i, x in zip(*(batch.column(c) for c in ("number", "ids", "data"))):
                top = TopK(*_read(i, x), k)
                top.meet(*longest)
                least = top.least.astype("<f8")
                need = float(np.where(top.norm > 0, (least - EPS) / np.maximum(top.norm, 1e-300), np.where(least > EPS, np.inf, -np.inf)).min())
                yield pa.RecordBatch.from_arrays([pa.array([number.as_py()], pa.int32()), pa.array([need]), pa.array([i.as_py()], pa.binary()), pa.array([x.as_py()], pa.binary()), pa.array([least.tobytes()], pa.binary())], ["block", "need", "ids", "data", "least"])

    return run


def _search(k: int):
    """Rows come sorted by (task, order): a block of queries (order -1), then buckets that it has to meet."""

    def result(top: TopK):
        return pa.RecordBatch.from_arrays([pa.array(top.ids[top.row]), pa.array(top.near), pa.array(top.score)], ["id", "neighbour", "score"])

    def run(batches):
        task, top = None, None
        for batch in batches:
            for t, order, ids, data, least in zip(*(batch.column(c) for c in ("task", "order", "ids", "data", "least"))):
                if t.as_py() != task:
                    if top is not None:
                        yield result(top)
                    task = t.as_py()
                if order.as_py() < 0:
                    top = TopK(*_read(ids, data), k)
                    top.floor(np.frombuffer(least.as_py(), "<f8"))
                else:
                    top.meet(*_read(ids, data))
        if top is not None:
            yield result(top)

    return run


def _even_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n shuffle partitions an integer that hash partitioning sends there: heavy rows of few keys spread evenly."""
    tried, found = 0, {}
    while len(found) < n:
        part = F.pmod(F.hash(F.col("key")), F.lit(n)).alias("part")
        more = spark.range(tried, tried + 20 * n).select(F.col("id").cast("int").alias("key")).groupBy(part).agg(F.min("key").alias("key")).collect()
        found = {r.part: r.key for r in more} | found
        tried += 20 * n
    return [found[p] for p in range(n)]


def top_k(vectors: DataFrame, k: int = K, bucket: int = BUCKET, queries: int = QUERIES, id_col: str = "vec_id", vec_col: str = "embedding", scratch: Scratch | None = None, asking: Column | None = None, group: int = GROUP) -> DataFrame:
    """(id, rank, neighbour, score): the k largest inner products of queries with all other vectors.

    asking: which rows are queries, a condition on `id`; by default all. With m queries of n vectors the work is
    m * n products at worst. A task holds a block of queries and meets `group` buckets, one at a time; what moves is those,
    once for each block that needs them, and at most k results of a query from each of its tasks that beat the first bucket's.
    The lists of buckets and blocks, a row of a few bytes each, are read on the driver.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("vec") > 0) & ~bad)
    common = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    nothing = spark.createDataFrame([], f"{id_col} bigint, rank int, neighbour bigint, score double")
    if common is None:
        return nothing
    rows = rows.filter(F.size("vec") == common["size"]).groupBy("id").agg(F.min("vec").alias("vec"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))

    def blocks(of: DataFrame, size: int, name: str) -> tuple[DataFrame, list]:
        """Written runs of rows by falling norm, numbered, and their lengths."""
        ordered = of.repartitionByRange(max(1, -(-common["count"] // (4 * size))), F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
        made = scratch.table(ordered.select("id", "vec").mapInArrow(_blocks(size), "longest double, ids binary, data binary"), name)
        keys = sorted(((r.longest, r.key) for r in made.select("longest", F.md5("ids").alias("key")).collect()), key=lambda x: (-x[0], x[1]))
        numbers = spark.createDataFrame([(key, i) for i, (_, key) in enumerate(keys)], "key string, number int")
        return made.withColumn("key", F.md5("ids")).join(numbers, "key").select("number", "ids", "data"), [n for n, _ in keys]

    made, lengths = blocks(rows, bucket, "buckets")
    asks, _ = blocks(rows if asking is None else rows.filter(asking), queries, "queries")
    head = made.filter("number = 0").select("ids", "data").first()  # at most `bucket` vectors
    begun = scratch.table(asks.mapInArrow(_begin(k, bytes(head.ids), bytes(head.data)), "block int, need double, ids binary, data binary, least binary"), "begun")
    plan, total = [], 0  # of each block its first task, and how many buckets it meets
    for r in begun.select("block", "need").orderBy("block").collect():
        live = sum(n >= r.need for n in lengths)
        plan.append((r.block, total, live))
        total += -(-live // group)
    if not total:
        return nothing
    # Tasks take turns over the partitions, each of which has a key that hashes to it.
    slots = min(total, max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keys = spark.createDataFrame(list(enumerate(_even_keys(spark, slots))), "slot bigint, key int")
    tasks = spark.createDataFrame(plan, "block int, begin bigint, live int").filter("live > 0").select("block", "begin", "live", F.explode(F.sequence(F.lit(0), F.expr(f"(live - 1) div {group}").cast("int"))).alias("g"))
    tasks = tasks.withColumn("task", F.col("begin") + F.col("g")).withColumn("slot", F.col("task") % slots).join(keys, "slot")
    first = begun.join(tasks, "block").select("key", "task", F.lit(-1).alias("order"), "ids", "data", "least")
    upto = F.least(F.col("live"), (F.col("g") + 1) * group) - 1
    wanted = tasks.select("key", "task", F.explode(F.sequence(F.col("g") * group, upto)).alias("number"))
    then = made.join(wanted, "number").select("key", "task", F.col("number").alias("order"), "ids", "data", F.lit(None).cast("binary").alias("least"))
    lined = first.union(then).repartition(slots, "key").sortWithinPartitions("task", "order")
    found = lined.mapInArrow(_search(k), "id bigint, neighbour bigint, score double")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("id").alias(id_col), "rank", "neighbour", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all rows whose id EVERY divides; each is held against all rows."""
    return top_k(table(spark, sf_dir, "embeddings"), asking=F.col("id") % EVERY == 0)


OP2_SQL = f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.e, b.e), 9) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS rank FROM s)
SELECT vec_id, rank::INTEGER AS rank, neighbour, score FROM r WHERE rank <= {K}
"""
