"""Sources as a stream: each micro-batch brings the files that changed, and findings are made anew from facts.

Extracted records are kept by batch in a state folder beside the stream's checkpoint, so that a restarted stream knows
the files that it read before; every so many batches they are merged into one table. The latest record of a file
counts, a null text removes it. Only changed files are parsed; rules run over the facts of all, as most of them
look across files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.engine import Engine
from ..scratch import Workspace
from ..sources import manifests
from ..sources.facts import RECORD, SOURCES, Facts, extract_records


def stream_sources(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON lines {project, rel, src} that some watcher drops into a folder."""
    return spark.readStream.schema(SOURCES).json(folder)


class Watcher:
    """Keeps facts up to date batch by batch and hands the findings of each state to `report`, which has to use them at once."""

    def __init__(self, spark: SparkSession, report: Callable[[DataFrame, int], None], config: manifests.Config | None = None, engines: tuple[str, ...] = ("dead-code", "security"), state: str | None = None, merge: int = 16):
        self.spark, self.report, self.engines, self.merge = spark, report, list(engines), merge
        self.config, self.state = config or manifests.Config(), state

    def _listed(self) -> list[tuple[str, int, str]]:
        """(kind, batch, path) of the state's whole tables, in order of batches."""
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.state)
        fs = at.getFileSystem(context._jsc.hadoopConfiguration())
        out = []
        for entry in fs.listStatus(at) if fs.exists(at) else []:
            kind, _, number = entry.getPath().getName().partition("-")
            if kind in ("batch", "merged") and number.isdigit() and fs.exists(context._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")):
                out.append((kind, int(number), entry.getPath().toString()))
        return sorted(out, key=lambda x: x[1])

    def _current(self) -> list[tuple[str, int, str]]:
        """The last merged table and the batches after it."""
        listed = self._listed()
        last = max((n for kind, n, _ in listed if kind == "merged"), default=-1)
        return [x for x in listed if x[0] == "merged" and x[1] == last or x[0] == "batch" and x[1] > last]

    def records(self) -> DataFrame:
        """The latest record of each file that still exists."""
        seen = self.spark.read.schema(f"{RECORD}, gone boolean, batch bigint").parquet(*[path for *_, path in self._current()])
        newest = seen.groupBy("project", "rel").agg(F.max("batch").alias("batch"))
        return seen.join(newest, ["project", "rel", "batch"]).filter("not gone").drop("gone", "batch")

    def __call__(self, changed: DataFrame, batch: int) -> None:
        one = changed.groupBy("project", "rel").agg(F.max_by(F.struct("src"), F.struct(F.col("src").isNull(), "src"))["src"].alias("src"))
        fresh = extract_records(one).withColumn("gone", F.lit(False))
        gone = one.filter("src is null").select("project", "rel", F.lit(True).alias("gone"))
        rows = fresh.unionByName(gone, allowMissingColumns=True).withColumn("batch", F.lit(batch).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{self.state}/batch-{batch:09d}")  # a repeated batch writes over its own rows
        work = Workspace(self.spark, f"watch-{batch}")
        facts = Facts(work.keep(self.records(), "records"))
        if len(self._current()) > self.merge:
            self._merge(facts.records, batch)
        self.report(Engine.over_facts(self.spark, facts, work, self.config).findings(self.engines), batch)
        work.remove(work.root)

    def _merge(self, records: DataFrame, batch: int) -> None:
        """One table in place of those so far, which go once it is whole."""
        old = self._listed()
        records.withColumn("gone", F.lit(False)).withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{self.state}/merged-{batch:09d}")
        keeper = Workspace(self.spark, "merge")
        for _, _, path in old:
            keeper.remove(path)


def watch(sources: DataFrame, watcher: Watcher, checkpoint: str, once: bool = False):
    """Start the stream; `once` works off what is there and ends. The watcher's state lies beside the checkpoint's own folders."""
    watcher.state = watcher.state or f"{checkpoint.rstrip('/')}/tessera-records"
    writer = sources.writeStream.foreachBatch(watcher).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
