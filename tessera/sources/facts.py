"""Sources to fact tables: one Arrow pass over the files, everything after it is plain DataFrame code.

Any number of projects are analysed at once: each row carries its project, and every join has the
project in its key, so the work spreads over projects as well as files.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..scratch import Workspace
from .extract import extract

SOURCES = "project string, rel string, src string"
_IMPORT = "ord: int, module: string, relative_dots: int, names: array<string>, bindings: array<string>, redundant: array<boolean>, is_star: boolean, type_checking_only: boolean, in_try: boolean, line: int, end_line: int"
_MEMBER = "name: string, line: int, end_line: int, is_method: boolean, private: boolean, decorators: array<string>"
LISTS = {
    "definitions": "ord: int, name: string, kind: string, line: int, end_line: int, private: boolean, decorators: array<string>",
    "imports": _IMPORT,
    "nested_imports": _IMPORT,
    "calls": "ord: int, callee: string, line: int",
    "functions": "ord: int, name: string, line: int, end_line: int, cyclomatic: int, cognitive: int, params_total: int, params_annotated: int, return_annotated: boolean",
    "security_hits": "ord: int, rule: string, line: int, detail: string",
    "scope_findings": "ord: int, name: string, line: int, is_param: boolean",
    "classes": f"ord: int, name: string, line: int, end_line: int, private: boolean, decorators: array<string>, bases: array<string>, is_enum: boolean, methods: array<struct<method: string, attrs: array<string>>>, members: array<struct<{_MEMBER}>>",
    "unreachable": "ord: int, line: int, after: string",
    "type_leaks": "ord: int, function: string, type_name: string, line: int, is_return: boolean",
    "ignores": "line: int, rule: string",
    "name_counts": "name: string, n: int",
    "tokens": "ord: int, norm: string, line: int",
}
NAMES = ("local_uses", "attr_accessed", "module_used", "dunder_all")
FLAGS = ("has_all", "all_dynamic", "has_dynamic_sink", "has_main_guard", "had_errors")
RECORD = ", ".join(
    ["project string", "rel string", "src string", *(f"{k} array<struct<{v}>>" for k, v in LISTS.items()), *(f"{k} array<string>" for k in NAMES), *(f"{k} boolean" for k in FLAGS), "halstead_volume double"]
)


def _extracted(rows: Iterable[dict]) -> list[dict]:
    """Records of some files. Trees hold no cycles, so that the collector, which would walk each of them again and again, rests."""
    rests = gc.isenabled()
    gc.disable()
    try:
        return [{"project": r["project"]} | extract(r["rel"], r["src"]) for r in rows]
    finally:
        if rests:
            gc.enable()


def extract_records(sources: DataFrame) -> DataFrame:
    """A record for each source; rows without a text are left out, as unreadable files are."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORD))
    most = 256  # files to an output batch, as records are larger than sources

    def run(batches):
        for batch in batches:
            rows = [r for r in batch.to_pylist() if r["src"] is not None and r["rel"] is not None]
            for k in range(0, len(rows), most):
                yield pa.RecordBatch.from_pylist(_extracted(rows[k : k + most]), schema=schema)

    return sources.select("project", "rel", "src").mapInArrow(run, RECORD)


@dataclass
class Facts:
    """Fact tables of a corpus. records: the table that extract_records made, best written down once."""

    records: DataFrame
    testpaths: list[str] = field(default_factory=list)
    slim: DataFrame | None = None

    @property
    def table(self) -> DataFrame:
        """The records, perhaps without texts and tokens."""
        return self.records if self.slim is None else self.slim

    def narrow(self, workspace: Workspace) -> None:
        """Write texts and tokens apart, once: scans are split by the size of files, so that dozens of them would each
        open as many files as the texts fill."""
        if self.slim is None:
            self.slim = workspace.keep(self.records.drop("src", "tokens"), "slim")

    def listed(self, name: str, outer: bool = False) -> DataFrame:
        """One of LISTS, a row for each element."""
        return (self.records if name == "tokens" else self.table).select("project", "rel", F.inline(name))

    def named(self, name: str) -> DataFrame:
        """(project, rel, name) of one of NAMES."""
        return self.table.select("project", "rel", F.explode(name).alias("name"))

    @property
    def modules(self) -> DataFrame:
        rel = F.col("rel")
        return self.table.select(
            "project", "rel", N.dotted_name(rel).alias("dotted"), N.is_package(rel).alias("is_package"), N.is_entry(rel, F.col("has_main_guard")).alias("is_entry"),
            N.is_test(rel, self.testpaths).alias("is_test"), N.is_dev(rel, self.testpaths).alias("is_dev"), N.is_fixture(rel).alias("is_fixture"), rel.endswith(".py").alias("is_py"),
            F.col("has_dynamic_sink").alias("sink"), "has_main_guard", "has_all", "all_dynamic", "halstead_volume", "had_errors",
        )

    @property
    def lines(self) -> DataFrame:
        """(project, rel, line_no, text); a last empty line after the final line end isn't one."""
        text = F.regexp_replace(F.col("src"), r"\r\n?", "\n")
        ended = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
        rows = self.records.filter(F.length("src") > 0).select("project", "rel", F.posexplode(F.split(ended, "\n", -1)).alias("at", "text"))
        return rows.select("project", "rel", (F.col("at") + 1).alias("line_no"), "text")

    @property
    def dynamic(self) -> DataFrame:
        """(project, global_dynamic): whether any file of the project looks names up at run time."""
        return self.table.groupBy("project").agg(F.bool_or("has_dynamic_sink").alias("global_dynamic"))


def facts_of(spark: SparkSession, sources: DataFrame, workspace: Workspace | None = None, testpaths: list[str] = ()) -> Facts:
    """Extract once and write the records down, since every rule reads some of their columns."""
    workspace = workspace or Workspace(spark, "facts")
    return Facts(workspace.keep(extract_records(sources), "records"), list(testpaths))
