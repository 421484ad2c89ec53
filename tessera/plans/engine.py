"""The analyses that users call: one Engine over the sources of one project or of many."""

from __future__ import annotations

import os
import traceback
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import findings as Fi
from ..operators.graph import Graph, build_graph, entry_modules
from ..operators.rules import AUDIT, ENGINES, dead_code, measures, risks
from ..scratch import Workspace
from ..sources import files, manifests
from ..sources.facts import Facts, facts_of

#: Where a project keeps its advisories, if it does.
ADVISORIES = ".tessera/advisories.json"
SIDES = {
    "declared": "project string, dist string, group string", "manifests": "project string, manifest string", "entry_points": "project string, module string, symbol string",
    "installed": "project string, top string, dist string, version string", "pins": "project string, name string, version string, source string, line int",
    "ranges": "project string, name string, spec string, source string, line int", "churn": "project string, path string, commits bigint", "coverage": "project string, key string, line int",
    "advisories": "seq int, id string, package string, specs array<string>, summary string, aliases array<string>, severity string",
}


@dataclass
class Analysis:
    """What rules read. The tables beside facts and graph are None where a corpus has none. The graph is made when first
    asked for, as metrics need none."""

    facts: Facts
    build: Callable[[], Graph]
    config: manifests.Config
    workspace: Workspace
    declared: DataFrame | None = None
    manifests: DataFrame | None = None
    entry_points: DataFrame | None = None
    installed: DataFrame | None = None
    pins: DataFrame | None = None
    ranges: DataFrame | None = None
    churn: DataFrame | None = None
    coverage: DataFrame | None = None
    advisories: DataFrame | None = None

    @cached_property
    def graph(self) -> Graph:
        return self.build()

    @cached_property
    def entry_symbols(self) -> DataFrame | None:
        if self.entry_points is None:
            return None
        where = entry_modules(self.graph.modules, self.entry_points)
        return where.join(self.entry_points.filter("symbol <> ''"), ["project", "module"]).select("project", "dotted", F.col("symbol").alias("name")).distinct()


@dataclass
class Engine:
    spark: SparkSession
    sources: DataFrame
    config: manifests.Config = field(default_factory=manifests.Config)
    sides: dict[str, DataFrame] = field(default_factory=dict)
    testpaths: list[str] = field(default_factory=list)
    tool: str = "tessera"
    engines: dict = field(default_factory=lambda: ENGINES)

    def __post_init__(self):
        self.workspace = Workspace(self.spark, "engine")
        facts = facts_of(self.spark, self.sources, self.workspace, self.testpaths)
        self.analysis = Analysis(facts, lambda: build_graph(facts, self.workspace, self.sides.get("entry_points")), self.config, self.workspace, **self.sides)

    @classmethod
    def over_facts(cls, spark: SparkSession, facts: Facts, workspace: Workspace, config: manifests.Config | None = None) -> Engine:
        """Over facts that were extracted before, with nothing beside them."""
        e = cls.__new__(cls)
        e.spark, e.config, e.sides, e.testpaths, e.tool, e.engines, e.workspace = spark, config or manifests.Config(), {}, facts.testpaths, "tessera", ENGINES, workspace
        e.analysis = Analysis(facts, lambda: build_graph(facts, workspace), e.config, workspace)
        return e

    @classmethod
    def over_buffer(cls, spark: SparkSession, rel: str, src: str, config: manifests.Config | None = None) -> DataFrame:
        """Findings of one text in memory by the rules that look at a single file: security, unused locals, complexity, comments."""
        e = cls.over_files(spark, {rel: src}, config=config or manifests.Config())
        e.engines = {"local": ("dead-code", [risks.security, dead_code.unused_locals, dead_code.commented_code, measures.complex_functions])}
        return Fi.ordered(e.findings(["local"]))

    @classmethod
    def over_files(cls, spark: SparkSession, texts: dict[str, str], project: str = "", **more) -> Engine:
        """Over files in memory: sources, and manifests beside them at the root."""
        root = {k: v for k, v in texts.items() if "/" not in k}
        config = more.pop("config", None) or manifests.parse_config(root.get(".tesserarc.json"))
        sides = {k: spark.createDataFrame([(project, *r) for r in rows], SIDES[k]) for k, rows in side_rows(root).items() if rows is not None}
        sides |= more.pop("sides", {})
        code = {k: v for k, v in texts.items() if k.endswith(files.SUFFIXES)}
        return cls(spark, files.from_mapping(spark, code, project), config, sides, manifests.testpaths(root.get("pyproject.toml")), **more)

    @classmethod
    def over_project(cls, spark: SparkSession, root: str, include: list[str] = (), with_git: bool = True, advisories: str | None = None, coverage: str | None = None) -> Engine:
        """Over a folder that driver and executors see."""
        base = Path(root)
        texts = {p.name: p.read_text(errors="replace") for p in base.iterdir() if p.is_file() and (p.suffix in (".toml", ".txt", ".lock") or p.name == ".tesserarc.json")}
        config = manifests.parse_config(texts.get(".tesserarc.json"))
        rows = side_rows(texts) | {"installed": manifests.installed(root, os.environ.get("VIRTUAL_ENV")) or None, "churn": manifests.git_churn(root) or None if with_git else None}
        if coverage:
            rows["coverage"] = manifests.coverage(Path(coverage).read_text())
        sides = {k: spark.createDataFrame([("", *r) for r in got], SIDES[k]) for k, got in rows.items() if got is not None}
        known = Path(advisories) if advisories else base / ADVISORIES
        if advisories or known.is_file():
            sides["advisories"] = spark.createDataFrame(manifests.advisories(known.read_text()), SIDES["advisories"])
        return cls(spark, files.read_project(spark, root, "", config.exclude_dirs, include), config, sides, manifests.testpaths(texts.get("pyproject.toml")))

    # ------------------------------------------------------------ rules

    def drafts(self, engines: list[str]) -> DataFrame:
        """All drafts of some engines as one plan. An engine whose plan can't be made gives a finding that says so."""
        out = []
        for name in engines:
            category, rules = self.engines[name]
            try:
                out += [d for rule in rules if (d := rule(self.analysis)) is not None]
            except Exception:
                out.append(self._broken(name, category))
        if not out:
            return Fi.draft(self.analysis.graph.modules.filter("false"), "none", "none", "likely", F.lit(""), ["rel"], "none", F.lit(""), line=F.lit(1))
        return reduce(DataFrame.unionByName, out)

    def _broken(self, name: str, category: str) -> DataFrame:
        last = traceback.format_exc().strip().splitlines()[-1][:300]
        one = self.analysis.facts.records.groupBy("project").agg(F.min("rel").alias("rel"))
        return Fi.draft(one, "engine-panic", category, "certain", F.lit(f"engine {name} failed: {last}"), [F.lit(name)], "report-bug", F.lit("Report this"), line=F.lit(1), severity="error")

    def _ran(self, engines: list[str]) -> DataFrame:
        """The drafts, written. If their common plan fails while it runs, each engine runs by itself, so that one that
        fails costs only itself."""
        self.analysis.facts.narrow(self.workspace)
        run, _ = uuid.uuid4().hex[:8], self.analysis.graph.modules  # if the graph can't be made, no engine is at fault
        try:
            return self.workspace.keep(self.drafts(engines), f"drafts-{run}")
        except Exception:
            out = []
            for name in engines:
                try:
                    out.append(self.workspace.keep(self.drafts([name]), f"drafts-{run}-{name}"))
                except Exception:
                    out.append(self._broken(name, self.engines[name][0]))
            return reduce(DataFrame.unionByName, out)

    def _finalize(self, drafts: DataFrame) -> DataFrame:
        found = Fi.finish(drafts, self.tool)
        return Fi.configure(Fi.suppress(found, self.analysis.facts.listed("ignores")), self.config.severity, self.config.ignore)

    def findings(self, engines: list[str]) -> DataFrame:
        """The findings of some engines. Runs them; an engine that fails gives one finding, engine-panic."""
        return self._finalize(self._ran(engines))

    def audit(self) -> DataFrame:
        return self.findings(AUDIT)

    def dead_code(self) -> DataFrame:
        return self.findings(["dead-code", "members", "commented"])

    def deps(self) -> DataFrame:
        return self.findings(["deps"])

    def arch(self) -> DataFrame:
        return self.findings(["circular", "arch"])

    def complexity(self) -> DataFrame:
        return self.findings(["complexity", "hotspots", "cohesion"])

    def dupes(self) -> DataFrame:
        return self.findings(["dupes"])

    def types(self) -> DataFrame:
        return self.findings(["types"])

    def security(self) -> DataFrame:
        return self.findings(["security"])

    def supply_chain(self) -> DataFrame:
        return self.findings(["supply-chain"])

    def coverage(self) -> DataFrame:
        return self.findings(["coverage"])

    # ------------------------------------------------------------ reports

    def score(self, findings: DataFrame) -> DataFrame:
        return Fi.summary(findings, self.analysis.graph.modules.select("project", "rel"))

    def metrics(self) -> DataFrame:
        return measures.file_metrics(self.analysis)

    def metric_totals(self) -> DataFrame:
        return measures.metric_totals(self.metrics())

    def import_edges(self) -> DataFrame:
        """(project, importer, imported) of eager imports by dotted name."""
        from ..operators.rules.architecture import _dotted_edges

        return _dotted_edges(self.analysis).select("project", "importer", "imported").distinct()

    def trace(self, query: str) -> DataFrame:
        """(project, module, rel, imports, imported_by) of the module named so, else of the first whose name ends so."""
        m = self.analysis.graph.modules.select("project", "rel", "dotted")
        hit = m.filter((F.col("dotted") == query) | F.col("dotted").endswith("." + query) | (F.col("rel") == query) | F.col("rel").endswith("/" + query))
        rank = F.struct((F.col("dotted") != query) & (F.col("rel") != query), "dotted", "rel")
        one = hit.groupBy("project").agg(F.min_by(F.struct("dotted", "rel"), rank).alias("m")).select("project", F.col("m.dotted").alias("module"), F.col("m.rel").alias("rel"))
        e = self.import_edges()
        out = e.groupBy("project", F.col("importer").alias("module")).agg(F.array_sort(F.collect_set("imported")).alias("imports"))
        into = e.groupBy("project", F.col("imported").alias("module")).agg(F.array_sort(F.collect_set("importer")).alias("imported_by"))
        none = F.array().cast("array<string>")
        return one.join(out, ["project", "module"], "left").join(into, ["project", "module"], "left").withColumns({"imports": F.coalesce("imports", none), "imported_by": F.coalesce("imported_by", none)})

    def inspect(self, file: str) -> tuple[DataFrame, DataFrame]:
        """Findings of one file, and its neighbours."""
        at = F.col("location.path")
        return Fi.ordered(self.audit().filter((at == file) | at.endswith("/" + file))), self.trace(file)

    def list_of(self, kind: str) -> DataFrame:
        """(project, name): entry-points, files, or frameworks whose decorators are met."""
        m = self.analysis.graph.modules
        if kind == "files":
            return m.select("project", F.col("rel").alias("name"))
        if kind == "entry-points":
            return m.filter("is_entry").select("project", F.col("rel").alias("name"))
        marks = self.analysis.facts.listed("definitions").select("project", F.explode("decorators").alias("d")).filter(N.last_segment(F.col("d")).isin(N.HANDLER_MARKS))
        return marks.select("project", F.split("d", r"\.")[0].alias("name")).distinct()

    def fix_plan(self, findings: DataFrame | None = None) -> DataFrame:
        a = self.analysis
        return Fi.fix_plan(findings if findings is not None else self.dead_code(), a.graph.imports.filter("not lazy"), a.facts.listed("definitions"))

    def fixed(self) -> DataFrame:
        """(project, rel, src) of the files that the fix plan changes."""
        return Fi.apply_fixes(self.analysis.facts.records, self.fix_plan())

    def report(self, findings: DataFrame, hunks: DataFrame | None = None, gate: bool = False, least: str | None = None, baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(findings, summary) after the shared steps in their order: attribution, gate, confidence, baseline, score."""
        if hunks is not None:
            findings = Fi.attribute(findings, hunks)
        if gate:
            findings = findings.filter("attribution = 'introduced'")
        if least:
            findings = Fi.at_least(findings, least)
        if baseline is not None:
            findings = Fi.against_baseline(findings, baseline)
        return findings, self.score(findings)


def side_rows(root: dict[str, str]) -> dict[str, list | None]:
    """Rows of the tables that manifests at a root give; None for those it has nothing for."""
    pyproject = root.get("pyproject.toml")
    listed = sorted(n for n in root if manifests.is_requirements(n))
    names = [(n, "main") for f in listed for line in root[f].splitlines() if (n := manifests.requirement_name(line))]
    has = pyproject is not None or bool(listed)
    first = "pyproject.toml" if pyproject is not None else listed[0] if listed else ""
    return {
        "declared": [*manifests.declared(pyproject), *names] if has else None, "manifests": [(first,)] if has else None,
        "entry_points": manifests.entry_points(pyproject) or None, "pins": manifests.pins(root) or None, "ranges": manifests.ranges(root) or None,
    }
