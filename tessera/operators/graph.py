"""The import graph: edges, reachability, cycles, unresolved imports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..scratch import Workspace
from ..sources.facts import Facts
from .components import components
from .relations import each_group


SMALL, HOPS, MERGE = 10_000, 8, 16  # a frontier that steps HOPS times in one job; folders that are merged into one


def reach(edges: DataFrame, seeds: DataFrame, key: list[str], workspace: Workspace, src: str = "src", dst: str = "dst") -> DataFrame:
    """(key, node): nodes that paths from the seeds end in, the seeds included.

    A frontier at a time; each is written beside the earlier ones, so the plan stays short and what is
    visited is one table, merged now and then. A small frontier goes several steps in one job, since on long chains jobs
    cost more than steps. edges: key, src, dst. seeds: key, node.
    """
    spark, root = edges.sparkSession, f"{workspace.root}/reach"
    names, arrows = [*key, "node"], edges.select(*key, F.col(src).alias("node"), F.col(dst).alias("_to"))
    front = seeds.select(*names).distinct()
    schema, parts, step = front.schema, [], 0
    read = lambda *paths: spark.read.schema(schema).parquet(*paths)
    while True:
        front.write.parquet(f"{root}/step={step:05d}")
        parts.append(f"{root}/step={step:05d}")
        last = read(parts[-1])
        n = last.count()
        if not n:
            return read(*parts)
        if len(parts) >= MERGE:
            read(*parts).write.parquet(f"{root}/merged={step:05d}")
            parts = [f"{root}/merged={step:05d}"]
        ahead, found = last, []
        for _ in range(HOPS if n <= SMALL else 1):
            ahead = arrows.join(ahead, names, "left_semi").select(*key, F.col("_to").alias("node")).distinct()
            found.append(ahead)
        front, step = reduce(DataFrame.union, found).distinct().join(read(*parts), names, "left_anti"), step + 1


def tarjan(pairs: list[tuple]) -> list[list]:
    """Strongly connected components of more than one node, members and components sorted."""
    out_of: dict = {}
    for a, b in sorted(pairs):
        out_of.setdefault(a, []).append(b)
    index: dict = {}
    low: dict = {}
    held: list = []
    inside: set = set()
    found: list[list] = []
    for start in sorted(out_of):
        if start in index:
            continue
        work = [(start, iter(out_of[start]))]
        index[start] = low[start] = len(index)
        held.append(start)
        inside.add(start)
        while work:
            node, rest = work[-1]
            step = next(rest, None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    cut = held.index(node) if held[-1] != node else len(held) - 1
                    group = held[cut:]
                    del held[cut:]
                    inside.difference_update(group)
                    if len(group) > 1:
                        found.append(sorted(group))
            elif step not in index:
                index[step] = low[step] = len(index)
                held.append(step)
                inside.add(step)
                work.append((step, iter(out_of.get(step, ()))))
            elif step in inside:
                low[node] = min(low[node], index[step])
    return sorted(found)


def cycles(edges: DataFrame, workspace: Workspace) -> DataFrame:
    """(project, members): import cycles.

    Only edges that have both an edge before and one after them may lie on one. A connected group of those is one
    task's work, not a project.
    """
    both = edges.select("project", F.col("src").alias("node")).intersect(edges.select("project", F.col("dst").alias("node")))
    inner = edges.join(both.withColumnRenamed("node", "src"), ["project", "src"], "left_semi").join(both.withColumnRenamed("node", "dst"), ["project", "dst"], "left_semi")
    inner = workspace.keep(inner.select("project", "src", "dst").distinct(), "inner")
    node = lambda c: F.struct("project", F.col(c).alias("rel"))
    roots = components(inner.select(node("src").alias("u"), node("dst").alias("v")), workspace)
    roots = roots.select(F.col("node.project").alias("project"), F.col("node.rel").alias("src"), F.col("root.rel").alias("part"))
    parted = inner.join(roots, ["project", "src"], "left").withColumn("part", F.coalesce("part", "src"))

    def run(rows: list[dict]) -> list[dict]:
        return [{"project": rows[0]["project"], "members": group} for group in tarjan([(r["src"], r["dst"]) for r in rows])]

    arrow = pa.schema([("project", pa.string()), ("members", pa.list_(pa.string()))])
    return each_group(parted.select("project", "part", "src", "dst"), ["project", "part"], [], run, "project string, members array<string>", arrow)


@dataclass
class Graph:
    """modules: with reachable, global_dynamic and final is_entry; made when first asked for, as what reads edges only
    needs no reachability. imports: all of them, lazy ones marked, with the dotted target, and as idle the bindings that
    their file neither uses nor exports. edges: (project, src, dst, lazy)
    of rels. imported: (project, rel, name) that others import from rel."""

    reached: Callable[[], DataFrame]
    imports: DataFrame
    edges: DataFrame
    imported: DataFrame
    targets: DataFrame

    @cached_property
    def modules(self) -> DataFrame:
        return self.reached()


def by_name(modules: DataFrame) -> DataFrame:
    """(project, dotted, rel): the first file of each dotted name."""
    return modules.groupBy("project", "dotted").agg(F.min("rel").alias("rel"))


def entry_modules(modules: DataFrame, wanted: DataFrame) -> DataFrame:
    """(project, module, dotted): entry-point modules by equal name, else by a suffix that one module has."""
    names = modules.select("project", "dotted")
    asked = wanted.select("project", "module").distinct()
    same = asked.join(names.distinct(), (asked.module == names.dotted) & (asked.project == names.project), "left_semi").select("project", "module", F.col("module").alias("dotted"))
    rest = asked.join(same, ["project", "module"], "left_anti")
    # Every suffix of a dotted name is a key, so that the match is an equality.
    parts = F.split("dotted", r"\.")
    tails = names.select("project", "dotted", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "."))).alias("module")).filter(F.size(parts) > 1)
    ends = rest.join(tails, ["project", "module"]).groupBy("project", "module").agg(F.count("*").alias("n"), F.min("dotted").alias("dotted")).filter("n = 1").drop("n")
    return same.unionByName(ends)


def join_dotted(base: Column, name: Column) -> Column:
    return F.when(base == "", name).otherwise(F.concat(base, F.lit("."), name))


def build_graph(facts: Facts, workspace: Workspace, entry_points: DataFrame | None = None) -> Graph:
    modules = facts.modules.join(facts.dynamic, "project")
    # What a file's own record tells of its imports is found before they are rows of their own.
    idle = F.array_except(F.flatten("imports.bindings"), F.concat("local_uses", "dunder_all"))
    rows = facts.table.select("project", "rel", "nested_imports", "imports", N.dotted_name(F.col("rel")).alias("dotted"), N.is_package(F.col("rel")).alias("is_package"), idle.alias("_idle"))
    part = lambda name, lazy: rows.select("project", "rel", "dotted", "is_package", "_idle", F.inline(name)).withColumn("lazy", F.lit(lazy))
    listed = part("imports", False).unionByName(part("nested_imports", True)).withColumn("idle", F.array_intersect("bindings", "_idle")).drop("_idle")
    imports = listed.withColumn("target", N.import_target(F.col("dotted"), F.col("is_package"), F.col("relative_dots"), F.col("module")))
    imports = workspace.keep(imports, "imports")
    index = by_name(modules)
    places = index.select("project", F.col("dotted").alias("target"), F.col("rel").alias("dst"))
    direct = imports.join(places, ["project", "target"])
    inner = imports.select("project", "rel", "lazy", F.explode("names").alias("name"), "target").withColumn("target", join_dotted(F.col("target"), F.col("name"))).join(places, ["project", "target"])
    edges = direct.select("project", F.col("rel").alias("src"), "dst", "lazy").union(inner.select("project", F.col("rel").alias("src"), "dst", "lazy")).filter("src <> dst").distinct()
    edges = workspace.keep(edges, "edges")
    symbols = F.when(F.col("is_star"), F.concat("names", F.array(F.lit("*")))).otherwise(F.col("names"))
    imported = direct.select("project", F.col("dst").alias("rel"), F.explode(symbols).alias("name")).distinct()

    def reached() -> DataFrame:
        found = modules
        if entry_points is not None:
            marked = entry_modules(modules, entry_points).select("project", "dotted", F.lit(True).alias("marked")).distinct()
            found = modules.join(marked, ["project", "dotted"], "left").withColumn("is_entry", F.col("is_entry") | F.coalesce("marked", F.lit(False))).drop("marked")
        seen = reach(edges, found.filter("is_entry").select("project", F.col("rel").alias("node")), ["project"], workspace)
        found = found.join(seen.select("project", F.col("node").alias("rel"), F.lit(True).alias("reachable")), ["project", "rel"], "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))
        return workspace.keep(found, "modules")

    return Graph(reached, imports, edges, imported, index)


def unresolved(graph: Graph) -> DataFrame:
    """(project, rel, line, display): imports of the project's own packages that no file answers."""
    here = graph.targets.select("project", F.col("dotted").alias("target"))
    asked = graph.imports.filter("target <> ''")
    open_ = asked.join(here, ["project", "target"], "left_anti")
    names = open_.select("project", "rel", "lazy", "ord", "target", F.explode("names").alias("name"))
    inner = names.withColumn("target", join_dotted(F.col("target"), F.col("name"))).join(here, ["project", "target"], "left_semi").select("project", "rel", "lazy", "ord").distinct()
    open_ = open_.join(inner, ["project", "rel", "lazy", "ord"], "left_anti").withColumn("top", F.split("target", r"\.")[0])
    tops = graph.targets.select("project", F.split("dotted", r"\.")[0].alias("top")).distinct()
    own = open_.filter("relative_dots > 0").unionByName(open_.filter("relative_dots = 0").join(tops, ["project", "top"], "left_semi").select(open_.columns))
    return own.select("project", "rel", "line", F.concat(F.repeat(F.lit("."), F.col("relative_dots")), "module").alias("display")).distinct()
