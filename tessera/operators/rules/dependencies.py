"""Manifests against imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import names as N
from ...functions.identity import occurrence
from ..findings import draft, text
from ..graph import unresolved


def external_imports(a) -> DataFrame:
    """(project, rel, dotted, is_test, candidates, bare): imports of other distributions, with those that may provide them.

    An import that the environment knows has that one candidate; bare namespaces have no owner to name.
    """
    tops = a.graph.targets.select("project", F.split("dotted", r"\.")[0].alias("top")).distinct()
    i = a.graph.imports.filter("relative_dots = 0 and module <> ''").withColumn("top", F.split("module", r"\.")[0]).filter(~F.col("top").isin(N.STANDARD))
    i = i.join(tops, ["project", "top"], "left_anti")
    if a.installed is not None:
        i = i.join(a.installed.select("project", F.col("top"), F.col("dist").alias("owner")), ["project", "top"], "left")
    else:
        i = i.withColumn("owner", F.lit(None).cast("string"))
    i = i.withColumn("candidates", F.when(F.col("owner").isNotNull(), F.array("owner")).otherwise(N.candidate_dists(F.col("module"))))
    i = i.withColumn("bare", F.col("owner").isNull() & F.col("top").isin(N.NAMESPACES))
    tests = a.facts.modules.select("project", "rel", N.is_test(F.col("rel")).alias("is_test"))
    return i.join(tests, ["project", "rel"]).select("project", "rel", "dotted", "is_test", "candidates", "bare", "module", "lazy", "ord")


def _confidence():
    return F.when(F.col("global_dynamic"), "uncertain").otherwise("likely")


def _groups(a) -> DataFrame:
    return a.declared.groupBy("project", "dist").agg((F.count_if(F.col("group") != "dev") == 0).alias("dev_only"))


def unused_dependencies(a) -> DataFrame | None:
    """Declared outside of dev groups, and no import that it may provide."""
    if a.declared is None:
        return None
    used = external_imports(a).select("project", F.explode("candidates").alias("dist")).distinct()
    idle = _groups(a).filter("not dev_only and dist <> 'python'").join(used, ["project", "dist"], "left_anti").join(a.facts.dynamic, "project").join(a.manifests, "project")
    return draft(idle, "unused-dependency", "dependency-hygiene", _confidence(), text("`{}` is declared, but no file imports it", "dist"), ["dist"], "remove-dependency", text("Remove `{}` from {}", "dist", "manifest"), path="manifest", line=F.lit(1))


def undeclared_dependencies(a) -> DataFrame | None:
    """Imported, while no distribution that may provide it is declared; transitive where it's installed."""
    if a.declared is None:
        return None
    e = external_imports(a).withColumn("dist", F.col("candidates")[0])
    first = F.min(F.struct("rel", "lazy", "ord", "bare"))
    by_dist = e.groupBy("project", "dist").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("candidates"), first["bare"].alias("bare"))
    known = a.declared.select("project", F.col("dist").alias("c")).distinct()
    covered = by_dist.select("project", "dist", F.explode("candidates").alias("c")).join(known, ["project", "c"], "left_semi").select("project", "dist").distinct()
    open_ = by_dist.filter("not bare").join(covered, ["project", "dist"], "left_anti").join(a.facts.dynamic, "project").join(a.manifests, "project")
    if a.installed is not None:
        there = a.installed.select("project", "dist", F.lit(True).alias("there")).distinct()
        open_ = open_.join(there, ["project", "dist"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    else:
        open_ = open_.withColumn("there", F.lit(False))
    rule = F.when(F.col("there"), "transitive-dependency").otherwise("missing-dependency")
    why = F.when(F.col("there"), text("`{}` is imported and only there because something else needs it", "dist")).otherwise(text("`{}` is imported, but nothing declares it", "dist"))
    return draft(open_, rule, "dependency-hygiene", _confidence(), why, ["dist"], "add-dependency", text("Declare `{}` in {}", "dist", "manifest"), path="manifest", line=F.lit(1))


def misplaced_dependencies(a) -> DataFrame | None:
    """Declared for development only, and imported by code that isn't a test."""
    if a.declared is None:
        return None
    dev = _groups(a).filter("dev_only").select("project", "dist")
    e = external_imports(a).filter("not is_test").select("project", "rel", "dotted", F.explode("candidates").alias("dist")).join(dev, ["project", "dist"], "left_semi")
    one = e.groupBy("project", "dist").agg(F.min_by("dotted", "rel").alias("dotted")).join(a.facts.dynamic, "project").join(a.manifests, "project")
    return draft(one, "misplaced-dev-dependency", "dependency-hygiene", _confidence(), text("`{}` is a development dependency, yet `{}` imports it", "dist", "dotted"), ["dist"], "move-dependency", text("Declare `{}` for run time", "dist"), path="manifest", line=F.lit(1))


def unresolved_imports(a) -> DataFrame:
    u = unresolved(a.graph).withColumn("nth", occurrence(["project", "rel", "display"], ["line"]))
    return draft(u, "unresolved-import", "dependency-hygiene", "likely", text("no file of the project answers the import of `{}`", "display"), ["rel", "display", "nth"], "fix-import", text("Correct or remove the import of `{}`", "display"))
