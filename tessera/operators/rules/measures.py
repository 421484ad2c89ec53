"""Complexity, churn, cohesion, duplication, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import names as N
from ...functions.identity import occurrence
from .. import relations
from ..clones import clones
from ..findings import closest_key, draft, text
from ..relations import hot

FILE = ["project", "rel"]
LEAST_CHURN, LEAST_COMPLEXITY, LEAST_METHODS, COHESION = 3, 15, 3, 0.8
ROLLUP_FUNCTIONS, ROLLUP_SHARE = 20, 0.6


def functions(a) -> DataFrame:
    """All functions, each with its number among those of its name; numbers count before any filter."""
    return a.facts.listed("functions").withColumn("nth", occurrence([*FILE, "name"], ["ord"]))


def complex_functions(a) -> DataFrame:
    f = functions(a).filter((F.col("cyclomatic") > a.config.max_cyclomatic) | (F.col("cognitive") > a.config.max_cognitive))
    why = text("`{}` has cyclomatic complexity {} and cognitive complexity {}", "name", "cyclomatic", "cognitive")
    return draft(f, "high-complexity", "complexity", "certain", why, ["rel", "name", "nth"], "split-function", text("Split `{}`", "name"), end_line=F.col("end_line"))


def hotspots(a) -> DataFrame | None:
    """Complex files that change often. a.churn: (project, path, commits)."""
    if a.churn is None:
        return None
    size = a.facts.listed("functions").groupBy(*FILE).agg(F.sum("cyclomatic").alias("complexity"))
    commits = closest_key(size, "rel", a.churn, "path").join(a.churn.groupBy("project", "path").agg(F.max("commits").alias("commits")), ["project", "path"]).drop("path")
    return draft(hot(size, commits, FILE, LEAST_COMPLEXITY, LEAST_CHURN), "hotspot", "complexity", "likely", text("{} commits changed this file of complexity {}", "commits", "complexity"), ["rel"], "simplify-file", F.lit("Simplify what changes so often"), path="rel", line=F.lit(1))


def cohesion(a) -> DataFrame:
    """(project, rel, class_ord, name, line, end_line, methods, attributes, uses, lcom) of classes with attributes."""
    c = a.facts.listed("classes").select(*FILE, F.col("ord").alias("class_ord"), "name", "line", "end_line", F.filter("methods", lambda m: ~(m["method"].startswith("__") & m["method"].endswith("__"))).alias("own"))
    used = F.flatten(F.transform("own", lambda m: F.array_distinct(m["attrs"])))
    c = c.withColumns({"methods": F.size("own"), "attributes": F.size(F.array_distinct(used)), "uses": F.size(used)}).filter((F.col("methods") >= LEAST_METHODS) & (F.col("attributes") > 0))
    return c.drop("own").withColumn("lcom", N.lcom(F.col("uses"), F.col("attributes"), F.col("methods")))


def low_cohesion(a) -> DataFrame:
    c = cohesion(a).filter(F.col("lcom") > COHESION)
    why = text("`{}`: its {} methods share few of {} attributes (lack of cohesion {})", "name", "methods", "attributes", F.format_number("lcom", 2))
    return draft(c, "low-cohesion", "complexity", "uncertain", why, ["rel", "name"], "split-class", text("Split `{}`", "name"), end_line=F.col("end_line"))


def duplication(a) -> DataFrame:
    c = clones(a.facts, a.workspace, a.config.min_tokens, a.config.min_lines)
    why = text("{} tokens occur in {} places: {}", "length", F.size("places"), F.array_join("places", ", "))
    return draft(c, "duplication", "duplication", "likely", why, ["hash", "length"], "extract-function", F.lit("Share one definition"), end_line=F.col("end_line"))


def _public(f: DataFrame) -> DataFrame:
    return f.filter(~F.col("name").startswith("_") & (F.col("params_total") > 0))


BARE = "params_annotated = 0 and not return_annotated"


def census(a) -> DataFrame:
    """(project, top, total, untyped, rel): public functions with parameters by top-level package; rel stands for it."""
    top = F.split("dotted", r"\.")[0]
    files = a.graph.modules.select(*FILE, top.alias("top"), (F.col("is_package") & (F.col("dotted") == top)).alias("init"))
    anchor = files.groupBy("project", "top").agg(F.min_by("rel", F.struct(~F.col("init"), F.col("rel"))).alias("anchor"))
    f = relations.census(_public(a.facts.listed("functions")).join(files, FILE), ["project", "top"], F.expr(BARE), ROLLUP_FUNCTIONS, ROLLUP_SHARE)
    return f.join(anchor, ["project", "top"])


def untyped_functions(a) -> DataFrame:
    """Public functions without any annotation, and packages that leave most so."""
    packages = census(a)
    rolled = packages.filter("rolled")
    share = F.round(100 * F.col("untyped") / F.col("total")).cast("int")
    whole = draft(rolled, "untyped-function", "type-health", "likely", text("package `{}` has no annotations on {} of {} public functions ({} %)", "top", "untyped", "total", share), [F.lit("package"), "top"], "add-annotations", text("Annotate `{}`", "top"), path="anchor", line=F.lit(1))
    f = _public(functions(a)).filter(BARE).join(a.graph.modules.select(*FILE, F.split("dotted", r"\.")[0].alias("top")), FILE).join(packages.select("project", "top", "rolled"), ["project", "top"], "left")
    one = draft(f, "untyped-function", "type-health", F.when(F.col("rolled"), "uncertain").otherwise("likely"), text("`{}` has no annotations", "name"), ["rel", "name", "nth"], "add-annotations", text("Annotate `{}`", "name"), end_line=F.col("end_line"))
    return whole.unionByName(one)


def type_leaks(a) -> DataFrame:
    t = a.facts.listed("type_leaks").withColumn("nth", occurrence([*FILE, "function", "type_name"], ["ord"])).join(a.graph.modules.select(*FILE, "sink"), FILE)
    where = F.when(F.col("is_return"), "returns").otherwise("takes")
    return draft(t, "private-type-leak", "type-health", F.when(F.col("sink"), "uncertain").otherwise("likely"), text("public `{}` {} the private type `{}`", "function", where, "type_name"), ["rel", "function", "type_name", "nth"], "publish-type", text("Make `{}` public, or keep it out of the signature", "type_name"))


def file_metrics(a) -> DataFrame:
    """A row for each file: lines by kind, functions, complexity, maintainability."""
    kinds = a.facts.lines.select(*FILE, N.line_kind(F.col("text")).alias("kind")).groupBy(*FILE).agg(F.count("*").alias("loc"), F.count_if(F.col("kind") == "blank").alias("blank_lines"), F.count_if(F.col("kind") == "comment").alias("comment_lines"))
    f = a.facts.listed("functions").groupBy(*FILE).agg(F.count("*").alias("functions"), F.sum("cyclomatic").alias("total_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"))
    m = a.facts.records.select(*FILE, "halstead_volume").join(kinds, FILE, "left").join(f, FILE, "left").na.fill(0)
    sloc = F.greatest(F.col("loc") - F.col("blank_lines") - F.col("comment_lines"), F.lit(1))
    mi = N.maintainability(F.col("halstead_volume"), F.col("total_cyclomatic"), sloc)
    return m.select(*FILE, "loc", sloc.alias("sloc"), "comment_lines", "blank_lines", "functions", "total_cyclomatic", "max_cyclomatic", F.round(mi, 2).alias("maintainability_index"), N.maintainability_rank(mi).alias("mi_rank"))


def metric_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("project").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"), F.sum("sloc").alias("sloc"), F.sum("functions").alias("functions"), F.round(F.avg("maintainability_index"), 2).alias("mean_maintainability_index"))
