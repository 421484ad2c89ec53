"""Cycles, layers, contracts, private names, policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import names as N
from ...functions.identity import occurrence
from ..findings import draft, text
from ..graph import cycles
from ..relations import first_rows


def _dotted_edges(a) -> DataFrame:
    """(project, importer, imported, rel) of eager edges by dotted names; rel is the importer's file."""
    m = a.facts.modules.select("project", "rel", "dotted")
    e = a.graph.edges.filter("not lazy")
    src = m.select("project", F.col("rel").alias("src"), F.col("dotted").alias("importer"))
    dst = m.select("project", F.col("rel").alias("dst"), F.col("dotted").alias("imported"))
    return e.join(src, ["project", "src"]).join(dst, ["project", "dst"]).select("project", "importer", "imported", F.col("src").alias("rel"))


def circular(a) -> DataFrame:
    """One finding for each import cycle, at its first file."""
    c = cycles(a.graph.edges.filter("not lazy"), a.workspace)
    names = a.graph.modules.select("project", F.col("rel").alias("member"), "dotted")
    one = c.select("project", F.col("members")[0].alias("rel"), F.explode("members").alias("member")).join(names, ["project", "member"])
    one = one.groupBy("project", "rel").agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "dotted"))), lambda x: x["dotted"]).alias("names"))
    return draft(one, "circular-dependency", "circular-dependency", "certain", text("import cycle: {}", F.array_join("names", " -> ")), [F.array_join("names", "\x1f")], "break-cycle", F.lit("Move what they share into a module of its own"), line=F.lit(1))


def upward(edges: DataFrame, order: list[str]) -> DataFrame:
    """Edges (importer, imported, ..) from a lower layer up, with both layers' places low and high in the order.

    A name's layer is the first configured one among its parts.
    """
    at = lambda c: reduce(lambda rest, k: F.when(F.array_contains(F.split(c, r"\."), order[k]), F.lit(k)).otherwise(rest), reversed(range(len(order))), F.lit(None).cast("int"))
    return edges.withColumn("low", at(F.col("importer"))).withColumn("high", at(F.col("imported"))).filter("high < low")


def layers(a) -> DataFrame | None:
    """Imports from a lower layer up."""
    order = a.config.layers
    if len(order) < 2:
        return None
    e = upward(_dotted_edges(a), order)
    name = F.array(*map(F.lit, order))
    why = text("`{}` ({}) imports `{}` of the higher layer {}", "importer", F.get(name, F.col("low")), "imported", F.get(name, F.col("high")))
    return draft(e, "layer-violation", "architecture", "certain", why, ["importer", "imported"], "respect-layers", F.lit("Turn the dependency around"), line=F.lit(1))


def forbidden(edges: DataFrame, source: str, targets: list[str]) -> DataFrame:
    """Edges from names under the source to names under any target."""
    return edges.filter(N.under(F.col("importer"), F.lit(source)) & N.any_of(N.under(F.col("imported"), F.lit(t)) for t in targets))


def contracts(a) -> DataFrame | None:
    """Forbidden imports, and imports between members of an independence group."""
    if not a.config.forbidden and not a.config.independent:
        return None
    e = _dotted_edges(a)
    found = []
    for source, targets in a.config.forbidden:
        hit = forbidden(e, source, targets)
        found.append(hit.withColumn("rule", F.lit("forbidden-import")).withColumn("why", text("`{}` imports `{}`, which `{}` may not", "importer", "imported", F.lit(source))))
    for group in a.config.independent:
        first = lambda c, g=group: F.coalesce(*[F.when(N.under(c, F.lit(m)), m) for m in g], F.lit(None).cast("string"))
        hit = e.withColumn("x", first(F.col("importer"))).withColumn("y", first(F.col("imported"))).filter("x <> y")
        found.append(hit.withColumn("rule", F.lit("independence-violation")).withColumn("why", text("`{}` and `{}` must stay apart: `{}` imports `{}`", "x", "y", "importer", "imported")).drop("x", "y"))
    rows = first_rows(reduce(DataFrame.unionByName, found), ["project", "rule", "importer", "imported"], ["rel", "why"])
    return draft(rows, F.col("rule"), "architecture", "certain", F.col("why"), ["importer", "imported"], "respect-contract", F.lit("Remove the dependency, or turn it around"), line=F.lit(1))


def private_imports(a) -> DataFrame:
    """Absolute imports of _names from another top-level package of the project."""
    tops = a.graph.targets.select("project", F.split("dotted", r"\.")[0].alias("top")).filter("top <> ''").distinct()
    i = a.graph.imports.filter("not lazy and relative_dots = 0").withColumn("top", F.split("module", r"\.")[0]).filter(F.col("top") != F.split("dotted", r"\.")[0]).join(tops, ["project", "top"], "left_semi")
    n = i.select("project", "rel", "ord", "line", "module", F.posexplode("names").alias("at", "name")).filter(F.col("name").startswith("_") & ~N.is_dunder(F.col("name")))
    n = n.withColumn("nth", occurrence(["project", "rel", "module", "name"], ["ord", "at"]))
    return draft(n, "private-import", "architecture", "likely", text("takes the private name `{}` from package `{}`", "name", "module"), ["rel", "module", "name", "nth"], "respect-interface", text("Use a public name of `{}`", "module"))


def policies(a) -> DataFrame | None:
    """Configured bans of imports and calls by prefix, within paths."""
    found = []
    for at, p in enumerate(a.config.policies):
        scope = N.any_of(F.col("rel").contains(x) for x in p["in_paths"]) if p["in_paths"] else F.lit(True)
        for k, (ban, rows, name, what) in enumerate(((p["forbid_import"], a.graph.imports.filter("not lazy"), "module", "import of"), (p["forbid_call"], a.facts.listed("calls"), "callee", "call to"))):
            if isinstance(ban, str):
                hit = rows.filter(scope & N.under(F.col(name), F.lit(ban))).select("project", "rel", "line", "ord", text(what + " `{}`", name).alias("what"))
                found.append(hit.withColumns({"id": F.lit(p["id"]), "ban": F.lit(ban), "level": F.lit(p["severity"]), "message": F.lit(p["message"]).cast("string"), "step": F.lit(2 * at + k)}))
    if not found:
        return None
    rows = reduce(DataFrame.unionByName, found).withColumn("nth", occurrence(["project", "rel", "id", "what"], ["step", "ord"]))
    why = F.coalesce("message", text("policy {} forbids `{}`", "id", "ban"))
    return draft(rows, F.col("id"), "architecture", "certain", F.concat("what", F.lit(": "), why), ["rel", "what", "ban", "nth"], "follow-policy", text("Remove the {}", "what"), severity=F.col("level"))
