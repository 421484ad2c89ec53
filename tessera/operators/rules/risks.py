"""Security hits and advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.identity import occurrence
from ...functions.versions import specs_intersect, with_match
from ..findings import draft, text
from ..relations import first_rows

DOUBTFUL = ["dangerous-eval", "insecure-random", "request-without-timeout", "sql-injection", "try-except-pass", "unsafe-deserialization"]
CWE = {
    "dangerous-eval": 95, "flask-debug-true": 94, "hardcoded-secret": 798, "insecure-random": 330, "jinja2-autoescape-false": 79, "request-without-timeout": 400, "sql-injection": 89,
    "subprocess-shell-true": 78, "tls-verify-disabled": 295, "try-except-pass": 703, "unsafe-deserialization": 502, "unsafe-yaml-load": 20, "weak-cipher": 327, "weak-hash": 327,
}


def security(a) -> DataFrame:
    """Hits of the extractor; in test, documentation and example trees they are uncertain."""
    h = a.facts.listed("security_hits").withColumn("nth", occurrence(["project", "rel", "rule", "detail"], ["ord"])).join(a.graph.modules.select("project", "rel", "is_dev"), ["project", "rel"])
    confidence = F.when(F.col("is_dev") | F.col("rule").isin(DOUBTFUL), "uncertain").otherwise("likely")
    cwe = F.try_element_at(F.create_map(*[F.lit(x) for kv in CWE.items() for x in kv]), F.col("rule"))
    why = F.concat("detail", F.coalesce(text(" (CWE-{})", cwe), F.lit("")), F.when(F.col("is_dev"), " in test, documentation or example code").otherwise(""))
    return draft(h, F.col("rule"), "security", confidence, why, ["rel", "detail", "nth"], "review-security", F.lit("Review this place"))


def _alias(aliases: Column, own: Column) -> Column:
    return F.coalesce(F.get(F.filter(aliases, lambda x: x.startswith("CVE-")), 0), own)


def _advised(rows: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies with the advisories on them; advisories are a small table next to the dependencies of many projects."""
    adv = advisories.select("seq", "id", F.col("package").alias("name"), "specs", "summary", _alias(F.col("aliases"), F.col("id")).alias("alias"))
    note = F.when(F.col("summary") != "", F.concat(F.lit(": "), "summary")).otherwise("")
    return rows.join(adv, "name").withColumn("note", note)


def _spread(rows: DataFrame) -> DataFrame:
    """A row for each spec, '' where an advisory names none: that is, all versions."""
    return rows.withColumn("affected", F.explode(F.when(F.size("specs") > 0, F.col("specs")).otherwise(F.array(F.lit("")))))


def _report(rows: DataFrame, confidence, why: Column, key: str) -> DataFrame:
    rows = first_rows(rows.withColumn("why", why), ["project", "name", key, "alias"], ["source", "line", "seq"])
    return draft(rows, "vulnerable-dependency", "security", confidence, F.col("why"), ["name", key, "id"], "upgrade-dependency", text("Move `{}` out of what {} affects", "name", "id"), path="source")


def vulnerable_pins(a) -> DataFrame | None:
    """a.pins: (project, name, version, source, line). a.advisories: (seq, id, package, specs, summary, aliases, severity)."""
    if a.pins is None or a.advisories is None:
        return None
    keys = ["project", "name", "version", "source", "line", "seq", "id", "alias", "note"]
    hit = with_match(_spread(_advised(a.pins, a.advisories)), "version", "affected", "within").filter((F.size("specs") == 0) | F.col("within")).select(*keys).distinct()
    return _report(hit, "certain", text("`{}` {} is affected by {}{}", "name", "version", "alias", "note"), "version")


def vulnerable_ranges(a) -> DataFrame | None:
    """Declared ranges without a pin: by the installed version where there's one, else by whether the ranges meet."""
    if a.ranges is None or a.advisories is None:
        return None
    open_ = a.ranges if a.pins is None else a.ranges.join(a.pins.select("project", "name").distinct(), ["project", "name"], "left_anti")
    if a.installed is not None:
        versions = a.installed.groupBy("project", F.col("dist").alias("name")).agg(F.min("version").alias("have"))
        open_ = open_.join(versions, ["project", "name"], "left")
    else:
        open_ = open_.withColumn("have", F.lit(None).cast("string"))
    keys = ["project", "name", "spec", "source", "line", "seq", "id", "alias", "note", "have", "key"]
    rows = with_match(_spread(_advised(open_, a.advisories)).withColumn("key", F.coalesce("have", "spec")), "have", "affected", "within")
    every = F.size("specs") == 0
    meets = F.when(F.col("have").isNotNull(), every | F.col("within")).when(F.col("spec") == "", F.lit(True)).otherwise(~every & specs_intersect("spec", "affected"))
    hit = rows.filter(meets).select(*keys).distinct()
    why = F.when(F.col("have").isNotNull(), text("installed `{}` {} is affected by {}{}", "name", "have", "alias", "note")).otherwise(text("what `{}` {} allows includes versions affected by {}{}", "name", "spec", "alias", "note"))
    return _report(hit, F.when(F.col("have").isNotNull(), "certain").otherwise("uncertain"), why, "key")
