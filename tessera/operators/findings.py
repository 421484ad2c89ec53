"""Findings: their rows, and what happens to them after the rules: identity, filters, score, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity

CONFIDENCE = {"certain": 0, "likely": 1, "uncertain": 2}
SEVERITY = {"error": 0, "warn": 1, "off": 2}
FINDING = (
    "project string, fingerprint string, rule string, category string, severity string, confidence string, attribution string, reason string,"
    " location struct<path: string, line: int, column: int, end_line: int>, actions array<struct<type: string, description: string, auto_fixable: boolean, suppression_comment: string>>"
)
DRAFT = ["project", "rule", "category", "severity", "confidence", "reason", "path", "line", "end_line", "identity", "action", "advice", "fixable"]


def text(template: str, *cols: Column | str) -> Column:
    """'{}' places of the template filled with columns."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for c, part in zip(cols, parts[1:]):
        out += [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")), F.lit(part)]
    return F.concat(*out)


def draft(df: DataFrame, rule: str | Column, category: str, confidence: str | Column, reason: Column, parts: list, action: str | Column, advice: Column, path: Column | str = "rel", line: Column | str = "line", end_line: Column | None = None, fixable: Column | None = None, severity: str | Column = "warn") -> DataFrame:
    """Rows of DRAFT. Identities stay plain text here; they are hashed once, after all rules are united."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    at = F.col(line) if isinstance(line, str) else line
    return df.select(
        "project", lit(rule).alias("rule"), F.lit(category).alias("category"), lit(severity).alias("severity"), lit(confidence).alias("confidence"), reason.alias("reason"),
        (F.col(path) if isinstance(path, str) else path).alias("path"), at.cast("int").alias("line"), (F.lit(None) if end_line is None else end_line).cast("int").alias("end_line"),
        identity.joined(*[F.col(p) if isinstance(p, str) else p for p in parts]).alias("identity"), lit(action).alias("action"), advice.alias("advice"),
        (F.lit(False) if fixable is None else fixable).alias("fixable"),
    )


def finish(drafts: DataFrame, tool: str = "tessera") -> DataFrame:
    """Drafts to findings; the one Python step of a report's plan is the hash."""
    comment = F.concat(F.lit(f"# {tool}: ignore["), "rule", F.lit("]"))
    return drafts.select(
        "project", identity.fingerprint(F.col("rule"), F.col("identity")).alias("fingerprint"), "rule", "category", "severity", "confidence", F.lit(None).cast("string").alias("attribution"), "reason",
        F.struct("path", "line", F.lit(0).alias("column"), "end_line").alias("location"),
        F.array(F.struct(F.col("action").alias("type"), F.col("advice").alias("description"), F.col("fixable").alias("auto_fixable"), comment.alias("suppression_comment"))).alias("actions"),
    )


def suppress(findings: DataFrame, ignores: DataFrame) -> DataFrame:
    """Without those that a comment on their line silences. ignores: (project, rel, line, rule or '*')."""
    f = findings.withColumn("_path", F.col("location.path")).withColumn("_line", F.col("location.line"))
    i = ignores.groupBy(F.col("project").alias("_p"), F.col("rel").alias("_r"), F.col("line").alias("_l")).agg(F.collect_set("rule").alias("_rules"))
    on = (f.project == i._p) & (f._path == i._r) & (f._line == i._l) & (F.array_contains("_rules", "*") | F.array_contains(F.col("_rules"), F.col("rule")))
    return f.join(i, on, "left_anti").drop("_path", "_line")


def configure(findings: DataFrame, severity: dict[str, str], ignore: list[str]) -> DataFrame:
    """Severities by rule, else by category; what is off, or lies on an ignored path, goes."""
    if severity:
        levels = F.create_map(*[F.lit(x) for kv in severity.items() for x in kv])
        findings = findings.withColumn("severity", F.coalesce(F.try_element_at(levels, F.col("rule")), F.try_element_at(levels, F.col("category")), F.col("severity")))
    for part in ignore:
        findings = findings.filter(~F.col("location.path").contains(part))
    return findings.filter("severity <> 'off'")


def at_least(findings: DataFrame, confidence: str) -> DataFrame:
    return findings.filter(F.col("confidence").isin([c for c, r in CONFIDENCE.items() if r <= CONFIDENCE[confidence]]))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("project", "location.path", "location.line", "rule", "fingerprint")


def summary(findings: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each project: counts, files and the score. files: (project, rel).

    penalty: error 3, warn 1, times certain 1, likely 0.5, uncertain 0.15; score = 100 - 10 * penalty / files.
    """
    weight = F.when(F.col("severity") == "error", 3.0).when(F.col("severity") == "warn", 1.0).otherwise(0.0)
    doubt = F.when(F.col("confidence") == "certain", 1.0).when(F.col("confidence") == "likely", 0.5).otherwise(0.15)
    per = findings.groupBy("project").agg(
        F.count("*").alias("total"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"),
        F.count_if(F.col("attribution") == "introduced").alias("introduced"), F.sum(weight * doubt).alias("penalty"),
    )
    n = files.groupBy("project").agg(F.count("*").alias("files_analyzed"))
    both = n.join(per, "project", "left").na.fill(0, ["total", "errors", "warnings", "introduced", "penalty"])
    score = F.round(F.least(F.greatest(100 - 10 * F.col("penalty") / F.col("files_analyzed"), F.lit(0.0)), F.lit(100.0))).cast("int")
    return both.select("project", "total", "errors", "warnings", "files_analyzed", "introduced", score.alias("quality_score"))


def against_baseline(findings: DataFrame, known: DataFrame, new: bool = True) -> DataFrame:
    """Findings whose fingerprint the baseline lacks (new), or has."""
    return findings.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti" if new else "left_semi").select(findings.columns)


def closest_key(rows: DataFrame, path: str, keys: DataFrame, key: str) -> DataFrame:
    """(project, path, key): each path's key: the equal one, else the least of those with its file name."""
    wanted = rows.select("project", path).distinct()
    found = keys.select("project", key).distinct()
    named = found.select("project", key, F.element_at(F.split(key, "/"), -1).alias("_name"))
    same = wanted.join(found, (wanted.project == found.project) & (wanted[path] == F.regexp_replace(found[key], r"^\./", ""))).select(wanted.project, wanted[path], found[key])
    rest = wanted.join(same, ["project", path], "left_anti").withColumn("_name", F.element_at(F.split(path, "/"), -1))
    loose = rest.join(named, ["project", "_name"]).groupBy("project", path).agg(F.min(key).alias(key))
    return same.groupBy("project", path).agg(F.min(key).alias(key)).unionByName(loose)


def attribute(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """introduced where a changed line holds the finding, else inherited; hunks: (project, path, start, end).

    A file is found by its path, else by its name. The join has the file in its key, so ranges are only
    compared within one file.
    """
    f = findings.withColumn("_path", F.col("location.path")).withColumn("_line", F.col("location.line"))
    keys = closest_key(f, "_path", hunks.withColumnRenamed("path", "_key"), "_key")
    spans = hunks.groupBy("project", F.col("path").alias("_key")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    marked = f.join(keys.join(spans, ["project", "_key"]), ["project", "_path"], "left")
    hit = F.coalesce(F.exists("_spans", lambda s: F.col("_line").between(s["start"], s["end"])), F.lit(False))
    return marked.withColumn("attribution", F.when(hit, "introduced").otherwise("inherited")).select(findings.columns)


def fix_plan(findings: DataFrame, facts_imports: DataFrame, definitions: DataFrame) -> DataFrame:
    """(project, path, start_line, end_line, description) of what is safe to delete: certain, fixable, unused."""
    able = findings.filter(F.col("rule").isin("unused-export", "unused-import") & (F.col("confidence") == "certain") & F.col("actions")[0]["auto_fixable"] & F.col("location.path").endswith(".py"))
    at = able.select("project", F.col("location.path").alias("rel"), F.col("location.line").alias("line"), F.col("location.end_line").alias("until"), "rule", F.col("actions")[0]["description"].alias("description"))
    spans = facts_imports.select("project", "rel", "line", "end_line").groupBy("project", "rel", "line").agg(F.max("end_line").alias("ends"))
    return at.join(spans, ["project", "rel", "line"], "left").select("project", F.col("rel").alias("path"), F.col("line").alias("start_line"), F.coalesce("until", "ends", "line").alias("end_line"), "description").distinct()


def apply_fixes(records: DataFrame, edits: DataFrame) -> DataFrame:
    """(project, rel, src) of the edited files: the edits' lines are gone, of overlapping edits the later start wins."""
    spans = edits.groupBy("project", F.col("path").alias("rel")).agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line")), False).alias("spans"))
    lines = F.split("src", r"(?<=\n)", -1)
    start = F.struct(F.lit(2**31 - 1).alias("low"), F.array().cast("array<struct<start_line: int, end_line: int>>").alias("kept"))
    chosen = F.aggregate(
        F.col("spans").cast("array<struct<start_line: int, end_line: int>>"), start.cast("struct<low: int, kept: array<struct<start_line: int, end_line: int>>>"),
        lambda a, s: F.when(s["end_line"] < a["low"], F.struct(s["start_line"].alias("low"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a),
    )["kept"]
    kept = F.filter(F.col("lines"), lambda _, i: ~F.exists("chosen", lambda s: (i + 1).between(s["start_line"], s["end_line"])))
    joined = records.select("project", "rel", "src").join(spans, ["project", "rel"]).withColumn("lines", lines).withColumn("chosen", chosen)
    return joined.select("project", "rel", F.array_join(kept, "").alias("src"))
