"""Findings as text: JSON, SARIF, annotations, JUnit, graphs, baselines. Small ends of a report, on the driver."""

from __future__ import annotations

import json
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import ordered

SARIF_LEVEL = {"error": "error", "warn": "warning", "off": "none"}
LSP_SEVERITY = {"error": 1, "warn": 2, "off": 4}
#: rule -> (what it says, how sure it can be, what to do)
RULES = {
    "engine-panic": ("One of the analyses broke down, and what it would have found is missing; the others ran as ever.", "certain", "Report the message. The project need not change."),
    "unused-file": ("No entry point leads to this module by imports.", "likely; uncertain where the project looks names up at run time", "Delete it, or name what loads it as an entry point."),
    "unused-export": ("A module-level function, class or variable that neither its module nor another one uses, and that __all__ doesn't list. Handlers of frameworks, tests and script targets are spared.", "certain for private names in reached modules; likely otherwise; uncertain with dynamic access", "Remove it, or list it in __all__."),
    "unused-import": ("An import that binds names which its module never reads. Re-exports by `as` of the same name, __future__, typing-only and noqa lines are spared.", "certain in reached modules; likely in unreached or vendored ones or where the import registers handlers; uncertain in packages' __init__ and under try or if", "Remove the import; `fix` does so where it's certain."),
    "unused-variable": ("A local name that is assigned and never read.", "likely", "Drop the assignment but keep what its right side does, or call it _."),
    "unused-parameter": ("A parameter that the body doesn't read. Methods that override or implement something, and decorated functions, are spared.", "uncertain, as callers or interfaces may ask for it", "Remove it, or start its name with an underscore."),
    "unused-method": ("A method whose name no file of the project accesses.", "likely for private names; uncertain for public ones", "Remove it unless users of the class call it."),
    "unused-attribute": ("A class-level name that nothing accesses as an attribute or reads.", "likely for private names; uncertain for public ones", "Remove it unless something reads it by name at run time."),
    "unused-enum-member": ("An enum member that no file names.", "uncertain, as enums are often looked up by value", "Remove it unless stored data hold its value."),
    "unreachable-code": ("A statement below a return, raise, break, continue or exit of its own block.", "certain", "Remove it, or move the exit."),
    "commented-code": ("A comment that reads like a statement.", "likely", "Delete it; history keeps it."),
    "cold-code": ("A function of a covered file none of whose lines ran.", "likely", "Test it, or remove it."),
    "duplicate-export": ("A package's __init__ takes one name from two modules, so that the later hides the earlier.", "likely", "Keep one source, or rename."),
    "unused-dependency": ("A declared distribution that no import needs.", "likely; uncertain with dynamic access", "Remove it from the manifest."),
    "missing-dependency": ("An import that no declared distribution may provide and that isn't installed either.", "likely; uncertain with dynamic access", "Declare it."),
    "transitive-dependency": ("An import that works only because another distribution pulled it in.", "likely; uncertain with dynamic access", "Declare it, as that other distribution may drop it."),
    "misplaced-dev-dependency": ("A distribution declared for development only, which code outside of tests imports.", "likely; uncertain with dynamic access", "Declare it for run time."),
    "unresolved-import": ("An import of the project's own packages that no file answers.", "likely, as a build step may make the module", "Correct it, or remove it."),
    "vulnerable-dependency": ("A pinned, installed or allowed version that an advisory names.", "certain for pins and installed versions; uncertain for ranges", "Move out of the affected versions."),
    "circular-dependency": ("Modules that import each other when loaded.", "certain", "Move what they share into a module of its own, or import late."),
    "layer-violation": ("An import from a lower layer into a higher one.", "certain", "Turn the dependency around."),
    "forbidden-import": ("An import that a contract rules out.", "certain", "Remove it, or change the contract."),
    "independence-violation": ("An import between packages that a contract keeps apart.", "certain", "Remove it, or go by a third module."),
    "private-import": ("An import of an underscore name from another top-level package.", "likely", "Use a public name."),
    "duplication": ("The same run of tokens, literals aside, in several places.", "likely", "Share one definition."),
    "high-complexity": ("A function whose cyclomatic or cognitive complexity is above its limit.", "certain", "Split it."),
    "hotspot": ("A complex file that many commits changed.", "likely", "Simplify it first."),
    "low-cohesion": ("A class whose methods share few attributes (Henderson-Sellers).", "uncertain", "Split the class."),
    "untyped-function": ("A public function with parameters and not one annotation; where most of a large package is so, one finding for it.", "likely; uncertain where the package is reported", "Annotate it."),
    "private-type-leak": ("A public signature with a private type in it.", "likely; uncertain with dynamic access", "Make the type public, or keep it out."),
    "dangerous-eval": ("Code is run from a text that isn't a literal.", "uncertain", "Parse the input instead."),
    "unsafe-yaml-load": ("YAML is loaded without a loader being named.", "likely", "Use the safe loader."),
    "unsafe-deserialization": ("Data are loaded in a format that can run code.", "uncertain", "Use a format of plain data, or verify the source."),
    "subprocess-shell-true": ("A command goes through a shell.", "likely", "Pass a list of arguments."),
    "tls-verify-disabled": ("A connection doesn't check certificates.", "likely", "Trust the right authority instead."),
    "weak-hash": ("A digest that collisions are known for.", "likely", "Use a stronger digest, or say that it's not for security."),
    "weak-cipher": ("A broken cipher or mode.", "likely", "Use an authenticated cipher."),
    "insecure-random": ("A generator that can be foretold.", "uncertain, as most uses aren't secrets", "Use the one for secrets where it is."),
    "sql-injection": ("A query text is put together at run time.", "uncertain", "Bind parameters."),
    "request-without-timeout": ("A request may wait for ever.", "uncertain", "Give a timeout."),
    "flask-debug-true": ("A web application runs with its debugger on.", "likely", "Switch it off outside of development."),
    "jinja2-autoescape-false": ("Templates don't escape what they insert.", "likely", "Switch escaping on."),
    "hardcoded-secret": ("A name like that of a secret holds a literal.", "likely", "Read it from outside, and change it."),
    "try-except-pass": ("Any error is caught and nothing done.", "uncertain", "Name the errors, or log them."),
}


def explain(rule: str | None = None) -> str | list[str]:
    """What a rule says, how sure it can be and what to do; without one, all rule ids. KeyError for one that isn't."""
    if rule is None:
        return sorted(RULES)
    what, sure, todo = RULES[rule]
    return f"{rule}: {what}\nConfidence: {sure}.\nAction: {todo}"


def as_dicts(findings: DataFrame) -> list[dict]:
    """Findings in their order, without empty optional parts."""
    out = []
    for row in ordered(findings).collect():
        d = row.asDict(recursive=True)
        d = {k: v for k, v in d.items() if v is not None and not (k == "project" and v == "")}
        d["location"] = {k: v for k, v in d["location"].items() if v is not None}
        out.append(d)
    return out


def to_json(kind: str, findings: DataFrame, summary: DataFrame | None = None) -> str:
    body = {"kind": kind, "schema_version": "0.1", "findings": as_dicts(findings)}
    if summary is not None:
        body["summary"] = [r.asDict() for r in summary.orderBy("project").collect()]
    return json.dumps(body, indent=2, ensure_ascii=False)


def to_sarif(findings: DataFrame, tool: str = "tessera", version: str = "0.1") -> str:
    rows = as_dicts(findings)
    results = [{
        "ruleId": f["rule"], "level": SARIF_LEVEL[f["severity"]], "message": {"text": f"{f['reason']} [{f['confidence']}]"}, "partialFingerprints": {"primary": f["fingerprint"]},
        "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["location"]["path"]}, "region": {"startLine": max(1, f["location"]["line"]), "endLine": max(1, f["location"].get("end_line", f["location"]["line"]))}}}],
    } for f in rows]
    driver = {"name": tool, "version": version, "rules": [{"id": r} for r in sorted({f["rule"] for f in rows})]}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2)


def annotations(findings: DataFrame) -> DataFrame:
    """(line) of CI annotations, as a projection."""
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    return ordered(findings).select(F.format_string("::%s file=%s,line=%d::%s: %s", level, "location.path", "location.line", "rule", "reason").alias("line"))


def to_junit(findings: DataFrame, suite: str = "tessera") -> str:
    rows = as_dicts(findings)
    cases = "".join(f"  <testcase name={quoteattr(f['rule'])} classname={quoteattr(f['location']['path'])}><failure message={quoteattr(f['reason'])}>{escape(f['location']['path'])}:{f['location']['line']}</failure></testcase>\n" for f in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name={quoteattr(suite)} tests="{len(rows)}" failures="{len(rows)}">\n{cases}</testsuite>\n'


def to_text(findings: DataFrame) -> str:
    return "\n".join(f"{f['location']['path']}:{f['location']['line']}: {f['severity']} {f['rule']} [{f['confidence']}] {f['reason']}" for f in as_dicts(findings))


def diagnostics(findings: DataFrame) -> DataFrame:
    """Editor diagnostics: zero-based lines, numeric severities."""
    level = F.create_map(*[F.lit(x) for kv in LSP_SEVERITY.items() for x in kv])
    last = F.coalesce("location.end_line", "location.line")
    return findings.select("location.path", F.greatest(F.col("location.line") - 1, F.lit(0)).alias("start_line"), F.greatest(last - 1, F.lit(0)).alias("end_line"), level[F.col("severity")].alias("severity"), F.col("rule").alias("code"), F.col("reason").alias("message"))


def graph_text(edges: DataFrame, mermaid: bool = False) -> str:
    """The import graph in DOT or Mermaid."""
    pairs = sorted({(r.importer, r.imported) for r in edges.collect()})
    name = lambda x: x.replace(".", "_").replace("-", "_").replace("/", "_")
    if mermaid:
        return "\n".join(["graph LR", *(f'  {name(a)}["{a}"] --> {name(b)}["{b}"]' for a, b in pairs)]) + "\n"
    return "\n".join(["digraph imports {", *(f'  "{a}" -> "{b}";' for a, b in pairs), "}"]) + "\n"


def save_baseline(findings: DataFrame, path: str) -> None:
    known = sorted({r.fingerprint for r in findings.select("fingerprint").collect()})
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps({"schema": "tessera-baseline/1", "fingerprints": known}, indent=2))


def load_baseline(spark, path: str) -> DataFrame | None:
    """(fingerprint) of a baseline; None where there's no file, or none that save_baseline would write."""
    try:
        known = json.loads(Path(path).read_text())["fingerprints"]
        return spark.createDataFrame([(str(f),) for f in known], "fingerprint string")
    except (OSError, ValueError, KeyError, TypeError):
        return None


def exit_code(summary: DataFrame, regressed: bool = False, brief: bool = False) -> int:
    """0, or 1 where errors or a regression were found and the report isn't only a brief one."""
    errors = summary.agg(F.sum("errors")).first()[0] or 0
    return int(not brief and (errors > 0 or regressed))
