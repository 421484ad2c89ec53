"""`python -m tessera.plans.cli COMMAND PATH`: the analyses from a shell, and as tools over JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators import findings as Fi
from ..operators.rules import AUDIT
from ..sources import manifests
from . import report
from .engine import SIDES, Engine

#: command -> engines
ANALYSES = {
    "audit": AUDIT, "dead-code": ["dead-code", "members", "commented"], "deps": ["deps"], "arch": ["circular", "arch"], "complexity": ["complexity", "hotspots", "cohesion"],
    "dupes": ["dupes"], "types": ["types"], "security": ["security"], "supply-chain": ["supply-chain"], "coverage": ["coverage"],
}
ALIASES = {"check": "dead-code", "health": "complexity"}
OTHERS = ("metrics", "graph", "trace", "inspect", "list", "fix", "explain", "tools")
FORMATS = ("text", "json", "sarif", "github", "junit")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=[*ANALYSES, *ALIASES, *OTHERS])
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("query", nargs="?", help="module, file, kind or rule")
    p.add_argument("--format", choices=FORMATS, default="text")
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--base", help="git revision that new lines are told by")
    p.add_argument("--gate", choices=("all", "new-only"), default="all")
    p.add_argument("--min-confidence", choices=list(Fi.CONFIDENCE))
    p.add_argument("--baseline")
    p.add_argument("--save-baseline")
    p.add_argument("--fail-on-regression", action="store_true")
    p.add_argument("--brief", action="store_true")
    p.add_argument("--advisories")
    p.add_argument("--coverage-file")
    p.add_argument("--mermaid", action="store_true")
    p.add_argument("--apply", action="store_true")
    return p


def render(kind: str, form: str, findings, summary) -> str:
    if form == "json":
        return report.to_json(kind, findings, summary)
    if form == "sarif":
        return report.to_sarif(findings)
    if form == "junit":
        return report.to_junit(findings)
    if form == "github":
        return "\n".join(r.line for r in report.annotations(findings).collect())
    line = ", ".join(f"{k} {v}" for k, v in summary.first().asDict().items() if k != "project") if not summary.isEmpty() else "no files"
    return f"{report.to_text(findings)}\n{line}"


def run(spark: SparkSession, argv: list[str]) -> tuple[int, str]:
    """(exit code, output): 2 for a bad root, 1 for errors or a regression."""
    a = parser().parse_args(argv)
    command = ALIASES.get(a.command, a.command)
    if command == "explain":
        rule = a.query or (a.path if a.path != "." else None)
        try:
            told = report.explain(rule)
        except KeyError:
            return 2, f"no such rule: {rule}"
        return 0, told if isinstance(told, str) else "\n".join(told)
    if not Path(a.path).is_dir():
        return 2, f"{a.path} is no folder"
    engine = Engine.over_project(spark, a.path, a.include, advisories=a.advisories, coverage=a.coverage_file)
    if command in ANALYSES:
        return _analysis(spark, engine, command, a)
    if command == "fix":
        done = fix(engine, a.path, a.apply)
        code = int(bool(done["failures"]) and not done["written"])
        if a.format == "json":
            return code, json.dumps(done, indent=2)
        return code, "\n".join([*(f"{e['path']}:{e['start_line']}-{e['end_line']}: {e['description']}" for e in done["fixes"]), *done["failures"]])
    if command == "graph":
        return 0, report.graph_text(engine.import_edges(), a.mermaid)
    if command == "inspect":
        found, near = engine.inspect(a.query or "")
        return 0, json.dumps({"kind": "inspect", "findings": report.as_dicts(found), "trace": [r.asDict() for r in near.collect()]}, indent=2)
    frame = {"metrics": engine.metrics, "trace": lambda: engine.trace(a.query or ""), "list": lambda: engine.list_of(a.query or "entry-points")}[command]()
    rows = sorted((r.asDict() for r in frame.collect()), key=str)
    if command == "metrics":
        return 0, json.dumps({"kind": "metrics", "files": rows, "totals": [r.asDict() for r in engine.metric_totals().collect()]}, indent=2)
    return 0, json.dumps({"kind": command, "rows": rows}, indent=2)


def fix(engine: Engine, root: str, apply: bool) -> dict:
    """The plan, and with apply what was written; a file that can't be written doesn't keep others from it."""
    plan = [r.asDict() for r in engine.fix_plan().drop("project").orderBy("path", "start_line").collect()]
    written, failures = [], []
    for r in engine.fixed().collect() if apply else []:  # only the files that the plan changes
        try:
            Path(root, r.rel).write_bytes(r.src.encode())
            written.append(r.rel)
        except OSError as e:
            failures.append(f"{r.rel}: {e}")
    return {"kind": "fix", "applied": apply, "count": len(plan), "fixes": plan, "written": len([e for e in plan if e["path"] in written]), "failures": failures}


def _analysis(spark: SparkSession, engine: Engine, command: str, a) -> tuple[int, str]:
    hunks = None
    if a.base or a.gate == "new-only":
        spans = [("", *h) for h in manifests.git_changes(a.path, a.base)[1]]
        hunks = spark.createDataFrame(spans, "project string, path string, start bigint, end bigint")
    known = report.load_baseline(spark, a.baseline) if a.baseline and not a.save_baseline else None
    if known is None and a.baseline and not a.save_baseline and a.fail_on_regression:
        return 1, f"--fail-on-regression needs a baseline; {a.baseline} is missing or isn't one"
    found, summary = engine.report(engine.findings(ANALYSES[command]), hunks, a.gate == "new-only", a.min_confidence, known)
    if a.save_baseline:
        try:
            report.save_baseline(found, a.save_baseline)
        except OSError as e:
            return 1, f"the baseline can't be written: {e}"
        return 0, f"baseline written to {a.save_baseline}"
    regressed = bool(a.fail_on_regression and known is not None and not found.isEmpty())
    kind = "security" if command == "supply-chain" else command
    return report.exit_code(summary, regressed, a.brief), render(kind, a.format, found, summary)


_TEXT, _FLAG = {"type": "string"}, {"type": "boolean"}
#: tool -> its arguments beside the path: (name, schema, whether it's required, the option or place it goes to)
TOOLS: dict[str, list[tuple[str, dict, bool, str]]] = {
    **{c: [] for c in ANALYSES if c not in ("coverage", "supply-chain")}, "metrics": [], "graph": [],
    "coverage": [("coverage_file", _TEXT, True, "--coverage-file")], "supply-chain": [("advisory_db", _TEXT, False, "--advisories")], "trace": [("module", _TEXT, True, "")], "inspect": [("file", _TEXT, True, "")],
    "list": [("kind", _TEXT, False, "")], "explain": [("rule", _TEXT, False, "")], "fix": [("apply", _FLAG, False, "--apply")],
}
PROTOCOLS = ("2024-11-05", "2025-03-26", "2025-06-18")


def _tool(name: str) -> dict:
    args = {"path": _TEXT} | {n: kind for n, kind, *_ in TOOLS[name]}
    schema = {"type": "object", "properties": args} | ({"required": need} if (need := [n for n, _, must, _ in TOOLS[name] if must]) else {})
    return {"name": name, "description": f"The {name} analysis as JSON", "inputSchema": schema}


def answer(spark: SparkSession, line: str) -> dict | None:
    """The reply to one JSON-RPC line; None for notifications."""
    try:
        ask = json.loads(line)
    except ValueError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
    if not isinstance(ask, dict) or "id" not in ask:
        return None
    reply = {"jsonrpc": "2.0", "id": ask["id"]}
    fault = lambda code, message: reply | {"error": {"code": code, "message": message}}
    method, params = ask.get("method"), ask.get("params") if isinstance(ask.get("params"), dict) else {}
    if not isinstance(method, str):
        return fault(-32600, "a request names its method")
    if method == "ping":
        return reply | {"result": {}}
    if method == "initialize":
        asked = params.get("protocolVersion")
        return reply | {"result": {"protocolVersion": asked if asked in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "0.1"}}}
    if method == "tools/list":
        return reply | {"result": {"tools": [_tool(t) for t in TOOLS]}}
    if method != "tools/call":
        return fault(-32601, f"unknown: {method}")
    name, given = params.get("name"), params.get("arguments") if isinstance(params.get("arguments"), dict) else {}
    if name not in TOOLS:
        return fault(-32602, f"no such tool: {name}")
    if missing := [n for n, _, must, _ in TOOLS[name] if must and not isinstance(given.get(n), str)]:
        return fault(-32602, f"{name} needs {', '.join(missing)}")
    words = [name, str(given.get("path", "."))]
    for arg, kind, _, option in TOOLS[name]:
        value = given.get(arg)
        if kind is _FLAG:
            words += [option] * (value is True)
        elif isinstance(value, str):
            words += [option, value] if option else [value]
    try:
        code, text = run(spark, [*words, "--format", "json"])
        failed = code == 2 or name == "fix" and code == 1
    except (Exception, SystemExit) as e:  # a failed call is an answer too
        failed, text = True, f"{type(e).__name__}: {e}"[:2000]
    return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}


def main() -> None:
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if sys.argv[1:2] == ["tools"]:
        for line in sys.stdin:
            if (reply := answer(spark, line)) is not None:
                print(json.dumps(reply), flush=True)
        return
    code, text = run(spark, sys.argv[1:])
    print(text)
    sys.exit(code)


if __name__ == "__main__":
    main()
