"""What lies beside the sources: manifests, lock files, configuration, coverage, history, advisories.

Each reader takes text and gives plain rows; `tables` turns those of a project into DataFrames. Any
of them may be missing or broken, which gives no rows.
"""

from __future__ import annotations

import json
import re
import subprocess
import tomllib
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.versions import from_poetry

WHOLE_FILE = 2**32 - 1


def normal(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.lower()).strip("-")


def _toml(text: str | None) -> dict:
    try:
        return tomllib.loads(text or "")
    except (tomllib.TOMLDecodeError, TypeError):
        return {}


def _at(value, *path):
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _texts(value) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def requirement_name(line: str) -> str | None:
    """The distribution of a requirements line; of URLs only that in #egg=."""
    line = line.strip()
    if not line or line[0] in "#-":
        return None
    if line.lower().startswith(("bzr+", "file:", "git+", "hg+", "http://", "https://", "svn+")):
        egg = re.search(r"#egg=([^&\s\[]+)", line)
        return normal(egg[1]) if egg else None
    name = re.split(r"[ <>=!~;\[(@]", line.partition(" #")[0].strip(), maxsplit=1)[0]
    return normal(name) or None


def declared(pyproject: str | None) -> list[tuple[str, str]]:
    """(distribution, group) with group one of main, extra, dev."""
    t, out = _toml(pyproject), []
    add = lambda items, group: out.extend((n, group) for i in items if (n := requirement_name(i)))
    add(_texts(_at(t, "project", "dependencies")), "main")
    for extra in (_at(t, "project", "optional-dependencies") or {}).values():
        add(_texts(extra), "extra")
    for group in (_at(t, "dependency-groups") or {}).values():
        add(_texts(group), "dev")
    poetry = _at(t, "tool", "poetry") or {}
    out += [(normal(n), "main") for n in _at(poetry, "dependencies") or {} if n.lower() != "python"]
    for group in (_at(poetry, "group") or {}).values():
        out += [(normal(n), "dev") for n in _at(group, "dependencies") or {}]
    out += [(normal(n), "dev") for n in _at(poetry, "dev-dependencies") or {}]
    add(_texts(_at(t, "tool", "uv", "dev-dependencies")), "dev")
    for group in (_at(t, "tool", "pdm", "dev-dependencies") or {}).values():
        add(_texts(group), "dev")
    return out


def entry_points(pyproject: str | None) -> list[tuple[str, str]]:
    """(module, symbol) of every script; symbol is '' where a script names none."""
    t, out = _toml(pyproject), set()
    for table in (_at(t, "project", "scripts"), _at(t, "project", "gui-scripts"), _at(t, "tool", "poetry", "scripts")):
        for target in (table or {}).values():
            target = target if isinstance(target, str) else _at(target, "callable") or _at(target, "reference")
            if isinstance(target, str):
                module, _, symbol = target.partition(":")
                out.add((module.strip(), re.split(r"[.\s\[]", symbol.strip())[0]))
    return sorted(out)


def testpaths(pyproject: str | None) -> list[str]:
    got = _at(_toml(pyproject), "tool", "pytest", "ini_options", "testpaths")
    return _texts(got) or (got.split() if isinstance(got, str) else [])


def split_requirement(line: str) -> tuple[str, str] | None:
    """(distribution, spec) of a requirement, without extras and markers."""
    line = line.partition(";")[0].strip()
    m = re.search(r"[<>=!~]", line)
    name = (line[: m.start()] if m else line).partition("[")[0].strip()
    return (normal(name), line[m.start() :].strip() if m else "") if name else None


def pins(files: dict[str, str]) -> list[tuple[str, str, str, int]]:
    """(name, version, source, line) that requirements files and lock files fix."""
    out = set()
    for path, text in files.items():
        name = path.rpartition("/")[2]
        if name in ("poetry.lock", "uv.lock"):
            for p in _toml(text).get("package") or []:
                if isinstance(p, dict) and isinstance(p.get("name"), str) and isinstance(p.get("version"), str):
                    out.add((normal(p["name"]), p["version"], path, 1))
        elif is_requirements(name):
            for k, line in enumerate(text.splitlines(), 1):
                got = split_requirement(line.partition("#")[0].strip())
                if got and not line.lstrip().startswith("-") and (m := re.fullmatch(r"==\s*([^,*\s]+)", got[1])):
                    out.add((got[0], m[1], path, k))
    return sorted(out)


def is_requirements(name: str) -> bool:
    return name.startswith("requirements") and name.endswith(".txt")


def ranges(files: dict[str, str]) -> list[tuple[str, str, str, int]]:
    """(name, spec, source, line) of each declared dependency."""
    out = set()
    for path, text in files.items():
        if is_requirements(path.rpartition("/")[2]):
            for k, line in enumerate(text.splitlines(), 1):
                body = line.partition("#")[0].strip()
                if body and body[0] != "-" and (got := split_requirement(body)):
                    out.add((*got, path, k))
        elif path == "pyproject.toml":
            t = _toml(text)
            out |= {(*got, path, 1) for d in _texts(_at(t, "project", "dependencies")) if (got := split_requirement(d))}
            for name, value in (_at(t, "tool", "poetry", "dependencies") or {}).items():
                spec = value if isinstance(value, str) else _at(value, "version")
                if name.lower() != "python" and isinstance(spec, str):
                    out.add((normal(name), from_poetry(spec), path, 1))
    return sorted(out)


def advisories(text: str | None) -> list[tuple]:
    """(seq, id, package, specs, summary, aliases, severity) of an advisory file."""
    try:
        items = json.loads(text or "{}").get("advisories") or []
    except (ValueError, AttributeError):
        return []
    out = []
    for k, a in enumerate(i for i in items if isinstance(i, dict) and isinstance(i.get("id"), str) and isinstance(i.get("package"), str)):
        out.append((k, a["id"], normal(a["package"]), _texts(a.get("specs")), a.get("summary") or "", _texts(a.get("aliases")), a.get("severity")))
    return out


def coverage(text: str | None) -> list[tuple[str, int]]:
    """(file key, executed line); a file without executed lines has the line 0."""
    try:
        files = json.loads(text or "{}").get("files") or {}
    except (ValueError, AttributeError):
        return []
    return [(key, n) for key, f in files.items() for n in [0, *(x for x in _at(f, "executed_lines") or [] if isinstance(x, int))]]


def hunks(diff: str, untracked: list[str] = ()) -> list[tuple[str, int, int]]:
    """(path, start, end) of the lines a diff without context added; untracked files count whole."""
    out, path = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            path = None if line[4:] == "/dev/null" else re.sub(r"^b/", "", line[4:].strip())
        elif path and (m := re.match(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@", line)):
            start, n = int(m[1]), int(m[2] or 1)
            if n:
                out.append((path, start, start + n - 1))
    return out + [(p, 1, WHOLE_FILE) for p in untracked]


def churn(log: str) -> list[tuple[str, int]]:
    """(path, commits) from the names that a log lists by commit."""
    return sorted(Counter(line.strip() for line in log.splitlines() if line.strip()).items())


def git(root: str, *args: str) -> str:
    """What git says, '' where there's no repository."""
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


def git_changes(root: str, base: str | None = None) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Files that differ from the base and the index, and their added lines."""
    untracked = git(root, "ls-files", "--others", "--exclude-standard").splitlines()
    diffs = [git(root, "diff", "--unified=0"), git(root, "diff", "--cached", "--unified=0"), git(root, "diff", "--unified=0", f"{base}...HEAD") if base else ""]
    spans = sorted({h for d in diffs for h in hunks(d)} | set(hunks("", untracked)))
    names = {n for a in ([], ["--cached"], [f"{base}...HEAD"] if base else None) if a is not None for n in git(root, "diff", "--name-only", *a).splitlines()}
    return sorted(names | set(untracked)), spans


def git_churn(root: str) -> list[tuple[str, int]]:
    return churn(git(root, "log", "--no-merges", "--name-only", "--format="))


def installed(root: str, env: str | None = None) -> list[tuple[str, str, str]]:
    """(import name, distribution, version) of the environment `env` where it has packages, else of the project's own; of several distributions with
    one import name that of the same name wins, else the first."""
    places = [*([Path(env)] if env else []), *(Path(root, d) for d in (".venv", "venv", "env", ".env"))]
    for place in places:
        site = next(iter(sorted([*place.glob("lib/python*/site-packages"), *place.glob("Lib/site-packages")])), None)
        if site:
            return _dists(site)
    return []


def _dists(site: Path) -> list[tuple[str, str, str]]:
    by_top: dict[str, list[tuple[bool, str, str]]] = {}
    for info in sorted(site.glob("*.dist-info")):
        try:
            head = dict(line.split(": ", 1) for line in (info / "METADATA").read_text().split("\n\n")[0].splitlines() if ": " in line)
        except OSError:
            continue
        name, version = normal(head.get("Name", info.name.partition("-")[0])), head.get("Version", "")
        tops = (info / "top_level.txt").read_text().split() if (info / "top_level.txt").exists() else [name.replace("-", "_")]
        for top in tops:
            by_top.setdefault(top, []).append((normal(top) != name, name, version))
    return [(top, *min(got)[1:]) for top, got in sorted(by_top.items())]


@dataclass
class Config:
    """Settings of an analysis. Wrong types fall back to defaults, as does a broken file."""

    severity: dict[str, str] = field(default_factory=dict)
    ignore: list[str] = field(default_factory=list)
    exclude_dirs: list[str] = field(default_factory=list)
    max_cyclomatic: int = 10
    max_cognitive: int = 15
    min_tokens: int = 40
    min_lines: int = 5
    layers: list[str] = field(default_factory=list)
    policies: list[dict] = field(default_factory=list)
    forbidden: list[tuple[str, list[str]]] = field(default_factory=list)
    independent: list[list[str]] = field(default_factory=list)


LEVELS = {"error": "error", "warn": "warn", "warning": "warn", "off": "off", "ignore": "off"}
PRESETS = {
    "layered": ["presentation", "application", "domain", "infrastructure"],
    "hexagonal": ["adapters", "application", "domain"],
    **dict.fromkeys(("bulletproof", "feature-sliced"), ["app", "features", "entities", "shared"]),
}


def parse_config(text: str | None) -> Config:
    try:
        raw = json.loads(text or "{}")
    except ValueError:
        raw = {}
    c = Config()
    if not isinstance(raw, dict):
        return c
    if isinstance(raw.get("severity"), dict):
        c.severity = {k: LEVELS[v.lower()] for k, v in raw["severity"].items() if isinstance(v, str) and v.lower() in LEVELS}
    c.ignore, c.exclude_dirs = _texts(raw.get("ignore")), _texts(raw.get("exclude_dirs"))
    for name, value in (("max_cyclomatic", raw.get("max_cyclomatic")), ("max_cognitive", raw.get("max_cognitive")), ("min_tokens", _at(raw, "duplication", "min_tokens")), ("min_lines", _at(raw, "duplication", "min_lines"))):
        if isinstance(value, int) and not isinstance(value, bool) and value >= 0:
            setattr(c, name, value)
    preset = _at(raw, "architecture", "preset")
    c.layers = _texts(_at(raw, "architecture", "layers")) or (PRESETS.get(preset.lower(), []) if isinstance(preset, str) else [])
    for p in raw.get("policies") or []:
        if isinstance(p, dict) and isinstance(p.get("id"), str):
            c.policies.append({"id": p["id"], "forbid_import": p.get("forbid_import"), "forbid_call": p.get("forbid_call"), "in_paths": _texts(p.get("in_paths")), "message": p.get("message"), "severity": LEVELS.get(str(p.get("severity", "warn")).lower(), "warn")})
    for f in _at(raw, "contracts", "forbidden") or []:
        if isinstance(_at(f, "from"), str):
            c.forbidden.append((f["from"], _texts(f.get("to"))))
    c.independent = [_texts(g) for g in _at(raw, "contracts", "independent") or []]
    return c
