"""Manifests, versions, discovery, notebooks."""

import json

import pytest

from tessera.functions.versions import from_poetry, intersect, matches, ordered, version_key
from tessera.sources import files, manifests as M


def test_version_order():
    chain = ["1.0.dev1", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.1", "1!0.1"]
    keys = [ordered(version_key(v)) for v in chain]
    assert keys == sorted(keys) and ordered(version_key("1.0")) == ordered(version_key("v1.0.0+local"))
    assert version_key("abc") is None


@pytest.mark.parametrize("version,spec,want", [("1.4.9", "==1.4.*", True), ("1.5", "==1.4.*", False), ("1.5", "!=1.4.*", True), ("2.2.9", "~=2.2.1", True), ("2.3", "~=2.2.1", False), ("1.0", ">=1,<2", True), ("1.0", "", True), ("x", "", False), ("1.0", ">=x", False), ("1.0", "1.0.0", True)])
def test_specs(version, spec, want):
    assert matches(version, spec) is want


def test_ranges_meet():
    assert intersect(">2.0,<2.0.1", "<3") and not intersect("<1", ">=1") and intersect("", ">=5")
    assert from_poetry("^1.2.3") == ">=1.2.3,<2" and from_poetry("^0.2.3") == ">=0.2.3,<0.3" and from_poetry("~1.2") == ">=1.2,<1.3" and from_poetry("*") == ""


def test_manifests():
    toml = """
[project]
dependencies = ["A_b>=1", "c ; python_version < '3'", "d[extra]==2"]
optional-dependencies = {x = ["e"]}
scripts = {run = "pkg.cli:main.sub"}
[dependency-groups]
dev = ["f", {include-group = "x"}]
[tool.poetry.dependencies]
python = "^3"
g = "^1.0"
[tool.pytest.ini_options]
testpaths = ["checks"]
"""
    assert M.declared(toml) == [("a-b", "main"), ("c", "main"), ("d", "main"), ("e", "extra"), ("f", "dev"), ("g", "main")]
    assert M.entry_points(toml) == [("pkg.cli", "main")] and M.testpaths(toml) == ["checks"]
    assert M.declared("not toml [") == [] and M.declared(None) == []
    assert [M.requirement_name(x) for x in ("# c", "-r x", "Foo.Bar ==1 # y", "git+https://h/x#egg=Egg", "https://h/x.whl", "a@ file:///x", "")] == [None, None, "foo-bar", "egg", None, "a", None]
    assert M.pins({"requirements-dev.txt": "a==1.0\nb>=2\n", "uv.lock": '[[package]]\nname = "C"\nversion = "3"\n'}) == [("a", "1.0", "requirements-dev.txt", 1), ("c", "3", "uv.lock", 1)]
    assert ("g", ">=1.0,<2", "pyproject.toml", 1) in M.ranges({"pyproject.toml": toml})


def test_side_files():
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1 +11,3 @@\n@@ -2,0 +24 @@\n@@ -9 +30,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert M.hunks(diff, ["new.py"]) == [("x.py", 11, 13), ("x.py", 24, 24), ("new.py", 1, M.WHOLE_FILE)]
    assert M.churn("a\n\nb\na\n") == [("a", 2), ("b", 1)]
    assert M.coverage('{"files": {"a.py": {"executed_lines": [3]}}}') == [("a.py", 0), ("a.py", 3)] and M.coverage("x") == []
    assert M.advisories("[") == [] and M.advisories('{"advisories": [{"id": "1", "package": "A.B"}, {"id": 2}]}') == [(0, "1", "a-b", [], "", [], None)]
    c = M.parse_config('{"severity": {"a": "WARNING", "b": 3}, "max_cyclomatic": "x", "architecture": {"preset": "Layered"}, "policies": [{"id": "p", "severity": "off"}, 1]}')
    assert c.severity == {"a": "warn"} and c.max_cyclomatic == 10 and c.layers[0] == "presentation" and c.policies[0]["severity"] == "off"
    assert M.parse_config("{") == M.Config()


def test_discovery(tmp_path):
    for p in ("a.py", "sub/b.py", "sub/c.txt", "venv/x.py", "named/pyvenv.cfg", "named/y.py", "build/z.py", "skip/s.py", "nb.ipynb", ".hidden/h.py"):
        at = tmp_path / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("skip/\n")
    assert files.discover(str(tmp_path)) == [".hidden/h.py", "a.py", "nb.ipynb", "sub/b.py"]
    assert "build/z.py" in files.discover(str(tmp_path), include=["build"]) and "named/y.py" not in files.discover(str(tmp_path), include=["named"])
    assert "sub/b.py" not in files.discover(str(tmp_path), exclude=["sub"])


def test_notebooks():
    v4 = json.dumps({"cells": [{"cell_type": "code", "source": ["%magic\n", "x = 1\n"]}, {"cell_type": "markdown", "source": "no"}, {"cell_type": "code", "source": "!kept\ny = 2"}]})
    v3 = json.dumps({"worksheets": [{"cells": [{"cell_type": "code", "input": ["z = 3"]}]}]})
    assert files.decode("a.ipynb", v4.encode()) == "x = 1\n\n!kept\ny = 2\n"
    assert "z = 3" in files.decode("a.ipynb", v3.encode())
    assert files.decode("a.ipynb", b"no json") is None and files.decode("a.py", b"\xff") is None


def test_installed(tmp_path):
    site = tmp_path / ".venv/lib/python3/site-packages"
    for name, top in (("PyYAML", "yaml"), ("other", "yaml"), ("yaml", "yaml")):
        d = site / f"{name}-1.dist-info"
        d.mkdir(parents=True)
        (d / "METADATA").write_text(f"Name: {name}\nVersion: 1.5\n\nbody: x")
        (d / "top_level.txt").write_text(top)
    assert M.installed(str(tmp_path)) == [("yaml", "yaml", "1.5")]


def test_include_frees_only_what_it_names(tmp_path):
    for at in ("skip/s.py", "skip/build/deep.py", "build/b.py", "a.py", "other/o.py"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("")
    (tmp_path / ".gitignore").write_text("skip/\n")
    assert files.discover(str(tmp_path)) == ["a.py", "other/o.py"]
    assert files.discover(str(tmp_path), include=["build"]) == ["a.py", "build/b.py", "other/o.py", "skip/build/deep.py"]


def test_the_active_environment_comes_first(tmp_path):
    for env, name in (("active", "one"), (".venv", "two")):
        info = tmp_path / env / "lib" / "python3" / "site-packages" / f"{name}-1.dist-info"
        info.mkdir(parents=True)
        (info / "METADATA").write_text(f"Name: {name}\nVersion: 1\n")
    assert [d for _, d, _ in M.installed(str(tmp_path), str(tmp_path / "active"))] == ["one"]
    assert [d for _, d, _ in M.installed(str(tmp_path), str(tmp_path / "none"))] == ["two"]
