"""Commands on a project on disk, and the tool lines."""

import json

import pytest

from tessera.plans import cli


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("project")
    (at / "m.py").write_text("import os\nx = 1\nif __name__ == '__main__':\n    print(x)\n")
    (at / "pyproject.toml").write_text('[project]\ndependencies = ["idle"]\n')
    return at


def test_commands(spark, root):
    code, text = cli.run(spark, ["check", str(root), "--format", "json"])
    assert code == 0 and [f["rule"] for f in json.loads(text)["findings"]] == ["unused-import"]
    base = str(root / "out" / "base.json")
    assert cli.run(spark, ["deps", str(root), "--save-baseline", base])[0] == 0
    assert "unused-dependency" not in cli.run(spark, ["deps", str(root), "--baseline", base, "--fail-on-regression"])[1]
    assert cli.run(spark, ["audit", str(root / "none")])[0] == 2
    assert "weak-hash" in cli.run(spark, ["explain"])[1] and cli.run(spark, ["explain", "weak-hash"])[1].startswith("weak-hash")
    assert json.loads(cli.run(spark, ["metrics", str(root)])[1])["totals"][0]["files"] == 1


def test_tools(spark, root):
    assert cli.answer(spark, '{"method": "notifications/initialized"}') is None
    assert cli.answer(spark, "{")["error"]["code"] == -32700
    names = {t["name"] for t in cli.answer(spark, '{"id": 1, "method": "tools/list"}')["result"]["tools"]}
    assert {"audit", "trace", "graph"} <= names
    call = {"id": 2, "method": "tools/call", "params": {"name": "list", "arguments": {"path": str(root), "kind": "files"}}}
    assert json.loads(cli.answer(spark, json.dumps(call))["result"]["content"][0]["text"])["rows"][0]["name"] == "m.py"
    call["params"]["arguments"] = {"path": "/nowhere"}
    assert cli.answer(spark, json.dumps(call))["result"]["isError"]


def test_tool_protocol(spark, root):
    ask = lambda **x: cli.answer(spark, json.dumps({"id": 1} | x))
    assert ask(method="ping")["result"] == {}
    assert ask()["error"]["code"] == -32600 and ask(method="x")["error"]["code"] == -32601
    assert ask(method="initialize", params={"protocolVersion": "2025-06-18"})["result"]["protocolVersion"] == "2025-06-18"
    call = lambda name, **args: ask(method="tools/call", params={"name": name, "arguments": {"path": str(root)} | args})
    assert call("nothing")["error"]["code"] == call("coverage")["error"]["code"] == call("trace")["error"]["code"] == -32602
    got = json.loads(call("fix")["result"]["content"][0]["text"])
    assert got["count"] == 1 and not got["applied"] and "import os" in (root / "m.py").read_text()
    assert call("explain", rule="no-such")["result"]["isError"]


def test_baselines_that_cannot_be_used(spark, root, tmp_path):
    (tmp_path / "broken.json").write_text("[]")
    for name in ("none.json", "broken.json"):
        assert cli.run(spark, ["deps", str(root), "--baseline", str(tmp_path / name), "--fail-on-regression"])[0] == 1
        assert "unused-dependency" in cli.run(spark, ["deps", str(root), "--baseline", str(tmp_path / name)])[1]
    (tmp_path / "file").write_text("")
    assert cli.run(spark, ["deps", str(root), "--save-baseline", str(tmp_path / "file" / "b.json")])[0] == 1


def test_advisories_of_the_project_count(spark, tmp_path):
    (tmp_path / "m.py").write_text("x = 1\n")
    (tmp_path / "requirements.txt").write_text("oldlib==1.0\n")
    (tmp_path / ".tessera").mkdir()
    (tmp_path / ".tessera" / "advisories.json").write_text('{"advisories": [{"id": "A-1", "package": "oldlib", "specs": ["<2"]}]}')
    assert "vulnerable-dependency" in cli.run(spark, ["supply-chain", str(tmp_path)])[1]


def test_every_rule_is_explained():
    from tessera.plans import analyzer, report

    assert {*analyzer.EXPECTED, "transitive-dependency", "unused-attribute", "engine-panic"} - {"no-pprint"} <= set(report.RULES)
    assert len({report.explain(r) for r in report.RULES}) == len(report.RULES)
