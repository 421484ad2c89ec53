"""Rules, graph, clones and reports on projects held in memory."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import findings as Fi
from tessera.operators.clones import clones
from tessera.operators.graph import reach, tarjan
from tessera.plans import report
from tessera.plans.engine import SIDES, Engine
from tessera.scratch import Workspace
from tessera.sources import files, manifests
from tessera.sources.facts import facts_of


def found(df, *rules):
    return sorted((r.rule, r.location.path, r.location.line, r.confidence) for r in df.collect() if not rules or r.rule in rules)


def test_relative_and_lazy_imports(spark):
    e = Engine.over_files(spark, {
        "p/__init__.py": "from .a import f\nfrom . import b\n", "p/a.py": "from .sub.c import x\ndef f(): return x\n", "p/b.py": "def g():\n    from p import late\n",
        "p/sub/__init__.py": "", "p/sub/c.py": "from ..b import g\nx = g\n", "p/late.py": "", "p/lost.py": "import p.nowhere\nfrom . import gone\n",
    })
    edges = {(r.src, r.dst, r.lazy) for r in e.analysis.graph.edges.collect()}
    assert {("p/__init__.py", "p/a.py", False), ("p/__init__.py", "p/b.py", False), ("p/a.py", "p/sub/c.py", False), ("p/sub/c.py", "p/b.py", False), ("p/b.py", "p/late.py", True)} <= edges
    assert [x[1] for x in found(e.findings(["dead-code"]), "unused-file")] == ["p/lost.py"]
    assert found(e.findings(["circular"])) == []
    assert [x[1:3] for x in found(e.findings(["deps"]), "unresolved-import")] == [("p/lost.py", 1)]


def test_what_is_not_asked_for_is_not_made(spark):
    e = Engine.over_files(spark, {"a.py": "import b\ndef f(x):\n    return x if x else 1\n", "b.py": ""})
    assert {(r.rel, r.functions, r.total_cyclomatic) for r in e.metrics().collect()} == {("a.py", 1, 2), ("b.py", 0, 0)}
    assert "graph" not in vars(e.analysis)
    assert [tuple(r) for r in e.import_edges().collect()] == [("", "a", "b")]
    assert "modules" not in vars(e.analysis.graph)


def test_import_confidence(spark):
    e = Engine.over_files(spark, {
        "main.py": "import used_by_try\nimport kept as kept\nimport a, b\nfrom c import d, e\nprint(d)\ntry:\n    import probe\nexcept ImportError:\n    pass\nif __name__ == '__main__':\n    pass\nfrom typing import cast\nimport quoted\nv = cast('quoted.X', 1)\nimport silent  # noqa\n",
        "loose.py": "import os\n", "opaque.py": "import sys\n__all__ = make()\nif __name__ == '__main__':\n    pass\n",
    })
    got = found(e.findings(["dead-code"]), "unused-import")
    assert ("unused-import", "main.py", 1, "certain") in got and ("unused-import", "main.py", 3, "certain") in got
    assert ("unused-import", "main.py", 4, "likely") in got and ("unused-import", "main.py", 7, "uncertain") in got
    assert ("unused-import", "loose.py", 1, "likely") in got and ("unused-import", "opaque.py", 1, "uncertain") in got
    assert not any(p == "main.py" and line in (2, 12, 13, 15) for _, p, line, _ in got)


def test_interface_parameters(spark):
    e = Engine.over_files(spark, {
        "base.py": "class B:\n    def over(self, x): return 1\n", "other.py": "class B:\n    def nope(self, x): return 1\n",
        "m.py": "from base import B\nfrom ext import E\nclass C(B):\n    def over(self, x): return 1\n    def own(self, y): return 1\nclass D(E):\n    def any(self, z): return 1\n@deco\ndef f(w): return 1\n",
    })
    got = {(r.location.path, r.location.line) for r in e.findings(["dead-code"]).filter("rule = 'unused-parameter'").collect()}
    assert got == {("base.py", 2), ("other.py", 2), ("m.py", 5)}


def test_many_projects_at_once(spark):
    a = files.from_mapping(spark, {"x.py": "import y\n", "y.py": ""}, "one")
    b = files.from_mapping(spark, {"x.py": "import y\nif __name__ == '__main__': pass\n", "z.py": "eval(q)\n"}, "two")
    e = Engine(spark, a.unionByName(b))
    got = {(r.project, r.location.path, r.confidence) for r in e.findings(["dead-code"]).filter("rule = 'unused-file'").collect()}
    assert got == {("one", "x.py", "likely"), ("one", "y.py", "likely"), ("two", "z.py", "uncertain")}
    assert {(r.project, r.files_analyzed) for r in e.score(e.findings(["complexity"])).collect()} == {("one", 2), ("two", 2)}


def test_package_rollup(spark):
    bare = "".join(f"def f{k}(a): return a\n" for k in range(20))
    e = Engine.over_files(spark, {"pk/__init__.py": "", "pk/m.py": bare, "solo.py": "def g(a): return a\n"})
    got = e.types().collect()
    assert sorted((r.location.path, r.confidence) for r in got if r.location.path == "pk/__init__.py") == [("pk/__init__.py", "likely")]
    assert {r.confidence for r in got if r.location.path == "pk/m.py"} == {"uncertain"}
    assert [r.confidence for r in got if r.location.path == "solo.py"] == ["likely"]


def test_dev_tree_caps_security(spark):
    e = Engine.over_files(spark, {"tests/test_a.py": "import hashlib\nhashlib.md5(b'')\n", "src/a.py": "import hashlib\nhashlib.md5(b'')  # tessera: ignore[weak-hash]\nhashlib.md5(b'')\n"})
    assert found(e.security()) == [("weak-hash", "src/a.py", 3, "likely"), ("weak-hash", "tests/test_a.py", 2, "uncertain")]


def test_tarjan_on_random_graphs():
    rng = random.Random(7)
    for _ in range(50):
        edges = [(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(rng.randint(0, 25))]
        nodes = {n for e in edges for n in e}
        ahead = {n: {n} for n in nodes}
        for _ in nodes:
            for a, b in edges:
                ahead[a] |= ahead[b]
        want = sorted({tuple(sorted(m for m in nodes if m in ahead[n] and n in ahead[m])) for n in nodes})
        assert tarjan(edges) == [list(c) for c in want if len(c) > 1]


def test_reach(spark):
    edges = spark.createDataFrame([("p", i, i + 1) for i in range(6)] + [("p", 6, 0), ("q", 1, 9)], "project string, src int, dst int")
    seeds = spark.createDataFrame([("p", 3), ("p", 3), ("q", 8)], "project string, node int")
    got = {tuple(r) for r in reach(edges, seeds, ["project"], Workspace(spark, "t")).collect()}
    assert got == {("p", n) for n in range(7)} | {("q", 8)}


def naive_clones(texts, k, min_lines):
    """Families by comparing all suffixes, in the same order of precedence."""
    ids = {}
    for _, toks in texts:
        for t in toks:
            ids.setdefault(t, len(ids))
    places = {}
    for i, (_, toks) in enumerate(texts):
        for p in range(len(toks) - k + 1):
            places.setdefault(tuple(toks[p : p + k]), []).append((i, p))
    blocks = []
    for gram, at in places.items():
        if len(at) > 1:
            n = k
            while len({tuple(texts[i][1][p + n : p + n + 1]) or (i, p) for i, p in at}) == 1:
                n += 1
            blocks.append((-n, [ids[t] for t in gram], at))
    covered, out = set(), []
    for n, _, at in sorted(blocks):
        kept = [x for x in at if x not in covered]
        if len(kept) > 1:
            covered |= {(i, p + d) for i, p in kept for d in range(-n)}
            out.append((-n, len(kept)))
    return sorted(out)


def test_clones_against_all_suffixes(spark):
    rng = random.Random(11)
    for _ in range(4):
        texts = [(f"f{i}.py", [rng.choice("abc") for _ in range(rng.randint(10, 120))]) for i in range(4)]
        src = {name: "\n".join(toks) for name, toks in texts}
        got = clones(facts_of(spark, files.from_mapping(spark, src)), Workspace(spark, "clones"), 8, 1).collect()
        assert sorted((r.length, len(r.places)) for r in got) == naive_clones([t for t in texts if len(t[1]) >= 8], 8, 1)


def test_gate_baseline_and_fixes(spark, tmp_path):
    e = Engine.over_files(spark, {"m.py": "import os\nimport sys\nx = 'a'\nif __name__ == '__main__':\n    print(x)\n"})
    all_ = e.workspace.keep(e.findings(["dead-code"]), "found")
    hunks = spark.createDataFrame([("", "m.py", 2, 2)], "project string, path string, start bigint, end bigint")
    gated, summary = e.report(all_, hunks=hunks, gate=True)
    assert found(gated) == [("unused-import", "m.py", 2, "certain")] and summary.first().introduced == 1
    report.save_baseline(gated, str(tmp_path / "b" / "base.json"))
    rest, _ = e.report(all_, baseline=report.load_baseline(spark, str(tmp_path / "b" / "base.json")), least="certain")
    assert found(rest) == [("unused-import", "m.py", 1, "certain")]
    assert e.fixed().first().src == "x = 'a'\nif __name__ == '__main__':\n    print(x)\n"


def test_reports(spark):
    e = Engine.over_files(spark, {"m.py": "import os\npassword = 'a<b>c'\nif __name__ == '__main__':\n    print(password)\n"})
    got = e.workspace.keep(e.findings(["dead-code", "security"]), "found")
    sarif = json.loads(report.to_sarif(got))["runs"][0]
    assert {r["id"] for r in sarif["tool"]["driver"]["rules"]} == {"hardcoded-secret", "unused-import"} and len(sarif["results"]) == 2
    assert json.loads(report.to_json("audit", got, e.score(got)))["summary"][0]["total"] == 2
    assert report.to_junit(got).count("<testcase") == 2
    assert [r.line.split(" ")[0] for r in report.annotations(got).collect()] == ["::warning", "::warning"]
    assert report.exit_code(e.score(got)) == 0 and "unused-import" in report.explain() and report.to_text(got).count("\n") == 1
    assert {(r.start_line, r.severity) for r in report.diagnostics(got).collect()} == {(0, 2), (1, 2)}


def test_chaos_and_isolation(spark, monkeypatch):
    from tessera.operators.rules import ENGINES

    texts = {"deep.py": "(" * 5000 + ")" * 5000, "nul.py": "a\0b", "open.py": "'''x", "bom.py": "﻿import os\r\n", "uni.py": "größe = 1\n", "wide.py": "x = [" + "1, " * 20_000 + "]\n", "ok.py": "x = 1\n"}
    e = Engine.over_files(spark, texts)
    got = e.workspace.keep(e.audit(), "found")
    assert got.filter("rule = 'engine-panic'").isEmpty() and e.score(got).first().files_analyzed == 7

    def broken(a):
        raise RuntimeError("no")

    monkeypatch.setitem(ENGINES, "types", ("type-health", [broken]))
    panic = e.workspace.keep(e.findings(["types", "dead-code"]), "panic")
    assert [(r.severity, r.category) for r in panic.filter("rule = 'engine-panic'").collect()] == [("error", "type-health")]
    assert panic.count() > 1


def test_empty_corpus(spark):
    e = Engine(spark, files.from_mapping(spark, {}))
    assert e.audit().count() == 0 and e.metrics().count() == 0


def test_same_result_at_any_partitioning(spark):
    from tessera.plans.corpus import LAB

    texts = {k: v for k, v in LAB.items() if k.endswith(".py")}
    runs = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append(report.to_json("x", Engine(spark, files.from_mapping(spark, texts)).findings(["dead-code", "circular", "dupes", "security"])))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert runs[0] == runs[1]


def test_watch_equals_batch(spark, tmp_path):
    from tessera.streaming.watch import Watcher, stream_sources, watch

    drop, seen = tmp_path / "in", []
    drop.mkdir()
    watcher = Watcher(spark, lambda df, n: seen.append(found(df)))

    def push(name, rows):
        (drop / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        watch(stream_sources(spark, str(drop)), watcher, str(tmp_path / "cp"), once=True).awaitTermination()

    push("1.json", [{"project": "", "rel": "a.py", "src": "import os\n"}, {"project": "", "rel": "b.py", "src": "x = 1\n"}])
    push("2.json", [{"project": "", "rel": "a.py", "src": "import b\nb.x\n"}, {"project": "", "rel": "b.py", "src": None}, {"project": "", "rel": "c.py", "src": "import sys\n"}])
    want = Engine.over_files(spark, {"a.py": "import b\nb.x\n", "c.py": "import sys\n"}).findings(["dead-code", "security"])
    assert seen[-1] == found(want) and len(seen) == 2
    # Another process goes on from the checkpoint, and merges what it finds there.
    watcher = Watcher(spark, lambda df, n: seen.append(found(df)), merge=1)
    push("3.json", [{"project": "", "rel": "d.py", "src": "import os\n"}])
    want = Engine.over_files(spark, {"a.py": "import b\nb.x\n", "c.py": "import sys\n", "d.py": "import os\n"}).findings(["dead-code", "security"])
    assert seen[-1] == found(want) and [kind for kind, *_ in watcher._listed()] == ["merged"]


def test_each_group_takes_whole_groups_in_order(spark):
    import pyarrow as pa

    from tessera.operators.relations import each_group

    rows = [(p, k, n) for p in ("a", "b", None) for k in (1, 2) for n in range(1200)]
    schema, arrow = "p string, k int, n int, ok boolean", pa.schema([("p", pa.string()), ("k", pa.int32()), ("n", pa.int32()), ("ok", pa.bool_())])
    run = lambda held: [{"p": held[0]["p"], "k": held[0]["k"], "n": len(held), "ok": [r["n"] for r in held] == list(range(1200))}]
    got = each_group(spark.createDataFrame(rows, "p string, k int, n int"), ["p", "k"], ["n"], run, schema, arrow).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((p, k, 1200, True)) for p in ("a", "b", None) for k in (1, 2))
    assert each_group(spark.createDataFrame([], "p string, k int, n int"), ["p", "k"], ["n"], run, schema, arrow).collect() == []


def test_what_a_file_tells_of_itself_is_not_shuffled(spark):
    """Definitions and bindings that their own file uses are dropped within its row; of a name all stay or none."""
    from tessera.operators.rules import dead_code

    src = {
        "a.py": "import os, sys\nimport os\nfrom b import x as y\n__all__ = ['kept']\ndef kept(): return sys\ndef idle(): pass\ndef idle(): return 1\ndef used(): pass\nused()\n",
        "dyn.py": "import json\ndef f(): return getattr(1, 'f')\nf()\n",
    }
    e = Engine.over_files(spark, src)
    assert sorted((r.rel, r.name, r.ord) for r in dead_code.idle_definitions(e.analysis).collect()) == [("a.py", "idle", 1), ("a.py", "idle", 2), ("dyn.py", "f", 0)]
    assert sorted((r.rel, r.line, *r.idle) for r in e.analysis.graph.imports.filter("size(idle) > 0").collect()) == [("a.py", 1, "os"), ("a.py", 2, "os"), ("a.py", 3, "y"), ("dyn.py", 1, "json")]
    found = e.findings(["dead-code"]).select("rule", "location.path", "location.line").collect()
    assert "src" not in e.analysis.facts.table.columns and "src" in e.analysis.facts.records.columns
    assert [tuple(r) for r in sorted(found) if r.rule in ("unused-import", "unused-export") and r.path == "a.py"] == [
        ("unused-export", "a.py", 6), ("unused-export", "a.py", 7), *[("unused-import", "a.py", n) for n in (1, 2, 3)],
    ]
