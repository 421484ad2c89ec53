"""Facts of single files, without Spark."""

import random
import textwrap

import pytest

from tessera.sources.extract import extract, noqa, suppressed
from tessera.sources.tokens import clone_tokens


def facts(src, rel="m.py"):
    return extract(rel, textwrap.dedent(src))


def names(rows, key="name"):
    return [r[key] for r in rows]


def test_definitions_in_suites_and_exports():
    f = facts("""
        __all__ = ["a"]
        __all__ += ["b"]
        __all__.append("c")
        __all__.extend(["d", "e"])
        if True:
            def one(): pass
        else:
            two = 1
        try:
            class Three: pass
        except Exception:
            four = 2
        x.y = 1
        p, q = 1, 2
        for i in []:
            five: int = 3
        """)
    assert names(f["definitions"]) == ["one", "two", "Three", "four", "five"]
    assert f["dunder_all"] == ["a", "b", "c", "d", "e"] and f["has_all"] and not f["all_dynamic"]
    assert facts("__all__ = make()")["all_dynamic"]


def test_imports():
    f = facts("""
        import a, b.c as d
        from . import e
        from ..f import g as g, h as i
        from j import *
        def k():
            import l
        if TYPE_CHECKING:
            import m
        try:
            import n
        except ImportError:
            n = None
        """)
    got = [(i["module"], i["relative_dots"], i["bindings"], i["is_star"], i["type_checking_only"], i["in_try"]) for i in f["imports"]]
    assert got == [("a", 0, ["a"], False, False, False), ("b.c", 0, ["d"], False, False, False), ("", 1, ["e"], False, False, False), ("f", 2, ["g", "i"], False, False, False), ("j", 0, [], True, False, False), ("m", 0, ["m"], False, True, False), ("n", 0, ["n"], False, False, True)]
    assert f["imports"][3]["redundant"] == [True, False]
    assert names(f["nested_imports"], "module") == ["l"]


def test_complexity():
    f = facts("""
        def f(a, b):
            if a and b:
                for x in a:
                    while x:
                        pass
            elif a:
                return [y for y in b if y]
            else:
                assert b
            return a if b else 1
        """)["functions"][0]
    assert f["cyclomatic"] == 1 + 1 + 1 + 1 + 1 + 1 + 2 + 1 + 1
    # if 1 + and 1, for 2, while 3, elif 1, else 1, return's ternary 1
    assert f["cognitive"] == 10


def test_unused_locals_and_parameters():
    f = facts("""
        def f(used, spare, _skip, *args, key=None):
            left = 1
            _ = 2
            right = used
            return right
        def g(spare):
            return locals()
        @deco
        def h(spare):
            return 1
        def stub(spare): ...
        """)
    assert [(s["name"], s["is_param"]) for s in f["scope_findings"]] == [("spare", True), ("key", True), ("left", False)]


def test_unreachable_and_leaks():
    f = facts("""
        class _P: pass
        def f(x: "list[_P]") -> int:
            return 1
            print()
        def g():
            sys.exit(1)
            pass
        """)
    assert [(u["line"], u["after"]) for u in f["unreachable"]] == [(5, "return"), (8, "exit call")]
    assert [(t["function"], t["type_name"]) for t in f["type_leaks"]] == [("f", "_P")]


def test_scope_resolution():
    f = facts("""
        import os
        glob = 1
        def f(a):
            local = a
            def inner():
                return local + glob
            return inner
        class C:
            def m(self): return os.path
        """)
    assert {"glob", "os"} <= set(f["module_used"]) and "local" not in f["module_used"] and "a" not in f["module_used"]


def test_comments():
    assert suppressed("# tessera: ignore[a, b] -- why") == ["a", "b"] and suppressed("# tessera: ignore") == ["*"] and suppressed("# tessera: ignored") == []
    assert noqa("# noqa") == ["unused-import", "unused-variable"] and noqa("# NOQA: F401, E1") == ["unused-import"] and noqa("# noqaX") == []
    f = facts("from a import (\n    b,\n    c,  # noqa: F401\n)\n")
    assert {(i["line"], i["rule"]) for i in f["ignores"]} == {(3, "unused-import"), (1, "unused-import")}


@pytest.mark.parametrize("src", ["def (", "\0", "(" * 5000 + ")" * 5000, "'''open", "print 'py2'"])
def test_broken_files_stay_modules(src):
    f = extract("bad.py", src)
    assert f["had_errors"] and f["definitions"] == []


def test_strange_files():
    assert names(extract("a.py", "﻿x = 1\r\ny = 2\r\n")["definitions"]) == ["x", "y"]
    assert names(extract("a.py", "größe = 1\n")["definitions"]) == ["größe"]
    assert not extract("a.py", "x = [" + "1," * 20_000 + "]\n")["had_errors"]


def test_lexer_takes_anything():
    norms = lambda s: [(t["norm"], t["line"]) for t in clone_tokens(s)]
    assert norms("a = rb'x' # c\nb = 1_0.5e3") == [("a", 1), ("=", 1), ("STR", 1), ("b", 2), ("=", 2), ("NUM", 2)]
    assert norms('"""a\nb"""\nc') == [("STR", 1), ("c", 3)]
    assert norms("'open\nx") == [("STR", 1), ("x", 2)]
    rng = random.Random(0)
    for _ in range(2000):
        s = "".join(rng.choice("ab1'\"\\\n #ß(") for _ in range(rng.randint(0, 40)))
        assert norms(s) == norms(s) and all(t["line"] <= s.count("\n") + 1 for t in clone_tokens(s))


SECURITY = {
    "dangerous-eval": ("eval(x)", "eval('1')\nsession.exec(x)"), "unsafe-yaml-load": ("yaml.load(x)", "yaml.load(x, Loader=L)"), "unsafe-deserialization": ("dill.load(f)", "json.load(f)"),
    "subprocess-shell-true": ("subprocess.Popen(x, shell=True)", "subprocess.run(x, shell=False)"), "tls-verify-disabled": ("r.get(u, verify=False)", "r.get(u, verify=True)"),
    "weak-hash": ("hashlib.sha1(x)", "hashlib.sha256(x)"), "weak-cipher": ("AES.new(k, AES.MODE_ECB)", "AES.new(k, AES.MODE_GCM)"), "insecure-random": ("random.choice(x)", "secrets.choice(x)"),
    "sql-injection": ("c.execute(f'select {x}')", "c.execute('select ?', x)"), "request-without-timeout": ("requests.get(u)", "requests.get(u, timeout=1)"), "flask-debug-true": ("app.run(debug=True)", "app.run(debug=False)"),
    "jinja2-autoescape-false": ("Environment(autoescape=False)", "Environment(autoescape=True)"), "hardcoded-secret": ("my_token = 'abcd'", "my_token = 'abc'\npassword = 'changeme'\nsecret = '${X}'"),
    "try-except-pass": ("try:\n    f()\nexcept Exception:\n    pass", "try:\n    f()\nexcept ValueError:\n    pass"),
}


@pytest.mark.parametrize("rule", SECURITY)
def test_security(rule):
    bad, good = SECURITY[rule]
    assert rule in names(facts(bad)["security_hits"], "rule")
    assert rule not in names(facts(good)["security_hits"], "rule")


CHAOS = {
    "mac.py": "import os\rdef f(a):\r  return 1\r  print(a)\r", "nul.py": "x = 1\x00\n", "deep.py": "x = " + "(" * 5000 + ")" * 5000, "form.py": "def f(a):\n\x0c    return a\n\x0c\nx = 1\n", "bom.py": "\ufeffx = 1\n",
    "mixed.py": "a = 1\r\nb = 2\rc = 3\n# tessera: ignore\r\nimport os\r", "sep.py": "x = 'a\u2028b'\ny = 1\u0085\n", "open.py": "def f(:\n", "quote.py": "'''never closed", "tab.py": "if x:\n\ty = 1\n        z = 2\n", "end.py": "x = \\", "long.py": "x = " + "+".join(["1"] * 3000),
}


@pytest.mark.parametrize("rel", CHAOS)
def test_no_file_breaks_the_run(rel):
    got = extract(rel, CHAOS[rel])
    assert got["rel"] == rel and isinstance(got["tokens"], list)


def test_old_line_ends_are_line_ends():
    got = extract("mac.py", CHAOS["mac.py"])
    assert not got["had_errors"] and [d["line"] for d in got["definitions"]] == [2] and got["unreachable"] == [{"ord": 0, "line": 4, "after": "return"}]
    assert [d["line"] for d in extract("mixed.py", CHAOS["mixed.py"])["definitions"]] == [1, 2, 3]
    assert max(t["line"] for t in got["tokens"]) == 4


def test_one_bad_file_costs_only_itself(spark):
    from tessera.sources import files
    from tessera.sources.facts import extract_records

    got = {r.rel: r.had_errors for r in extract_records(files.from_mapping(spark, CHAOS)).collect()}
    assert set(got) == set(CHAOS) and not got["mac.py"] and not got["mixed.py"] and got["nul.py"]


def test_a_file_is_walked_once(monkeypatch):
    """Nodes' children are found once and kept: no rule walks the tree by itself."""
    import ast

    walks, walk, below = [], ast.walk, ast.iter_child_nodes
    monkeypatch.setattr(ast, "walk", lambda n: walks.append(n) or walk(n))
    monkeypatch.setattr(ast, "iter_child_nodes", lambda n: walks.append(n) or below(n))
    f = facts("""
        def a(x):
            global t
            t = u = 1
            return [y for y in x if y and t]
        class B:
            def c(self): return self.d
    """)
    monkeypatch.undo()
    assert not walks and not f["had_errors"]
    assert [(r["name"], r["cyclomatic"]) for r in f["functions"]] == [("a", 4), ("c", 1)]
    assert names(f["scope_findings"]) == []


def test_globals_count_for_the_functions_around_them():
    f = facts("""
        def a():
            b = 1
            def inner():
                nonlocal b
        def c(): b = 1
        def d(): global e; e = 1
        def g(): e = 2
    """)
    assert [(r["name"], r["line"]) for r in f["scope_findings"]] == [("b", 6), ("e", 8)]


def test_literal_tokens():
    cases = {
        '"""a"b""c\\"""d"""e': ["STR", "e"], "'''a'\n''b'''c": ["STR", "c"], '"""open\\': ["STR"], '"a\\"b" c': ["STR", "c"], '"a\nb': ["STR", "b"],
        "'a\\\nb' c": ["STR", "c"], '"a\\': ["STR"], '""""a"""b': ["STR", "b"],
    }
    assert {src: names(clone_tokens(src), "norm") for src in cases} == cases


def test_both_lexers_agree():
    """The fast lexer stands back where a sign outside of literals isn't plain ASCII, and takes all else as the other does."""
    from tessera.sources import tokens

    rng, fell = random.Random(1), 0
    for _ in range(3000):
        s = "".join(rng.choice(["a", "b1", "'", '"""', "\\", "\n", " ", "#", "é", "\x1c", " ", "²", "1.5", "("]) for _ in range(rng.randint(0, 25)))
        fast = tokens._scanned(s, tokens._ASCII)
        fell += fast is None
        assert fast is None or fast == tokens._scanned(s, tokens._LEXER)
    assert 0 < fell < 3000
    assert names(clone_tokens("é = '''ß'''"), "norm") == ["é", "=", "STR"] and tokens._scanned("x = '''ß'''", tokens._ASCII) is not None


def test_the_collector_rests_while_files_are_read(monkeypatch):
    import gc

    from tessera.sources import facts as F

    seen = []
    monkeypatch.setattr(F, "extract", lambda rel, src: seen.append(gc.isenabled()) or {"rel": rel} if src else 1 / 0)
    assert F._extracted([{"project": "p", "rel": "a.py", "src": "x"}]) == [{"project": "p", "rel": "a.py"}] and seen == [False] and gc.isenabled()
    with pytest.raises(ZeroDivisionError):
        F._extracted([{"project": "p", "rel": "a.py", "src": ""}])
    assert gc.isenabled()
