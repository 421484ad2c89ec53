"""One pass per file: Python source to the facts that every rule reads.

`extract(rel, src)` gives a plain record in the shape of FACTS. A file that doesn't parse gives the
empty record with had_errors set, so that it stays a module. Nothing here knows of Spark.
"""

from __future__ import annotations

import ast
import io
import keyword
import math
import re
import tokenize
import warnings
from bisect import bisect_left
from collections import Counter

from .security import call_hits, import_hits, secret_hit, swallow_hits
from .tokens import clone_tokens

STRING_LIST = ("names", "bindings", "decorators", "bases", "attrs")
ENUM_BASES = {"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag", "ReprEnum", "EnumMeta"}
SINKS = {"getattr", "setattr", "eval", "exec", "__import__"}
OPAQUE = {"locals", "vars", "globals", "eval", "exec"}
EXITS = {"sys.exit", "os._exit", "exit", "quit"}
TYPE_PARAMS = {"TypeVar", "ParamSpec", "TypeVarTuple"}
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
SCOPED = (*FUNCTIONS, ast.ClassDef)
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
BLOCKS = (ast.Module, *SCOPED, ast.For, ast.AsyncFor, ast.While, ast.If, ast.With, ast.AsyncWith, ast.Try, getattr(ast, "TryStar", ast.Try), ast.Match)
_BRANCHES = {ast.If, ast.For, ast.AsyncFor, ast.While, ast.Assert, ast.IfExp, ast.ExceptHandler, ast.match_case}
_LEAVES = {"ctx", "op", "ops", "kind", "type_comment"}  # fields whose nodes have no place and nothing below
_PLAIN = {"arg", "asname", "attr", "conversion", "id", "is_async", "level", "module", "simple"}  # fields that never hold nodes
_FIELDS: dict[type, tuple] = {ast.Constant: ()}
_TOOL = "tessera"


def children(node: ast.AST) -> list[ast.AST]:
    """Nodes right below in the order of the fields, without contexts and operators; found once for each node."""
    held = node.__dict__
    if (out := held.get("_below")) is not None:
        return out
    kind = type(node)
    if (fields := _FIELDS.get(kind)) is None:
        fields = _FIELDS[kind] = tuple(f for f in kind._fields if f not in _LEAVES and f not in _PLAIN)
    out = []
    for name in fields:
        value = held.get(name)
        if type(value) is list:
            out += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    held["_below"] = out
    return out


def below(node: ast.AST) -> list[ast.AST]:
    """A node and all nodes within it, level by level."""
    out = [node]
    for n in out:
        out += children(n)
    return out


def path_of(node: ast.AST | None) -> str:
    """`a.b.c` for a chain of names, '' for anything else."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def text_of(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def last_part(path: str) -> str:
    return path.rpartition(".")[2]


def decorators_of(node) -> list[str]:
    named = (path_of(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list)
    return [d for d in named if d]


def words_of(text: str) -> list[str]:
    """ASCII identifiers in a string annotation."""
    return [w for w in re.findall(r"[A-Za-z0-9_]+", text) if not w[0].isdigit()]


def suites(node: ast.AST):
    """Every block of statements that hangs on a node, and what kind it is."""
    for name in ("body", "orelse", "finalbody"):
        block = getattr(node, name, None)
        if isinstance(block, list) and block and isinstance(block[0], ast.stmt):
            yield name, block
    for handler in getattr(node, "handlers", ()):
        yield "handler", handler.body
    for case in getattr(node, "cases", ()):
        yield "case", case.body


def params_of(args: ast.arguments) -> list[ast.arg]:
    return [*args.posonlyargs, *args.args, *args.kwonlyargs]


class _Source:
    """A parsed file with its tokens."""

    def __init__(self, src: str):
        src = re.sub(r"\r\n?", "\n", src)  # the parser takes either for the end of a line
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            self.tree = ast.parse(src)
        self.lines = src.split("\n")
        self.kinds: dict[type, list] = {}
        for n in below(self.tree):
            self.kinds.setdefault(type(n), []).append(n)
        self.tokens = list(tokenize.generate_tokens(io.StringIO(src).readline))

    def is_elif(self, node: ast.stmt) -> bool:
        return isinstance(node, ast.If) and self.lines[node.lineno - 1].encode()[node.col_offset :].startswith(b"elif")

    def chain(self, node: ast.If):
        """(test, body) of an if and of each elif, and (None, body) of its else."""
        while True:
            yield node.test, node.body
            rest = node.orelse
            if len(rest) == 1 and self.is_elif(rest[0]):
                node = rest[0]
                continue
            if rest:
                yield None, rest
            return

    def of(self, *kinds: type) -> list:
        """Nodes of some kinds, level by level within a kind."""
        return [n for k in dict.fromkeys(kinds) for n in self.kinds.get(k, ())]

    def ordered(self, *kinds: type) -> list:
        """Nodes of some kinds in source order, an outer before what it holds."""
        return sorted(self.of(*kinds), key=lambda n: (n.lineno, n.col_offset, -(n.end_lineno or 0), -(n.end_col_offset or 0)))


# ---------------------------------------------------------------- tokens


def _soft_keywords(s: _Source) -> tuple[set, list[tuple[int, int]]]:
    at = {(n.lineno, n.col_offset) for n in s.of(ast.Match, getattr(ast, "TypeAlias", ast.Match))}
    return at, [(n.lineno, n.end_lineno) for n in s.of(ast.Match)]


def scan_tokens(s: _Source) -> dict:
    """Name frequencies with places, suppression comments, Halstead volume."""
    soft, matches = _soft_keywords(s)
    names: list[tuple[tuple[int, int], str]] = []
    ignores: list[tuple[int, str]] = []
    operators: Counter = Counter()
    operands: Counter = Counter()
    literal = {tokenize.NUMBER, tokenize.STRING} | {getattr(tokenize, n) for n in ("FSTRING_START", "FSTRING_MIDDLE", "FSTRING_END") if hasattr(tokenize, n)}
    for kind, word, start, _, text in s.tokens:
        if kind == tokenize.NAME:
            row, col = start
            is_case = word == "case" and not text[:col].strip() and any(a <= row <= b for a, b in matches)
            if word in ("True", "False", "None"):
                operands[word] += 1
            elif keyword.iskeyword(word) or word in ("match", "type") and (row, len(text[:col].encode())) in soft or is_case:
                operators[word] += 1
            else:
                names.append((start, word))
                operands[word] += 1
        elif kind in literal:
            operands[word] += 1
        elif kind == tokenize.OP:
            operators[word] += 1
        elif kind == tokenize.COMMENT:
            ignores += [(start[0], r) for r in [*suppressed(word), *noqa(word)]]
    vocabulary, length = len(operators) + len(operands), operators.total() + operands.total()
    return {"names": names, "ignores": ignores, "volume": length * math.log2(vocabulary) if vocabulary > 1 else 0.0}


def suppressed(comment: str, tool: str = _TOOL) -> list[str]:
    """Rules that an ignore comment names; ['*'] for all."""
    body = comment.lstrip("#").strip()
    m = re.fullmatch(re.escape(tool) + r":\s*ignore\s*(?:(\[)([^\]]*)\].*|)", body, re.DOTALL)
    if not m:
        return []
    if not m.group(1):
        return ["*"]
    return [r.strip() for r in m.group(2).split(",") if r.strip()] or ["*"]


def noqa(comment: str) -> list[str]:
    """Rules that a flake8 comment stands for."""
    body = comment.lstrip("#").strip()
    if body[:4].lower() != "noqa":
        return []
    rest = body[4:].lstrip()
    if not rest or rest[0] == "#":
        return ["unused-import", "unused-variable"]
    if rest[0] != ":":
        return []
    known = {"F401": "unused-import", "F841": "unused-variable"}
    return [known[c] for c in (x.strip().upper() for x in re.split(r"[, #]", rest[1:])) if c in known]


# ---------------------------------------------------------------- module level


def imports_of(node: ast.Import | ast.ImportFrom) -> list[dict]:
    base = {"relative_dots": 0, "names": [], "is_star": False, "type_checking_only": False, "in_try": False, "line": node.lineno, "end_line": node.end_lineno}
    if isinstance(node, ast.Import):
        return [base | {"module": a.name, "bindings": [a.asname or a.name.partition(".")[0]], "redundant": [a.asname == a.name]} for a in node.names]
    plain = [a for a in node.names if a.name != "*"]
    return [base | {"module": node.module or "", "relative_dots": min(node.level, 255), "names": [a.name for a in plain], "bindings": [a.asname or a.name for a in plain], "redundant": [a.asname == a.name for a in plain], "is_star": len(plain) < len(node.names)}]


def is_main_test(test: ast.expr) -> bool:
    if not (isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], ast.Eq)):
        return False
    pair = (test.left, test.comparators[0])
    return any(path_of(a) == "__name__" and isinstance(a, ast.Name) and text_of(b) == "__main__" for a, b in (pair, pair[::-1]))


def is_typing_test(test: ast.expr) -> bool:
    if isinstance(test, ast.Constant) and test.value is False:
        return True
    return last_part(path_of(test)) == "TYPE_CHECKING"


class TopLevel:
    """Definitions, imports and exports that importing the module runs through."""

    def __init__(self, s: _Source):
        self.s, self.definitions, self.imports = s, [], []
        self.exports: list[str] | None = None
        self.open_exports = self.main_guard = False
        self.block(s.tree.body, False)

    def define(self, node, name: str, kind: str) -> None:
        self.definitions.append({"name": name, "kind": kind, "line": node.lineno, "end_line": node.end_lineno, "private": name.startswith("_"), "decorators": decorators_of(node) if kind != "variable" else []})

    def export(self, value: ast.AST | None, extend: bool) -> None:
        if isinstance(value, (ast.List, ast.Tuple)):
            items = [t for t in map(text_of, value.elts) if t is not None]
            self.exports = [*(self.exports or []), *items] if extend else items
        else:
            self.open_exports = True
            if extend:
                self.exports = None

    def call(self, call: ast.Call) -> None:
        where, first = path_of(call.func), call.args[0] if call.args else None
        if where == "__all__.extend":
            self.export(first, True)
        elif where == "__all__.append":
            self.export(ast.List(elts=[first]) if text_of(first) is not None else None, True)

    def marked(self, block: list[ast.stmt], typing: bool, probe: bool) -> None:
        """A guarded block: its imports are for typing only, or else conditional."""
        before = len(self.imports)
        self.block(block, typing)
        for imp in self.imports[before:]:
            if typing:
                imp["type_checking_only"] = True
            elif probe:
                imp["in_try"] = True

    def block(self, body: list[ast.stmt], typing: bool) -> None:
        for node in body:
            if isinstance(node, FUNCTIONS):
                self.define(node, node.name, "function")
            elif isinstance(node, ast.ClassDef):
                self.define(node, node.name, "class")
            elif isinstance(node, ast.Import):
                self.imports += imports_of(node)
            elif isinstance(node, ast.ImportFrom):
                self.imports += [i | {"type_checking_only": typing} for i in imports_of(node)]
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                target = node.target if isinstance(node, ast.AnnAssign) else node.targets[0] if len(node.targets) == 1 else None
                if isinstance(target, ast.Name) and target.id != "__all__":
                    self.define(node, target.id, "variable")
                elif isinstance(target, ast.Name) and node.value is not None:
                    self.export(node.value, False)
            elif isinstance(node, ast.AugAssign):
                if isinstance(node.target, ast.Name) and node.target.id == "__all__":
                    self.export(node.value, True)
            elif isinstance(node, ast.Expr) and isinstance(node.value, ast.Call):
                self.call(node.value)
            elif isinstance(node, ast.If):
                self.branches(node, typing)
            elif isinstance(node, (ast.Try, getattr(ast, "TryStar", ast.Try))):
                before = len(self.imports)
                self.block(node.body, typing)
                for handler in node.handlers:
                    self.block(handler.body, typing)
                for imp in self.imports[before:]:
                    imp["in_try"] = True
                self.block(node.orelse, typing)
                self.block(node.finalbody, typing)
            elif isinstance(node, (ast.With, ast.AsyncWith, ast.For, ast.AsyncFor, ast.While, ast.Match)):
                for _, inner in suites(node):
                    self.block(inner, typing)

    def branches(self, node: ast.If, typing: bool) -> None:
        self.main_guard |= is_main_test(node.test)
        other = typing or isinstance(node.test, ast.UnaryOp) and isinstance(node.test.op, ast.Not) and is_typing_test(node.test.operand)
        for k, (_, body) in enumerate(self.s.chain(node)):
            self.marked(body, other if k else typing or is_typing_test(node.test), True)


def nested_imports(s: _Source) -> list[dict]:
    out: list[dict] = []
    if len(s.of(ast.Import, ast.ImportFrom)) == sum(isinstance(n, (ast.Import, ast.ImportFrom)) for n in s.tree.body):
        return out

    def walk(node: ast.AST, deep: bool) -> None:
        for child in children(node):
            if isinstance(child, (ast.Import, ast.ImportFrom)):
                if deep:
                    out.extend(imports_of(child))
            elif isinstance(child, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                walk(child, deep or isinstance(child, SCOPED))

    walk(s.tree, False)
    return out


# ---------------------------------------------------------------- functions


def _own(node: ast.AST, stop) -> list[ast.AST]:
    """Nodes below, without going into those of the kinds in stop."""
    out, stack = [], list(children(node))
    while stack:
        n = stack.pop()
        out.append(n)
        if not isinstance(n, stop):
            stack += children(n)
    return out


def cyclomatic(fn) -> int:
    points = 1
    for stmt in fn.body:
        for n in [stmt, *([] if isinstance(stmt, SCOPED) else _own(stmt, SCOPED))]:
            if type(n) in _BRANCHES:
                points += 1
            elif isinstance(n, ast.BoolOp):
                points += len(n.values) - 1
            elif isinstance(n, COMPREHENSIONS):
                points += sum(1 + len(g.ifs) for g in n.generators)
    return points


def cognitive(s: _Source, body: list[ast.stmt], depth: int = 0) -> int:
    def condition(e: ast.AST | None) -> int:
        found = [] if e is None else below(e)
        return sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, ast.IfExp) for n in found)

    total = 0
    for n in body:
        if isinstance(n, ast.If):
            for k, (test, block) in enumerate(s.chain(n)):
                total += (1 if k else 1 + depth) + condition(test) + cognitive(s, block, depth + 1)
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
            total += 1 + depth + condition(getattr(n, "test", None)) + cognitive(s, n.body, depth + 1) + cognitive(s, n.orelse, depth + 1)
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            total += cognitive(s, n.body, depth)
        elif isinstance(n, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            total += sum(cognitive(s, b, depth) for b in (n.body, n.orelse, n.finalbody))
            total += sum(1 + depth + cognitive(s, h.body, depth + 1) for h in n.handlers)
        elif isinstance(n, ast.Match):
            total += sum(1 + depth + cognitive(s, c.body, depth + 1) for c in n.cases)
        elif isinstance(n, (ast.Expr, ast.Return, ast.Assign, ast.AugAssign, ast.AnnAssign)):
            total += condition(n.value)
    return total


def counted_params(args: ast.arguments) -> list[ast.arg]:
    positional = [*args.posonlyargs, *args.args]
    bound = bool(positional) and positional[0].arg in ("self", "cls")
    return [*positional[bound:], *args.kwonlyargs]


def is_stub(body: list[ast.stmt]) -> bool:
    return all(isinstance(n, (ast.Pass, ast.Raise)) or isinstance(n, ast.Expr) and (text_of(n.value) is not None or isinstance(n.value, ast.Constant) and n.value.value is ...) for n in body)


def scope_findings(s: _Source, fn, names: list[tuple[tuple[int, int], str]], columns) -> list[dict]:
    """Parameters and plain locals whose name occurs once within the function, decorators included."""
    first = fn.decorator_list[0] if fn.decorator_list else fn
    begin, end = columns(first.lineno, first.col_offset), columns(fn.end_lineno, fn.end_col_offset)
    count = Counter(w for _, w in names[bisect_left(names, (begin, "")) : bisect_left(names, (end, ""))])
    if OPAQUE & count.keys():
        return []
    place = lambda n: (n.lineno, n.col_offset)
    outer = {name for n in s.of(ast.Global, ast.Nonlocal) if place(fn) <= place(n) < (fn.end_lineno, fn.end_col_offset) for name in n.names}
    out = []
    dunder = fn.name.startswith("__") and fn.name.endswith("__")
    if not (fn.decorator_list or dunder or is_stub(fn.body)):
        out += [{"name": p.arg, "line": p.lineno, "is_param": True} for p in counted_params(fn.args) if not p.arg.startswith("_") and p.arg not in outer and count[p.arg] == 1]
    for n in fn.body:
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            name = n.targets[0].id
            if name != "_" and name not in outer and count[name] == 1:
                out.append({"name": name, "line": n.lineno, "is_param": False})
    return out


# ---------------------------------------------------------------- classes, leaks, dead ends


def class_record(c: ast.ClassDef) -> dict:
    members, methods = [], []
    for n in c.body:
        target = n.target if isinstance(n, ast.AnnAssign) else n.targets[0] if isinstance(n, ast.Assign) and len(n.targets) == 1 else None
        if isinstance(n, FUNCTIONS):
            held = {a.attr for stmt in n.body for a in below(stmt) if isinstance(a, ast.Attribute) and isinstance(a.value, ast.Name) and a.value.id in ("self", "cls")}
            methods.append({"method": n.name, "attrs": sorted(held)})
        if isinstance(n, FUNCTIONS) or isinstance(target, ast.Name):
            name = n.name if isinstance(n, FUNCTIONS) else target.id
            members.append({"name": name, "line": n.lineno, "end_line": n.end_lineno, "is_method": isinstance(n, FUNCTIONS), "private": name.startswith("_"), "decorators": decorators_of(n) if isinstance(n, FUNCTIONS) else []})
    bases = [b for b in map(path_of, c.bases) if b]
    return {"name": c.name, "line": c.lineno, "end_line": c.end_lineno, "private": c.name.startswith("_"), "decorators": decorators_of(c), "bases": bases, "is_enum": any(last_part(b) in ENUM_BASES for b in bases), "methods": methods, "members": members}


def ends_block(n: ast.stmt) -> str:
    for kind, label in ((ast.Return, "return"), (ast.Raise, "raise"), (ast.Break, "break"), (ast.Continue, "continue")):
        if isinstance(n, kind):
            return label
    leaves = isinstance(n, ast.Expr) and isinstance(n.value, ast.Call) and path_of(n.value.func) in EXITS
    return "exit call" if leaves else ""


def unreachable(s: _Source) -> list[dict]:
    out = set()
    for node in s.of(*BLOCKS):
        for _, block in suites(node):
            for here, after in zip(block, block[1:]):
                if label := ends_block(here):
                    start = after.decorator_list[0] if isinstance(after, SCOPED) and after.decorator_list else after
                    out.add((start.lineno, label))
                    break
    return [{"line": line, "after": label} for line, label in sorted(out)]


def annotation_names(e: ast.AST | None) -> list[str]:
    if isinstance(e, ast.Name):
        return [e.id]
    if isinstance(e, ast.Attribute):
        return [*annotation_names(e.value), e.attr]
    if text_of(e) is not None:
        return words_of(text_of(e))
    return [w for part in annotation_parts(e) for w in annotation_names(part)]


def annotation_parts(e: ast.AST | None) -> list[ast.AST]:
    if isinstance(e, ast.Subscript):
        return [e.value, e.slice]
    if isinstance(e, (ast.Tuple, ast.List)):
        return e.elts
    return [e.left, e.right] if isinstance(e, ast.BinOp) else []


def quoted_names(e: ast.AST | None) -> list[str]:
    """Names within the string parts of an annotation."""
    if text_of(e) is not None:
        return words_of(text_of(e))
    return [w for part in annotation_parts(e) for w in quoted_names(part)]


def type_leaks(s: _Source) -> list[dict]:
    private: set[str] = set()

    def variables(body: list[ast.stmt]) -> None:
        for n in body:
            if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name) and isinstance(n.value, ast.Call):
                if last_part(path_of(n.value.func)) in TYPE_PARAMS:
                    private.add(n.targets[0].id)
            elif isinstance(n, (ast.If, ast.Try)):
                for _, block in suites(n):
                    variables(block)

    variables(s.tree.body)
    public = [n for n in s.tree.body if isinstance(n, SCOPED) and not n.name.startswith("_")]
    functions = [(n.name, n) for n in public if isinstance(n, FUNCTIONS)]
    functions += [(f"{c.name}.{f.name}", f) for c in public if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, FUNCTIONS) and not f.name.startswith("_")]
    found = {}
    for label, f in functions:
        marks = [(p.annotation, p.lineno, False) for p in params_of(f.args)] + [(f.returns, f.lineno, True)]
        for mark, line, is_return in marks:
            for name in annotation_names(mark):
                special = name.startswith("__") and name.endswith("__")
                if name.startswith("_") and not special and name not in private:
                    found[line, name, label, is_return] = None
    ranked = sorted(found, key=lambda k: (k[0], k[1]))
    return [{"function": f, "type_name": name, "line": line, "is_return": r} for line, name, f, r in ranked]


# ---------------------------------------------------------------- uses


def uses_of(s: _Source) -> tuple[set[str], set[str]]:
    """Names used outside imports, and attributes accessed."""
    attrs = {n.attr for n in s.of(ast.Attribute)}
    used = {n.id for n in s.of(ast.Name)} | attrs
    for n in s.of(ast.AnnAssign):
        used.update(quoted_names(n.annotation))
        if last_part(path_of(n.annotation)) == "TypeAlias":
            used.update(quoted_names(n.value))
    for n in s.of(*FUNCTIONS):
        for mark in [n.returns, *(p.annotation for p in params_of(n.args))]:
            used.update(quoted_names(mark))
    for n in s.of(ast.Call):
        if n.args and last_part(path_of(n.func)) == "cast":
            used.update(quoted_names(n.args[0]))
    return used, attrs


class Resolver:
    """Names whose loads reach module scope: no enclosing function binds them.

    Only functions and lambdas make scopes here. Class bodies are transparent, and what comprehensions,
    imports and handlers bind within a function isn't held to be local.
    """

    def __init__(self, tree: ast.Module):
        self.used: set[str] = set()
        self.scopes: list[tuple[set[str], set[str]]] = []
        for n in tree.body:
            self.visit(n)

    def load(self, name: str) -> None:
        for local, shared in reversed(self.scopes):
            if name in shared:
                break
            if name in local:
                return
        self.used.add(name)

    def signature(self, a: ast.arguments) -> None:
        rest = [x for x in (a.vararg, a.kwarg) if x]
        for e in [*a.defaults, *a.kw_defaults, *(p.annotation for p in [*params_of(a), *rest])]:
            if e is not None:
                self.visit(e)

    @staticmethod
    def names(a: ast.arguments) -> set[str]:
        return {p.arg for p in [*params_of(a), *(x for x in (a.vararg, a.kwarg) if x)]}

    def bindings(self, fn) -> tuple[set[str], set[str]]:
        local, shared = self.names(fn.args), set()
        for stmt in fn.body:
            for n in [stmt, *([] if isinstance(stmt, SCOPED) else _own(stmt, (*SCOPED, ast.Lambda, *COMPREHENSIONS)))]:
                if isinstance(n, SCOPED):
                    local.add(n.name)
                elif isinstance(n, ast.Global):
                    shared.update(n.names)
                elif isinstance(n, ast.Nonlocal):
                    local.update(n.names)
                elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                    local.add(n.id)
        return local - shared, shared

    def visit(self, n: ast.AST) -> None:
        kind = type(n)
        if kind is ast.Name:
            if isinstance(n.ctx, ast.Load):
                self.load(n.id)
        elif kind in (*FUNCTIONS, ast.Lambda):
            for d in getattr(n, "decorator_list", ()):
                self.visit(d)
            self.signature(n.args)
            if getattr(n, "returns", None) is not None:
                self.visit(n.returns)
            plain = isinstance(n, ast.Lambda)
            self.scopes.append((self.names(n.args), set()) if plain else self.bindings(n))
            for inner in [n.body] if plain else n.body:
                self.visit(inner)
            self.scopes.pop()
        else:
            for child in children(n):
                if kind is not ast.ClassDef or not isinstance(child, getattr(ast, "type_param", ())):
                    if type(child) is not ast.Constant:
                        self.visit(child)


# ---------------------------------------------------------------- the record


def empty_record(rel: str, src: str) -> dict:
    lists = ("definitions", "imports", "nested_imports", "calls", "functions", "security_hits", "scope_findings", "classes", "unreachable", "type_leaks", "ignores", "name_counts", "local_uses", "attr_accessed", "module_used")
    return {"rel": rel, "src": src, "tokens": [], **{k: [] for k in lists}, "dunder_all": [], "has_all": False, "all_dynamic": False, "has_dynamic_sink": False, "has_main_guard": False, "halstead_volume": 0.0, "had_errors": True}


def extract(rel: str, src: str) -> dict:
    """The facts of one file. Whatever goes wrong with it costs its own facts only."""
    src = src.removeprefix("﻿")
    out = empty_record(rel, src)
    try:
        out["tokens"] = clone_tokens(re.sub(r"\r\n?", "\n", src))
        return out | _facts(_Source(src)) | {"had_errors": False}
    except Exception:  # a text that isn't Python, nested too deep, or one that the rules' authors didn't think of
        return out


def _numbered(rows: list[dict]) -> list[dict]:
    return [{"ord": k, **r} for k, r in enumerate(rows)]


def _facts(s: _Source) -> dict:
    scanned, top, nested = scan_tokens(s), TopLevel(s), nested_imports(s)
    calls = s.ordered(ast.Call)
    sites = [{"callee": c, "line": n.func.lineno} for n in calls if (c := path_of(n.func))]
    hits = [h for n in calls for h in call_hits(n, path_of(n.func))]
    for n in s.ordered(ast.Assign, ast.AnnAssign):
        hits += secret_hit(n)
    hits += [h for n in s.ordered(ast.Try, getattr(ast, "TryStar", ast.Try)) for h in swallow_hits(n)]
    hits += import_hits(top.imports + nested)
    once = {}
    for rule, line, detail in sorted(hits, key=lambda h: (h[1], h[0])):
        once.setdefault((line, rule), {"rule": rule, "line": line, "detail": detail})
    functions, classes = s.ordered(*FUNCTIONS), s.ordered(ast.ClassDef)
    columns = lambda row, col: (row, len(s.lines[row - 1].encode()[:col].decode("utf-8", "ignore")))
    complexity = [{
        "name": f.name, "line": f.lineno, "end_line": f.end_lineno, "cyclomatic": cyclomatic(f), "cognitive": cognitive(s, f.body), "params_total": len(counted_params(f.args)),
        "params_annotated": sum(p.annotation is not None for p in counted_params(f.args)), "return_annotated": f.returns is not None,
    } for f in functions]
    scoped = [x for f in functions for x in scope_findings(s, f, scanned["names"], columns)]
    used, attrs = uses_of(s)
    spans = [(i["line"], i["end_line"]) for i in top.imports]
    ignores = scanned["ignores"] + [(a, rule) for line, rule in scanned["ignores"] for a, b in spans if a < line <= b]
    return {
        "definitions": _numbered(top.definitions), "imports": _numbered(top.imports), "nested_imports": _numbered(nested), "calls": _numbered(sites),
        "functions": _numbered(sorted(complexity, key=lambda f: f["line"])), "security_hits": _numbered(list(once.values())), "scope_findings": _numbered(sorted(scoped, key=lambda x: x["line"])),
        "classes": _numbered(sorted(map(class_record, classes), key=lambda c: c["line"])), "unreachable": _numbered(unreachable(s)), "type_leaks": _numbered(type_leaks(s)),
        "ignores": [{"line": a, "rule": b} for a, b in dict.fromkeys(ignores)], "name_counts": [{"name": w, "n": n} for w, n in sorted(Counter(w for _, w in scanned["names"]).items())],
        "local_uses": sorted(used), "attr_accessed": sorted(attrs), "module_used": sorted(Resolver(s.tree).used), "dunder_all": top.exports or [], "has_all": top.exports is not None, "all_dynamic": top.open_exports,
        "has_dynamic_sink": any(c["callee"] in SINKS or c["callee"].startswith("importlib") for c in sites), "has_main_guard": top.main_guard, "halstead_volume": scanned["volume"],
    }
