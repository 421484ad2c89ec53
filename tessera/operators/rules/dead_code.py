"""Files, symbols, imports, locals, members and lines that nothing needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import names as N
from ...functions.identity import occurrence
from ..findings import closest_key, draft, text
from ..relations import conflicts, enclosing, innermost, unexecuted

FILE = ["project", "rel"]
CONTRACT = ["abstractmethod", "overload", "override"]
EXEMPT = sorted("abstractmethod abstractproperty cached_property classmethod deleter getter overload override property setter singledispatchmethod staticmethod".split())
INTERFACES, CONTAINERS, CONTAINER_MARKS = ["ABC", "ABCMeta", "Protocol"], ["BaseModel", "NamedTuple", "TypedDict"], ["attr", "attrs", "dataclass", "define", "frozen", "s"]
MACHINERY = ["_generate_next_value_", "_ignore_", "_order_"]


def _flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with a boolean column: whether other has its keys."""
    return df.join(other.select(*keys, F.lit(True).alias(name)).distinct(), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def unused_files(a) -> DataFrame:
    loose = a.graph.modules.filter("not is_entry and not reachable")
    loose = _flag(loose, a.graph.edges.select("project", F.col("dst").alias("rel")), FILE, "imported")
    why = F.when(F.col("imported"), "only files that nothing reaches import this one").otherwise("no file imports this one")
    return draft(loose, "unused-file", "dead-code", F.when(F.col("global_dynamic"), "uncertain").otherwise("likely"), why, ["rel"], "delete-file", text("Delete `{}` if nothing outside of the project loads it", "rel"), line=F.lit(1))


def idle_definitions(a) -> DataFrame:
    """Definitions whose names their file doesn't export, nor use where it looks no names up at run time. All of a name or none."""
    used = F.concat("dunder_all", F.when(F.col("has_dynamic_sink"), F.array().cast("array<string>")).otherwise(F.col("module_used")))
    open_ = a.facts.table.select(*FILE, "definitions", F.array_except("definitions.name", used).alias("open")).filter(F.size("open") > 0)
    return open_.select(*FILE, F.inline(F.filter("definitions", lambda d: F.array_contains("open", d["name"]))))


def used_symbols(a, asked: DataFrame) -> DataFrame:
    """(project, rel, name) among those asked with evidence of use: within a file that looks names up at run time, by name from
    others, or a token of an importer."""
    counts, asked = a.facts.listed("name_counts"), asked.groupBy(*FILE, "name").agg(F.count("*").alias("defs"))
    there = a.facts.table.filter("has_dynamic_sink").select(*FILE, F.inline("name_counts"))
    inside = there.join(asked, [*FILE, "name"]).filter("n > defs").select(*FILE, "name")
    asked = asked.drop("defs")
    starred = asked.join(a.graph.imported.filter("name = '*'").select(*FILE), FILE, "left_semi")
    reaching = asked.join(a.graph.edges.select("project", F.col("dst").alias("rel"), "src").distinct(), FILE)
    tokens = counts.select("project", F.col("rel").alias("src"), "name")
    by_token = reaching.join(tokens, ["project", "src", "name"], "left_semi").select(*FILE, "name")
    return inside.unionByName(a.graph.imported.filter("name <> '*'").select(*FILE, "name")).unionByName(starred).unionByName(by_token).distinct()


def unused_exports(a) -> DataFrame:
    idle = idle_definitions(a)
    d = idle.withColumn("nth", occurrence([*FILE, "name"], ["ord"])).join(a.graph.modules, FILE)
    pytest = F.col("is_test") & (F.col("name").startswith("test_") | F.col("name").startswith("Test"))
    d = d.filter(~pytest & ~N.is_dunder(F.col("name")) & ~N.is_handler(F.col("decorators")))
    d = d.join(used_symbols(a, idle), [*FILE, "name"], "left_anti")
    if a.entry_symbols is not None:
        d = d.join(a.entry_symbols, ["project", "dotted", "name"], "left_anti")
    sure = F.col("private") & (F.col("is_entry") | F.col("reachable")) & ~F.col("is_fixture") & ~F.col("all_dynamic")
    confidence = F.when(F.col("sink") | F.col("global_dynamic"), "uncertain").when(sure, "certain").otherwise("likely")
    return draft(
        d, "unused-export", "dead-code", confidence, text("{} `{}` isn't used in this project", "kind", "name"), ["rel", "name", "nth"], F.concat(F.lit("remove-"), "kind"),
        text("Remove `{}`, or list it in __all__ if others rely on it", "name"), end_line=F.col("end_line"), fixable=(confidence == "certain") & F.col("is_py"),
    )


def unused_imports(a) -> DataFrame:
    """Statements none of whose bindings is used, and single unused bindings of the others."""
    i = a.graph.imports.filter("not lazy and size(idle) > 0").withColumn("key", F.array_join("bindings", ","))
    i = i.withColumn("nth", occurrence([*FILE, "key"], ["ord"]))
    b = i.select(*FILE, "ord", F.posexplode("bindings").alias("at", "name"), "redundant", "is_star", "type_checking_only", "module", F.col("idle").alias("open")).filter("array_contains(open, name)")
    b = b.withColumn("nth_name", occurrence([*FILE, "name"], ["ord", "at"])).filter("not is_star and not type_checking_only and module <> '__future__'")
    star = a.graph.imported.filter("name = '*'").select(*FILE)
    known = a.graph.imported.filter("name <> '*'").select(*FILE, "name")
    b = b.filter(~F.coalesce(F.get("redundant", F.col("at")), F.lit(False))).join(known, [*FILE, "name"], "left_anti").join(star, FILE, "left_anti")
    idle = b.groupBy(*FILE, "ord").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("at", "name", "nth_name"))).alias("idle"))
    i = i.drop("idle").join(idle, [*FILE, "ord"]).join(a.graph.modules.drop("dotted", "is_package"), FILE)
    handlers = a.facts.table.filter(F.exists("definitions", lambda d: N.is_handler(d["decorators"]))).select("project", "rel")
    answering = a.graph.targets.join(handlers, FILE, "left_semi").select("project", F.col("dotted").alias("target"))
    i = _flag(i, answering, ["project", "target"], "registers")
    whole = i.filter(F.col("n") == F.size("bindings"))
    is_init = N.is_package(F.col("rel"))
    unsure = is_init | F.col("in_try") | F.col("sink") | F.col("all_dynamic")
    weak = ~(F.col("is_entry") | F.col("reachable")) | F.col("is_fixture") | F.col("registers")
    confidence = F.when(unsure, "uncertain").when(weak, "likely").otherwise("certain")
    note = F.when(F.col("in_try"), " (the import is conditional)").when(F.col("registers"), " (importing the module registers handlers)").otherwise("")
    first = draft(
        whole, "unused-import", "dead-code", confidence, F.concat(text("`{}` is imported here and never used", F.array_join("bindings", "`, `")), note), ["rel", "key", "nth"], "remove-import",
        text("Drop the import of `{}`", F.array_join("bindings", "`, `")), fixable=(confidence == "certain") & F.col("is_py"),
    )
    partly = i.filter(F.col("n") < F.size("bindings")).select(*FILE, "line", F.inline("idle"))
    second = draft(partly, "unused-import", "dead-code", "likely", text("`{}` is imported and never used, unlike its neighbours", "name"), ["rel", "name", "nth_name"], "remove-import-name", text("Drop `{}` from the import", "name"))
    return first.unionByName(second)


def base_methods(a) -> DataFrame:
    """(project, rel, class_ord, base, found, methods): the methods of each named base.

    found says that the base was traced to one class: in the file, or through an import. Otherwise
    methods are those of all classes of that bare name, null where the project has none.
    """
    classes = a.facts.listed("classes")
    methods = classes.select(*FILE, "ord", "name", F.transform(F.filter("members", lambda m: m["is_method"]), lambda m: m["name"]).alias("methods"))
    first = methods.groupBy(*FILE, "name").agg(F.min_by("methods", "ord").alias("methods"))
    pooled = methods.groupBy("project", F.col("name").alias("last")).agg(F.array_distinct(F.flatten(F.collect_list("methods"))).alias("pooled"))
    uses = classes.select(*FILE, F.col("ord").alias("class_ord"), F.explode("bases").alias("base")).withColumn("last", N.last_segment(F.col("base"))).filter("last <> 'object'")
    cut = F.length("base") - F.length("last")
    uses = uses.withColumn("prefix", F.when(cut > 0, F.substring("base", F.lit(1), cut - 1)).otherwise(""))
    head = F.split("prefix", r"\.")[0]
    uses = uses.withColumn("seen_as", F.when(F.col("prefix") == "", F.col("base")).otherwise(head)).withColumn("rest", F.when(F.col("prefix") != "", F.substring(F.col("prefix"), F.length(head) + 2, F.length("prefix"))))
    bound = a.graph.imports.filter("not lazy").select(*FILE, "ord", "module", "target", "names", F.posexplode("bindings").alias("at", "seen_as"))
    bound = bound.withColumn("original", F.get("names", F.col("at")))
    places = a.graph.targets.select("project", F.col("dotted").alias("goal"), F.col("rel").alias("home"))
    # A dotted spelling that is a module's name, or leads to one through what its first part is bound to.
    direct = uses.filter("prefix <> ''").withColumn("goal", F.col("prefix")).join(places, ["project", "goal"])
    direct = direct.select(*FILE, "class_ord", "base", F.lit(-1).alias("ord"), "home", F.col("last").alias("wanted"))
    origin = F.when(F.size("names") == 0, F.col("module")).when(F.col("target") == "", F.col("original")).otherwise(F.concat("target", F.lit("."), "original"))
    spelled = F.when(F.col("prefix") == "", F.col("target")).when(F.col("rest") == "", origin).otherwise(F.concat(origin, F.lit("."), "rest"))
    through = uses.join(bound, [*FILE, "seen_as"]).filter((F.col("prefix") != "") | F.col("original").isNotNull()).withColumn("goal", spelled).join(places, ["project", "goal"])
    through = through.select(*FILE, "class_ord", "base", "ord", "home", F.when(F.col("prefix") == "", F.col("original")).otherwise(F.col("last")).alias("wanted"))
    here = uses.filter("prefix = ''").select(*FILE, "class_ord", "base", F.lit(-1).alias("ord"), F.col("rel").alias("home"), F.col("last").alias("wanted"))
    ways = direct.unionByName(through).unionByName(here)
    traced = ways.join(first.select("project", F.col("rel").alias("home"), F.col("name").alias("wanted"), "methods"), ["project", "home", "wanted"])
    one = traced.groupBy(*FILE, "class_ord", "base").agg(F.min_by("methods", "ord").alias("traced"))
    out = uses.select(*FILE, "class_ord", "base", "last").distinct().join(one, [*FILE, "class_ord", "base"], "left").join(pooled, ["project", "last"], "left")
    return out.select(*FILE, "class_ord", "base", F.col("traced").isNotNull().alias("found"), F.coalesce("traced", "pooled").alias("methods"))


def bound_parameters(a) -> DataFrame:
    """(project, rel, ord) of unused parameters that an interface asks for."""
    p = a.facts.listed("scope_findings").filter("is_param").select(*FILE, "ord", F.col("line").alias("at"))
    members = a.facts.listed("classes").select(*FILE, F.col("ord").alias("class_ord"), F.col("line").alias("begin"), F.col("end_line").alias("finish"), F.posexplode("members").alias("nth", "m")).filter("m.is_method")
    members = members.select(*FILE, "class_ord", "nth", F.greatest("begin", "m.line").alias("begin"), F.least("finish", "m.end_line").alias("finish"), F.col("m.line").alias("first"), F.col("m.name").alias("method"), F.col("m.decorators").alias("decorators"))
    method = innermost(enclosing(p, members, FILE, "at", "begin", "finish"), [*FILE, "ord"], ["first", "class_ord", "nth"], ["class_ord", "method", "decorators"])
    own = N.is_dunder(F.col("method")) | F.exists("decorators", lambda d: N.last_segment(d).isin(CONTRACT))
    by_base = method.join(base_methods(a), [*FILE, "class_ord"]).filter(F.col("methods").isNull() | F.array_contains("methods", F.col("method")))
    functions = a.facts.listed("definitions").filter((F.col("kind") == "function") & (F.size("decorators") > 0)).select(*FILE, F.col("line").alias("begin"), F.col("end_line").alias("finish"))
    free = enclosing(p.join(method, [*FILE, "ord"], "left_anti"), functions, FILE, "at", "begin", "finish")
    return method.filter(own).select(*FILE, "ord").unionByName(by_base.select(*FILE, "ord")).unionByName(free.select(*FILE, "ord")).distinct()


def unused_locals(a) -> DataFrame:
    s = a.facts.listed("scope_findings").join(bound_parameters(a), [*FILE, "ord"], "left_anti").withColumn("nth", occurrence([*FILE, "name"], ["ord"]))
    kind = F.when(F.col("is_param"), "parameter").otherwise("variable")
    return draft(
        s, F.concat(F.lit("unused-"), kind), "dead-code", F.when(F.col("is_param"), "uncertain").otherwise("likely"), text("{} `{}` is never read", kind, "name"), ["rel", "name", "nth"],
        F.concat(F.lit("remove-"), kind), text("Remove {} `{}`", kind, "name"),
    )


def unreachable_code(a) -> DataFrame:
    u = a.facts.listed("unreachable").withColumn("nth", occurrence([*FILE, "after"], ["ord"]))
    return draft(u, "unreachable-code", "dead-code", "certain", text("no path leads here: the block ends at the {} above", "after"), ["rel", "after", "nth"], "remove-code", F.lit("Remove what follows"))


def duplicate_exports(a) -> DataFrame:
    i = a.graph.imports.filter("not lazy and not is_star").filter(N.is_package(F.col("rel")))
    i = i.join(a.graph.modules.filter("not sink").select(*FILE), FILE, "left_semi")
    b = i.select(*FILE, "ord", "line", "module", F.posexplode("bindings").alias("at", "name"))
    b = conflicts(b, [*FILE, "name"], "module", ["ord", "at"]).withColumn("nth", occurrence([*FILE, "name"], ["ord", "at"]))
    return draft(b, "duplicate-export", "architecture", "likely", text("`{}` comes from {} here and from {} above, which it hides", "name", "module", "first"), ["rel", "name", "module", "nth"], "rename-export", text("Keep one source of `{}`", "name"))


def unused_members(a) -> DataFrame:
    """Methods, attributes and enum members whose names no file of the project touches."""
    classes = a.facts.listed("classes")
    bindings = a.graph.imports.filter("not lazy").select("project", F.explode("bindings").alias("name"))
    referenced = bindings.unionByName(a.facts.named("local_uses").select("project", "name")).unionByName(a.facts.named("module_used").select("project", "name")).unionByName(a.facts.named("dunder_all").select("project", "name")).distinct()
    touched = a.facts.named("attr_accessed").select("project", "name").distinct()
    classes = classes.join(referenced, ["project", "name"], "left_semi")
    ends = lambda c, among: F.exists(c, lambda x: N.last_segment(x).isin(among))
    classes = classes.withColumn("contract", ends("bases", INTERFACES) | ends("decorators", ["runtime_checkable"])).withColumn("container", ends("bases", CONTAINERS) | ends("decorators", CONTAINER_MARKS))
    m = classes.filter(F.col("is_enum") | ~F.col("contract")).select(*FILE, F.col("ord").alias("class_ord"), F.col("name").alias("class"), "is_enum", "container", F.posexplode("members").alias("at", "m"))
    m = m.select(*FILE, "class_ord", "class", "is_enum", "container", "at", "m.*").filter("not (is_enum and is_method)").withColumn("nth", occurrence([*FILE, "class", "name"], ["class_ord", "at"]))
    m = m.filter(~N.is_dunder(F.col("name")) & (F.col("name") != "_") & ~(F.col("is_enum") & F.col("name").isin(MACHINERY)))
    exempt = F.exists("decorators", lambda d: N.last_segment(d).isin(EXEMPT)) | N.is_handler(F.col("decorators"))
    m = m.filter(F.col("is_enum") | F.when(F.col("is_method"), ~exempt).otherwise(~F.col("container"))).join(touched, ["project", "name"], "left_anti")
    m = _flag(m, referenced, ["project", "name"], "mentioned").filter("is_enum or is_method or not mentioned").join(a.facts.dynamic, "project")
    word = F.when(F.col("is_enum"), "enum-member").when(F.col("is_method"), "method").otherwise("attribute")
    confidence = F.when(F.col("private") & ~F.col("global_dynamic"), "likely").otherwise("uncertain")
    return draft(
        m, F.concat(F.lit("unused-"), word), "dead-code", confidence, text("nothing reads `{}.{}`", "class", "name"), ["rel", "class", "name", "nth"], F.concat(F.lit("remove-"), word),
        text("Remove `{}.{}` unless something outside needs it", "class", "name"), end_line=F.col("end_line"),
    )


def commented_code(a) -> DataFrame:
    """Comment lines that read like statements. A scan of lines, without Python."""
    c = a.facts.lines.withColumn("body", N.comment_body(F.col("text"))).filter(F.col("body").isNotNull() & N.looks_like_code(F.col("body")))
    c = c.withColumn("nth", occurrence([*FILE, "body"], ["line_no"]))
    return draft(c, "commented-code", "dead-code", "likely", text("a comment that looks like code: {}", F.substring("body", 1, 60)), ["rel", "body", "nth"], "remove-comment", F.lit("Remove it, or restore the code"), line="line_no")


def cold_code(a) -> DataFrame | None:
    """Functions of covered files none of whose lines ran; the def line itself doesn't count. a.coverage: (project, key, line)."""
    if a.coverage is None:
        return None
    keys = closest_key(a.facts.records, "rel", a.coverage, "key")
    f = a.facts.listed("functions").withColumn("nth", occurrence([*FILE, "name"], ["ord"])).join(keys, FILE).withColumnRenamed("line", "first")
    begin = F.when(F.col("first") >= F.col("end_line"), F.col("first")).otherwise(F.col("first") + 1)
    cold = unexecuted(f, a.coverage, ["project", "key"], begin, F.greatest("first", "end_line")).withColumnRenamed("first", "line")
    return draft(cold, "cold-code", "dead-code", "likely", text("`{}` didn't run under coverage", "name"), ["rel", "name", "nth"], "review-function", text("Test `{}`, or remove it", "name"), end_line=F.col("end_line"))
