"""Analyzer queries: rules over the projects of `corpus`, held against literal rows.

They don't read the driver's tables. The fingerprints, score and metrics of the sample project are
published ones. The rows of EXPECTED were noted after a first run and then checked by hand, each
against the fixture's text and the rule's definition, so they guard against change more than they prove.
"""

from __future__ import annotations

import copy
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as Fi
from ..operators.rules import ENGINES
from ..sources import manifests
from .corpus import ENV, ENV_INSTALLED, LAB, LAB_ADVISORIES, LAB_CHURN, LAB_COVERAGE, SAMPLE
from .engine import SIDES, Engine

_engines: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, name: str) -> Engine:
    """The engine over a fixture, once for each application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _engines:
        if name == "sample":
            _engines[key] = Engine.over_files(spark, SAMPLE)
        elif name == "env":
            sides = {"advisories": spark.createDataFrame(manifests.advisories(LAB_ADVISORIES), SIDES["advisories"]), "installed": spark.createDataFrame([("", *r) for r in ENV_INSTALLED], SIDES["installed"])}
            _engines[key] = Engine.over_files(spark, ENV, sides=sides)
        else:
            sides = {
                "advisories": spark.createDataFrame(manifests.advisories(LAB_ADVISORIES), SIDES["advisories"]),
                "coverage": spark.createDataFrame([("", *r) for r in manifests.coverage(LAB_COVERAGE)], SIDES["coverage"]),
                "churn": spark.createDataFrame([("", *r) for r in LAB_CHURN], SIDES["churn"]),
            }
            _engines[key] = Engine.over_files(spark, LAB, sides=sides)
    return _engines[key]


GOLDEN = """circular-dependency:d297a057a059c6fb high-complexity:1cbe4ffa6ee8ed1d untyped-function:308c065e993ecff3 untyped-function:7058751ef9260e0f
untyped-function:a3c79d14005834f2 unused-dependency:262b99f436d498a8 unused-dependency:d4b9afaea73f6d0a unused-export:5024ab2f29d5cdeb unused-export:51b9d1bcc4e4ee5b
unused-export:b3454f8f0092acf5 unused-import:0e814590eab517ff unused-import:4de5ca3ebae02431 unused-import:5c1d3a12f0f0f698 unused-import:9a5e10483cc040fd
unused-variable:bced62ab9da79356 weak-hash:2fda8ae0463ffdee""".split()

M, R, V, K, P, D, T = "lab/core/model.py", "lab/core/rules.py", "lab/web/views.py", "lab/risks.py", "pyproject.toml", "lab/store/disk.py", "requirements.txt"
U, L, C = "uncertain", "likely", "certain"
#: rule -> (engine, [(path, line, confidence)]). eval in risks.py makes the whole project dynamic.
EXPECTED: dict[str, tuple[str, list[tuple[str, int, str]]]] = {
    "unused-file": ("dead-code", [("lab/orphan.py", 1, U), (K, 1, U)]),
    "unused-export": ("dead-code", [("lab/orphan.py", 1, U), *[(K, n, U) for n in (14, 16, 17, 19, 20, 21, 22, 24)], (D, 8, U)]),
    "unused-import": ("dead-code", [(R, 1, C)]),
    "unused-variable": ("dead-code", [(R, 12, L)]),
    "unused-parameter": ("dead-code", [(R, 11, U)]),
    "unreachable-code": ("dead-code", [(R, 15, C)]),
    "duplicate-export": ("dead-code", [("lab/__init__.py", 2, L)]),
    "unused-method": ("members", [(M, 33, U), (M, 39, U), (R, 7, U)]),
    "unused-enum-member": ("members", [(M, 17, U)]),
    "commented-code": ("commented", [(M, 47, L)]),
    "cold-code": ("coverage", [(R, 7, L), (R, 31, L)]),
    "unused-dependency": ("deps", [(P, 1, U), (P, 1, U)]),
    "missing-dependency": ("deps", [(P, 1, U)]),
    "misplaced-dev-dependency": ("deps", [(P, 1, U)]),
    "unresolved-import": ("deps", [(M, 8, L)]),
    "layer-violation": ("arch", [(M, 1, C)]),
    "forbidden-import": ("arch", [(M, 1, C)]),
    "independence-violation": ("arch", [(V, 1, C), (V, 1, C)]),
    "private-import": ("arch", [(M, 9, L)]),
    "no-pprint": ("arch", [(M, 2, C), (M, 44, C)]),
    "high-complexity": ("complexity", [(R, 11, C)]),
    "hotspot": ("hotspots", [(R, 1, L)]),
    "low-cohesion": ("cohesion", [(M, 48, U)]),
    "duplication": ("dupes", [(R, 31, L)]),
    "untyped-function": ("types", [(M, 26, L), (M, 33, L), (R, 7, L), (R, 11, L)]),
    "private-type-leak": ("types", [(M, 43, L)]),
    "hardcoded-secret": ("security", [(K, 14, L)]),
    "dangerous-eval": ("security", [(K, 15, U)]),
    "unsafe-yaml-load": ("security", [(K, 16, L)]),
    "unsafe-deserialization": ("security", [(K, 17, U)]),
    "subprocess-shell-true": ("security", [(K, 18, L)]),
    "tls-verify-disabled": ("security", [(K, 19, L)]),
    "weak-hash": ("security", [(K, 20, L)]),
    "weak-cipher": ("security", [(K, 12, L)]),
    "insecure-random": ("security", [(K, 22, U)]),
    "sql-injection": ("security", [(K, 23, U)]),
    "request-without-timeout": ("security", [(K, 24, U)]),
    "jinja2-autoescape-false": ("security", [(K, 25, L)]),
    "flask-debug-true": ("security", [(K, 26, L)]),
    "try-except-pass": ("security", [(K, 29, U)]),
    "vulnerable-dependency": ("supply-chain", [(P, 1, U), (P, 1, U), (P, 1, U), (T, 2, C)]),
}


def values(rows: list[tuple], names: str) -> str:
    quoted = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({names})"


def _rule(rule: str, owner: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = engine(spark, "lab").findings([owner]).filter(F.col("rule") == rule)
        return found.select(F.col("location.path").alias("path"), F.col("location.line").alias("line"), "confidence")

    return query


def audit_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all findings on the sample project."""
    return engine(spark, "sample").audit().select("fingerprint")


def audit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, "sample")
    return e.score(e.audit()).drop("project")


def metrics_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = engine(spark, "sample").metrics()
    return m.select("rel", F.round("maintainability_index", 1).alias("mi"), "max_cyclomatic", "total_cyclomatic", "sloc")


def import_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "sample").import_edges().select("importer", "imported")


def engine_panic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One engine whose rule fails while it runs, beside one that doesn't: the finding that says so, and the other's."""
    broken = lambda a: Fi.draft(a.graph.modules, "none", "none", "likely", F.raise_error(F.lit("broken on purpose")).cast("string"), ["rel"], "none", F.lit(""), line=F.lit(1))
    e = copy.copy(engine(spark, "lab"))
    e.engines = ENGINES | {"broken": ("none", [broken])}
    return e.findings(["broken", "commented"]).select("rule", F.col("location.path").alias("path"), F.col("location.line").alias("line"), "severity")


def env_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies by what is installed, suppressed imports, and a package whose functions are reported as one."""
    found = engine(spark, "env").findings(["deps", "supply-chain", "types", "dead-code"]).filter("rule not in ('unused-export', 'unused-file')")
    return found.select("rule", F.col("location.path").alias("path"), F.col("location.line").alias("line"), "confidence")


def trace_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, "lab").trace("model")
    return t.select("module", F.array_join("imports", " ").alias("imports"), F.array_join("imported_by", " ").alias("imported_by"))


def fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, "lab").fix_plan().select("path", "start_line", "end_line")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"rule_" + r.replace("-", "_"): _rule(r, e) for r, (e, _) in EXPECTED.items()}
QUERIES |= {f.__name__: f for f in (audit_golden, audit_score, metrics_golden, import_graph, engine_panic, env_findings, trace_module, fix_plan)}
QUERIES["rule_circular_dependency"] = lambda spark, sf_dir: engine(spark, "sample").findings(["circular"]).select(F.col("location.path").alias("path"), F.col("location.line").alias("line"), "confidence")

ORACLES = {"rule_" + r.replace("-", "_"): values(rows, "path, line, confidence") for r, (_, rows) in EXPECTED.items()}
ORACLES |= {
    "rule_circular_dependency": values([("billing/services/invoice.py", 1, C)], "path, line, confidence"),
    "audit_golden": values([(g,) for g in GOLDEN], "fingerprint"),
    "audit_score": "SELECT CAST(16 AS BIGINT) AS total, CAST(0 AS BIGINT) AS errors, CAST(16 AS BIGINT) AS warnings, CAST(7 AS BIGINT) AS files_analyzed, CAST(0 AS BIGINT) AS introduced, 84 AS quality_score",
    "metrics_golden": "SELECT rel, CAST(mi AS DOUBLE) AS mi, m AS max_cyclomatic, CAST(t AS BIGINT) AS total_cyclomatic, CAST(s AS BIGINT) AS sloc FROM ("
    + values([("billing/__init__.py", 99.9, 0, 0, 1), ("billing/domain/__init__.py", 99.9, 0, 0, 1), ("billing/services/__init__.py", 99.9, 0, 0, 1), ("billing/app.py", 56.0, 1, 3, 14), ("billing/domain/money.py", 77.1, 1, 1, 3), ("billing/services/invoice.py", 57.1, 7, 7, 12), ("billing/services/ledger.py", 76.4, 1, 1, 3)], "rel, mi, m, t, s") + ")",
    "import_graph": values([("billing.app", "billing.domain.money"), ("billing.app", "billing.services.invoice"), ("billing.services.invoice", "billing.domain.money"), ("billing.services.invoice", "billing.services"), ("billing.services.invoice", "billing.services.ledger"), ("billing.services.ledger", "billing.services.invoice")], "importer, imported"),
    "engine_panic": values([("engine-panic", "lab/__init__.py", 1, "error"), ("commented-code", M, 47, "warn")], "rule, path, line, severity"),
    # attrs is installed but not declared; numpy 1.21.2 lies within ADV-2, whatever its range; json and os are silenced, re isn't.
    "env_findings": values([("transitive-dependency", P, 1, L), ("vulnerable-dependency", P, 1, C), ("unused-import", "bulk/start.py", 6, C), ("untyped-function", "bulk/__init__.py", 1, L), *[("untyped-function", "bulk/many.py", 1 + 4 * k, U) for k in range(21)]], "rule, path, line, confidence"),
    "trace_module": values([("lab.core.model", "lab.store.disk lab.web.views other._impl", "lab lab.cli lab.core.rules")], "module, imports, imported_by"),
    "fix_plan": values([(R, 1, 1)], "path, start_line, end_line"),
}
