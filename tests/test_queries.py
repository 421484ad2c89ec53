"""Every query that has SQL against DuckDB, and the analyzer's against values typed by hand, at the least scale."""

import math

import duckdb
import pytest

from tessera.plans import analyzer, kernels, planted

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    show = lambda x: "" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", [*kernels.QUERIES, *planted.QUERIES, "audit_golden", "metrics_golden", "audit_score", "import_graph", "fix_plan", "trace_module", "rule_circular_dependency", "rule_untyped_function", "rule_vulnerable_dependency", "engine_panic", "env_findings"])
def test_query(spark, con, name):
    f, sql = {**kernels.QUERIES, **planted.QUERIES, **analyzer.QUERIES}[name], {**kernels.ORACLES, **planted.ORACLES, **analyzer.ORACLES}[name]
    got, want = f(spark, SF).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(want) or name in ("forbidden_pairs", "package_census", "secret_like_text")  # the least scale has no such rows; 0.01 has


def test_every_rule_has_its_rows(spark):
    from pyspark.sql import functions as F

    from tessera.operators.rules import AUDIT

    got = analyzer.engine(spark, "lab").findings([*AUDIT, "coverage"]).select("rule", F.col("location.path"), F.col("location.line"), "confidence").collect()
    want = sorted((rule, *r) for rule, (_, rs) in analyzer.EXPECTED.items() for r in rs)
    assert sorted(tuple(r) for r in got) == want


def test_lcom_star_parts_rows_by_their_number(spark, tmp_path, monkeypatch):
    """More rows give more parts, not larger ones; no row is expanded; nulls count as in SQL."""
    rows = [(s, p, n) for s in (1, 2, None) for p in (1, 2, 3, None) for n in (1, 2, None) if (s or 0) + (p or 0) + (n or 0) != 5]
    spark.createDataFrame(rows * 2, "l_suppkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(kernels, "TASK_ROWS", 10, raising=False)
    got = kernels.lcom_star(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and f", {-(-len(rows) * 2 // 10)}" in plan.split("RepartitionByExpression")[1].splitlines()[0]
    c = duckdb.connect()
    c.execute("create table lineitem (l_suppkey bigint, l_partkey bigint, l_linenumber integer)")
    c.executemany("insert into lineitem values (?, ?, ?)", rows * 2)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, c.execute(kernels.ORACLES["lcom_star"]).fetchall()))
