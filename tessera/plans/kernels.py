"""Kernel queries: the library's operators on the driver's tables, each with SQL of its own.

They show the operators at work on data of any size; what they compute isn't code analysis.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.identity import occurrence
from ..functions.versions import parsed_spec, parsed_version, satisfies, specs_intersect
from ..operators import findings as Fi
from ..operators import relations as R
from ..operators.clones import repeated
from ..operators.graph import reach
from ..operators.rules import architecture
from ..scratch import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORD = r"\S+"
TASK_ROWS = 500_000  # rows that one task makes distinct


def kernel(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(docs: DataFrame, pattern: str = WORD) -> DataFrame:
    return docs.select("doc_id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("words"))


@kernel(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, w[i:i + 39] AS gram FROM t, unnest(generate_series(1, len(w) - 39)) AS u(i)),
r AS (SELECT gram, count(*) AS members, count(DISTINCT doc_id) AS docs, min({'d': doc_id, 'p': pos}) AS first FROM g GROUP BY gram HAVING count(*) > 1)
SELECT first.d AS doc_id, CAST(first.p AS INTEGER) AS pos, members, docs FROM r""")
def clone_kgrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 40 words that occur more than once: the first place, how often, in how many documents."""
    runs = repeated(_words(table(spark, sf_dir, "documents")), ["doc_id"], "words", 40)
    per = runs.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    out = per.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.sum("n").alias("members"), F.count("*").alias("docs")).filter("members > 1")
    return out.select("first.doc_id", "first.pos", "members", "docs")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


@kernel(f"""WITH l AS ({_LINES}), k AS (SELECT doc_id, regexp_replace(line, '^\\s+', '') AS t FROM l)
SELECT doc_id, count(*) AS loc, count(*) FILTER (t = '') AS blank, count(*) FILTER (starts_with(t, '#')) AS comment FROM k GROUP BY doc_id""")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document by kind."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    kinds = lines.select("doc_id", N.line_kind(F.col("line")).alias("kind"))
    return kinds.groupBy("doc_id").agg(F.count("*").alias("loc"), F.count_if(F.col("kind") == "blank").alias("blank"), F.count_if(F.col("kind") == "comment").alias("comment"))


@kernel(f"WITH l AS ({_LINES}) SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE line <> '' GROUP BY line HAVING count(*) > 1")
def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur more than once. Partial counts by document keep hot lines small."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return R.repeats(lines, "line", "doc_id").withColumnRenamed("owners", "docs")


_NAME = r"[A-Za-z_][A-Za-z0-9_]*"


@kernel(f"SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_NAME}')) AS name FROM documents) GROUP BY name")
def name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each identifier-like word occurs."""
    return _words(table(spark, sf_dir, "documents"), _NAME).select(F.explode("words").alias("name")).transform(R.frequencies, "name")


@kernel(r"""SELECT doc_id, round(CASE WHEN len(list_distinct(w)) > 1 THEN len(w) * log2(len(list_distinct(w))) ELSE 0 END, 4) AS volume
FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)""")
def halstead_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length times the logarithm of the vocabulary, of each document's words."""
    return _words(table(spark, sf_dir, "documents")).select("doc_id", F.round(N.halstead_volume(F.col("words")), 4).alias("volume"))


@kernel("""SELECT p_partkey, round(m, 4) AS mi, CASE WHEN m >= 20 THEN 'A' WHEN m >= 10 THEN 'B' ELSE 'C' END AS rank FROM (
SELECT p_partkey, least(greatest((171 - 5.2 * ln(greatest(p_retailprice, 1)) - 0.23 * greatest(p_size, 1) - 16.2 * ln(greatest(length(p_name), 1))) * 100 / 171, 0), 100) AS m FROM part)""")
def mi_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maintainability formula over three numbers of a part."""
    mi = N.maintainability(F.col("p_retailprice"), F.col("p_size"), F.length("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(mi, 4).alias("mi"), N.maintainability_rank(mi).alias("rank"))


@kernel("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS VARCHAR) AS nth FROM events")
def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's number among those of its user and type."""
    return table(spark, sf_dir, "events").select("event_id", occurrence(["user_id", "event_type"], ["ts", "event_id"]).alias("nth"))


@kernel("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, first FROM (SELECT *, first_value(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS first FROM lineitem) WHERE l_suppkey <> first""")
def first_source_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose supplier isn't the first that shipped the part."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return R.conflicts(table(spark, sf_dir, "lineitem").select(*keys, "l_shipdate"), ["l_partkey"], "l_suppkey", ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]).select(*keys, "first")


_GRAPH = """e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey),
r AS (SELECT CAST(p_partkey AS BIGINT) AS node FROM part WHERE p_size = 1 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)"""


def _part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges from each line of an order to the later ones; seeds are the parts of size 1."""
    line = table(spark, sf_dir, "lineitem")
    a = line.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_linenumber").alias("i"))
    b = line.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("j"))
    edges = a.join(b, "l_orderkey").filter("i < j and src <> dst").select("src", "dst").distinct()
    return edges, table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("node"))


@kernel(f"WITH RECURSIVE {_GRAPH} SELECT node FROM r")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, seeds = _part_graph(spark, sf_dir)
    work = Workspace(spark, "reachable")
    return reach(work.keep(edges, "edges"), seeds, [], work)


@kernel(f"WITH RECURSIVE {_GRAPH} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM r)")
def unreachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")).join(reachable(spark, sf_dir), "node", "left_anti")


_TRADE = """SELECT DISTINCT s.s_nationkey AS src, c.c_nationkey AS dst FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey"""


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) nations of supplier and customer. Keys are reduced before each join's output grows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")  # noqa: E741
    return l.join(s, "l_suppkey").join(o.join(c, "o_custkey"), "o_orderkey").select("src", "dst").distinct()


@kernel(f"WITH t AS ({_TRADE}) SELECT src, dst, a.n_regionkey AS low, b.n_regionkey AS high FROM t JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE b.n_regionkey < a.n_regionkey")
def layer_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade edges into a region of lower rank; a nation's dotted name begins with its region, and regions are the layers."""
    n = table(spark, sf_dir, "nation").withColumn("name", F.format_string("region%d.nation%d", "n_regionkey", "n_nationkey"))
    a, b = n.select(F.col("n_nationkey").alias("src"), F.col("name").alias("importer")), n.select(F.col("n_nationkey").alias("dst"), F.col("name").alias("imported"))
    order = [f"region{k}" for k in range(5)]
    return architecture.upward(_trade(spark, sf_dir).join(a, "src").join(b, "dst"), order).select("src", "dst", F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"))


@kernel(f"""WITH t AS (SELECT 'NATION.' || src AS importer, 'NATION.' || dst AS imported FROM ({_TRADE}))
SELECT importer, imported FROM t WHERE (importer = 'NATION.1' OR starts_with(importer, 'NATION.1.')) AND imported IN ('NATION.2', 'NATION.3')""")
def forbidden_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that a contract from one prefix to others forbids."""
    t = _trade(spark, sf_dir).select(*[F.concat(F.lit("NATION."), F.col(c).cast("string")).alias(n) for c, n in (("src", "importer"), ("dst", "imported"))])
    return architecture.forbidden(t, "NATION.1", ["NATION.2", "NATION.3"])


@kernel("""SELECT p_partkey, ban FROM part JOIN (VALUES ('red'), ('small'), ('red.ring')) AS b(ban) ON replace(p_name, ' ', '.') = ban OR starts_with(replace(p_name, ' ', '.'), ban || '.')""")
def prefix_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that policies ban by a dotted prefix of their name."""
    bans = spark.createDataFrame([("red",), ("small",), ("red.ring",)], "ban string")
    p = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", " ", ".").alias("name"))
    return p.join(F.broadcast(bans), N.under(F.col("name"), F.col("ban"))).select("p_partkey", "ban")  # three rows


_INSIDE = """SELECT e.event_id, w.event_id AS window_id, w.ts AS begin FROM events e JOIN events w ON e.user_id = w.user_id
AND w.event_type = 'error' AND e.event_type <> 'error' AND e.ts >= w.ts AND e.ts < w.ts + INTERVAL 6 HOUR"""


def _inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events within six hours after an error of their user: the user is the hash key, the range a residue."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    w = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("window_id"), F.col("ts").alias("begin"), F.expr("ts + interval 6 hours - interval 1 microsecond").alias("finish"))
    return R.enclosing(e.filter("event_type <> 'error'"), w, ["user_id"], "ts", "begin", "finish").select("event_id", "window_id", "begin")


@kernel(f"SELECT event_id, window_id FROM ({_INSIDE})")
def interval_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inside(spark, sf_dir).select("event_id", "window_id")


@kernel(f"SELECT event_id FROM events WHERE event_type <> 'error' AND event_id NOT IN (SELECT event_id FROM ({_INSIDE}))")
def interval_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside of all such windows."""
    return table(spark, sf_dir, "events").filter("event_type <> 'error'").select("event_id").join(_inside(spark, sf_dir).select("event_id"), "event_id", "left_anti")


@kernel(f"SELECT event_id, window_id FROM ({_INSIDE}) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY begin DESC, window_id DESC) = 1")
def innermost_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that opened last around each event."""
    return R.innermost(_inside(spark, sf_dir), ["event_id"], ["begin", "window_id"], ["window_id"])


_FOUND = "SELECT c_mktsegment AS project, CAST(o_orderkey AS VARCHAR) AS fingerprint, o_orderpriority AS rule, o_orderstatus AS category FROM orders JOIN customer ON o_custkey = c_custkey"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings: the segment is the project, priority the rule, status the category."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    level = F.when(F.col("o_orderpriority").startswith("1"), "error").otherwise("warn")
    doubt = F.when(F.col("o_orderstatus") == "F", "certain").when(F.col("o_orderstatus") == "O", "likely").otherwise("uncertain")
    return o.select(
        F.col("c_mktsegment").alias("project"), F.col("o_orderkey").cast("string").alias("fingerprint"), F.col("o_orderpriority").alias("rule"), F.col("o_orderstatus").alias("category"), level.alias("severity"), doubt.alias("confidence"),
        F.lit(None).cast("string").alias("attribution"), F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), F.month("o_orderdate").alias("line")).alias("location"),
    )


@kernel("SELECT CAST(o_orderkey AS VARCHAR) AS fingerprint FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def baseline_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a baseline lacks."""
    known = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("fingerprint"))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("fingerprint"))
    return Fi.against_baseline(found, known)


@kernel("SELECT CAST(o_orderkey AS VARCHAR) AS fingerprint FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def baseline_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("fingerprint"))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("fingerprint"))
    return Fi.against_baseline(found, known, new=False)


@kernel(f"""WITH f AS (SELECT c_mktsegment AS project, o_orderkey, o_custkey, month(o_orderdate) AS line, o_orderpriority AS rule FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT CAST(o_orderkey AS VARCHAR) AS fingerprint FROM f WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = f.o_custkey AND c.c_nationkey = f.line AND (c.c_acctbal < 0 OR f.rule = '5-LOW'))""")
def suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings without those that an ignore of their path and line silences, by rule or wholly."""
    c = table(spark, sf_dir, "customer")
    ignores = c.select(F.col("c_mktsegment").alias("project"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("rel"), F.col("c_nationkey").alias("line"), F.when(F.col("c_acctbal") < 0, "*").otherwise("5-LOW").alias("rule"))
    return Fi.suppress(_found(spark, sf_dir), ignores).select("fingerprint")


@kernel(f"""SELECT fingerprint, severity FROM (SELECT fingerprint, CASE rule WHEN '5-LOW' THEN 'off' WHEN '2-HIGH' THEN 'error' ELSE
CASE category WHEN 'P' THEN 'error' ELSE CASE WHEN starts_with(rule, '1') THEN 'error' ELSE 'warn' END END END AS severity FROM ({_FOUND})) WHERE severity <> 'off'""")
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities by rule, then by category; what is off goes."""
    return Fi.configure(_found(spark, sf_dir), {"5-LOW": "off", "2-HIGH": "error", "P": "error"}, []).select("fingerprint", "severity")


@kernel(f"""WITH f AS (SELECT project, CASE WHEN starts_with(rule, '1') THEN 3.0 ELSE 1.0 END AS s, CASE category WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.15 END AS c FROM ({_FOUND})),
p AS (SELECT project, count(*) AS total, count(*) FILTER (s = 3) AS errors, count(*) FILTER (s = 1) AS warnings, sum(s * c) AS penalty FROM f GROUP BY project),
n AS (SELECT c_mktsegment AS project, count(*) AS files_analyzed FROM customer GROUP BY 1)
SELECT project, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, files_analyzed, CAST(0 AS BIGINT) AS introduced,
CAST(round(least(greatest(100 - 10 * coalesce(penalty, 0) / files_analyzed, 0), 100)) AS INTEGER) AS quality_score FROM n LEFT JOIN p USING (project)""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and score by project."""
    files = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("project"))
    return Fi.summary(_found(spark, sf_dir), files)


@kernel("""WITH c AS (SELECT c_nationkey AS top, count(*) AS total, count(*) FILTER (c_acctbal < 4000) AS untyped, min(c_custkey) AS anchor FROM customer GROUP BY 1)
SELECT top, total, untyped, anchor FROM c WHERE total >= 20 AND untyped >= 0.4 * total""")
def package_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of twenty or more, a share of which fails."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("top"), "c_acctbal", "c_custkey")
    anchor = c.groupBy("top").agg(F.min("c_custkey").alias("anchor"))
    return R.census(c, ["top"], F.col("c_acctbal") < 4000, 20, 0.4).filter("rolled").join(anchor, "top").drop("rolled")


@kernel("""WITH u AS (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber FROM lineitem),
a AS (SELECT l_suppkey, count(*) AS uses, count(DISTINCT l_linenumber) AS attributes, count(DISTINCT l_partkey) AS methods FROM u GROUP BY 1)
SELECT l_suppkey, round(CASE WHEN methods > 1 THEN least(greatest((uses / attributes - methods) / (1 - methods), 0), 1) ELSE 0 END, 6) AS lcom FROM a""")
def lcom_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lack of cohesion with suppliers as classes, parts as methods, line numbers as attributes.

    Rows are parted by class and method before they are made distinct, in as many parts as keep each small, so that a
    task's memory is the same for any size of the table; two counts of distinct values at once would expand every row.
    """
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-l.count() // TASK_ROWS))
    u = l.select("l_suppkey", "l_partkey", "l_linenumber").repartition(parts, "l_suppkey", "l_partkey").distinct()
    methods = u.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("uses")).select("l_suppkey", "uses", F.col("l_partkey").isNotNull().cast("long").alias("methods"), F.lit(0).cast("long").alias("attributes"))
    lines = l.select("l_suppkey", "l_linenumber").distinct().select("l_suppkey", F.lit(0).cast("long").alias("uses"), F.lit(0).cast("long").alias("methods"), F.col("l_linenumber").isNotNull().cast("long").alias("attributes"))
    a = methods.unionByName(lines).groupBy("l_suppkey").agg(*(F.sum(c).alias(c) for c in ("uses", "methods", "attributes")))
    return a.select("l_suppkey", F.round(N.lcom(F.col("uses"), F.col("attributes"), F.col("methods")), 6).alias("lcom"))


@kernel("""WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_custkey, count(*) AS churn, CAST(coalesce(sum(n), 0) AS BIGINT) AS complexity FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) >= 3 AND coalesce(sum(n), 0) >= 15""")
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with many orders of many lines; lines are counted before the join."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))  # noqa: E741
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(l, "o_orderkey", "left")
    size = o.groupBy("o_custkey").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("complexity"))
    churn = o.groupBy("o_custkey").agg(F.count("*").alias("commits"))
    return R.hot(size, churn, ["o_custkey"], 15, 3).withColumnRenamed("commits", "churn")


_PATH = r"^[a-z]+://[^/?#]*/?([^?#]*).*$"


@kernel(f"""WITH p AS (SELECT page_id, regexp_replace(url, '{_PATH}', '\\1') AS path FROM pages), k AS (SELECT DISTINCT path AS key FROM p WHERE contains(path, '/')),
q AS (SELECT page_id, string_split(path, '/')[-1] AS path FROM p)
SELECT q.page_id, q.path, min(k.key) AS key FROM q JOIN k ON string_split(k.key, '/')[-1] = q.path GROUP BY q.page_id, q.path""")
def fallback_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names matched with the least key that ends in them."""
    p = table(spark, sf_dir, "pages").select(F.lit("").alias("project"), "page_id", F.regexp_replace("url", _PATH, "$1").alias("path"))
    keys = p.filter(F.col("path").contains("/")).select("project", F.col("path").alias("key"))
    q = p.withColumn("path", F.element_at(F.split("path", "/"), -1))
    return q.join(Fi.closest_key(q, "path", keys, "key"), ["project", "path"]).select("page_id", "path", "key")


@kernel(r"SELECT p_partkey, trim(regexp_replace(lower(p_name || '__' || p_brand || '.' || p_type || '-'), '[-_.]+', '-', 'g'), '-') AS dist FROM part")
def normalize_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("__"), "p_brand", F.lit("."), "p_type", F.lit("-"))
    return table(spark, sf_dir, "part").select("p_partkey", N.normalize_dist(raw).alias("dist"))


@kernel(rf"""WITH p AS (SELECT page_id, 'src/' || regexp_replace(url, '{_PATH}', '\1') || CASE WHEN page_id % 2 = 0 THEN '/__init__.py' ELSE '.py' END AS rel FROM pages),
d AS (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(rel, '^src/', ''), '\.py$', ''), '/__init__$', ''), '/', '.') AS dotted FROM p)
SELECT page_id, dotted, array_to_string(list_concat(list_filter(string_split(dotted, '.'), lambda x: x <> '')[1:greatest(len(list_filter(string_split(dotted, '.'), lambda x: x <> '')) - CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END, 0)], ['util']), '.') AS target FROM d""")
def dotted_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as module names, and what `from . import util` would ask for there."""
    package = F.col("page_id") % 2 == 0
    rel = F.concat(F.lit("src/"), F.regexp_replace("url", _PATH, "$1"), F.when(package, "/__init__.py").otherwise(".py"))
    p = table(spark, sf_dir, "pages").select("page_id", N.dotted_name(rel).alias("dotted"), package.alias("package"))
    return p.select("page_id", "dotted", N.import_target(F.col("dotted"), F.col("package"), F.lit(1), F.lit("util")).alias("target"))


@kernel("""SELECT p_partkey, spec FROM (SELECT p_partkey, p_size AS a, CAST(floor(p_retailprice) AS INTEGER) AS b FROM part), (VALUES ('>=10,<12.1000'), ('~=20.900'), ('==7.*'), ('!=1.901')) AS s(spec)
WHERE (spec = '>=10,<12.1000' AND a >= 10 AND (a < 12 OR (a = 12 AND b < 1000))) OR (spec = '~=20.900' AND a = 20 AND b >= 900) OR (spec = '==7.*' AND a = 7) OR (spec = '!=1.901' AND NOT (a = 1 AND b = 901))""")
def advisory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version specs over versions made of two numbers."""
    specs = spark.createDataFrame([(">=10,<12.1000",), ("~=20.900",), ("==7.*",), ("!=1.901",)], "spec string")
    v = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", F.col("p_size").cast("string"), F.floor("p_retailprice").cast("string")).alias("version"))
    v, specs = v.select("p_partkey", parsed_version("version").alias("v")), specs.select("spec", parsed_spec("spec").alias("s"))
    return v.join(F.broadcast(specs), satisfies(F.col("v"), F.col("s"))).select("p_partkey", "spec")  # four rows


_RANGES = [(">=1,<2", ">=1.5", True), (">=1,<2", ">=2", False), (">2.0,<2.0.1", "<3", True), ("==1.4.*", "<1.4.9", True), ("<1.0", ">=1.0", False), ("", ">=9", True), ("~=2.2", "<2.3", True), ("~=2.2", ">=3", False)]


@kernel("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in _RANGES) + ") AS t(a, b, meets)")
def spec_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth table of ranges that share a version, typed by hand."""
    return spark.createDataFrame([r[:2] for r in _RANGES], "a string, b string").withColumn("meets", specs_intersect("a", "b"))


@kernel("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_extendedprice) = 1")
def contract_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each part and supplier, by an aggregate that combines before the shuffle."""
    keys, order = ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice"]
    return R.first_rows(table(spark, sf_dir, "lineitem").select(*keys, *order), keys, order).select(*keys, *order[:2])


@kernel("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')")
def cold_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a late order."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    ran = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), day(F.col("o_orderdate")).alias("line"))
    spans = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return R.unexecuted(spans, ran, ["c_custkey"], day(F.lit("2000-06-01").cast("date")), F.lit(2**31 - 1))


_SECRET = "(access_key|api_key|apikey|auth_token|passwd|password|private_key|secret|secret_key|token)"


@kernel(f"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '{_SECRET}')) AS INTEGER) AS n FROM documents WHERE regexp_matches(lower(text), '{_SECRET}')")
def secret_like_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that speak of credentials, and how often."""
    return table(spark, sf_dir, "documents").select("doc_id", N.secret_mentions(F.col("text")).alias("n")).filter("n > 0")


@kernel("SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations) WHERE before IS DISTINCT FROM role")
def adjacent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose role differs from that of the turn before."""
    return R.changes(table(spark, sf_dir, "conversations"), ["conv_id"], "role", ["turn", "role", "text"]).select("conv_id", "turn", "role")


@kernel("""SELECT e.event_id, CASE WHEN EXISTS (SELECT 1 FROM events h WHERE h.event_type = 'signup' AND h.user_id = e.user_id AND dayofmonth(e.ts) BETWEEN dayofmonth(h.ts) AND dayofmonth(h.ts) + 3) THEN 'introduced' ELSE 'inherited' END AS attribution FROM events e WHERE e.event_type = 'error'""")
def gate_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on changed lines: errors as findings, the three days from a signup as a user's changed lines."""
    e = table(spark, sf_dir, "events").select(F.lit("").alias("project"), "event_id", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.dayofmonth("ts").alias("line"))
    spans = e.filter("event_type = 'signup'").select("project", "path", F.col("line").alias("start"), (F.col("line") + 3).alias("end"))
    found = e.filter("event_type = 'error'").select("project", "event_id", F.struct("path", "line").alias("location"), F.lit(None).cast("string").alias("attribution"))
    return Fi.attribute(found, spans).select("event_id", "attribution")
