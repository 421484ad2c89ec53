"""Temporal URL filter: dated list entries become validity intervals, captures join as of their fetch.

An entry (list, pattern, action, day) adds a pattern to a list or removes it from a day on. A pattern
is a domain, which covers its subdomains, or a host with a leading path, cut at a slash. Per list and
pattern the entries in order of day make intervals [day, next entry's day); those of an add are
active. A capture is blocked if an interval active on the day of its fetch has one of its keys: its
host's suffixes by label, and its host with each leading path.

Defined results: a capture without a readable host, or without a fetch day, is not blocked; of
entries of one list, pattern and day an add prevails; repeated entries count once; entries with a
null part are dropped; the answer names the longest matching pattern, then the first list; rows
repeat as they come; empty tables give empty or unblocked results. Only the named columns are
read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

_AUTHORITY = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?"

#: The list that the query applies: the tables of this repository's driver hold none of their own.
ENTRIES = [
    ("spam", "spam-farm.example.org", "add", "2023-02-01"), ("spam", "spam-farm.example.org", "remove", "2023-09-15"), ("spam", "spam-farm.example.org", "add", "2024-03-01"),
    ("spam", "cheap-pills.example.com", "add", "2023-01-15"), ("spam", "cheap-pills.example.com", "remove", "2024-06-30"),
    ("malware", "www.cheap-pills.example.com/en", "add", "2024-07-01"), ("malware", "example.net", "add", "2023-06-01"), ("malware", "example.net", "remove", "2023-06-20"),
    ("optout", "example.org/fr", "add", "2023-01-01"), ("optout", "thther.example.org/fr", "add", "2023-04-01"), ("optout", "thther.example.org/en", "add", "2023-10-01"),
    ("optout", "thther.example.org/en", "remove", "2023-10-01"), ("optout", "therti.example.org", "add", "2024-01-01"),
]

#: Names that the longer list holds under each domain of the table.
BAD = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")


def host(url: Column) -> Column:
    """Lower-case host without user, port or closing dot; '' where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), _AUTHORITY + r"([^/:?#]*)", 1), r"\.+$", "")


def path(url: Column) -> Column:
    """The parts of the path that aren't empty."""
    return F.filter(F.split(F.regexp_extract(url, r"(?i)" + _AUTHORITY + r"[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")


def keys(url: Column) -> Column:
    """Every pattern that covers the URL."""
    name = host(url)
    labels = F.split(name, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = path(url)
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_union(suffixes, F.when(F.size(parts) > 0, paths).otherwise(F.array().cast("array<string>"))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to) of the adds; valid_to is null while an entry still holds."""
    name = F.substring_index("pattern", "/", 1)  # only the host's case is without meaning
    pattern = F.concat(F.lower(name), F.substring(F.col("pattern"), F.length(name) + 1, F.length("pattern")))
    clean = entries.select("list", pattern.alias("pattern"), "action", F.col("day").cast("date").alias("day")).dropna()
    days = clean.groupBy("list", "pattern", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("active"))
    order = Window.partitionBy("list", "pattern").orderBy("day")
    return days.withColumn("valid_to", F.lead("day").over(order)).filter("active = 1").select("list", "pattern", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """(id, url, fetched, blocked, list, pattern) for each capture.

    The join is on the key alone, with the interval as residue, so Spark may broadcast the list where
    its size allows it and shuffle by key where not. Captures themselves aren't shuffled before it; repeated
    ones meet in the grouping of the hits. Only hits are grouped and joined back.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("fetched"))
    asked = rows.filter(F.col("fetched").isNotNull()).select("id", "url", "fetched", F.explode(keys(F.col("url"))).alias("pattern"))
    spans = intervals(entries)
    hits = asked.join(spans, (asked.pattern == spans.pattern) & (asked.fetched >= spans.valid_from) & (spans.valid_to.isNull() | (asked.fetched < spans.valid_to))).select("id", "url", "fetched", spans.pattern, "list")
    best = hits.select(F.col("id").alias("h_id"), F.col("url").alias("h_url"), F.col("fetched").alias("h_day"), "pattern", "list").groupBy("h_id", "h_url", "h_day").agg(F.min(F.struct((-F.length("pattern")).alias("length"), "pattern", "list")).alias("m"))
    same = F.col("id").eqNullSafe(F.col("h_id")) & (F.col("url") == F.col("h_url")) & (F.col("fetched") == F.col("h_day"))
    out = rows.join(best, same, "left").select("id", "url", "fetched", F.col("m").isNotNull().cast("int").alias("blocked"), F.col("m.list").alias("list"), F.col("m.pattern").alias("pattern"))
    return out.withColumnsRenamed({"id": id_col, "url": url_col, "fetched": day_col})


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch day of their own: it is taken to be page_id days (of two years) after 2023-01-01."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") % 730).cast("int")).alias("fetched"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_captures(_fetched(spark, sf_dir), spark.createDataFrame(ENTRIES, "list string, pattern string, action string, day string"))


def listed(captures: DataFrame, url_col: str = "url") -> DataFrame:
    """Entries (list, pattern, action, day) over all hosts and paths of the captures, so that the list grows with them.

    By the MD5 of the pattern: an eighth of the hosts and of the hosts with one part of a path, a sixteenth
    of those with two. Besides, BAD names under each domain of the table. Each is added on a day of its own;
    half are removed later, and a quarter of all are removed and added again.
    """
    rows = captures.select(host(F.col(url_col)).alias("name"), path(F.col(url_col)).alias("parts")).filter("name <> ''")
    upto = lambda n: F.when(F.size("parts") >= n, F.concat_ws("/", "name", F.slice("parts", 1, n)))
    entry = lambda name, pattern, share: F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(share).alias("share"))
    found = rows.select(F.explode(F.array(entry("optout", F.col("name"), 2), entry("optout", upto(1), 2), entry("malware", upto(2), 1))).alias("e")).select("e.*").dropna()
    domains = rows.select(F.slice(F.split("name", r"\."), -2, 2).alias("d")).filter(F.size("d") == 2).distinct()
    bad = domains.select(F.lit("spam").alias("list"), F.explode(F.array(*map(F.lit, BAD))).alias("bad"), "d").select("list", F.concat_ws(".", "bad", "d").alias("pattern"), F.lit(16).alias("share"))
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("pattern"), k, 1)) - 1
    chosen = found.filter(digit(1) < F.col("share")).distinct().union(bad)
    begin = F.date_add(F.lit("2022-07-01").cast("date"), 16 * digit(2) + digit(3))
    end = F.date_add(begin, 90 + 32 * digit(4))
    change = lambda action, day, when: F.when(when, F.struct(F.lit(action).alias("action"), day.alias("day")))
    changes = F.array(change("add", begin, F.lit(True)), change("remove", end, digit(5) < 8), change("add", F.date_add(end, 60), digit(5) < 4))
    return chosen.select("list", "pattern", F.explode(changes).alias("c")).filter("c is not null").select("list", "pattern", "c.action", "c.day")


def op9_url_filter_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _fetched(spark, sf_dir)
    return filter_captures(pages, listed(pages))


OP9_SQL = f"""
WITH entries(list, pattern, action, day) AS (VALUES {", ".join(str(e) for e in ENTRIES)}),
days AS (SELECT list, pattern, day::DATE AS day, max(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS active FROM entries GROUP BY ALL),
spans AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to FROM days) WHERE active = 1),
caps AS (SELECT page_id, url, DATE '2023-01-01' + (page_id % 730)::INTEGER AS fetched,
  string_split(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)', 1), '.') AS labels,
  list_filter(string_split(regexp_extract(url, '(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM pages),
keyed AS (SELECT page_id, url, fetched, unnest(list_concat(
  list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')),
  list_transform(range(1, len(parts) + 1), lambda i: array_to_string(labels, '.') || '/' || array_to_string(parts[:i], '/')))) AS pattern FROM caps),
hits AS (SELECT k.page_id, k.pattern, s.list, row_number() OVER (PARTITION BY k.page_id ORDER BY length(k.pattern) DESC, k.pattern, s.list) AS r
  FROM keyed k JOIN spans s ON k.pattern = s.pattern AND k.fetched >= s.day AND (s.valid_to IS NULL OR k.fetched < s.valid_to))
SELECT c.page_id, c.url, c.fetched, CASE WHEN h.pattern IS NULL THEN 0 ELSE 1 END AS blocked, h.list, h.pattern FROM caps c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1
"""

#: The longer list in SQL; what is done with it is what OP9_SQL does.
OP9_LISTED_SQL = f"""
WITH split AS (SELECT regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)', 1) AS name,
  list_filter(string_split(regexp_extract(url, '(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM pages),
found AS (SELECT 'optout' AS list, name AS pattern, 2 AS share FROM split
  UNION SELECT 'optout', name || '/' || parts[1], 2 FROM split WHERE len(parts) >= 1
  UNION SELECT 'malware', name || '/' || parts[1] || '/' || parts[2], 1 FROM split WHERE len(parts) >= 2
  UNION SELECT 'spam', bad || '.' || array_to_string(string_split(name, '.')[-2:], '.'), 16 FROM split, (VALUES {", ".join(f"('{b}')" for b in BAD)}) b(bad)),
digits AS (SELECT *, list_transform(range(1, 6), lambda k: instr('0123456789abcdef', md5(pattern)[k]) - 1) AS x FROM found),
chosen AS (SELECT list, pattern, x, DATE '2022-07-01' + (16 * x[2] + x[3])::INTEGER AS first, DATE '2022-07-01' + (16 * x[2] + x[3] + 90 + 32 * x[4])::INTEGER AS last FROM digits WHERE x[1] < share),
entries AS (SELECT list, pattern, 'add' AS action, first AS day FROM chosen UNION ALL SELECT list, pattern, 'remove', last FROM chosen WHERE x[5] < 8 UNION ALL SELECT list, pattern, 'add', last + 60 FROM chosen WHERE x[5] < 4),
{OP9_SQL[OP9_SQL.index("days AS"):]}"""
