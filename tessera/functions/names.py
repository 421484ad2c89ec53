"""Names and paths as column expressions: modules, path classes, distributions, lines, measures."""

from __future__ import annotations

import re
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.security import SECRET_WORDS

DEV_FOLDERS = "benchmarks doc docs example examples".split()
FIXTURE_FOLDERS = "_vendor data extern fixtures golden snapshots test_data testdata third_party thirdparty vendor vendored".split()
#: Last parts of decorators that hand a definition to a framework.
HANDLER_MARKS = sorted(
    "action actor admin after_request before_request callback command computed_field delete dispatch display errorhandler event exception_handler"
    " field_serializer field_validator filter fixture get group handler head hook hookimpl implementer inclusion_tag listener middleware model_serializer"
    " model_validator on_event on_message options patch periodic_task plugin post provides put receiver register root_validator route rule scheduled_job"
    " setup shared_task simple_tag subscribe task teardown validator websocket websocket_route".split()
)
ALIASES = dict(
    pair.split(":")
    for pair in "Crypto:pycryptodome MySQLdb:mysqlclient OpenSSL:pyopenssl PIL:pillow attr:attrs bs4:beautifulsoup4 cv2:opencv-python dateutil:python-dateutil"
    " docx:python-docx dotenv:python-dotenv git:gitpython jose:python-jose jwt:pyjwt pptx:python-pptx psycopg2:psycopg2-binary serial:pyserial sklearn:scikit-learn yaml:pyyaml".split()
)
NAMESPACES = ["azure", "backports", "google", "zope"]
#: Modules of the standard library, those that later versions dropped included.
STANDARD = sorted(
    set(sys.stdlib_module_names)
    | set("aifc asynchat asyncore audioop binhex cgi cgitb chunk crypt distutils formatter imghdr imp lib2to3 mailcap msilib nis nntplib ossaudiodev parser pipes smtpd sndhdr spwd sunau symbol telnetlib uu xdrlib".split())
)
DIRECTIVES = "! fixme flake8 hack isort mypy nosec noqa note pragma pylint pyright ruff tessera todo type: xxx".split()
OPENERS = ["assert ", "async ", "await ", "class ", "def ", "del ", "elif ", "else:", "except", "finally:", "for ", "from ", "if ", "import ", "lambda ", "print(", "raise ", "return", "try:", "while ", "with ", "yield "]


def any_of(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, r"\."), -1)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def dotted_name(rel: Column) -> Column:
    """a/b/__init__.py -> a.b; a leading src/ goes, the root package is ''."""
    bare = F.regexp_replace(F.regexp_replace(slashes(rel), r"^src/", ""), r"\.py$", "")
    return F.translate(F.when(bare == "__init__", "").otherwise(F.regexp_replace(bare, r"/__init__$", "")), "/", ".")


def is_package(rel: Column) -> Column:
    return file_name(rel) == "__init__.py"


def is_entry(rel: Column, main_guard: Column) -> Column:
    """Files that something outside of the project runs or loads."""
    name = file_name(rel)
    return name.isin("__init__.py", "__main__.py", "conftest.py", "setup.py") | name.startswith("test_") | name.endswith("_test.py") | name.endswith(".ipynb") | main_guard


def within(rel: Column, folders: list[str]) -> Column:
    alternatives = "|".join(f.strip("/").replace(".", r"\.") for f in folders if f.strip("/"))
    return slashes(rel).rlike(f"(^|/)({alternatives})/") if alternatives else F.lit(False)


def is_test(rel: Column, testpaths: list[str] = ()) -> Column:
    name = file_name(rel)
    return within(rel, ["test", "tests", *testpaths]) | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")


def is_dev(rel: Column, testpaths: list[str] = ()) -> Column:
    return is_test(rel, testpaths) | within(rel, DEV_FOLDERS)


def is_fixture(rel: Column) -> Column:
    return within(rel, FIXTURE_FOLDERS)


def is_dunder(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__")


def is_handler(decorators: Column) -> Column:
    return F.exists(decorators, lambda d: last_segment(d).isin(HANDLER_MARKS))


def normalize_dist(name: Column) -> Column:
    """PEP 503: lower case, runs of - _ . as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[-_.]+", "-"), r"^-+|-+$", "")


def candidate_dists(module: Column) -> Column:
    """Distributions that may provide an import, the likeliest first."""
    parts = F.split(module, r"\.")
    top = parts[0]
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    first = normalize_dist(F.coalesce(F.try_element_at(alias, top), top))
    dashed = [F.when(F.size(parts) >= n, normalize_dist(F.array_join(F.slice(parts, 1, n), "-"))) for n in (2, 3)]
    return F.array_distinct(F.array_compact(F.array(first, normalize_dist(top), *dashed)))


def import_target(dotted: Column, package: Column, dots: Column, module: Column) -> Column:
    """The dotted name that an import asks for, relative ones resolved against the importer."""
    parts = F.filter(F.split(dotted, r"\."), lambda p: p != "")
    up = F.when(package, dots - 1).otherwise(dots)
    base = F.slice(parts, 1, F.greatest(F.size(parts) - up, F.lit(0)))
    return F.when(dots == 0, module).otherwise(F.concat_ws(".", F.filter(F.concat(base, F.array(module)), lambda p: p != "")))


def under(name: Column, prefix: Column) -> Column:
    """name is prefix or lies below it."""
    return (name == prefix) | name.startswith(F.concat(prefix, F.lit(".")))


def line_kind(line: Column) -> Column:
    text = F.regexp_replace(line, r"^\s+", "")
    return F.when(text == "", "blank").when(text.startswith("#"), "comment").otherwise("code")


def comment_body(line: Column) -> Column:
    """What follows the marks of a comment line, trimmed; null for other lines."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(text.startswith("#"), F.regexp_replace(F.regexp_replace(text, r"^#+", ""), r"^\s+", ""))


def _starts(words: list[str]) -> str:
    return "^(" + "|".join(re.escape(w).replace("\\ ", " ") for w in words) + ")"


def looks_like_code(body: Column) -> Column:
    """Whether a comment's text reads like a statement; few expressions, as whole-stage code has a size limit."""
    prose = body.endswith(".") | (F.size(F.split(body, r"\s+")) > 12)
    shaped = body.rlike(r"^[^ ]*:$| = |==|\(.*\)$|\\$")
    code = F.when(body.rlike(_starts(OPENERS)), ~body.startswith("from ") | body.contains(" import ")).otherwise(shaped)
    return (F.octet_length(body) >= 3) & ~body.rlike("(?i)" + _starts(DIRECTIVES)) & ~prose & code


def halstead_volume(words: Column) -> Column:
    """Length times the logarithm of the vocabulary; 0 for fewer than two kinds of words."""
    kinds = F.size(F.array_distinct(words))
    return F.when(kinds > 1, F.size(words) * F.log2(kinds.cast("double"))).otherwise(0.0)


def secret_mentions(text: Column) -> Column:
    """How often a text has one of the words that mark names of secrets."""
    return F.regexp_count(F.lower(text), F.lit("(" + "|".join(SECRET_WORDS) + ")"))


def maintainability(volume: Column, cyclomatic: Column, sloc: Column) -> Column:
    """0 to 100, unrounded; each part counts as 1 at least."""
    one = lambda c: F.greatest(c.cast("double"), F.lit(1.0))
    raw = F.lit(171.0) - F.lit(5.2) * F.log(one(volume)) - F.lit(0.23) * one(cyclomatic) - F.lit(16.2) * F.log(one(sloc))
    return F.least(F.greatest(raw * 100 / 171, F.lit(0.0)), F.lit(100.0))


def maintainability_rank(mi: Column) -> Column:
    return F.when(mi >= 20, "A").when(mi >= 10, "B").otherwise("C")


def lcom(uses: Column, attributes: Column, methods: Column) -> Column:
    """Henderson-Sellers lack of cohesion, clamped to 0..1; 0 where it isn't defined."""
    raw = (uses / attributes - methods) / (1 - methods)
    return F.when((attributes > 0) & (methods > 1), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
