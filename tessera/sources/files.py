"""Python files and notebooks of a project as a sources table."""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .facts import SOURCES

PRUNED = set(
    ".cache .eggs .git .hg .idea .ipynb_checkpoints .mypy_cache .nox .pytest_cache .ruff_cache .svn .tox .venv .vscode __pycache__ __pypackages__ build dist env eggs htmlcov node_modules site-packages target venv wheels".split()
)
SUFFIXES = (".py", ".ipynb")


def notebook_code(text: str) -> str | None:
    """The code cells of a notebook (format 4, or the worksheets of format 3) one below the other.

    Lines of a cell given as a list that start with % or ! are dropped; what isn't a notebook gives None.
    """
    try:
        book = json.loads(text)
    except ValueError:
        return None
    if not isinstance(book, dict):
        return None
    sheets = book.get("worksheets")
    cells = book.get("cells") if isinstance(book.get("cells"), list) else [c for s in sheets or [] if isinstance(s, dict) for c in s.get("cells") or []]
    out = []
    for cell in cells:
        if isinstance(cell, dict) and cell.get("cell_type") == "code":
            body = cell.get("source", cell.get("input"))
            if isinstance(body, list):
                body = "".join(x for x in body if isinstance(x, str) and not x.lstrip().startswith(("%", "!")))
            out.append(body if isinstance(body, str) else "")
    return "\n".join(out) + "\n" if out else ""


def decode(rel: str, data: bytes) -> str | None:
    """Text of a file; None where it isn't UTF-8 or its notebook can't be read."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return notebook_code(text) if rel.endswith(".ipynb") else text


class _Ignored:
    """The patterns of .gitignore files on the way down to a folder."""

    def __init__(self, rules: list[tuple[str, str, bool, bool]] = ()):
        self.rules = list(rules)

    def below(self, folder: Path, rel: str) -> _Ignored:
        at = folder / ".gitignore"
        if not at.is_file():
            return self
        new = []
        for line in at.read_text(errors="replace").splitlines():
            line = line.strip()
            if line and line[0] != "#":
                keep, only_dirs = line[0] == "!", line.endswith("/")
                new.append((rel, line.lstrip("!").rstrip("/"), keep, only_dirs))
        return _Ignored([*self.rules, *new])

    def hides(self, rel: str, is_dir: bool) -> bool:
        hidden = False
        for base, pattern, keep, only_dirs in self.rules:
            inner = rel[len(base) + 1 :] if base else rel
            anchored = "/" in pattern
            subject = inner if anchored else inner.rpartition("/")[2]
            if (is_dir or not only_dirs) and fnmatch.fnmatchcase(subject, pattern.lstrip("/").replace("**/", "*")):
                hidden = not keep
        return hidden


def discover(root: str, exclude: Iterable[str] = (), include: Iterable[str] = ()) -> list[str]:
    """Relative paths of *.py and *.ipynb, sorted. A folder with a pyvenv.cfg is never entered; the
    pruned names and `exclude` aren't unless named in `include`, which .gitignore doesn't hide either."""
    include, pruned, found, base = set(include), PRUNED | set(exclude), set(), Path(root)

    def walk(folder: Path, rel: str, ignored: _Ignored, free: bool, hidden: bool) -> None:
        """free: below an included folder. hidden: ignored, and only entered to look for included ones."""
        ignored = ignored.below(folder, rel)
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            at = f"{rel}/{entry.name}" if rel else entry.name
            if entry.is_dir(follow_symlinks=False):
                wanted = free or entry.name in include
                unseen = not wanted and (hidden or ignored.hides(at, True))
                if Path(entry.path, "pyvenv.cfg").exists() or not wanted and entry.name in pruned or unseen and not include:
                    continue
                walk(Path(entry.path), at, ignored, wanted, unseen)
            elif entry.name.endswith(SUFFIXES) and entry.is_file() and (free or not hidden and not ignored.hides(at, False)):
                found.add(at)

    walk(base, "", _Ignored(), False, False)
    return sorted(found)


def read_project(spark: SparkSession, root: str, project: str = "", exclude: Iterable[str] = (), include: Iterable[str] = ()) -> DataFrame:
    """Sources of one project on a path that all executors see: the driver lists names, tasks read files."""
    paths = discover(root, exclude, include)
    if not paths:
        return spark.createDataFrame([], SOURCES)
    at = spark.createDataFrame([(project, p) for p in paths], "project string, rel string").repartition(max(1, min(len(paths) // 50, 10_000)))

    def read(batches):
        for batch in batches:
            rows = batch.to_pylist()
            texts = []
            for r in rows:
                try:
                    texts.append(decode(r["rel"], Path(root, r["rel"]).read_bytes()))
                except OSError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("project"), batch.column("rel"), pa.array(texts, pa.string())], ["project", "rel", "src"])

    return at.mapInArrow(read, SOURCES).filter("src is not null")


def read_tree(spark: SparkSession, glob: str, project_depth: int) -> DataFrame:
    """Sources of many projects by Spark's own file listing, for corpora of any size.

    The first `project_depth` parts of a path (below its scheme and host) name the project.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,ipynb}").load(glob)
    parts = F.split(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), "/")
    kept = raw.select(F.array_join(F.slice(parts, 1, project_depth + 1), "/").alias("project"), F.array_join(F.slice(parts, project_depth + 2, 1000), "/").alias("rel"), "content")
    kept = kept.filter(~F.exists(F.split("rel", "/"), lambda p: p.isin(sorted(PRUNED))))

    def read(batches):
        for batch in batches:
            texts = [decode(r, c) for r, c in zip(batch.column("rel").to_pylist(), batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("project"), batch.column("rel"), pa.array(texts, pa.string())], ["project", "rel", "src"])

    return kept.mapInArrow(read, SOURCES).filter("src is not null")


def from_mapping(spark: SparkSession, files: dict[str, str], project: str = "") -> DataFrame:
    """Sources held in memory: path -> text (a notebook's raw JSON for .ipynb)."""
    rows = [(project, rel, decode(rel, text.encode("utf-8", "surrogatepass"))) for rel, text in files.items()]
    return spark.createDataFrame([r for r in rows if r[2] is not None], SOURCES)
