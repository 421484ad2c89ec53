"""Two small projects written for this repository: inputs of the analyzer queries and of tests."""

from __future__ import annotations

#: Names here are part of published identities; the text is our own.
SAMPLE = {
    "pyproject.toml": '[project]\nname = "billing"\nversion = "1.0"\ndependencies = ["fastapi", "requests", "rich"]\n',
    "billing/__init__.py": "",
    "billing/domain/__init__.py": "",
    "billing/services/__init__.py": "",
    "billing/domain/money.py": "class Money:\n    def __init__(self, cents):\n        self.cents = cents\n",
    "billing/services/ledger.py": "from billing.services.invoice import create_invoice\n\n\ndef post(line):\n    return create_invoice(line)\n",
    "billing/services/invoice.py": """from billing.services import ledger
from billing.domain.money import Money
import requests


def create_invoice(sum_):
    if sum_.cents > 100:
        if sum_.cents > 200:
            if sum_.cents > 300:
                for k in range(sum_.cents):
                    if k % 5 == 0:
                        if k % 7 == 0:
                            pass
    return {"cents": sum_.cents, "unit": "EUR"}
""",
    "billing/app.py": """import hashlib
import os
from billing.domain.money import Money
from billing.services.invoice import create_invoice


def password_hash(text):
    return hashlib.md5(text.encode()).hexdigest()


def _legacy_helper(n):
    tmp = n + 5
    return n


def start(cents: int) -> None:
    made = create_invoice(Money(cents))
    print(made)




if __name__ == "__main__":
    start(700)
""",
}

_SHARED = """

def tally{0}(rows: list) -> dict:
    totals = {{}}
    for row in rows:
        key = row["kind"]
        value = row["amount"] * row["rate"]
        if key not in totals:
            totals[key] = 0
        totals[key] += value
    return {{k: round(v, 2) for k, v in totals.items() if v > 0}}
"""

#: A project in which every rule has something to say.
LAB = {
    ".tesserarc.json": """{"architecture": {"layers": ["web", "core"]},
 "contracts": {"forbidden": [{"from": "lab.core", "to": ["lab.store"]}], "independent": [["lab.web", "lab.store"]]},
 "policies": [{"id": "no-pprint", "forbid_import": "pprint", "forbid_call": "pprint.pprint", "in_paths": ["core/"], "severity": "error"}]}""",
    "pyproject.toml": """[project]
name = "lab"
dependencies = ["numpy>=1.20,<1.22", "unusedlib", "pyyaml", "requests", "pycryptodome", "flask", "jinja2"]
[project.scripts]
lab = "lab.cli:run"
[dependency-groups]
dev = ["hypothesis"]
""",
    "requirements.txt": "numpy>=1.20,<1.22\noldlib==1.4.2\n",
    "lab/__init__.py": "from lab.core.model import Shape\nfrom lab.core.rules import Shape\n\n__all__ = [\"Shape\"]\n",
    "lab/cli.py": """from lab.core import model, rules
from lab.web import views


def run() -> None:
    print(model.Shape().area(), rules.Shape, views.show, model.Kind.ROUND)
""",
    "lab/core/__init__.py": "",
    "lab/core/model.py": """import enum
import pprint
from abc import ABC, abstractmethod
from typing import TYPE_CHECKING

from lab.web.views import show
from lab.store.disk import _secret, save
from lab.core.missing import gone
from other._impl import _hidden

if TYPE_CHECKING:
    import decimal


class Kind(enum.Enum):
    ROUND = 1
    SQUARE = 2


class _Token:
    pass


class Base(ABC):
    @abstractmethod
    def size(self, unit):
        ...


class Shape(Base):
    corners = 4

    def size(self, unit):
        return 1

    def area(self) -> int:
        return len([_secret, save, gone, _hidden, show])

    def unplanned(self) -> int:
        return 2


def leak(token: _Token) -> None:
    pprint.pprint(token)


# total = price * count
class Mixed:
    def one(self):
        return self.a

    def two(self):
        return self.b

    def three(self):
        return self.c


print(leak, Mixed().one(), Mixed().two(), Mixed().three(), Kind)
""",
    "lab/core/rules.py": """import math
import hypothesis
from lab.core.model import Base


class Shape(Base):
    def size(self, unit):
        return 2


def decide(a, b, unused_arg):
    spare = 1
    if a and b or a > 1 and b > 1:
        return 1
        print("never")
    for x in range(a):
        while b:
            if x:
                b -= 1
            elif b > 2 and x > 1:
                break
    try:
        return [y for y in range(a) if y]
    except ValueError:
        return 0


print(decide, Shape, hypothesis)
"""
    + _SHARED.format("_a")
    + "\n\nprint(tally_a)\n",
    "lab/store/__init__.py": "",
    "lab/store/disk.py": "_secret = 1\n\n\ndef save() -> int:\n    return 1\n\n\ndef _forgotten() -> int:\n    return 1\n" + _SHARED.format("_a") + "\n\nprint(tally_a)\n",
    "lab/web/__init__.py": "",
    "lab/web/views.py": """import undeclared_thing
from flask import Flask
from lab.store import disk

app = Flask("lab")


@app.route("/")
def show() -> str:
    return str(undeclared_thing) + str(disk)
""",
    "lab/orphan.py": "def lonely(x: int) -> int:\n    return x\n",
    "lab/risks.py": """import hashlib
import os
import pickle
import random
import ssl
import subprocess

import jinja2
import numpy
import requests
import yaml
from Crypto.Cipher import DES

api_key = "abcd1234"
value = eval(os.environ["X"])
loaded = yaml.load("a: 1")
thing = pickle.loads(b"")
subprocess.run("ls", shell=True)
context = ssl._create_unverified_context()
digest = hashlib.md5(b"")
cipher = DES.new(b"12345678")
die = random.randint(1, 6)
numpy.connection.execute("select " + value)
page = requests.get("http://localhost")
app = jinja2.Environment(autoescape=False)
app.run(debug=True)
try:
    pass
except Exception:
    pass
""",
    "other/__init__.py": "",
    "other/_impl.py": "_hidden = 1\n",
    "tests/test_model.py": "import hypothesis\n\n\ndef test_shape():\n    assert hypothesis\n",
}

#: A project with an environment: what only installed packages, suppressions and large packages bring about.
ENV = {
    "pyproject.toml": '[project]\nname = "env"\ndependencies = ["numpy>=1.20", "six"]\n[project.scripts]\nenv = "bulk.start:main"\n',
    "bulk/__init__.py": "",
    "bulk/start.py": "import numpy\nimport six\nimport attr\nimport json  # noqa: F401\nimport os  # tessera: ignore[unused-import]\nimport re\nfrom bulk import many\n\n\ndef main() -> None:\n    print(numpy, six, attr, many)\n",
    "bulk/many.py": "".join(f"def part{k}(value):\n    return value\n\n\n" for k in range(21)) + "def typed(value: int) -> int:\n    return value\n",
}
ENV_INSTALLED = [("numpy", "numpy", "1.21.2"), ("attr", "attrs", "23.1"), ("six", "six", "1.16")]

LAB_ADVISORIES = """{"schema": "1", "source": "own", "advisories": [
 {"id": "ADV-1", "package": "OldLib", "specs": ["<1.5"], "summary": "overflow", "aliases": ["CVE-2020-1"], "severity": "high"},
 {"id": "ADV-2", "package": "numpy", "specs": [">=1.21,<1.21.5"], "summary": "", "aliases": []},
 {"id": "ADV-3", "package": "flask", "specs": [], "summary": "all of them", "aliases": ["CVE-2021-9"]},
 {"id": "ADV-4", "package": "requests", "specs": [">=99"], "summary": "", "aliases": []}]}"""
LAB_COVERAGE = '{"files": {"lab/core/rules.py": {"executed_lines": [1, 2, 3, 6, 7, 11, 12, 13, 14]}}}'
LAB_CHURN = [("lab/core/rules.py", 5), ("lab/cli.py", 9)]
