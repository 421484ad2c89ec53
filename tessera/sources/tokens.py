"""The lexer of clone detection: comments and space go, literals are blinded, the rest stays as written.

One alternation does the work, so that scanning is linear and runs in the regex engine. It takes any
text, whether or not it's valid Python.
"""

from __future__ import annotations

import re

import regex

# Within a literal whole stretches of plain text are one step; a step for each character costs most of a long docstring's time.
_TEXT = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+(?:"""|\\?\Z)' r"|'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:'''|\\?\Z)" r'|"(?:[^"\\\n]++|\\[\s\S])*+(?:"|(?=\n)|\\?\Z)' r"|'(?:[^'\\\n]++|\\[\s\S])*+(?:'|(?=\n)|\\?\Z)"
_KINDS = rf"(?P<skip>\s++|\#[^\n]*+)|(?P<text>(?:[^\W\d]\w*+)?(?:{_TEXT}))|(?P<number>[0-9][0-9A-Za-z._]*+)|(?P<word>[^\W\d]\w*+)|(?P<sign>[\s\S])"
_LEXER = regex.compile(_KINDS)
_ASCII = re.compile(_KINDS, re.ASCII)  # faster, and the same as long as all outside of literals and comments is plain ASCII
_ODD = re.compile(r"[^\x00-\x1b\x20-\x7f]")


def clone_tokens(src: str) -> list[dict]:
    """{ord, norm, line} of each token; a literal over many lines lies on its first."""
    return _scanned(src, _ASCII) or _scanned(src, _LEXER)


def _scanned(src: str, lexer) -> list[dict] | None:
    """The tokens by one of the lexers; None where the faster one meets a sign that both may not take alike."""
    out: list[dict] = []
    line, fast = 1, lexer is _ASCII
    for m in lexer.finditer(src):
        kind, text = m.lastgroup, m.group()
        if kind == "sign" and fast and _ODD.match(text):
            return None
        if kind == "skip":
            line += text.count("\n")
        elif kind == "text":
            out.append({"ord": len(out), "norm": "STR", "line": line})
            line += text.count("\n")
        else:
            out.append({"ord": len(out), "norm": "NUM" if kind == "number" else text, "line": line})
    return out
