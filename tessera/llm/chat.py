"""Chat formatting: a hidden Markov model recovers roles by Viterbi, then turns are rendered.

A conversation is read as a transcript of lines. A line's features are the speaker marker written at its
head, as in "User:" or "<|assistant|>", whether it opens a row of the table, and its length, closing mark, list or
code look and place. Hidden states are the roles. Emissions are the product of the features' frequencies by
role, transitions depend on whether the line opens a row or bears a marker; both are counted from rows whose role is
known, over a prior that a marker is right with probability MARKER. Viterbi's best path gives each line's role; in rows of
known role the path is bound to that role. Lines of one role that follow each other make one turn, and turns
are rendered canonically.

No text is lost: a written marker is taken off only in a row without a known role, and only where the path
gives its line the role that it names; elsewhere it is text like any other. Only blank lines at a turn's ends, and
the opening of control tags, "<|", which becomes "< |", change.

Defined results: a null or unknown role is no evidence, and the model decides; a null text counts
as empty; empty lines belong to the turn around them; a conversation without text has no turns and ''
as rendering; equal rows of one turn number count once, those without a number each; rows of one turn go by role, then
text, a null turn comes last; each row of a null conversation is a conversation of its own; ties between paths go to the
earlier of system, user, assistant. An empty table gives an empty result; without labelled rows the model is
the smoothed prior. Only the named columns are read. A conversation is one row of the result, so a task holds it whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_sample, table

ROLES = ("system", "user", "assistant")
NAMES = {
    **dict.fromkeys(("system", "instruction", "instructions", "context"), 0),
    **dict.fromkeys(("user", "human", "question", "q", "customer", "client", "prompter", "you"), 1),
    **dict.fromkeys(("assistant", "ai", "bot", "gpt", "model", "answer", "a", "agent", "chatbot"), 2),
}
MARKER, SEEN = 0.9999, 20  # a marker's probability to be right, and how many seen ones that prior counts as
_WORD = r"(system|instructions?|context|user|human|question|customer|client|prompter|assistant|ai|bot|gpt|model|answer|agent|chatbot)"
#: Brackets that match, a colon, or a heading that is the whole line; a single letter needs a colon.
_WRITTEN = re.compile(
    rf"^\s*(?:<\|{_WORD}\|>|<{_WORD}>|\[{_WORD}\]:?|\*\*{_WORD}(?::\*\*|\*\*:)|#{{1,4}}\s*{_WORD}:?\s*$|(?:#{{1,4}}\s*)?{_WORD}:|([qa]):)[ \t]*", re.IGNORECASE
)
_BLANK_ENDS = re.compile(r"\A(?:[^\S\n]*\n)+|\s+\Z|\A\s+\Z")
#: Sizes of the features: length class, closing mark, look, place in the conversation.
SIZES = (6, 4, 3, 3)


def line_features(line: str, index: int) -> tuple[int, int, int, int]:
    words = len(line.split())
    end = line.rstrip()[-1:]
    look = 1 if re.match(r"\s*(?:[-*•]|\d+[.)])\s", line) else 2 if line.startswith(("    ", "\t", "```", ">>>")) else 0
    return (0 if words == 0 else min(5, 1 + int(np.log2(words) / 1.7)), 1 if end == "?" else 2 if end in ".!" and end else 3 if end == ":" else 0, look, min(index, 2))


@dataclass(frozen=True)
class Line:
    text: str
    bare: str  # without its marker
    marker: int  # the role that is written at its head, or -1
    given: int  # the role of its row, or -1
    opens: int  # whether it opens a row

    @property
    def step(self) -> int:
        """Which transitions lead to it: within a row, to another row, or over a marker in a row of unknown role."""
        return 2 if self.marker >= 0 and self.given < 0 else self.opens


def split_lines(rows: list[tuple[str | None, str | None]]) -> list[Line]:
    """The lines of (role, text) rows."""
    out = []
    for role, text in rows:
        given = NAMES.get((role or "").strip().lower(), -1)
        for k, line in enumerate((text or "").split("\n")):
            written = _WRITTEN.match(line)
            marker = NAMES[next(g for g in written.groups() if g).lower()] if written else -1
            out.append(Line(line, line[written.end() :] if written else line, marker, given, int(k == 0)))
    return out


@dataclass
class ChatModel:
    start: np.ndarray  # [role]
    step: np.ndarray  # [kind of step, from, to]
    emit: list[np.ndarray]  # for each feature [role, value]
    marked: np.ndarray  # [role, marker + 1]

    def scores(self, lines: list[Line]) -> np.ndarray:
        """Log emission of each line by role."""
        out = np.zeros((len(lines), len(ROLES)))
        for i, line in enumerate(lines):
            for table_, value in zip(self.emit, line_features(line.bare, i)):
                out[i] += table_[:, value]
            out[i] += self.marked[:, line.marker + 1]
            if line.given >= 0:
                out[i, np.arange(len(ROLES)) != line.given] = -np.inf
        return out

    def viterbi(self, lines: list[Line]) -> list[int]:
        """The most probable roles."""
        if not lines:
            return []
        emit = self.scores(lines)
        best, back = self.start + emit[0], []
        for i in range(1, len(lines)):
            paths = best[:, None] + self.step[lines[i].step]
            back.append(paths.argmax(0))
            best = paths.max(0) + emit[i]
        path = [int(best.argmax())]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        return path[::-1]

    def turns(self, rows: list[tuple[str | None, str | None]]) -> list[tuple[str, str]]:
        """(role, text) turns of a conversation's (role, text) rows."""
        lines = split_lines(rows)
        roles = iter(self.viterbi([x for x in lines if x.text.strip()]))
        out: list[list] = []
        role = None
        for line in lines:
            if line.text.strip():
                role = next(roles)
            if role is None:
                continue
            if not out or out[-1][0] != role:
                out.append([role, []])
            out[-1][1].append(line.bare if line.given < 0 and line.marker == role else line.text)
        joined = [(ROLES[r], _BLANK_ENDS.sub("", "\n".join(t))) for r, t in out]
        return [t for t in joined if t[1]]

    def recovered(self, rows: list[tuple[str | None, str | None]]) -> tuple[int, int]:
        """Of the lines whose role is known, how many there are, and to how many the model gives it when all roles are withheld."""
        lines = [x for x in split_lines(rows) if x.text.strip()]
        known = np.array([x.given for x in lines], int)
        found = np.array(self.viterbi([replace(x, given=-1) for x in lines]), int)
        return int((known >= 0).sum()), int(((known >= 0) & (found == known)).sum())


def render(turns: list[tuple[str, str]]) -> str:
    """<|role|> text <|end|> by turn; the tags' opening is broken up within texts."""
    return "".join(f"<|{role}|>\n" + text.replace("<|", "< |") + "\n<|end|>\n" for role, text in turns)


def parse_transcript(text: str | None, model: ChatModel) -> list[tuple[str, str]]:
    """Turns of one raw transcript."""
    return model.turns([(None, text)])


def _conversations(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    row = F.struct(F.col(turn_col).isNull().alias("last"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = df.select(F.col(conv_col).alias("conv"), row.alias("row"))
    in_order = lambda c: F.transform(F.array_sort(c), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows")
    whole = rows.filter("conv is not null").groupBy("conv").agg(F.collect_list("row").alias("all"))
    numbered, other = F.array_distinct(F.filter("all", lambda r: ~r["last"])), F.filter("all", lambda r: r["last"])
    return whole.select("conv", in_order(F.concat(numbered, other))).union(rows.filter("conv is null").select("conv", in_order(F.array("row"))))


def train(conversations: DataFrame, max_conversations: int = 2_000, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> ChatModel:
    """Count the model from a bounded sample: about max_conversations by the id's hash, their rows of known role."""
    known = conversations.filter(F.col(conv_col).isNotNull())
    ids = bounded_sample(known.select(F.col(conv_col).alias("c")).distinct(), "c", max_conversations)
    sample = known.join(F.broadcast(ids), known[conv_col] == ids.c, "left_semi")  # at most about max_conversations ids
    got = _conversations(sample, conv_col, turn_col, role_col, text_col).orderBy("conv").select("rows").collect()
    n = len(ROLES)
    start, step, emit = np.ones(n), np.ones((3, n, n)), [np.ones((n, k)) for k in SIZES]
    step[0] += 20 * np.eye(n)  # a speaker seldom changes within a row
    marked = np.ones((n, 1 + n))
    marked[:, 1:] = SEEN * (np.full((n, n), (1 - MARKER) / (n - 1)) + (MARKER - (1 - MARKER) / (n - 1)) * np.eye(n))
    for (rows,) in got:
        before = None
        for i, line in enumerate(x for x in split_lines(rows) if x.text.strip()):
            if line.given >= 0:
                for table_, value in zip(emit, line_features(line.bare, i)):
                    table_[line.given, value] += 1
                marked[line.given, line.marker + 1] += 1
                if before is None:
                    start[line.given] += 1
                elif before >= 0:
                    step[line.opens, before, line.given] += 1
            before = line.given
    share = lambda t: np.log(t / t.sum(-1, keepdims=True))
    # How often a marker stands at all says nothing about the role: rows of a table seldom bear one, transcripts do.
    marked[:, 0] = 1
    marked[:, 1:] /= marked[:, 1:].sum(1, keepdims=True)
    return ChatModel(share(start), share(step), [share(t) for t in emit], np.log(marked))


def format_conversations(conversations: DataFrame, model: ChatModel, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, n_turns, roles, rendered, n_lines, n_recovered): a row for each conversation.

    n_lines counts the lines whose role the table gives, n_recovered those of them to which the model gives the same
    one from the texts alone, all roles withheld: what it would do for transcripts that name none.
    """

    def run(rows: pa.Array) -> pa.Array:
        talks = [[(r["role"], r["text"]) for r in c or []] for c in rows.to_pylist()]
        found, held = [model.turns(t) for t in talks], [model.recovered(t) for t in talks]
        number = lambda x: pa.array(list(x), pa.int32())
        return pa.StructArray.from_arrays(
            [number(len(t) for t in found), pa.array([[r for r, _ in t] for t in found], pa.list_(pa.string())), pa.array([render(t) for t in found], pa.string()), number(h[0] for h in held), number(h[1] for h in held)],
            ["n_turns", "roles", "rendered", "n_lines", "n_recovered"],
        )

    form = arrow_udf(run, "struct<n_turns: int, roles: array<string>, rendered: string, n_lines: int, n_recovered: int>")
    got = _conversations(conversations, conv_col, turn_col, role_col, text_col)
    return got.select(F.col("conv").alias(conv_col), form("rows").alias("f")).select(conv_col, "f.*")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return format_conversations(conversations, train(conversations))


def op1_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1_chat_format's result that follows from the table's own roles alone."""
    return op1_chat_format(spark, sf_dir).select("conv_id", "n_turns", "rendered")


OP1_RENDERED_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
runs AS (SELECT *, sum(CASE WHEN role = before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t WHERE trim(text, E' \t\r\n') <> '')),
turns AS (SELECT conv_id, run, min(role) AS role, string_agg(text, chr(10) ORDER BY turn, role, text) AS text FROM runs GROUP BY conv_id, run),
clean AS (SELECT conv_id, run, role, regexp_replace(regexp_replace(text, '\A(?:[ \t\r]*\n)+', ''), '\s+\z', '') AS text FROM turns)
SELECT c.conv_id, count(run)::INTEGER AS n_turns,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10), '' ORDER BY run), '') AS rendered
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN clean USING (conv_id) GROUP BY c.conv_id
"""
