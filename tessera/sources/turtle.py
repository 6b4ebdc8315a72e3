"""Turtle files, read by blocks: statements are told apart first, then each is parsed by itself.

Only long strings reach over lines, so where a line stands in one is a state of three values. Each part of
the lines says what it makes of each state, these are put together over a file's parts, and a second pass knows for
every line whether a statement ends with it. The few directives of a file go to all its statements.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..operators.storage import materialize

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)"""
    r"""|(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w-]*:[\w-]+))?"""
    r"""|(?P<word>@prefix|@base|PREFIX|BASE)(?=\s)|(?P<blank>_:[\w.-]*[\w-])|(?P<name>[\w-]*:(?:[\w%-](?:[\w.%-]*[\w%-])?)?)"""
    r"""|(?P<value>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false)|(?P<a>a)(?=[\s<\[])|(?P<mark>[;,.\[\]()])""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\"}
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
Triple = tuple[str, str, str]


class _Statements:
    """Reads statements from tokens, by recursion for terms in brackets; blank(n) names the n-th unnamed node."""

    def __init__(self, text: str, prefixes: dict[str, str], base: str, blank: Callable[[int], str]):
        self.text, self.prefixes, self.base, self.blank = text, prefixes, base, blank
        self.made, self.out, self.tokens = 0, [], self._tokens()
        self._next()

    def _tokens(self) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m:
                raise ValueError(f"no Turtle at character {at}: {self.text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup:
                yield m.lastgroup, m[m.lastgroup]

    def _next(self) -> tuple[str, str]:
        now = getattr(self, "token", ("", ""))
        self.token = next(self.tokens, ("", ""))
        return now

    def _take(self, mark: str) -> None:
        if self.token != ("mark", mark):
            raise ValueError(f"{mark} is missing before {self.token[1]!r}")
        self._next()

    def _plain(self, kind: str, value: str) -> str:
        if kind == "iri":
            return value[1:-1] if ":" in value else self.base + value[1:-1]
        if kind == "name":
            prefix, _, rest = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"prefix {prefix}: is not declared")
            return self.prefixes[prefix] + rest
        if kind == "text":
            inner = value[3:-3] if value[:3] in ('"""', "\'\'\'") else value[1:-1]
            return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), inner, flags=re.S)
        return value

    def _new(self) -> str:
        self.made += 1
        return self.blank(self.made)

    def _term(self, kinds: tuple[str, ...]) -> str:
        kind, value = self._next()
        if kind != "mark" and kind in kinds:
            return self._plain(kind, value)
        if "mark" in kinds and value == "[":
            node = self._new()
            if self.token != ("mark", "]"):
                self._properties(node)
            self._take("]")
            return node
        if "mark" in kinds and value == "(":
            items = []
            while self.token != ("mark", ")"):
                items.append(self._term(("iri", "name", "blank", "text", "value", "mark")))
            self._next()
            nodes = [self._new() for _ in items]
            for i, (node, item) in enumerate(zip(nodes, items)):
                self.out.append((node, _RDF + "first", item))
                self.out.append((node, _RDF + "rest", nodes[i + 1] if i + 1 < len(nodes) else _RDF + "nil"))
            return nodes[0] if nodes else _RDF + "nil"
        raise ValueError(f"{value!r} is no term here")

    def _properties(self, subject: str) -> None:
        while True:
            predicate = _RDF + "type" if self.token[0] == "a" and self._next() else self._term(("iri", "name"))
            while True:
                here = len(self.out)
                found = self._term(("iri", "name", "blank", "text", "value", "mark"))
                self.out.insert(here, (subject, predicate, found))
                if self.token != ("mark", ","):
                    break
                self._next()
            if self.token != ("mark", ";"):
                return
            while self.token == ("mark", ";"):
                self._next()
            if self.token[1] in (".", "]", ""):
                return

    def read(self) -> Iterator[Triple]:
        while self.token[0]:
            if self.token[0] == "word":
                word = self._next()[1]
                if word.lower().endswith("prefix"):
                    prefix = self._next()[1]
                    self.prefixes[prefix[:-1]] = self._plain(*self._next())
                else:
                    self.base = self._next()[1][1:-1]
                if word.startswith("@"):
                    self._take(".")
                continue
            nested = self.token == ("mark", "[")
            subject = self._term(("iri", "name", "blank", "mark"))
            if not (nested and self.token == ("mark", ".")):
                self._properties(subject)
            self._take(".")
            yield from self.out
            self.out = []


def turtle_triples(text: str, prefixes: dict[str, str] | None = None, base: str = "", blank: Callable[[int], str] = "_:b{}".format) -> Iterator[Triple]:
    """Subject, predicate and object of statements: prefixes, `a`, `;` and `,` lists, nested unnamed nodes and collections.

    Literals are their text, without language or type. What does not fit raises an error.
    """
    return _Statements(text, dict(prefixes or {}), base, blank).read()


# --- which statement a line belongs to

_OPENERS = ('"""', "'''")
_SKIP = re.compile(r"""#[^\n]*|<[^<>"{}|^`\\\s]*>|\"\"\"|'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|\s+|.""", re.S)
_INSIDE = tuple(re.compile(rf"(?:\\.|(?!{q}).)*?{q}", re.S) for q in _OPENERS)


def line_state(line: str, state: int) -> tuple[int, bool]:
    """The state behind a line that begins in `state` (0 outside, 1 and 2 in a long string), and whether a full stop is its last token."""
    at, last = 0, ""
    while at < len(line):
        if state:
            m = _INSIDE[state - 1].match(line, at)
            if not m:
                return state, False
            at, state, last = m.end(), 0, "text"
            continue
        m = _SKIP.match(line, at)
        at, token = m.end(), m[0]
        if token in _OPENERS:
            state = _OPENERS.index(token) + 1
        elif not token.isspace() and not token.startswith("#"):
            last = token
    return state, state == 0 and last == "."


def _composed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each file's lines in a partition make of each state."""
    made: dict = {}
    for f in frames:
        for file, part, line in zip(f["file"], f["_part"], f["value"]):
            now = made.get((file, part), (0, 1, 2))
            made[file, part] = tuple(line_state(line, s)[0] for s in now)
    if made:
        yield pd.DataFrame([(*k, list(v)) for k, v in made.items()], columns=["file", "_part", "makes"])


def _ended(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now: dict = {}
    for f in frames:
        ends = []
        for file, begins, line in zip(f["file"], f["begins"], f["value"]):
            now[file], end = line_state(line, now.get(file, begins))
            ends.append(end)
        yield f[["file", "start", "row", "value"]].assign(ends=ends)


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, statement, text): texts of whole statements, numbered in order; directives without a full stop stay before the next one."""
    read = spark.read.text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value")
    placed = scan.dealt(materialize(lines), "file", ["start", "row"])
    makes = placed.mapInPandas(_composed, "file string, _part int, makes array<int>")
    parts = F.array_sort(F.collect_list(F.struct("_part", "makes")))
    step = lambda told, p: F.struct(F.concat(told["seen"], F.array(F.struct(p["_part"].alias("part"), told["state"].alias("begins")))).alias("seen"), F.element_at(p["makes"], told["state"] + 1).alias("state"))  # noqa: E731, E501
    first = F.struct(F.array().cast("array<struct<part:int,begins:int>>").alias("seen"), F.lit(0).alias("state"))
    told = makes.groupBy("file").agg(F.aggregate(parts, first, step)["seen"].alias("seen")).select("file", F.explode("seen").alias("x")).select("file", F.col("x.part").alias("_part"), "x.begins")
    # a row for each file and part; the parts' lines stay as they are, in order
    known = placed.join(F.broadcast(told), ["file", "_part"]).select("file", "start", "row", "value", "begins")
    ended = known.mapInPandas(_ended, "file string, start long, row long, value string, ends boolean")
    counted = scan.running_sum(ended, "file", ["start", "row"], F.col("ends").cast("long"), "_done")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "row", "value"))), lambda x: x["value"]), "\n")
    return counted.groupBy("file", (F.col("_done") - F.col("ends").cast("long")).alias("statement")).agg(text.alias("text"))


_DIRECTIVE = r"(?i)\A(?:\s+|#[^\n]*\n)*((?:@?(?:prefix|base)\s[^<]*<[^>]*>(?:\s*\.)?(?:\s+|#[^\n]*(?:\n|\z))*)+)"


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of Turtle files, each read by as many tasks as it has blocks.

    A statement is a task's smallest piece of work. Directives are collected first and hold for the statements behind them; there are
    few of them, and every statement of the file sees them. Unnamed nodes are named by their statement.
    """
    found = materialize(statements(spark, path))
    said = F.regexp_extract("text", _DIRECTIVE, 1)
    directives = found.where(F.trim(said) != "").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("statement", said.alias("said")))).alias("directives"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[Triple] = []
            for name, number, text, before in zip(f["name"], f["statement"], f["text"], f["directives"]):
                known = _Statements("\n".join(d["said"] for d in (before if before is not None else ()) if d["statement"] < number), {}, "", str)
                list(known.read())
                out += turtle_triples(text, known.prefixes, known.base, lambda i, name=name, number=number: f"_:{name}-{number}-{i}")
            yield pd.DataFrame(out, columns=["s", "p", "o"], dtype="object")

    name = F.substring(F.md5(F.col("file").cast("binary")), 1, 8)
    rows = found.join(directives, "file", "left").select(name.alias("name"), "statement", "text", "directives")
    return rows.mapInPandas(run, "s string, p string, o string")
